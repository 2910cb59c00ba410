"""Stored tables: a log of commits, each over several tables.

Data files are written first, in folders that nobody reads yet. A commit then puts one file, the state of all tables, under the
next number of the log, if no other writer has: it is there as a whole or not at all, so a stop at any step leaves the version
before. The latest version is the largest number in the log; there is no pointer to lose. A writer whose number is taken goes on
behind the other one, unless that changed a table which this one has read or changed (Conflict).

A table is a base and a few changes, each a folder of rows by key with a mark for those that are gone: a change writes its own rows and
no others. Changes are folded together when they are FOLDED, and into a new base when they hold more than one in SHARE of its rows.
Rows need a key; older versions stay readable.
"""

from __future__ import annotations

import copy
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import store as rules

FOLDED, SHARE = 16, 4


class Conflict(Exception):
    """Another writer has changed what this one has read or changed."""


class Store:
    """Tables by name in a folder: schemas and keys are the caller's. Set up once; later starts find what is there."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, str] | None = None):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self.keys = {name: "id" for name in schemas} | (keys or {})
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self.version():
            self.put(1, {"changed": [], "tables": {name: {"base": None, "rows": 0, "changes": []} for name in schemas}})  # whoever is first, it's the same

    def version(self) -> int:
        """The latest complete commit, 0 before the first."""
        log = self.path(f"{self.folder}/_log")
        names = [x.getPath().getName() for x in self.fs.listStatus(log)] if self.fs.exists(log) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def state(self, version: int) -> dict:
        found = self.fs.open(self.path(f"{self.folder}/_log/{version:010d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()

    def put(self, version: int, state: dict) -> bool:
        """Whether the version was free, and is now this state."""
        new, to = self.path(f"{self.folder}/_log/.{uuid.uuid4().hex}"), self.path(f"{self.folder}/_log/{version:010d}")
        out = self.fs.create(new, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a local rename would replace, a link doesn't
                file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(file(self.fs.makeQualified(to)), file(self.fs.makeQualified(new)))
            else:
                option = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
                option[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, to, option)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.fs.delete(new, False)
        return True

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.rows(name, self.state(version or self.version())["tables"][name])

    def rows(self, name: str, table: dict) -> DataFrame:
        """A table's rows: the base without what was changed, and the last change of each key."""
        schema, key = self.schemas[name], self.keys[name]
        base = self.spark.read.schema(schema).parquet(f"{self.folder}/{table['base']}") if table["base"] else self.spark.createDataFrame([], schema)
        if not table["changes"]:
            return base
        last = self.changes(name, table)
        return base.join(last.select(key), key, "left_anti").select(*base.columns).unionByName(last.where("NOT _gone").select(*base.columns))

    def changes(self, name: str, table: dict) -> DataFrame:
        """The last change of each key, with its mark."""
        schema, key, every = self.schemas[name] + ", _gone boolean", self.keys[name], None
        for k, (folder, _) in enumerate(table["changes"]):
            one = self.spark.read.schema(schema).parquet(f"{self.folder}/{folder}").withColumn("_k", F.lit(k))
            every = one if every is None else every.unionByName(one)
        if len(table["changes"]) == 1:
            return every.drop("_k")
        rest = [c for c in every.columns if c not in (key, "_k")]
        return every.groupBy(key).agg(F.max_by(F.struct(*rest), "_k").alias("_x")).select(key, "_x.*")

    def begin(self) -> Batch:
        return Batch(self)


class Batch:
    """Changes of several tables that are committed together. What it reads has its own changes in it."""

    def __init__(self, store: Store):
        self.store, self.seen = store, store.version()
        self.tables = store.state(self.seen)["tables"]
        self.used: set[str] = set()
        self.changed: set[str] = set()

    def read(self, name: str) -> DataFrame:
        self.used.add(name)
        return self.store.rows(name, self.tables[name])

    def _write(self, name: str, df: DataFrame) -> tuple[str, int]:
        folder, key = f"data/{name}-{uuid.uuid4().hex}", self.store.keys[name]
        refused = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row of {name} has no {key}"))).otherwise(F.col(key))
        df.withColumn(key, refused).write.parquet(f"{self.store.folder}/{folder}")
        return folder, self.store.spark.read.parquet(f"{self.store.folder}/{folder}").count()

    def _columns(self, name: str) -> list[str]:
        return self.store.spark.createDataFrame([], self.store.schemas[name]).columns

    def replace(self, name: str, df: DataFrame) -> None:
        """The whole table, whose keys are distinct."""
        base, rows = self._write(name, df.select(*self._columns(name)))
        self.tables[name] = {"base": base, "rows": rows, "changes": []}
        self.changed.add(name)

    def change(self, name: str, df: DataFrame) -> None:
        """Rows that are new or take the place of those with their key, which are distinct in df."""
        self._add(name, df.select(*self._columns(name), F.lit(False).alias("_gone")))

    def remove(self, name: str, keys: DataFrame) -> None:
        """The rows with these keys go."""
        key = self.store.keys[name]
        schema = {f.name: f.dataType for f in self.store.spark.createDataFrame([], self.store.schemas[name]).schema}
        self._add(name, keys.select(key).distinct().select(*(F.col(c) if c == key else F.lit(None).cast(kind).alias(c) for c, kind in schema.items()), F.lit(True).alias("_gone")))

    def _add(self, name: str, df: DataFrame) -> None:
        self.used.add(name)
        self.changed.add(name)
        folder, rows = self._write(name, df)
        table = self.tables[name]
        if not rows:
            return
        table["changes"].append([folder, rows])
        if sum(n for _, n in table["changes"]) * SHARE > table["rows"]:
            self.replace(name, self.store.rows(name, table))
        elif len(table["changes"]) >= FOLDED:
            table["changes"] = [list(self._write(name, self.store.changes(name, table)))]

    # --- the changes of operators/store.py, of touched rows only ---
    def upsert(self, name: str, batch: DataFrame, now: Column) -> None:
        old = self.read(name).join(batch.select("id").distinct(), "id", "left_semi")
        self.change(name, rules.upsert(old, batch, now).drop("op"))

    def insert_or_ignore(self, name: str, batch: DataFrame) -> None:
        self.change(name, rules.insert_or_ignore(self.read(name), batch))

    def expire(self, name: str, now: Column, hours: int = 72) -> None:
        old = self.read(name).where("is_active")
        self.change(name, rules.expired(old, now, hours).where("NOT is_active"))

    def commit(self) -> int:
        """The version that the changes are in."""
        state = {"changed": sorted(self.changed), "tables": self.tables}
        while not self.store.put(self.seen + 1, state):
            other = self.store.state(self.seen + 1)
            if set(other["changed"]) & (self.used | self.changed):
                raise Conflict(f"version {self.seen + 1} changed {', '.join(other['changed'])}")
            self.seen += 1
            state["tables"] = copy.deepcopy(other["tables"]) | {name: self.tables[name] for name in self.changed}
        return self.seen + 1


class Snapshots:
    """One table without keys, written as a whole each time."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.store = Store(spark, folder, {"rows": schema})

    def version(self) -> int:
        return self.store.version()

    def read(self) -> DataFrame:
        return self.store.read("rows")

    def write(self, df: DataFrame) -> int:
        batch = self.store.begin()
        batch.tables["rows"] = {"base": (folder := f"data/rows-{uuid.uuid4().hex}"), "rows": 0, "changes": []}
        df.write.parquet(f"{self.store.folder}/{folder}")
        batch.changed.add("rows")
        return batch.commit()
