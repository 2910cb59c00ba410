"""A source that is given filters: landed listings as a data source of Spark, whose scan takes what the portal's search takes.

A portal's search has parameters for some filters (requests.py). Spark hands the scan all filters of a query; those that the
portal has a parameter for stay in the scan, as the request that would be sent and as conditions on the landed files,
whose statistics leave out row groups; the others go back to Spark. Files are Parquet, one partition of the scan each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tessera.sources.requests import REQUESTS

SCHEMA = "id string, title string, url string, price double, area double, city string"
#: What a filter on a column is called, by its kind.
NAMES = {("price", GreaterThanOrEqual): "price_min", ("price", LessThanOrEqual): "price_max", ("area", GreaterThanOrEqual): "area_min", ("area", LessThanOrEqual): "area_max", ("city", EqualTo): "city"}
#: Strict bounds are asked for as bounds, and made strict by Spark.
LOOSE = {GreaterThan: GreaterThanOrEqual, LessThan: LessThanOrEqual}
CONDITIONS = {"price_min": lambda v: pc.field("price") >= v, "price_max": lambda v: pc.field("price") <= v, "area_min": lambda v: pc.field("area") >= v, "area_max": lambda v: pc.field("area") <= v, "city": lambda v: pc.field("city") == v}


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class ListingReader(DataSourceReader):
    def __init__(self, path: str, portal: str):
        self.path, self.portal, self.asked = path, portal, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Those that the portal's search can't do, or does loosely."""
        takes = {name for name, _ in REQUESTS[self.portal].filters}
        given = {f.attribute[0] for f in filters if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)}
        for f in filters:
            if isinstance(f, IsNotNull):
                if f.attribute[0] not in given:
                    yield f
                continue
            name = NAMES.get((f.attribute[0], LOOSE.get(type(f), type(f)))) if len(getattr(f, "attribute", ())) == 1 else None
            if name not in takes or name in self.asked:
                yield f
                continue
            self.asked[name] = f.value
            if type(f) in LOOSE:
                yield f

    def request(self, keyword: str = "") -> str:
        """The address that the portal would be asked with."""
        r, text = REQUESTS[self.portal], {k: f"{v:g}" if isinstance(v, float) else str(v) for k, v in self.asked.items()}
        pairs = [(r.keyword, keyword), *r.fixed, *((parameter, text[name]) for name, parameter in r.filters if name in text)]
        return r.url + "?" + "&".join(f"{k}={quote(v, safe='').replace('%20', '+')}" for k, v in pairs)

    def partitions(self) -> list[InputPartition]:
        fs, at = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return [File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith(".parquet")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        where = None
        for name, value in self.asked.items():
            where = CONDITIONS[name](value) if where is None else where & CONDITIONS[name](value)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in ds.dataset(partition.value, filesystem=fs, format="parquet").to_batches(columns=names, filter=where):
            if b.num_rows:
                yield b


class LandedListings(DataSource):
    """Options: path, a folder of Parquet files of SCHEMA, and portal."""

    @classmethod
    def name(cls) -> str:
        return "landed_listings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ListingReader:
        return ListingReader(self.options["path"], self.options["portal"])


def search(spark: SparkSession, path: str, portal: str, where: Column | str) -> DataFrame:
    """A portal's landed listings that fit where, of which the scan takes what the portal's search has.

    Spark keeps what one query gave a frame's scan for the next one that gives it nothing. So each search has a scan of its own, and filters
    on the result stay above it: they don't pass a condition that isn't deterministic.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedListings)
    found = spark.read.format("landed_listings").option("portal", portal).load(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return found.where(where).where(F.rand() >= 0)
