"""All rows of a table in order, with their numbers: pages of any depth read what they show.

The rows are dealt by ranges of the order, sorted in each, and written with their place in it, a folder for each range. A range's
first number follows from the counts of those before, which are as many as there are ranges. No window over all rows is needed,
and a page, or what follows a given row, reads the ranges that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Ordered:
    """df in the order of columns by (name, ascending), nulls first where ascending; ties are as the ranges hold them.

    folder is new, and shared by all executors.
    """

    def __init__(self, df: DataFrame, by: list[tuple[str, bool]], folder: str, ranges: int | None = None):
        self.by, self.columns, self.spark = by, df.columns, df.sparkSession
        order = [F.col(c).asc() if up else F.col(c).desc() for c, up in by]
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        # the number of the task and the place in it, after the sort
        made = dealt.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
        made.withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id").write.partitionBy("_range").parquet(folder)
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, _place long, _range int"
        self.all = self.spark.read.schema(schema).parquet(folder)
        last = F.max_by(F.struct(*(c for c, _ in by)), "_place").alias("last")
        found = self.all.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), last).collect()  # a row for each range
        self.ranges, self.count = [], 0
        for r in sorted(found, key=lambda r: r["_range"]):
            self.ranges.append((r["_range"], self.count, r.n, tuple(r.last)))
            self.count += r.n

    def _of(self, ranges: list[tuple]) -> DataFrame:
        rows = self.all.where(F.col("_range").isin([r[0] for r in ranges]))
        before = F.lit(0).cast("long")
        for number, n, _, _ in ranges:
            before = F.when(F.col("_range") == number, F.lit(n).cast("long")).otherwise(before)
        return rows.withColumn("_n", before + F.col("_place") + 1)

    def rows(self, name: str = "n") -> DataFrame:
        """All rows with their numbers from 1, in no order themselves."""
        before = self.spark.createDataFrame([(r, b) for r, b, _, _ in self.ranges], "_range int, _before long")
        joined = self.all.join(F.broadcast(before), "_range")
        return joined.select(*self.columns, (F.col("_before") + F.col("_place") + 1).alias(name))

    def page(self, number: int, size: int, name: str = "n") -> DataFrame:
        """Page number (from 1) of size rows, in order."""
        lo, hi = (number - 1) * size, number * size
        held = [r for r in self.ranges if r[1] < hi and r[1] + r[2] > lo]
        return self._of(held).where(F.col("_n").between(lo + 1, hi)).orderBy("_n").select(*self.columns, F.col("_n").alias(name))

    def after(self, last: tuple, size: int, name: str = "n") -> DataFrame:
        """The size rows that follow the one with these values of by."""
        begun = [k for k, r in enumerate(self.ranges) if self._beyond(r[3], last)]
        held, some = [], 0
        for r in self.ranges[begun[0] :] if begun else []:
            held.append(r)
            some += r[2]
            if some - held[0][2] >= size:  # of the first range, none may follow
                break
        return self._of(held).where(self._follows(last)).orderBy("_n").limit(size).select(*self.columns, F.col("_n").alias(name))

    def _beyond(self, a: tuple, b: tuple) -> bool:
        """Whether values a come after b."""
        for (_, up), x, y in zip(self.by, a, b, strict=True):
            if x != y:
                return (x is not None and (y is None or x > y)) if up else (x is None or (y is not None and x < y))
        return False

    def _follows(self, last: tuple) -> Column:
        out = F.lit(False)
        for (c, up), v in reversed(list(zip(self.by, last, strict=True))):
            x, y = F.col(c), F.lit(v)
            more = F.coalesce(x > y, x.isNotNull()) if up else F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = x.isNotNull() if up and v is None else more
            more = (F.lit(False) if v is None else x.isNull() | (x < y)) if not up else more
            out = more | (x.eqNullSafe(y) & out)
        return out


def watched(scored: DataFrame, name: str = "funnel") -> tuple[DataFrame, object]:
    """scored and an observation of its funnel, which the action that reads scored fills: no pass of its own.

    observation.get has raw, candidates, noise and found after that.
    """
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = {"raw": F.count(F.lit(1)), "candidates": F.count_if(F.col("score") > 0), "noise": F.count_if(F.col("score") <= 0), "found": F.count_if("is_share")}
    return scored.observe(seen, *(c.alias(n) for n, c in counts.items())), seen
