"""Per-user throttling: an event passes if the user's last passed one is at least limit seconds ago.

What was refused doesn't move the limit, so this is a fold over each user's events and not a comparison of neighbours.
In a stream the state is one time a user; in a batch, cells of a user's time are folded side by side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SECONDS_KEPT = 3600
#: Limits in a cell of a user's time.
CELL = 64


def throttled(events: DataFrame, limit: float = 1.0, user: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """events with allowed, in a batch. Ties in time go by key; an event without a time passes and is no user's last one.

    A user's time is cut into cells of CELL limits, which are dealt over all tasks, so a user with most of the events is many groups.
    Each cell tells, for every time from which events pass again, the last event that it then lets pass (steps); a fold over
    a user's cells, which time bounds and not events, gives each the last passed one before it; then each cell is folded from there.
    """
    us, t = int(limit * 1_000_000), F.unix_micros(F.col(ts).cast("timestamp"))
    columns = [key, *(c for c in events.columns if c != key)]
    if us <= 0:
        return events.select(*columns, F.lit(True).alias("allowed"))
    # what has no time is dealt over cells by its key
    timed = events.withColumn("_t", t).withColumn("_cell", F.coalesce(F.floor(F.col("_t") / F.lit(us * CELL)).cast("long"), F.xxhash64(key)))
    cell, kind = Window.partitionBy(user, "_cell"), events.schema[user].dataType.simpleString()
    first = lambda w: (F.row_number().over(w) == 1).alias("_new")
    steps_of = f"`{user}` {kind}, _cell long, upto array<long>, leaves array<long>"
    steps = timed.where(F.col("_t").isNotNull()).select(user, "_cell", "_t", first(cell.orderBy("_t"))).mapInArrow(lambda it: all_steps(it, us), steps_of)
    before = steps.select("*", first(Window.partitionBy(user).orderBy("_cell"))).mapInArrow(lambda it: cells_before(it, us), f"`{user}` {kind}, _cell long, _last long")
    # a cell's state is a row of its own, before those with a time
    mixed = timed.withColumns({"_last": F.lit(None).cast("long"), "_event": F.lit(True)}).unionByName(before.withColumn("_event", F.lit(False)), allowMissingColumns=True)
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    ordered = mixed.select(*events.columns, "_last", "_t", "_event", F.row_number().over(cell.orderBy(F.asc_nulls_first("_t"), ts, key)).alias("_place"))
    return ordered.mapInArrow(lambda it: passed(it, us, schema.names), schema).select(*columns, "allowed")


def steps_in(times: np.ndarray, begins: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted times of cells, which begin at these places: how many steps each has; for each step, up to which time events may pass again for the last passed one to be the same, and that one.

    The last one before a cell is older than the cell, so only what comes in its first limit, and the event after, can pass first.
    All cells are followed at once: on one line, each at a distance that a limit doesn't bridge.
    """
    span, sizes = limit * CELL, np.diff(np.append(begins, len(times)))
    cell, off = np.repeat(np.arange(len(begins)), sizes), times % span
    line, end = off + cell * (2 * span), np.repeat(begins + sizes, sizes)
    early = off < limit
    after = ~early
    after[1:] &= early[:-1] | (cell[1:] != cell[:-1])
    first = np.flatnonzero(early | after)
    at, alive = first.copy(), np.arange(len(first))
    while len(alive):
        then = np.searchsorted(line, line[at[alive]] + limit)
        on = then < end[at[alive]]
        alive = alive[on]
        at[alive] = then[on]
    leaves, own = times[at], cell[first]
    last = np.append((leaves[1:] != leaves[:-1]) | (own[1:] != own[:-1]), True)
    return np.bincount(own[last], minlength=len(begins)), times[first][last], leaves[last]


def all_steps(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """user, cell, upto and leaves of each cell from sorted rows of user, cell, time and whether a cell begins. A cell's times are held together."""
    whose, held = [], [np.zeros(0, np.int64)]

    def made(begins: np.ndarray) -> pa.RecordBatch:
        own = pa.Table.from_batches(whose).combine_chunks().to_batches()[0]
        counts, upto, leaves = steps_in(np.concatenate(held), begins, limit)
        ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        return pa.RecordBatch.from_arrays([*own.columns, *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (upto, leaves))], names=[*own.schema.names, "upto", "leaves"])

    for b in batches:
        times, starts = b.column(2).to_numpy(), np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
        if not len(starts):
            held.append(times)
            continue
        before, owners = sum(map(len, held)), b.select([0, 1])
        begins = np.append(np.zeros(len(whose), np.int64), before + starts[:-1])
        held.append(times[: starts[-1]])
        whose.append(owners.take(pa.array(starts[:-1])))
        if len(begins):
            yield made(begins)
        whose, held = [owners.slice(starts[-1], 1)], [times[starts[-1] :]]
    if whose:
        yield made(np.zeros(1, np.int64))


def cells_before(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """user, cell and the last passed event before it, from each user's cells in order."""
    last = None
    for b in batches:
        out = []
        for upto, leaves, new in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            last = None if new else last
            out.append(last)
            at = 0 if last is None else bisect_left(upto, last + limit)
            last = leaves[at] if at < len(leaves) else last
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=[b.schema.names[0], "_cell", "_last"])


def passed(batches: Iterator[pa.RecordBatch], limit: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Events with allowed, from each cell's rows in order: first those without a time, of which the one that is no event has the last passed event before."""
    last = None
    for b in batches:
        allowed, n = [], b.num_columns - 4
        for before, at, event in zip(*(b.column(n + k).to_pylist() for k in range(3)), strict=True):
            if at is None:
                last = last if event else before
                allowed.append(True)
                continue
            ok = last is None or at - last >= limit
            last = at if ok else last
            allowed.append(ok)
        yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(allowed, pa.bool_())], names=names).filter(b.column(n + 2))


class Throttle(StatefulProcessor):
    """A user's last passed event, in microseconds, which goes after a time without one."""

    def __init__(self, limit_us: int, kept: int, user: str, ts: str, key: str):
        self.limit, self.kept, self.names = limit_us, kept, (user, ts, key)

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "at long", ttlDurationMs=self.kept * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        user, ts, name = self.names
        last = self.last.get()[0] if self.last.exists() else None
        df, allowed = pd.concat(list(rows)).sort_values([ts, name]), []
        for t in df[ts].tolist():
            ok = last is None or t - last >= self.limit
            last = t if ok else last
            allowed.append(ok)
        self.last.update((last,))
        yield pd.DataFrame({user: key[0], name: df[name].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, limit: float = 1.0, user: str = "user_id", ts: str = "ts", key: str = "event_id", kept: int = SECONDS_KEPT) -> DataFrame:
    """The same on a stream: user, key and allowed. A user's state goes after kept seconds without a change to it.

    The state is in RocksDB, so it isn't bounded by memory; a batch of a user's events is sorted by itself.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = {c: events.schema[c].dataType.simpleString() for c in (user, key)}
    timed = events.select(user, key, F.unix_micros(F.col(ts).cast("timestamp")).alias(ts))
    return timed.groupBy(user).transformWithStateInPandas(Throttle(int(limit * 1_000_000), kept, user, ts, key), f"{user} {kind[user]}, {key} {kind[key]}, allowed boolean", "Append", "ProcessingTime")


def forgotten(events: DataFrame, now, seconds: int = SECONDS_KEPT, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Users with their last event, without those that are older than seconds at now."""
    return events.groupBy(user).agg(F.max(ts).alias("last_seen")).where(F.timestamp_diff("SECOND", F.col("last_seen"), now) <= seconds)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events and their value by type and window of time; on a stream, late ones wait for the watermark. (An extension.)"""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", user: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Sessions of each user, which end gap after their last event: start, end, n and total value. An event that is delivered again counts once.

    On a stream a session is returned when the watermark has passed its end; events older than the watermark are dropped, and copies are told for late after an event.
    """
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
    found = once.groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
