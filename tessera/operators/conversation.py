"""What a chat remembers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which a user's messages are cut down.
SALTS = 32

def last_messages(df: DataFrame, n: int = 10, user: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each user. Spark turns the filter on the place into a partial top-n of each group."""
    w = Window.partitionBy(user).orderBy(F.desc(turn))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest_users(df: DataFrame, n: int = 100, user: str = "conv_id", first: str = "first_turn") -> DataFrame:
    """Messages of the n users that came last; the ones inserted before them are forgotten. One row a user, then a top-n."""
    users = df.groupBy(user).agg(F.min(first).alias("_first")).orderBy(F.desc("_first"), F.desc(user)).limit(n)
    return df.join(F.broadcast(users.select(user)), user, "left_semi")


def within_budget(df: DataFrame, chars: int = 8000, least: int = 2, user: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Each user's newest messages that hold chars characters together, and least messages at any rate. Of one turn, shorter texts come first.

    No more than chars + 1 texts with characters decide, so a user's messages are cut down in SALTS parts first, and the rest meet in one window
    of a bounded size; any number of empty texts may follow, which are told by the turn that goes beyond.
    """
    bound, order = chars + least + 1, [F.desc_nulls_last(turn), F.asc("_size")]
    sized = df.withColumn("_size", F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    part = Window.partitionBy(F.col(user), F.pmod(F.xxhash64(turn, text), F.lit(SALTS)), F.col("_size") > 0).orderBy(*order)
    cut = sized.withColumn("_n", F.row_number().over(part))
    w = Window.partitionBy(user).orderBy(*order)
    near = cut.where(F.col("_n") <= bound).withColumns({"_n": F.row_number().over(w), "_sum": F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    beyond = near.groupBy(F.col(user).alias("_user")).agg(F.max(F.when(F.col("_sum") > chars, F.col(turn))).alias("_beyond"))
    far = cut.where((F.col("_n") > bound) & (F.col("_size") == 0)).join(beyond, F.col(user).eqNullSafe(F.col("_user")))
    near = near.where((F.col("_sum") <= chars) | (F.col("_n") <= least))
    return near.select(*df.columns).unionByName(far.where(F.col("_beyond").isNull() | (F.col(turn) >= F.col("_beyond"))).select(*df.columns))
