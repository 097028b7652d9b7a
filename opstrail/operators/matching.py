"""Semi and anti joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key list this long is at most a few megabytes, so it may be broadcast.
BROADCAST_KEYS = 10_000
# A key is hot from this share of all rows on, so there are at most 1 / share hot keys.
HOT_SHARE = 0.001
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys holding at least ``HOT_SHARE`` of the rows and ``HOT_ROWS`` of them.

    Counting combines map-side, and by arithmetic there are at most
    ``1 / HOT_SHARE`` such keys, however large the input.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) * HOT_SHARE).alias("n")).scalar()
    return counts.where((F.col("n") >= HOT_ROWS) & (F.col("n") >= total)).select(key)


def _matched(df: DataFrame, keys: DataFrame, key: str, how: str, max_keys: int | None) -> DataFrame:
    keys = keys.select(key).distinct()
    if max_keys is not None and max_keys <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), key, how)
    # Salts come from the row itself, so a task that runs again deals its rows alike.
    slices = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # At most 1 / HOT_SHARE rows, see hot_keys.
    hot = F.broadcast(hot_keys(df, key).withColumn("is_hot", F.lit(True)))
    is_hot = F.coalesce("is_hot", F.lit(False))
    salted = df.join(hot, key, "left").withColumn(
        "salt",
        F.when(is_hot, F.pmod(F.xxhash64(*df.columns), F.lit(slices))).otherwise(0),
    )
    last = F.when(is_hot, slices - 1).otherwise(0).cast("long")
    spread = keys.join(hot, key, "left").select(
        key, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("salt")
    )
    return salted.join(spread, [key, "salt"], how).select(df.columns)


def with_keys(df: DataFrame, keys: DataFrame, key: str, max_keys: int | None = None) -> DataFrame:
    """Rows whose key is listed (left semi).

    ``max_keys`` is an upper bound on the listed keys known to the caller; up
    to ``BROADCAST_KEYS`` the list is broadcast. Otherwise the join is
    shuffled, with the rows of hot keys spread over all partitions. ``df`` is
    then read twice, so hand in a table rather than a costly plan.
    """
    return _matched(df, keys, key, "left_semi", max_keys)


def without_keys(df: DataFrame, keys: DataFrame, key: str, max_keys: int | None = None) -> DataFrame:
    """Rows whose key is not listed (left anti). See ``with_keys``."""
    return _matched(df, keys, key, "left_anti", max_keys)
