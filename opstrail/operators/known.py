"""Known content hashes by prefix, with a Bloom filter for each prefix.

A state folder has ``hashes`` and ``filter``, both partitioned by the first ``PREFIX`` hex
digits of a hash. A filter is ``BITS`` bits, kept as bitmaps of 32,768 of them; a hash sets
``PROBES`` bits, taken from its own digits, as SHA-256 is random enough. Runs append, and
bitmaps of several runs are joined by OR when read.

Asking whether hashes are known reads the filters of their prefixes alone. A hash with a
bit missing is new for certain; of the others the state's prefixes are read and
compared in full. Filters are written before hashes, so a run that stops in between
leaves bits too many, which only costs a second look. A filter that fills up costs more
second looks and is never wrong.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opstrail.operators.matching import with_keys

PREFIX = 2
BITS = 1 << 20
PROBES = 6
HASHES = "sha256 string, prefix string"
FILTER = "bucket bigint, bits binary, prefix string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A part of a state; one that does not exist yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def prefix_of(sha256: Column) -> Column:
    return F.substring(sha256, 1, PREFIX)


def probes(hashes: DataFrame) -> DataFrame:
    """(sha256, prefix, bucket, bit): the bits that each hash sets in its prefix's filter."""
    digits = [F.conv(F.substring("sha256", PREFIX + 1 + 8 * i, 8), 16, 10).cast("bigint") % BITS for i in range(PROBES)]
    at = hashes.select("sha256", prefix_of(F.col("sha256")).alias("prefix"), F.explode(F.array(*digits)).alias("at"))
    return at.select("sha256", "prefix", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))


def append_known(hashes: DataFrame, state: str) -> None:
    """Add hashes (sha256) to a state: filter bits first, then the hashes.

    A run writes up to a file for each prefix of both, however few its hashes; the number of
    tasks is fixed, as adaptive execution would take the hashes for little and leave all files to one.
    """
    dealt = min(hashes.sparkSession.sparkContext.defaultParallelism, 16**PREFIX)
    once = hashes.select("sha256").where("sha256 IS NOT NULL").distinct()
    bits = probes(once).groupBy("prefix", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits.repartition(dealt, "prefix").write.mode("append").partitionBy("prefix").parquet(f"{state}/filter")
    rows = once.withColumn("prefix", prefix_of(F.col("sha256")))
    rows.repartition(dealt, "prefix").write.mode("append").partitionBy("prefix").parquet(f"{state}/hashes")


def read_known(spark: SparkSession, state: str) -> DataFrame:
    """All hashes of a state: (sha256, prefix)."""
    return _table(spark, f"{state}/hashes", HASHES)


def reset_known(spark: SparkSession, state: str) -> None:
    """Forget all hashes: filters last, so that nothing is missed if this stops in between."""
    for name in ("hashes", "filter"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _only(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """The folders of some prefixes, chosen when the query is planned."""
    return df.where(F.col("prefix").isin(prefixes))


def _prefixes(hashes: DataFrame) -> list[str]:
    """At most 16 ** PREFIX of them."""
    return sorted(r.prefix for r in hashes.select(prefix_of(F.col("sha256")).alias("prefix")).distinct().collect() if r.prefix)


def maybe_known(spark: SparkSession, hashes: DataFrame, state: str) -> DataFrame:
    """(sha256) of hashes whose bits are all set: every known one, and few others."""
    asked = hashes.select("sha256").where("sha256 IS NOT NULL").distinct()
    filters = _only(_table(spark, f"{state}/filter", FILTER), _prefixes(hashes))
    whole = filters.groupBy("prefix", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = probes(asked).join(whole, ["prefix", "bucket"])
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.where(is_set).groupBy("sha256").agg(F.count("*").alias("n")).where(F.col("n") == PROBES).select("sha256")


def known_among(spark: SparkSession, hashes: DataFrame, state: str, maybe: DataFrame | None = None) -> DataFrame:
    """(sha256) of the hashes that a state holds. ``hashes`` is read several times: hand in a table.

    Only prefixes of hashes that may be known are read. ``maybe`` is ``maybe_known`` as a
    table, if the caller has written it."""
    maybe = maybe_known(spark, hashes, state) if maybe is None else maybe
    near = _prefixes(maybe)
    if not near:
        return maybe.where("false")
    return with_keys(maybe, _only(read_known(spark, state), near), "sha256")
