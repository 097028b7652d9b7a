"""Database tables as export sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Size of a quantile sketch: ranks are right within about 1 in 700.
SKETCH = 1024


def list_tables(spark: SparkSession, db: str | None = None, like: str | None = None) -> DataFrame:
    """Tables and views of a catalog database as ``(table_name, is_temporary)``."""
    text = "SHOW TABLES" + (f" IN `{db}`" if db else "")
    if like:
        text += " LIKE '" + like.replace("'", "\\'") + "'"
    return spark.sql(text).select(
        F.col("tableName").alias("table_name"), F.col("isTemporary").alias("is_temporary")
    )


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options of a JDBC scan, split over ``partitions`` ranges of a column."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def key_cuts(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Where ``ranges`` ranges of a whole-number key begin, but for the first, each with about as many rows.

    The key's quantiles come from sketches that tasks make of their rows and Spark merges;
    no row is moved. Keys with more rows than a range leave fewer ranges, as no cut can
    split a key. Null keys are not counted.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    sketch = F.kll_sketch_agg_bigint(F.col(key).cast("bigint"), F.lit(SKETCH))
    # A sketch of no keys has no quantiles.
    cuts = F.when(F.count(key) > 0, F.kll_sketch_get_quantile_bigint(sketch, shares))
    found = df.agg(cuts.alias("cuts")).first()["cuts"] if ranges > 1 else None
    return sorted(set(found or []))


def cut_predicates(column: str, cuts: list[int]) -> list[str]:
    """SQL conditions of the ranges between cuts: every row meets one, null keys the first."""
    name = f"{column}"
    if not cuts:
        return ["1 = 1"]
    inner = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{name} < {cuts[0]} OR {name} IS NULL", *inner, f"{name} >= {cuts[-1]}"]


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of the range a key lies in, from 0; found by halving, null keys in the first."""
    if not cuts:
        return F.lit(0).cast("bigint")

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("bigint")
        mid = (low + high) // 2
        return F.when(key >= cuts[mid], find(mid + 1, high)).otherwise(find(low, mid))

    return find(0, len(cuts))


def jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, ranges: int, **properties: str) -> DataFrame:
    """A JDBC scan in ranges of a key with about as many rows each; no bounds need be known.

    The key column alone is read first, by one task, for its quantiles."""
    keys = spark.read.format("jdbc").options(**jdbc_options(url, f"(SELECT {key} FROM {table}) keys", **properties)).load()
    predicates = cut_predicates(key, key_cuts(keys, keys.columns[0], ranges))
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def read_table(spark: SparkSession, name: str, fmt: str = "table", **options) -> DataFrame:
    """A full table scan: a catalog table, files of a format, or ``fmt="jdbc"``.

    ``options`` for JDBC are those of ``jdbc_options`` after ``table``.
    """
    if fmt == "table":
        return spark.table(name)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(table=name, **options)).load()
    return spark.read.format(fmt).options(**options).load(name)
