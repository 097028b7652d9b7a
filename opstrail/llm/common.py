"""What the operators of this subpackage share: words, working tables, input columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.session import work_dir

#: A word is a run of anything but these six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared work folder: lineage ends here, on disk."""
    return kept(spark, df, label)[0]


def kept(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``stored`` with the folder's path, for those who remove it when they are done."""
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(whole(text), SPACES, -1), "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores behind it, so that no column of ``df`` clashes."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def batches_for(spark: SparkSession, size: int, each: int, least: int = 8) -> int:
    """How many parts of about ``each`` bytes (or words) make ``size``."""
    return max(least, math.ceil(size / each))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
