"""Slow-query log scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opstrail.sources.files import read_lines, scan_lines

# Fixed value: a line starting like this opens a record.
RECORD_SEPARATOR = "\n# Time"


def read_slowlog(
    spark: SparkSession,
    paths,
    pattern: str = "",
    recursive: bool = False,
    sniff: bool = True,
) -> DataFrame:
    """Raw records of a log file, of every file in a directory, or of several of either.

    ``pattern`` is a glob on file names; it does not apply to a path that is
    itself a file.
    """
    return read_lines(spark, paths, RECORD_SEPARATOR, pattern, recursive, sniff)


def scan_slowlog(spark: SparkSession, paths, pattern: str = "", recursive: bool = False) -> tuple[DataFrame, int | None]:
    """``read_slowlog`` and the number of files it is planned over, where known."""
    return scan_lines(spark, paths, RECORD_SEPARATOR, pattern, recursive)
