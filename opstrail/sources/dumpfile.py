"""Lines of dump files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opstrail.sources.files import first_lines, read_lines


def read_dump_lines(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """Lines of plain or gzip dump files with their order inside the file."""
    return read_lines(spark, paths, "\n", recursive=recursive)


def read_dump_heads(spark: SparkSession, paths, having: str, recursive: bool = False) -> DataFrame:
    """The first line of each dump in which ``having`` is found; reading a dump ends there.

    A dump without such a line is read whole, by one task."""
    return first_lines(spark, paths, having, recursive)
