"""Decoded change-log events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from opstrail import tasks
from opstrail.functions.paths import base_name, log_number


#: Folders of a written log, at most, and rows from which a folder has another file, up to 8.
FOLDERS, FILE_ROWS = 256, 1_000_000
#: Fixed value: the folder column of a log with more numbers than folders.
LAST_SEQ = "log_seq_to"


def write_changelog(events: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Events with a folder per log number, so that a start coordinate leaves earlier folders unread.

    A log of more than about ``folders`` numbers has a folder per range of them instead, named by
    its last number: neither folders nor files grow with the number of logs. Rows lie there in order
    of number, so that files give away which parts of a range come before a start.
    """
    rows = events if "log_seq" in events.columns else events.withColumn("log_seq", log_number(base_name(F.col("log_file"))))
    seq = F.col("log_seq")
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(seq).alias("logs"), F.min(seq).alias("first"), F.max(seq).alias("last")
    ).first()
    by = "log_seq"
    if size["logs"] > folders:
        width, first = -(-(size["last"] - size["first"] + 1) // folders), size["first"]
        rows = rows.withColumn(LAST_SEQ, seq + (width - 1 - F.pmod(seq - first, F.lit(width))))
        by = LAST_SEQ
    # A number's events are spread over tasks, as one log may hold most of them.
    files = max(1, min(8, -(-size["n"] // FILE_ROWS)))
    # A fixed number of tasks: adaptive execution would see little data and have few tasks open all files.
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, F.col(by), F.pmod(F.xxhash64("log_pos"), F.lit(files)))
    dealt.sortWithinPartitions(*dict.fromkeys([by, "log_seq"])).write.partitionBy(by).parquet(path)


def later_logs(spark: SparkSession, paths, start: str) -> list[str]:
    """The files of a folder of logs from log ``start`` on, by number; files without one are left out.

    Their list is made before any is opened: earlier ones take no part in the plan."""
    least = _number(start)
    found = tasks.list_inputs([paths] if isinstance(paths, str) else list(paths), False)
    kept = [p for p, _ in found if _number(p) >= max(least, 1)]
    if not kept:
        raise ValueError(f"no log from {start} on in {paths}")
    return kept


def _number(name: str) -> int:
    """``functions.log_number`` of a name at hand, before an ending such as ``.parquet``."""
    base = name.rsplit("/", 1)[-1].removesuffix(".parquet").removesuffix(".json")
    head, _, digits = base.partition(".")
    return int(digits) if re.fullmatch(r"[0-9]+", digits) else 0


def read_changelog(spark: SparkSession, paths, fmt: str = "parquet", schema=None, start: str | None = None) -> DataFrame:
    """Events with their place in the log: ``log_file``, ``log_seq``, ``log_pos``, ``event_ts``.

    ``log_file`` falls back to the name of the file an event is read from, and
    ``log_seq`` to the number in that name. ``log_pos`` is the end offset of
    the event. The index file of a log is never read as events. With ``start``, a log's
    name, files of earlier numbers are not read. Folders of ``write_changelog`` are told by
    a filter on ``log_seq`` alone, also one whose value the query finds; those of ranges by
    ``operators.changelog.after_start``.
    """
    if start is not None:
        paths = later_logs(spark, paths, start)
    reader = spark.read.format(fmt)
    events = (reader.schema(schema) if schema else reader).load(paths)
    events = events.where(~F.col("_metadata.file_name").endswith(".index"))
    if "log_file" not in events.columns:
        events = events.withColumn("log_file", F.col("_metadata.file_name"))
    if "log_seq" not in events.columns:
        events = events.withColumn("log_seq", log_number(base_name(F.col("log_file"))))
    elif LAST_SEQ in events.columns:  # typed as folders of numbers are
        events = events.withColumn("log_seq", F.col("log_seq").cast(events.schema[LAST_SEQ].dataType))
    return events
