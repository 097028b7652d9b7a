"""Point-in-time restore as one job: a dump and the log after it in, plan and table out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from opstrail.functions.paths import base_name, log_number
from opstrail.operators import changelog as ops
from opstrail.session import work_dir
from opstrail.sources.dumpfile import read_dump_heads


class Restore(NamedTuple):
    """Where replay starts (one row), its steps, their command texts and the restored table."""

    start: DataFrame
    plan: DataFrame
    commands: DataFrame
    table: DataFrame


def start_of(spark: SparkSession, dump) -> DataFrame:
    """``(log_file, log_seq, log_pos)`` a dump was taken at, one row.

    The dump is read up to its coordinates; the row is kept as a table, since several steps
    use it. A dump without coordinates, or with a position that is out of
    range, raises here.
    """
    at = ops.one_coordinate(read_dump_heads(spark, dump, ops.COORDINATES)).select(
        "log_file", log_number(base_name(F.col("log_file"))).alias("log_seq"), "log_pos"
    )
    path = f"{work_dir(spark, 'restore')}/start"
    at.write.parquet(path)
    return spark.read.schema(at.schema).parquet(path)


def restore_job(
    spark: SparkSession,
    dump,
    files: DataFrame,
    events: DataFrame,
    base: DataFrame,
    keys: list[str],
    stop: str | None = None,
) -> Restore:
    """Restore ``base``, the table as dumped, to ``stop`` (UTC text) or to the end of the log.

    ``files`` lists the log files (``name`` or ``path``), ``events`` are the
    decoded changes. The stop is looked for from the dump's log file on, so
    earlier logs that are still there do not matter. Coordinates enter every
    step as scalar subqueries over one row.
    """
    start = start_of(spark, dump)
    log_file, log_seq, log_pos = (start.select(c).scalar() for c in ("log_file", "log_seq", "log_pos"))
    later = events.where(F.col("log_seq") >= log_seq)
    end = ops.stop_coordinate(later, stop) if stop is not None else None
    plan = ops.replay_plan(ops.log_sequence(files, log_file), log_pos, end)
    window = ops.replay_window(events, log_seq, log_pos, stop)
    return Restore(start, plan, ops.replay_commands(plan), ops.restore_table(base, window, keys))
