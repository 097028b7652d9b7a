"""Sync and mirror runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from opstrail.operators import filesync as ops
from opstrail.operators import known, ranges as parts
from opstrail.session import remove_folder, work_dir
from opstrail.sources.files import list_files, list_prefix


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes one copy task should move.
TASK_BYTES = 128 << 20


def _spread(files: DataFrame) -> DataFrame:
    """A listing dealt out to tasks of about ``TASK_BYTES``, and to every core if there is less.

    Listings are small however much they stand for, so adaptive execution
    would merge them into one task after a shuffle; a fixed number stays.
    """
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, (total.bytes or 0) // TASK_BYTES)
    return files.repartition(max(1, min(total.n, tasks)))


def sync_run(
    spark: SparkSession,
    source: str,
    dest: str,
    state: str,
    log: str | None = None,
    pattern: str = "",
    skip_ext: str = "",
    checksum: bool = True,
    recursive: bool = False,
    now: datetime | None = None,
) -> DataFrame:
    """Copy files whose content is new, remember it, log the run; returns outcomes.

    The hashed listing and the copy outcomes are written tables, so each file
    is hashed once and copied once whatever reads them afterwards. The state is asked by
    prefix and filter, see ``operators.known``: a run reads what its files' hashes need. Of new
    files with equal content the one with the smallest path is copied.
    A recursive run keeps each file's path below ``source``, so files of one
    base name do not meet. ``checksum=False`` copies everything and leaves the
    state alone. State and log must lie outside ``source``. The run's working
    tables are deleted once it has logged, all but the outcomes it returns.
    """
    run = work_dir(spark, "sync")
    files = list_files(spark, source, pattern, skip_ext, recursive)
    if checksum:
        hashed = _written(ops.fingerprint(files), f"{run}/hashed")
        maybe = _written(known.maybe_known(spark, hashed, state), f"{run}/maybe")
        new = ops.one_per_content(ops.pending_files(hashed, known.known_among(spark, hashed, state, maybe)))
        files = _spread(_written(new, f"{run}/new"))
    copied = _written(ops.copy_files(files, dest), f"{run}/copied")
    if checksum:
        known.append_known(copied.where("ok"), state)
    if log:
        ops.append_run_log(copied, log, run.rpartition("-")[2], now)
    if checksum:
        for name in ("hashed", "maybe", "new"):
            remove_folder(spark, f"{run}/{name}")
    return copied


def copy_by_ranges(
    files: DataFrame,
    dest: str,
    range_bytes: int = parts.RANGE_BYTES,
    leaf_bytes: int = parts.LEAF_BYTES,
) -> DataFrame:
    """Copy listed files range by range: ``(path, name, ok, error, bytes, tree)`` per file.

    One large file is read and written by as many tasks as it has ranges, up to a
    wave of tasks of ``TASK_BYTES``. Ranges are a written table before files get their
    names, so a lost executor repeats a range and no file appears half done. ``dest``
    takes writes at a position; ``copy_files`` serves object stores.
    """
    spark = files.sparkSession
    run = work_dir(spark, "ranges")
    listed = _written(parts.byte_ranges(files, range_bytes, leaf_bytes), f"{run}/listed")
    total = listed.agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes")).first()
    wanted = max(spark.sparkContext.defaultParallelism, (total.bytes or 0) // TASK_BYTES)
    dealt = parts.spread_ranges(listed, max(1, min(total.n, wanted)))
    mark = run.rpartition("-")[2]
    copied = _written(parts.copy_ranges(dealt, dest, mark, leaf_bytes), f"{run}/copied")
    shown = _written(parts.finish_copies(copied, dest, mark), f"{run}/shown")
    for name in ("listed", "copied"):
        remove_folder(spark, f"{run}/{name}")
    return shown


def mirror_prefix(spark: SparkSession, root: str, prefix: str, dest: str) -> DataFrame:
    """Copy every object below a key prefix, keeping the rest of its key as the path."""
    run = work_dir(spark, "mirror")
    return _written(ops.copy_files(list_prefix(spark, root, prefix), dest), f"{run}/copied")
