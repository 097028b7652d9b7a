"""Content-addressed incremental file sync."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

from opstrail import tasks
from opstrail.operators.matching import with_keys, without_keys


def content_hash(c: Column) -> Column:
    """SHA-256 of a column, lower-case hex."""
    return F.sha2(c.cast("binary"), 256)


def fingerprint(files: DataFrame) -> DataFrame:
    """Adds ``sha256`` of the first ``length`` bytes of each listed file.

    Files are streamed in chunks where they are listed; no content enters a row.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())])
    return files.mapInArrow(tasks.digest_files, schema)


def merged_state(state: DataFrame, hashes: DataFrame) -> DataFrame:
    """State and new hashes without repeats, for compaction into a new folder."""
    return state.select("sha256").unionByName(hashes.select("sha256")).dropDuplicates()


def pending_files(hashed: DataFrame, state: DataFrame, max_keys: int | None = None) -> DataFrame:
    """Rows whose content is not in the state."""
    return without_keys(hashed, state, "sha256", max_keys)


def synced_files(hashed: DataFrame, state: DataFrame, max_keys: int | None = None) -> DataFrame:
    """Rows whose content is in the state."""
    return with_keys(hashed, state, "sha256", max_keys)


def one_per_content(files: DataFrame) -> DataFrame:
    """One row per hash, the smallest path, with ``copies``, the number of files alike."""
    rest = [c for c in files.columns if c != "sha256"]
    return (
        files.groupBy("sha256")
        .agg(
            F.min_by(F.struct(*rest), "path").alias("first"), F.count(F.lit(1)).alias("copies")
        )
        .select("first.*", "sha256", "copies")
    )


def copy_files(files: DataFrame, dest: str) -> DataFrame:
    """Copy ``path`` to ``dest/name`` on executors: ``(path, name, ok, error, bytes, sha256)``.

    Exactly ``length`` bytes are copied, as listed, even if a log has grown
    since. A file appears under its name only when complete, so a repeated
    task does no harm. ``sha256`` is that of the bytes copied. The copy runs
    whenever the result is evaluated: write the result, then use what was
    written.
    """
    return files.select("path", "name", "length").mapInArrow(
        tasks.copy_to(dest.rstrip("/")),
        "path string, name string, ok boolean, error string, bytes long, sha256 string",
    )


def _stamp(finished_at: datetime | None) -> Column:
    at = (finished_at or datetime.now(timezone.utc)).timestamp()
    return F.timestamp_micros(F.lit(int(at * 1_000_000))).alias("finished_at")


def run_log_files(copied: DataFrame, run_id: str, finished_at: datetime | None = None) -> DataFrame:
    """One row per file of a run: ``(run_id, finished_at, path, ok, error)``."""
    return copied.select(F.lit(run_id).alias("run_id"), _stamp(finished_at), "path", "ok", "error")


def run_log(copied: DataFrame, run_id: str, finished_at: datetime | None = None) -> DataFrame:
    """One row per run, idle or not: ``(run_id, finished_at, n_files, n_failed, ok)``."""
    return copied.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("ok")).alias("n_failed")
    ).select(
        F.lit(run_id).alias("run_id"),
        _stamp(finished_at),
        "n_files",
        "n_failed",
        (F.col("n_failed") == 0).alias("ok"),
    )


def append_run_log(
    copied: DataFrame, dest: str, run_id: str, finished_at: datetime | None = None
) -> None:
    """Append a run as JSON lines: its files below ``dest/files``, then itself below ``dest/runs``."""
    finished_at = finished_at or datetime.now(timezone.utc)
    run_log_files(copied, run_id, finished_at).write.mode("append").json(f"{dest}/files")
    run_log(copied, run_id, finished_at).write.mode("append").json(f"{dest}/runs")
