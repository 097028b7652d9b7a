"""Exports: one extract to several destinations, SQL scripts, batches of jobs."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opstrail.errors import error_text
from opstrail.functions.paths import dest_name
from opstrail.operators import literals
from opstrail.sources.tables import list_tables, read_table

MAX_PARALLEL = 10
SCRIPT_PART = re.compile(r"1-header|2-structure|4-footer|3-[0-9]{6}-.*-(1-open|2-rows|3-close)", re.S)

# Session settings around a script, in the order they are written.
SCRIPT_HEADER = [
    "/*!40101 SET @OLD_CHARACTER_SET_CLIENT=@@CHARACTER_SET_CLIENT */;",
    "/*!40101 SET @OLD_CHARACTER_SET_RESULTS=@@CHARACTER_SET_RESULTS */;",
    "/*!40101 SET @OLD_COLLATION_CONNECTION=@@COLLATION_CONNECTION */;",
    "/*!40101 SET NAMES utf8mb4 */;",
    "/*!40014 SET @OLD_UNIQUE_CHECKS=@@UNIQUE_CHECKS, UNIQUE_CHECKS=0 */;",
    "/*!40014 SET @OLD_FOREIGN_KEY_CHECKS=@@FOREIGN_KEY_CHECKS, FOREIGN_KEY_CHECKS=0 */;",
    "/*!40101 SET @OLD_SQL_MODE=@@SQL_MODE, SQL_MODE='NO_AUTO_VALUE_ON_ZERO' */;",
    "/*!40111 SET @OLD_SQL_NOTES=@@SQL_NOTES, SQL_NOTES=0 */;",
]
SCRIPT_FOOTER = [
    "/*!40101 SET SQL_MODE=@OLD_SQL_MODE */;",
    "/*!40014 SET FOREIGN_KEY_CHECKS=@OLD_FOREIGN_KEY_CHECKS */;",
    "/*!40014 SET UNIQUE_CHECKS=@OLD_UNIQUE_CHECKS */;",
    "/*!40101 SET CHARACTER_SET_CLIENT=@OLD_CHARACTER_SET_CLIENT */;",
    "/*!40101 SET CHARACTER_SET_RESULTS=@OLD_CHARACTER_SET_RESULTS */;",
    "/*!40101 SET COLLATION_CONNECTION=@OLD_COLLATION_CONNECTION */;",
    "/*!40111 SET SQL_NOTES=@OLD_SQL_NOTES */;",
]


@dataclass(frozen=True)
class Destination:
    """A folder to write and its format: rows as ``json``, ``orc`` or ``parquet``, INSERT
    statements as ``text``, or a whole SQL ``script``."""

    path: str
    fmt: str = "parquet"


@dataclass(frozen=True)
class ExportJob:
    """One export. ``driver`` is a source format (``table``, ``parquet``, ``jdbc``, …) and
    ``dsn`` what it reads, with ``options``; ``table`` is the name used in SQL text, and
    ``dump`` says how that text is made: ``batch_rows``, ``batch_by``, ``source_types``,
    ``lossless``, ``parity``, and for scripts ``database``, ``locks`` and ``drop``."""

    name: str
    driver: str
    dsn: str
    destinations: list[Destination] = field(default_factory=list)
    table: str = ""
    gzip: bool = False
    unique: bool = False
    options: dict = field(default_factory=dict)
    dump: dict = field(default_factory=dict)


def _write_file(df: DataFrame, path: str, fmt: str, gzip: bool) -> None:
    writer = df.write.mode("overwrite")
    if gzip:
        writer = writer.option("compression", "zlib" if fmt == "orc" else "gzip")
    writer.format(fmt).save(path)


# Sinks by format: DataFrame, path, format, gzip.
SINKS: dict[str, Callable[[DataFrame, str, str, bool], None]] = {
    fmt: _write_file for fmt in ("parquet", "orc", "json", "text")
}
# Formats that give back exactly what was written come first as the copy others are fed from.
COPY_ORDER = ["parquet", "orc", "text", "json"]


def export(
    df: DataFrame,
    dest: Destination,
    gzip: bool = False,
    unique: bool = False,
    now: datetime | None = None,
) -> str:
    """Write an extract; returns the folder written."""
    if dest.fmt not in SINKS:
        raise ValueError(f"unsupported format: {dest.fmt}")
    path = dest_name(dest.path, gzip, unique, now)
    SINKS[dest.fmt](df, path, dest.fmt, gzip)
    return path


def _outcome(dest: Destination, action: Callable[[], str]) -> tuple[str, str, bool, str]:
    try:
        return dest.path, action(), True, ""
    except Exception as problem:  # one destination must not stop the others
        return dest.path, "", False, error_text(problem)


def export_many(
    df: DataFrame,
    destinations: list[Destination],
    gzip: bool = False,
    unique: bool = False,
    now: datetime | None = None,
    max_parallel: int = MAX_PARALLEL,
) -> DataFrame:
    """One extract to every destination: ``(dest, path, ok, error)`` per destination.

    The extract runs for the first destination that takes it. The others are
    fed in parallel from what was written there, which also survives the loss
    of executors.
    """
    spark = df.sparkSession
    waiting = sorted(
        destinations,
        key=lambda d: COPY_ORDER.index(d.fmt) if d.fmt in COPY_ORDER else len(COPY_ORDER),
    )
    outcomes = []
    while waiting:
        first = waiting.pop(0)
        outcomes.append(_outcome(first, lambda: export(df, first, gzip, unique, now)))
        if outcomes[-1][2]:
            break
    if waiting:
        copy = spark.read.schema(df.schema).format(first.fmt).load(outcomes[-1][1])

        @inheritable_thread_target(spark)
        def feed(dest: Destination):
            return _outcome(dest, lambda: export(copy, dest, gzip, unique, now))

        with ThreadPoolExecutor(max_parallel) as pool:
            outcomes += pool.map(feed, waiting)
    return spark.createDataFrame(outcomes, "dest string, path string, ok boolean, error string")


def _write_lines(spark: SparkSession, lines: list[str], path: str, gzip: bool) -> None:
    df = spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
    _write_file(df, path, "text", gzip)


def _clear_script(spark: SparkSession, dest: str) -> None:
    """Remove the parts of a script; a folder that holds anything else is refused."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(dest)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return
    parts = [x.getPath() for x in fs.listStatus(folder)]
    strange = [p.getName() for p in parts if not SCRIPT_PART.fullmatch(p.getName())]
    if strange:
        raise ValueError(f"{dest} holds more than a script: {strange[0]}")
    for part in parts:
        fs.delete(part, True)


def export_sql(
    tables: dict[str, DataFrame],
    dest: str,
    database: str = "",
    batch_rows: int = 1000,
    batch_by: dict[str, tuple[str, int]] | None = None,
    locks: bool = True,
    drop: bool = True,
    gzip: bool = False,
    **literal_options,
) -> str:
    """A SQL script as a folder whose parts, in name order, are the script.

    Header, definitions of all tables, rows table by table, footer; without
    tables, header and footer. The rows of a table are written by many tasks; a
    table without rows writes neither statements nor locks. Types are checked
    before anything is written, and parts of an earlier script are removed.
    """
    spark = SparkSession.active()
    types = literal_options.get("source_types") or {}
    ddl = [s for name, df in tables.items() for s in literals.table_ddl(df.schema, name, drop, types)]
    inserts = {
        name: literals.insert_statements(
            df, name, batch_rows, (batch_by or {}).get(name), **literal_options
        )
        for name, df in tables.items()
    }
    _clear_script(spark, dest)
    _write_lines(spark, [f"-- Database: {database}", *SCRIPT_HEADER], f"{dest}/1-header", gzip)
    if ddl:
        _write_lines(spark, ddl, f"{dest}/2-structure", gzip)
    for i, (name, statements) in enumerate(inserts.items()):
        if tables[name].isEmpty():
            continue
        part = f"{dest}/3-{i:06d}-{name}"
        before, after = literals.insert_frame(name, locks)
        _write_lines(spark, before, f"{part}-1-open", gzip)
        _write_file(statements.select("statement"), f"{part}-2-rows", "text", gzip)
        _write_lines(spark, after, f"{part}-3-close", gzip)
    _write_lines(spark, SCRIPT_FOOTER, f"{dest}/4-footer", gzip)
    return dest


def export_database(
    spark: SparkSession, dest: str, db: str | None = None, like: str | None = None, **options
) -> str:
    """``export_sql`` of every table of a catalog database, by name."""
    # Table names only: a driver-side list, as long as the catalog listing.
    names = sorted(row.table_name for row in list_tables(spark, db, like).collect())
    prefix = f"`{db}`." if db else ""
    tables = {n: read_table(spark, f"{prefix}`{n}`") for n in names}
    return export_sql(tables, dest, database=db or "", **options)


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a script folder with the part each one is in."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    part = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*)/[^/]*\z", 1)
    return lines.select(part.alias("part"), "value")


# What a job without one of these is told, in the order looked at.
REQUIRED = {
    "name": "job name is required",
    "dsn": "database dsn is required",
    "driver": "database driver is required",
}
HOMELESS = "job %s has no destination"


def job_faults(jobs: DataFrame) -> DataFrame:
    """Adds ``fault`` to rows ``(name, dsn, driver, n_destinations)``: the first one of a job, or NULL."""

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""

    homeless = F.format_string(HOMELESS, "name")
    fault = F.when(F.coalesce("n_destinations", F.lit(0)) == 0, homeless)
    for name, text in reversed(REQUIRED.items()):
        fault = F.when(blank(name), text).otherwise(fault)
    return jobs.withColumn("fault", fault)


def validate_jobs(jobs: list[ExportJob], max_parallel: int) -> None:
    """Raise with every fault found in a batch of jobs."""
    if max_parallel <= 0:
        raise ValueError(f"max jobs should be greater than 0, got {max_parallel}")
    faults = []
    for job in jobs:
        missing = [text for name, text in REQUIRED.items() if not getattr(job, name).strip()]
        if not job.destinations:
            missing.append(HOMELESS % job.name)
        faults += missing[:1]
    if faults:
        raise ValueError("\n".join(faults))


def run_job(spark: SparkSession, job: ExportJob, now: datetime | None = None) -> DataFrame:
    """Export of one job; raises with the errors of all failed destinations."""
    df = read_table(spark, job.dsn, job.driver, **job.options)
    table, dump = job.table or job.name, dict(job.dump)
    frame = {k: dump.pop(k) for k in ("locks", "drop", "database") if k in dump}
    by_kind = {"rows": [], "text": [], "script": []}
    for dest in job.destinations:
        by_kind[dest.fmt if dest.fmt in by_kind else "rows"].append(dest)
    outcome = export_many(df, by_kind["rows"], job.gzip, job.unique, now)
    if by_kind["text"]:
        statements = literals.insert_statements(df, table, **dump).select("statement")
        outcome = outcome.unionAll(export_many(statements, by_kind["text"], job.gzip, job.unique, now))
    if by_kind["script"]:
        ranges = {table: dump.pop("batch_by")} if "batch_by" in dump else None

        def script(dest: Destination) -> str:
            path = dest_name(dest.path, False, job.unique, now)
            return export_sql({table: df}, path, batch_by=ranges, gzip=job.gzip, **frame, **dump)

        done = [_outcome(d, lambda d=d: script(d)) for d in by_kind["script"]]
        outcome = outcome.unionAll(spark.createDataFrame(done, outcome.schema))
    errors = [row.error for row in outcome.where(~F.col("ok")).collect()]
    if errors:
        raise RuntimeError("\n".join(errors))
    return outcome


def run_exports(
    spark: SparkSession,
    jobs: list[ExportJob],
    max_parallel: int = MAX_PARALLEL,
    now: datetime | None = None,
) -> DataFrame:
    """Run a batch of independent exports: ``(job_name, ok, error, elapsed_ms)`` per job.

    Jobs are submitted from driver threads, at most ``max_parallel`` at once,
    and share the cluster. One failed job leaves the others alone.
    """
    validate_jobs(jobs, max_parallel)

    @inheritable_thread_target(spark)
    def run(job: ExportJob):
        start, error = time.monotonic(), ""
        try:
            run_job(spark, job, now)
        except Exception as problem:  # the outcome of the job
            error = f"failed to store dump file {error_text(problem)}"
        return job.name, not error, error, int((time.monotonic() - start) * 1000)

    with ThreadPoolExecutor(max_parallel) as pool:
        rows = list(pool.map(run, jobs))
    return spark.createDataFrame(
        rows, "job_name string, ok boolean, error string, elapsed_ms long"
    )
