"""Point-in-time restore from a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opstrail.functions.paths import base_name, log_number
from opstrail.functions.times import utc_literal
from opstrail.operators.ranking import with_ordinal
from opstrail.sources.changelog import LAST_SEQ

# Where a dump names the log coordinates it was taken at.
COORDINATES = (
    r"(?i)(?:MASTER|SOURCE)_LOG_FILE\s*=\s*'([^']+)'\s*,\s*(?:MASTER|SOURCE)_LOG_POS\s*=\s*(\d+)"
)
NO_COORDINATES = "could not extract log file and position"
NO_STOP = "stop position not found"
NO_LOGS = "no log files were found in the directory"
FILES_PER_COMMAND = 10


def event_place() -> Column:
    """Place of an event in the whole log; struct order is log order."""
    return F.struct("log_seq", "log_pos")


def dump_coordinates(lines: DataFrame) -> DataFrame:
    """First log coordinates of each dump file: ``(file, log_file, log_pos)``.

    Only matching lines leave the scan. A first position beyond 64 bits fails the query.
    """
    found = lines.select(
        "file",
        "block_start",
        "row_id",
        F.regexp_extract("value", COORDINATES, 1).alias("log_file"),
        F.regexp_extract("value", COORDINATES, 2).alias("digits"),
    ).where(F.col("log_file") != "")
    first = F.min_by(F.struct("log_file", "digits"), F.struct("block_start", "row_id"))
    too_large = F.raise_error(F.concat(F.lit("log position out of range: "), "at.digits"))
    return found.groupBy("file").agg(first.alias("at")).select(
        "file",
        "at.log_file",
        F.coalesce(F.col("at.digits").try_cast("bigint"), too_large.cast("bigint")).alias("log_pos"),
    )


def one_coordinate(lines: DataFrame) -> DataFrame:
    """The coordinates of a single dump; running it fails when the dump has none."""
    found = dump_coordinates(lines).agg(
        F.min_by(F.struct("log_file", "log_pos"), "file").alias("at")
    )
    return found.select(
        F.coalesce("at.log_file", F.raise_error(F.lit(NO_COORDINATES))).alias("log_file"),
        F.col("at.log_pos").alias("log_pos"),
    )


def log_sequence(files: DataFrame, start: str | Column | None = None) -> DataFrame:
    """Log files with ``log_seq``, from ``start`` on, without ``.index`` files.

    ``files`` has ``name`` or ``path``. Names without a number count as 0. An
    empty listing or an absent ``start`` makes the query fail when it runs.
    """
    if "name" not in files.columns:
        files = files.withColumn("name", base_name(F.col("path")))
    logs = files.where(~F.col("name").endswith(".index")).withColumn(
        "log_seq", log_number(F.col("name"))
    )
    if start is None:
        return logs
    start = start if isinstance(start, Column) else F.lit(start)
    found = logs.agg(
        F.max(F.when(F.col("name") == start, F.col("log_seq"))).alias("seq"),
        F.count(F.lit(1)).alias("n"),
    ).select(
        F.when(F.col("n") == 0, F.raise_error(F.lit(NO_LOGS)).cast("bigint"))
        .when(
            F.col("seq").isNull(),
            F.raise_error(F.concat(F.lit("current log "), start, F.lit(" not found"))).cast("bigint"),
        )
        .otherwise(F.col("seq"))
    )
    # Files sharing the start's number come after it in name order.
    cut = F.struct(found.scalar(), start)
    return logs.where(F.struct("log_seq", "name") >= cut)


def after_start(events: DataFrame, log_seq: int | Column, log_pos: int | Column) -> DataFrame:
    """Events after the start coordinates.

    ``log_pos`` of an event is its end, so the first event wanted, which
    begins at the start position, ends after it. Where events lie in a folder per log
    number or range of numbers, folders before the start's are not read, whether the start is
    a value or a scalar subquery.
    """
    if LAST_SEQ in events.columns:
        events = events.where(F.col(LAST_SEQ) >= log_seq).drop(LAST_SEQ)
    return events.where(F.col("log_seq") >= log_seq).where(
        (F.col("log_seq") > log_seq) | (F.col("log_pos") > log_pos)
    )


def _stop_cut(events: DataFrame, stop: str) -> DataFrame:
    """One row: the place of the first event at or after the stop time, NULL if there is none."""
    limit = utc_literal(stop, events.schema["event_ts"].dataType.simpleString())
    return events.where(F.col("event_ts") >= limit).agg(F.min(event_place()).alias("cut"))


def before_stop(events: DataFrame, stop: str) -> DataFrame:
    """The events in log order up to the first one at or after ``stop`` (UTC text).

    This is a prefix of the log, not a filter on time: an earlier time after
    that first event is cut off as well. The cut is one narrow aggregate and
    enters the filter as a scalar subquery.
    """
    cut = _stop_cut(events, stop).scalar()
    return events.where(F.coalesce(event_place() < cut, F.lit(True)))


def stop_coordinate(events: DataFrame, stop: str, strict: bool = True) -> DataFrame:
    """Place of the last event before the stop cut: ``(log_seq, log_pos)``.

    With ``strict`` the query fails when no event precedes the stop time.
    """
    last = before_stop(events, stop).agg(F.max(event_place()).alias("at"))
    seq = F.col("at.log_seq")
    if strict:
        seq = F.coalesce(seq, F.raise_error(F.lit(NO_STOP)).cast("bigint"))
    return last.select(seq.alias("log_seq"), F.col("at.log_pos").alias("log_pos"))


def replay_window(
    events: DataFrame, start_seq: int | Column, start_pos: int | Column, stop: str | None = None
) -> DataFrame:
    """Events to replay: after the start, and before the stop cut if there is one.

    The cut is looked for from the beginning of the start file, so a cut
    before the start leaves nothing.
    """
    events = events.where(F.col("log_seq") >= start_seq)
    if stop is not None:
        events = before_stop(events, stop)
    return after_start(events, start_seq, start_pos)


def replay_plan(
    files: DataFrame,
    start_pos: int | Column,
    stop: DataFrame | None = None,
    chunk: int = FILES_PER_COMMAND,
) -> DataFrame:
    """Replay steps as a table ``(ord, log_file, start_pos, stop_pos, batch_id)``.

    ``files`` comes from ``log_sequence`` and ``stop`` from
    ``stop_coordinate``. The first file has the start position, the last one
    the stop position, and files between them are batched by ``chunk``. Files
    after the stop are not part of the plan; a stop at or before the start
    leaves an empty plan.
    """
    files = files.select(F.col("name").alias("log_file"), "log_seq")
    stop_pos = F.lit(None).cast("bigint")
    if stop is not None:
        # The plan ends with the file of the stop, whose own position applies.
        files = files.where(F.col("log_seq") <= stop.select("log_seq").scalar())
        stop_pos = stop.select("log_pos").scalar()
    n_files = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = with_ordinal(files, "log_seq", "log_file").withColumn("n_files", n_files)
    first, last = F.col("ord") == 0, F.col("ord") == F.col("n_files") - 1
    middle_batches = F.ceil((F.col("n_files") - 2) / chunk)
    plan = ranked.select(
        F.col("ord").cast("long").alias("ord"),
        "log_file",
        F.when(first, F.lit(start_pos).cast("bigint")).alias("start_pos"),
        F.when(last, stop_pos).alias("stop_pos"),
        F.when(first, 0)
        .when(last, middle_batches + 1)
        .otherwise(F.floor((F.col("ord") - 1) / chunk) + 1)
        .cast("long")
        .alias("batch_id"),
        "n_files",
    )
    nothing = (F.col("n_files") == 1) & (
        F.coalesce(F.col("stop_pos") <= start_pos, F.lit(False))
    )
    return plan.where(~nothing).drop("n_files")


def replay_commands(plan: DataFrame) -> DataFrame:
    """One argument text per batch of the plan, in ``batch_id`` order."""
    words = F.concat_ws(
        " ",
        "log_file",
        F.concat(F.lit("--start-position="), F.col("start_pos").cast("string")),
        F.concat(F.lit("--stop-position="), F.col("stop_pos").cast("string")),
    )
    # A batch holds at most ``chunk`` files.
    listed = F.sort_array(F.collect_list(F.struct("ord", words.alias("words"))))
    return plan.groupBy("batch_id").agg(
        F.array_join(F.transform(listed, lambda f: f["words"]), " ").alias("command")
    )


def latest_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Last change per key in log order; partial aggregation absorbs hot keys."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), event_place())
    return (
        changes.groupBy(F.xxhash64(*keys).alias("key_hash"), *keys)
        .agg(last.alias("last"))
        .select(*keys, "last.*")
    )


def restore_table(
    base: DataFrame, changes: DataFrame, keys: list[str], delete_op: str = "delete"
) -> DataFrame:
    """Snapshot plus changes: the last change of a key replaces or deletes its row.

    ``changes`` has the columns of ``base`` and ``op``, ``log_seq`` and
    ``log_pos``. The snapshot is only filtered by the changed keys, so a small
    log costs it no shuffle. NULL is a key value like any other.
    """
    latest = latest_changes(changes, keys)
    changed = latest.select(*[F.col(k).alias(f"changed_{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"changed_{i}")) for i, k in enumerate(keys)]
    untouched = base.join(changed, same, "left_anti")
    return untouched.unionByName(latest.where(F.col("op") != delete_op).select(base.columns))
