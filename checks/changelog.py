"""Change-log queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs
from opstrail.functions import base_name, dir_name, glob_match, instant, relative_key
from opstrail.operators import changelog as ops
from opstrail.plans.restore import restore_job
from opstrail.session import work_dir
from opstrail.sources import read_changelog, read_dump_heads, write_changelog
from opstrail.streaming import compact_parts, read_applied, stream_apply

START_SEQ, START_POS = 5, 30_050
STOP = "2024-01-21 06:30:00"
KEYS = ["user_id", "item"]
GLOBS = {
    "is_page": "*[?]page=[0-9]*",
    "is_short": "[0-9]??",
    "not_digit": "[^0-9]*",
    "escaped": "*\\?*",
    "named": "[a-f]*[x-z0-9]",
}


def _log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the log files, with index files and names without a number between them."""
    names = inputs.binlog_events(spark, sf_dir).select("log_file", "log_seq").distinct()
    odd = F.when(F.col("log_seq") % 10 == 3, F.concat("log_file", F.lit(".index"))).when(
        F.col("log_seq") % 10 == 4, F.concat(F.lit("note"), F.col("log_seq").cast("string"))
    )
    shown = names.select(F.explode(F.array_compact(F.array("log_file", odd))).alias("shown"))
    return shown.select(F.concat(F.lit("/var/lib/db.d/"), "shown").alias("path"))


def log_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ops.log_sequence(_log_names(spark, sf_dir), start="binlog.000002")
    return files.select("name", dir_name(F.col("path")).alias("folder"), "log_seq")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(path: str) -> None:
        events = inputs.binlog_events(spark, sf_dir).drop("log_seq")
        events.write.parquet(path)

    events = read_changelog(spark, inputs.once(spark, sf_dir, "binlog", make))
    late = ops.after_start(events, START_SEQ, START_POS)
    return late.select(
        "log_file",
        "log_seq",
        "log_pos",
        instant(F.floor(F.unix_seconds(F.col("event_ts").cast("timestamp")))).alias("at"),
    ).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


def after_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the coordinates that a dump names, from a log with a folder per number."""

    def make(path: str) -> None:
        write_changelog(inputs.binlog_events(spark, sf_dir), path)

    events = read_changelog(spark, inputs.once(spark, sf_dir, "binlog-by-number", make))
    dump = f"{work_dir(spark, 'dump')}/coordinates"
    line = f"CHANGE MASTER TO MASTER_LOG_FILE='binlog.{START_SEQ:06d}', MASTER_LOG_POS={START_POS};"
    spark.range(1).select(F.lit(line)).write.text(dump)
    at = ops.one_coordinate(read_dump_heads(spark, dump, ops.COORDINATES))
    seq = at.select(F.substring_index("log_file", ".", -1).cast("bigint")).scalar()
    late = ops.after_start(events, seq, at.select("log_pos").scalar())
    return late.select("log_file", "log_seq", "log_pos")


def stop_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stop_coordinate(inputs.interleaved_events(spark, sf_dir), STOP)


def replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.replay_window(inputs.interleaved_events(spark, sf_dir), 0, 77, STOP)


def replay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.binlog_events(spark, sf_dir)
    files = ops.log_sequence(_log_names(spark, sf_dir), start="binlog.000002")
    return ops.replay_plan(files, 123, ops.stop_coordinate(events, STOP))


def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_plan(spark, sf_dir).fillna(-1)


def replay_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.replay_commands(replay_plan(spark, sf_dir))


def dump_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_dump_heads(spark, inputs.dump_files(spark, sf_dir), ops.COORDINATES, recursive=True)
    found = ops.dump_coordinates(lines)
    dump = F.regexp_extract("file", "dump=([0-9]*)", 1).cast("long")
    return found.select(dump.alias("dump"), "log_file", "log_pos")


def _snapshot(changes: DataFrame) -> DataFrame:
    """The oldest row of each key as the snapshot the changes are applied to."""
    first = F.min_by(F.struct("event_type", "value"), "log_pos")
    return changes.groupBy(*KEYS).agg(first.alias("first")).select(*KEYS, "first.*")


def restore_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = inputs.interleaved_events(spark, sf_dir)
    window = ops.replay_window(changes, 0, 77, STOP)
    return ops.restore_table(_snapshot(changes), window, KEYS)


def restore_from_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restore of ``restore_table`` as one job, from a dump file that names where it was taken."""

    def make(path: str) -> None:
        rows = inputs.table(spark, sf_dir, "nation").select(F.concat(F.lit("-- "), "n_name").alias("value"))
        at = "CHANGE MASTER TO MASTER_LOG_FILE='binlog.000000', MASTER_LOG_POS=77;"
        head = rows.limit(1).select(F.lit(at).alias("value"))
        head.unionAll(rows).coalesce(1).write.text(path)

    changes = inputs.interleaved_events(spark, sf_dir)
    names = changes.select(F.format_string("/logs/binlog.%06d", "log_seq").alias("path")).distinct()
    job = restore_job(
        spark, inputs.once(spark, sf_dir, "dump-at", make), names, changes, _snapshot(changes), KEYS, STOP
    )
    n_files = job.plan.agg(F.count(F.lit(1)).alias("n"), F.min("start_pos").alias("at"))
    return job.table.select(
        "*", n_files.select("n").scalar().alias("n_files"), n_files.select("at").scalar().alias("start_pos")
    )


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = work_dir(spark, "stream")
    changes = inputs.interleaved_events(spark, sf_dir)
    for newer in (True, False):  # newer events arrive before older ones
        part = changes.where((F.col("log_seq") >= 4) == newer)
        part.write.mode("append").parquet(f"{run}/in")
        source = spark.readStream.schema(changes.schema).parquet(f"{run}/in")
        stream_apply(source, f"{run}/table", KEYS, f"{run}/checkpoint").awaitTermination()
    compact_parts(spark, f"{run}/table", f"{run}/compact", KEYS)
    return read_applied(spark, f"{run}/compact", KEYS, _snapshot(changes))


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inputs.table(spark, sf_dir, "pages")
    name = base_name(F.col("url"))
    return pages.select(
        "page_id",
        name.alias("name"),
        dir_name(F.col("url")).alias("folder"),
        relative_key(F.col("url"), "http:").alias("key"),
        *[glob_match(name, g).alias(n) for n, g in GLOBS.items()],
    )


QUERIES = {
    "after_dump": after_dump,
    "log_sequence": log_sequence,
    "after_start": read_events,
    "stop_coordinate": stop_coordinate,
    "replay_window": replay_window,
    "replay_plan": replay_steps,
    "replay_commands": replay_commands,
    "dump_coordinates": dump_coordinates,
    "restore_table": restore_table,
    "restore_from_dump": restore_from_dump,
    "stream_apply": stream_changes,
    "glob_filter": glob_filter,
}

PER_LOG = inputs.EVENTS_PER_BINLOG
INTERLEAVED = """SELECT event_id % 7 AS log_seq, event_id AS log_pos, ts AS event_ts,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
  user_id, event_id % 100 AS item, event_type, value FROM events"""
CUT = f"""cut AS (SELECT log_seq AS s, log_pos AS p FROM ({INTERLEAVED})
  WHERE event_ts >= TIMESTAMP '{STOP}' ORDER BY 1, 2 LIMIT 1)"""
BEFORE = f"""before AS (SELECT e.* FROM ({INTERLEAVED}) e LEFT JOIN cut ON true
  WHERE s IS NULL OR log_seq < s OR (log_seq = s AND log_pos < p))"""
WINDOW = f"""WITH {CUT}, {BEFORE},
  win AS (SELECT * FROM before WHERE log_seq > 0 OR log_pos > 77)"""
SNAPSHOT = """snap AS (SELECT user_id, event_id % 100 AS item, arg_min(event_type, event_id) AS event_type,
  arg_min(value, event_id) AS value FROM events GROUP BY ALL)"""


def _restored(source: str) -> str:
    return f"""{SNAPSHOT},
      latest AS (SELECT * FROM {source}
        QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY log_seq DESC, log_pos DESC) = 1)
      SELECT user_id, item, event_type, value FROM snap
      WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM latest)
      UNION ALL
      SELECT user_id, item, event_type, value FROM latest WHERE op <> 'delete'"""


LOG_NAME = f"'binlog.' || lpad(CAST(event_id // {PER_LOG} AS VARCHAR), 6, '0')"
PLAN = f"""WITH logs AS (SELECT DISTINCT event_id // {PER_LOG} AS seq, {LOG_NAME} AS log_file FROM events),
  cut AS (SELECT event_id // {PER_LOG} AS s, event_id AS p FROM events
    WHERE ts >= TIMESTAMP '{STOP}' ORDER BY 1, 2 LIMIT 1),
  stop AS (SELECT max(event_id) AS e FROM events LEFT JOIN cut ON true
    WHERE s IS NULL OR (event_id // {PER_LOG}, event_id) < (s, p)),
  files AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS ord, count(*) OVER () AS n, log_file
    FROM logs, stop WHERE seq >= 2 AND seq <= e // {PER_LOG}),
  plan AS (SELECT ord, log_file,
    CAST(CASE WHEN ord = 0 THEN 123 END AS BIGINT) AS start_pos,
    CASE WHEN ord = n - 1 THEN (e + 1) * 100 END AS stop_pos,
    CAST(CASE WHEN ord = 0 THEN 0 WHEN ord = n - 1 THEN ceil((n - 2) / 10.0) + 1
      ELSE floor((ord - 1) / 10.0) + 1 END AS BIGINT) AS batch_id
    FROM files, stop)"""

GLOB_SQL = {
    "is_page": "^[^/]*[?]page=[0-9][^/]*$",
    "is_short": "^[0-9][^/][^/]$",
    "not_digit": "^[^0-9][^/]*$",
    "escaped": "^[^/]*[?][^/]*$",
    "named": "^[a-f][^/]*[x-z0-9]$",
}

ORACLE = {
    "log_sequence": f"""WITH logs AS (SELECT DISTINCT event_id // {PER_LOG} AS seq, {LOG_NAME} AS name FROM events)
      SELECT name, '/var/lib/db.d' AS folder,
        CAST(regexp_extract(name, '[.]([0-9]+)$', 1) AS BIGINT) AS log_seq
      FROM logs WHERE seq >= 2""",
    "after_dump": f"""SELECT {LOG_NAME} AS log_file, event_id // {PER_LOG} AS log_seq, (event_id + 1) * 100 AS log_pos FROM events
      WHERE (event_id // {PER_LOG}, (event_id + 1) * 100) > ({START_SEQ}, {START_POS})""",
    "after_start": f"""SELECT {LOG_NAME} AS log_file, event_id // {PER_LOG} AS log_seq,
        (event_id + 1) * 100 AS log_pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
      FROM events WHERE (event_id // {PER_LOG}, (event_id + 1) * 100) > ({START_SEQ}, {START_POS})""",
    "stop_coordinate": f"WITH {CUT}, {BEFORE} SELECT log_seq, log_pos FROM before ORDER BY 1 DESC, 2 DESC LIMIT 1",
    "replay_window": f"{WINDOW} SELECT * FROM win",
    "replay_plan": f"""{PLAN} SELECT ord, log_file, coalesce(start_pos, -1) AS start_pos,
        coalesce(stop_pos, -1) AS stop_pos, batch_id FROM plan""",
    "replay_commands": f"""{PLAN} SELECT batch_id, string_agg(log_file
        || coalesce(' --start-position=' || start_pos, '')
        || coalesce(' --stop-position=' || stop_pos, ''), ' ' ORDER BY ord) AS command
      FROM plan GROUP BY batch_id""",
    "dump_coordinates": """SELECT o_orderkey // 1000 AS dump,
        'mysql-bin.00' || arg_min(o_orderkey % 89, o_orderkey) AS log_file,
        arg_min(o_custkey, o_orderkey) AS log_pos
      FROM orders WHERE o_orderkey % 250 = 7 GROUP BY 1""",
    "restore_table": f"{WINDOW}, {_restored('win')}",
    "restore_from_dump": f"""{WINDOW},
      stops AS (SELECT max(log_seq) AS last FROM before), {_restored('win')}""".replace(
        "SELECT user_id, item, event_type, value FROM",
        "SELECT user_id, item, event_type, value, (SELECT last + 1 FROM stops) AS n_files, 77 AS start_pos FROM",
    ),
    "stream_apply": f"WITH every AS ({INTERLEAVED}), {_restored('every')}",
    "glob_filter": f"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name,
        regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, CASE WHEN starts_with(url, 'http:') THEN ltrim(substr(url, 6), '/') ELSE url END AS key,
        {", ".join(f"regexp_matches(regexp_extract(url, '([^/]*)$', 1), '{g}') AS {n}" for n, g in GLOB_SQL.items())}
      FROM pages""",
}
