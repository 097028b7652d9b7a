"""Slow-log queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs
from opstrail.functions import mask_literals
from opstrail.operators import slowlog as ops
from opstrail.operators.ranking import with_ordinal
from opstrail.plans.slowlog import slow_report, slowlog_json, write_envelope
from opstrail.sources import read_slowlog
from opstrail.streaming import read_slow_table, stream_slowlog
from opstrail.operators.filesync import copy_files
from opstrail.session import work_dir
from opstrail.sources.files import scan_listing

TOP = 20


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*inputs.log_place(F.col("file")), *(columns or ops.RECORD_FIELDS))


def slowlog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_slowlog(spark, inputs.slow_logs(spark, sf_dir), recursive=True)
    return _placed(ops.keep_timed(ops.parse_records(raw).where("error IS NULL")))


def slowlog_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_slowlog(spark, inputs.flat_logs(spark, sf_dir), pattern="event_type=*.log*")
    return _placed(ops.keep_timed(ops.parse_records(raw).where("error IS NULL")))


def slowlog_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = slow_report(spark, inputs.slow_logs(spark, sf_dir), mask=True, recursive=True)
    return _placed(report.records)


def slowlog_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = slow_report(
        spark, inputs.slow_logs(spark, sf_dir), mask=True, recursive=True, dedup="global"
    )
    return _placed(report.records)


def slowlog_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = inputs.slow_logs(spark, sf_dir)
    return _placed(slow_report(spark, logs, mask=True, recursive=True, limit=TOP).records)


def slowlog_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = slow_report(spark, inputs.faulty_logs(spark, sf_dir), recursive=True)
    return _placed(report.status, "ok", "error", "n_records")


def slowlog_error_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(slow_report(spark, inputs.faulty_logs(spark, sf_dir), recursive=True).records)


def slowlog_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = slow_report(
        spark, inputs.faulty_logs(spark, sf_dir), recursive=True, on_error="record"
    )
    return _placed(report.records)


def slowlog_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = inputs.slow_logs(spark, sf_dir)
    report = slow_report(spark, logs, mask=True, recursive=True, limit=TOP)
    row = report.records.drop("file").schema.simpleString()
    schema = f"struct<ok:boolean,error:string,results:array<{row}>>"
    parsed = slowlog_json(report, TOP).select(F.from_json("envelope", schema).alias("e"))
    rows = parsed.select("e.ok", "e.error", F.explode("e.results").alias("r"))
    return rows.select("ok", "error", "r.*")


def slowlog_envelope_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope without limit, read back line by line."""
    report = slow_report(spark, inputs.slow_logs(spark, sf_dir), mask=True, recursive=True)
    dest = work_dir(spark, "envelope")
    write_envelope(report, dest)
    lines = spark.read.text(f"{dest}/2-records").select(
        "value", F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("long").alias("part"), F.monotonically_increasing_id().alias("at")
    )
    # Lines in order of part and line: times never grow, and the first line alone has no comma.
    numbered = with_ordinal(lines, "part", "at").withColumn("led", F.col("value").startswith(","))
    row = report.records.drop("file").schema.simpleString()
    parsed = numbered.select("ord", "led", F.from_json(F.ltrim("value", F.lit(",")), row).alias("r"))
    frame = spark.read.text([f"{dest}/1-head", f"{dest}/3-tail"])
    whole = frame.agg(F.array_join(F.sort_array(F.collect_list("value"), False), "").alias("v")).scalar()
    return parsed.select("ord", "led", "r.*", whole.alias("frame"))


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", mask_literals(F.col("text")).alias("masked"))


def stream_slow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = work_dir(spark, "stream")
    files = scan_listing(spark, inputs.slow_logs(spark, sf_dir), recursive=True).select(
        "*", *inputs.log_place(F.col("uri"))
    )
    name = F.concat(
        F.lit("event_type="), "event_type", F.lit(",chunk="), F.col("chunk").cast("string")
    )
    named = files.withColumn("name", name)
    late = (F.col("chunk") % 2 == 1) | (F.col("event_type") > "m")
    for drop in (True, False):  # later logs arrive first
        copy_files(named.where(late == drop), f"{run}/in").write.parquet(f"{run}/copied-{drop}")
        stream_slowlog(
            spark, f"{run}/in", f"{run}/table", f"{run}/checkpoint", mask=True, max_files=100
        ).awaitTermination()
    return _placed(read_slow_table(spark, f"{run}/table"))


QUERIES = {
    "slowlog_parse": slowlog_parse,
    "slowlog_gzip": slowlog_gzip,
    "slowlog_dedup": slowlog_dedup,
    "slowlog_global": slowlog_global,
    "slowlog_topk": slowlog_topk,
    "slowlog_file_status": slowlog_file_status,
    "slowlog_error_policy": slowlog_error_policy,
    "slowlog_quarantine": slowlog_quarantine,
    "slowlog_envelope": slowlog_envelope,
    "slowlog_envelope_lines": slowlog_envelope_lines,
    "mask_literals": mask_documents,
    "stream_slowlog": stream_slow_table,
}

ZEROES = (
    "errno killed bytes_received read_first read_last read_key read_next read_prev read_rnd "
    "read_rnd_next sort_merge_passes sort_range_count sort_rows sort_scan_count "
    "created_tmp_disk_tables created_tmp_tables count_hit_tmp_table_size"
).split()

EVENTS = f"""
  SELECT event_id, event_type, event_id // {inputs.EVENTS_PER_LOG} AS chunk,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "time",
    'u' || user_id || '[u' || user_id || ']' AS "user",
    'host' || (user_id % 7) || ' [10.0.0.' || (user_id % 250) || ']' AS host_ip,
    CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value END AS query_time,
    CAST('0.00' || (event_id % 7) AS DOUBLE) AS lock_time,
    user_id AS rows_sent, event_id AS rows_examined, CAST(4 AS BIGINT) AS thread_id,
    event_id AS bytes_sent,
    {", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ZEROES)},
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "start",
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "end",
    'SELECT * FROM ' || event_type || '_' || (user_id % 20) || ' -- x' || chr(10)
      || 'WHERE user_id = ' || user_id || ' AND props = ''' || props || ''' AND shard = "s'
      || (event_id % 5) || '"' AS query
  FROM events"""


def masked_sql(c: str) -> str:
    for pattern in (r"\b\d+\b", "''[^'']*''", '"[^"]*"'):
        c = f"regexp_replace({c}, '{pattern}', '?', 'g')"
    return c


FIELDS = ", ".join(f'"{c}"' for c in ops.RECORD_FIELDS)
KEPT = f"kept AS (SELECT * FROM ({EVENTS}) WHERE query_time > 0)"
MASKED = f"masked AS (SELECT * REPLACE ({masked_sql('query')} AS query) FROM kept)"
FILE_ORDER = "query_time DESC, event_id"
GLOBAL_ORDER = "query_time DESC, event_type, CAST(chunk AS VARCHAR), event_id"


def _slowest(source: str, keys: str, order: str) -> str:
    return f"""SELECT event_id, event_type, chunk, {FIELDS} FROM {source}
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"""


FAULTS = f"""faults AS (
  SELECT event_type, event_id // {inputs.EVENTS_PER_LOG} AS chunk, event_id,
    CASE WHEN event_id % 1009 = 7 THEN 'fail to parse time'
      WHEN event_id % 1013 = 11 THEN 'fail to parse user and host, line: # User@Host: [] @ host'
        || (user_id % 7) || ' [10.0.0.' || (user_id % 250) || ']  Id: ' || event_id
      WHEN event_id % 997 = 5 THEN 'fail to convert Rows_sent to int' END AS error
  FROM events)"""

PARSE_SQL = f"WITH {KEPT} SELECT event_type, chunk, {FIELDS} FROM kept"
DEDUP_SQL = f"""WITH {KEPT}, {MASKED}
  SELECT event_type, chunk, {FIELDS} FROM ({_slowest('masked', 'event_type, chunk, query', FILE_ORDER)})"""

ORACLE = {
    "slowlog_parse": PARSE_SQL,
    "slowlog_gzip": PARSE_SQL,
    "slowlog_dedup": DEDUP_SQL,
    "stream_slowlog": DEDUP_SQL,
    "slowlog_global": f"""WITH {KEPT}, {MASKED}
      SELECT event_type, chunk, {FIELDS} FROM ({_slowest('masked', 'query', GLOBAL_ORDER)})""",
    "slowlog_topk": f"""WITH {KEPT}, {MASKED}
      SELECT event_type, chunk, {FIELDS}
      FROM ({_slowest('masked', 'event_type, chunk, query', FILE_ORDER)})
      ORDER BY {GLOBAL_ORDER} LIMIT {TOP}""",
    "slowlog_envelope": f"""WITH {KEPT}, {MASKED}
      SELECT true AS ok, '' AS error, {FIELDS}
      FROM ({_slowest('masked', 'event_type, chunk, query', FILE_ORDER)})
      ORDER BY {GLOBAL_ORDER} LIMIT {TOP}""",
    "slowlog_envelope_lines": f"""WITH {KEPT}, {MASKED}
      SELECT row_number() OVER (ORDER BY {GLOBAL_ORDER}) - 1 AS ord, row_number() OVER (ORDER BY {GLOBAL_ORDER}) > 1 AS led, {FIELDS}, '{{"ok":true,"error":"","results":[]}}' AS frame
      FROM ({_slowest('masked', 'event_type, chunk, query', FILE_ORDER)})""",
    "slowlog_file_status": f"""WITH {FAULTS}
      SELECT event_type, chunk, count(error) = 0 AS ok,
        coalesce(arg_min(error, event_id) FILTER (error IS NOT NULL), '') AS error,
        count(*) AS n_records
      FROM faults GROUP BY ALL""",
    "slowlog_error_policy": f"""WITH {KEPT}, {FAULTS},
      good AS (SELECT * FROM kept WHERE (event_type, chunk) NOT IN
        (SELECT (event_type, chunk) FROM faults WHERE error IS NOT NULL))
      SELECT event_type, chunk, {FIELDS}
      FROM ({_slowest('good', 'event_type, chunk, query', FILE_ORDER)})""",
    "slowlog_quarantine": f"""WITH {KEPT}, {FAULTS},
      good AS (SELECT * FROM kept WHERE event_id NOT IN
        (SELECT event_id FROM faults WHERE error IS NOT NULL))
      SELECT event_type, chunk, {FIELDS}
      FROM ({_slowest('good', 'event_type, chunk, query', FILE_ORDER)})""",
    "mask_literals": f"SELECT doc_id, {masked_sql('text')} AS masked FROM documents",
}
