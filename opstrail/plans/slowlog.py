"""The slow-log report: scan, parse, deduplicate, order, limit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from opstrail.errors import error_text
from opstrail.functions.text import json_text
from opstrail.operators import slowlog as ops
from opstrail.sources.slowlog import scan_slowlog

REPORT_COLUMNS = ops.RECORD_FIELDS


def parse_mysql(raw: DataFrame, mask: bool = False, split_blocks: bool = False) -> DataFrame:
    return ops.parse_records(raw, mask=mask, split_blocks=split_blocks)


# Parsers by engine: raw records to typed records with an ``error`` column.
PARSERS = {"mysql": parse_mysql}


class SlowReport(NamedTuple):
    """Records of the report in order, and one status row per file."""

    records: DataFrame
    status: DataFrame


def parser_for(engine: str):
    if engine not in PARSERS:
        raise ValueError(f"unsupported database type: {engine}")
    return PARSERS[engine]


def slow_report(
    spark: SparkSession,
    paths,
    engine: str = "mysql",
    limit: int = 0,
    mask: bool = False,
    pattern: str = "",
    on_error: str = "file",
    dedup: str = "file",
    recursive: bool = False,
    split_blocks: bool = False,
) -> SlowReport:
    """Slowest occurrence of each query, slowest first.

    Queries are told apart per file (``dedup="file"``) or over all files
    (``"global"``). Both the records and the status come from one aggregation
    over one scan. A file without records has a status row too.
    """
    parse = parser_for(engine)
    raw, n_files = scan_slowlog(spark, paths, pattern, recursive)
    groups = ops.slowest_groups(parse(raw, mask=mask, split_blocks=split_blocks))
    status = ops.file_status(groups)
    records = ops.apply_error_policy(ops.slowest_per_query(groups), status, on_error, n_files=n_files)
    if dedup == "global":
        records = ops.slowest_overall(records)
    elif dedup != "file":
        raise ValueError(f"unknown dedup scope: {dedup}")
    ordered = ops.top_slowest(records, limit)
    return SlowReport(ordered.select("file", *REPORT_COLUMNS), status)


def slowlog_json(report: SlowReport, limit: int) -> DataFrame:
    """One row with the JSON envelope ``{ok, error, results}`` of a limited report.

    ``limit`` bounds the cell; reports without limit go to ``write_report``.
    """
    if limit <= 0:
        raise ValueError("an envelope needs a limit; write_report has none")
    rows = report.records.select(F.struct(*REPORT_COLUMNS).alias("row")).limit(limit)
    ranked = rows.agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("row.query_time")).alias("key"), "row"))
        ).alias("ranked")
    )
    overall = ops.overall_status(report.status)
    return overall.select(
        json_text(
            "ok",
            "error",
            ranked.select(F.transform("ranked", lambda r: r["row"])).scalar().alias("results"),
        ).alias("envelope")
    )


def failed_envelope(spark: SparkSession, error: str) -> DataFrame:
    """The envelope of a report that could not start; it has no results at all."""
    return spark.range(1).select(
        json_text(
            F.lit(False).alias("ok"),
            F.lit(error).alias("error"),
            F.lit(None).cast("array<string>").alias("results"),
        ).alias("envelope")
    )


def slow_envelope(spark: SparkSession, paths, limit: int, **options) -> DataFrame:
    """``slow_report`` as an envelope; a missing path gives a failed one."""
    try:
        report = slow_report(spark, paths, limit=limit, **options)
    except AnalysisException as problem:
        return failed_envelope(spark, error_text(problem))
    return slowlog_json(report, limit)


def write_envelope(report: SlowReport, dest: str) -> None:
    """The envelope of a report of any size as lines below ``dest``: in order of part and
    line they are one JSON document. No cell holds more than one record, or the errors.

    Records are sorted in ranges, and each range writes its own lines: all begin with a
    comma but the very first row of the first range, which is never empty unless all are.
    """
    row = F.to_json(F.struct(*REPORT_COLUMNS), {"ignoreNullFields": "false"})
    error = F.to_json(F.struct("error"))
    head = F.concat(
        F.lit('{"ok":'), F.col("ok").cast("string"), F.lit(","),
        F.substr(error, F.lit(2), F.length(error) - 2), F.lit(',"results":['),
    )
    # Rows are numbered after the sort: only the first row of the first range has number 0.
    first = F.monotonically_increasing_id() == 0
    parts = {
        "1-head": ops.overall_status(report.status).select(head.alias("value")),
        "2-records": report.records.select(F.concat(F.when(first, "").otherwise(","), row).alias("value")),
        "3-tail": report.records.sparkSession.range(1).select(F.lit("]}").alias("value")),
    }
    for name, lines in parts.items():
        lines.write.mode("overwrite").text(f"{dest}/{name}")


def write_report(report: SlowReport, dest: str) -> None:
    """Records and status of any size as JSON lines below ``dest``."""
    report.records.write.mode("overwrite").json(f"{dest}/results")
    report.status.write.mode("overwrite").json(f"{dest}/status")
