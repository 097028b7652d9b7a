"""Slow-log records: parsing, filtering, deduplication, status and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opstrail.functions.text import (
    ASCII_SPACE_RUN,
    ascii_spaces,
    mask_literals,
    strip_semicolons,
    to_number,
    trim_ws,
)
from opstrail.operators.matching import without_keys

# The log's metric names with the column each one fills.
FLOAT_METRICS = {"Query_time": "query_time", "Lock_time": "lock_time"}
INT_METRICS = {
    "Rows_sent": "rows_sent",
    "Rows_examined": "rows_examined",
    "Thread_id": "thread_id",
    "Errno": "errno",
    "Killed": "killed",
    "Bytes_received": "bytes_received",
    "Bytes_sent": "bytes_sent",
    "Read_first": "read_first",
    "Read_last": "read_last",
    "Read_key": "read_key",
    "Read_next": "read_next",
    "Read_prev": "read_prev",
    "Read_rnd": "read_rnd",
    "Read_rnd_next": "read_rnd_next",
    "Sort_merge_passes": "sort_merge_passes",
    "Sort_range_count": "sort_range_count",
    "Sort_rows": "sort_rows",
    "Sort_scan_count": "sort_scan_count",
    "Created_tmp_disk_tables": "created_tmp_disk_tables",
    "Created_tmp_tables": "created_tmp_tables",
    "Count_hit_tmp_table_size": "count_hit_tmp_table_size",
}
TEXT_METRICS = {"Start": "start", "End": "end"}

# Header shapes and error messages.
TIME_SHAPE = r"(?i)^: (\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|\+\d{2}:?\d{2})?)"
INSTANT_SHAPE = (
    r"(?i)^: (\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?:(Z)|([+-]\d{2}):?(\d{2}))?"
)
USER_SHAPE = (
    r"(?id)^# User@Host: ([^ \t\n\f\r]+\[[^ \t\n\f\r]+\]) @ ([\w.\-]*[ \t\n\f\r]*\[.*?\])"
)
TIME_ERROR = "fail to parse time"
USER_ERROR = "fail to parse user and host, line: "

COMMENT_LINES = r"(?md)^(?:--|#)[^\n]*(?:\n|\z)"
LINE_END = "\u0001"  # a word no log line holds, keeps pairs from spanning lines
RECORD_FIELDS = (
    ["time", "user", "host_ip", *FLOAT_METRICS.values(), *INT_METRICS.values()]
    + [*TEXT_METRICS.values(), "query"]
)
POSITION = ["block_start", "row_id", "sub_id"]


def split_records(raw: DataFrame, split_blocks: bool = False) -> DataFrame:
    """Records as ``text`` that starts right after ``# Time``.

    The separator swallows that prefix from every record but the one that
    opens a file; it is stripped there too. A first record without it is text
    before the log's first record; ``lead`` marks it. ``split_blocks`` cuts a
    record into one per ``# User`` header, for logs that leave out a repeated
    time line.
    """
    opens = F.col("value").startswith("# Time")
    records = raw.select(
        "file",
        "block_start",
        "row_id",
        F.lit(0).alias("sub_id"),
        ((F.col("block_start") == 0) & ~opens & F.col("scan_error").isNull()).alias("lead"),
        F.when(opens, F.substr("value", F.lit(7))).otherwise(F.col("value")).alias("text"),
        "scan_error",
    )
    if not split_blocks:
        return records
    blocks = F.when(F.col("lead"), F.array("text")).otherwise(
        F.split("text", r"(?md)(?=^# User)")
    )
    head = F.substring_index("text", "\n", 1)
    return (
        records.withColumns({"head": head, "n_blocks": F.size(blocks)})
        .select("*", F.posexplode(blocks).alias("block_id", "block"))
        .where((F.col("block_id") > 0) | (F.col("n_blocks") == 1))
        .withColumn(
            "text",
            F.when(F.col("block_id") == 0, F.col("block")).otherwise(
                F.concat("head", F.lit("\n"), "block")
            ),
        )
        .withColumn("sub_id", F.col("block_id"))
        .select(records.columns)
    )


def with_time(records: DataFrame, as_instant: bool = False) -> DataFrame:
    """``time`` as written; with ``as_instant`` also ``time_ts``, offsets of either sign applied.

    A time without offset is UTC.
    """
    records = records.withColumn("time", F.regexp_extract("text", TIME_SHAPE, 1))
    if not as_instant:
        return records
    day, clock, hours, minutes = (
        F.regexp_extract("text", INSTANT_SHAPE, g) for g in (1, 2, 4, 5)
    )
    zone = F.when(hours == "", "Z").otherwise(F.concat(hours, F.lit(":"), minutes))
    return records.withColumn(
        "time_ts", F.concat(day, F.lit("T"), clock, zone).try_cast("timestamp")
    )


def _with_lines(records: DataFrame, name: str, prefix: str) -> DataFrame:
    """``name``: the lines with a prefix. One such line, the usual case, needs no regex."""
    start = F.position(F.lit("\n" + prefix), F.col("text"))
    found = records.withColumn("line_at", start)
    second = F.position(F.lit("\n" + prefix), F.col("text"), F.col("line_at") + 1)
    line = F.substring_index(F.substr("text", F.col("line_at") + 1), "\n", 1)
    every = F.regexp_extract_all("text", F.lit(rf"(?md)^{prefix}[^\n]*"), F.lit(0))
    return found.withColumn(
        name,
        F.when(F.col("line_at") == 0, F.array().cast("array<string>"))
        .when(second == 0, F.array(line))
        .otherwise(every),
    ).drop("line_at")


def with_user_host(records: DataFrame) -> DataFrame:
    """``user`` and ``host_ip`` of the last user line; ``user_error`` for a malformed one."""
    lines = _with_lines(records, "user_lines", "# User")
    last = F.try_element_at("user_lines", F.lit(-1))
    parsed = lines.withColumns(
        {
            "user": F.coalesce(F.regexp_extract(last, USER_SHAPE, 1), F.lit("")),
            "host_ip": F.coalesce(trim_ws(F.regexp_extract(last, USER_SHAPE, 2)), F.lit("")),
        }
    )
    bad = F.when(
        F.size("user_lines") > 1,
        F.get(F.filter("user_lines", lambda line: ~line.rlike(USER_SHAPE)), F.lit(0)),
    ).when(F.col("user") == "", last)
    return parsed.withColumn("user_error", F.concat(F.lit(USER_ERROR), bad)).drop("user_lines")


def _is_bad(pair: Column) -> Column:
    return pair["value"].isNotNull() & (
        F.when(pair["name"].isin(*FLOAT_METRICS), to_number(pair["value"], "float").isNull())
        .when(pair["name"].isin(*INT_METRICS), to_number(pair["value"], "int").isNull())
        .otherwise(False)
    )


def _first(items: Column | str, where) -> Column:
    return F.get(F.filter(items, where), F.lit(0))


def with_metrics(records: DataFrame) -> DataFrame:
    """The two float, 21 integer and two text metrics; ``metric_error`` for a bad number.

    Each word of a metric line is a name for the word after it. Unknown names
    are ignored and the last of repeated names counts; a bad number counts
    wherever it stands. A ``plain`` line has the metrics in their usual order
    and nothing else, so its values are every second word; the words of any
    other line are paired one by one. Metrics are handled as arrays, which
    keeps the generated code small enough to be compiled well.
    """
    names = [*FLOAT_METRICS, *INT_METRICS, *TEXT_METRICS]
    n_float, n_int = len(FLOAT_METRICS), len(INT_METRICS)
    known = F.array(*map(F.lit, names))
    usual = F.array(*[F.lit(f"{n}:") for n in names])
    text = _with_lines(records, "metric_lines", "# Query_time").withColumn(
        "metric_text", trim_ws(F.array_join("metric_lines", f" {LINE_END} "))
    )
    words = text.withColumn("words", F.array_remove(F.split("metric_text", " "), ""))
    halves = words.withColumns(
        {
            "odd_words": F.filter("words", lambda w, i: i % 2 == 1),
            "even_words": F.filter("words", lambda w, i: (i > 0) & (i % 2 == 0)),
        }
    )
    plain = halves.withColumn(
        "plain",
        (F.col("odd_words") == F.slice(usual, 1, F.size("odd_words")))
        & (F.size("odd_words") == F.size("even_words"))
        & (F.octet_length("metric_text") == F.length("metric_text"))
        & ~F.col("metric_text").rlike(r"[\t-\r\x01]"),
    )
    # The words of a line that is not plain, split at any white space.
    other = plain.withColumn(
        "words",
        F.when(~F.col("plain"), F.split(ascii_spaces(F.col("metric_text")), ASCII_SPACE_RUN)),
    )
    pairs = F.filter(
        F.zip_with(
            "words",
            F.slice("words", 2, F.size("words")),
            lambda name, value: F.struct(name.alias("name"), value.alias("value")),
        ),
        lambda p: p["name"].isin(*names, *[f"{n}:" for n in names]) & (p["value"] != LINE_END),
    )
    paired = other.withColumn("pairs", pairs).withColumn(
        "names", F.transform("pairs.name", lambda n: F.rtrim(n, F.lit(":")))
    )
    paired = paired.withColumn("repeated", F.size(F.array_distinct("names")) < F.size("names"))
    last_of_each = F.filter(
        F.arrays_zip(F.col("names").alias("name"), F.col("pairs.value").alias("value")),
        lambda p, i: ~F.array_contains(F.slice("names", i + 2, F.size("names")), p["name"]),
    )
    mapped = paired.withColumn(
        "metrics",
        F.when(F.col("repeated"), F.map_from_entries(last_of_each)).otherwise(
            F.map_from_arrays("names", F.col("pairs.value"))
        ),
    )
    values = mapped.withColumn(
        "values",
        F.when(F.col("plain"), F.col("even_words")).otherwise(
            F.array(*[F.try_element_at("metrics", F.lit(n)) for n in names])
        ),
    )
    numbers = values.withColumns(
        {
            "floats": F.transform(F.slice("values", 1, n_float), lambda v: to_number(v, "float")),
            "ints": F.slice("values", 1 + n_float, n_int).try_cast("array<bigint>"),
        }
    )
    n_given = F.size(F.array_compact(F.slice("values", 1, n_float + n_int)))
    n_parsed = F.size(F.array_compact("floats")) + F.size(F.array_compact("ints"))
    given = F.when(
        F.col("plain"),
        F.arrays_zip(known.alias("name"), F.col("even_words").alias("value")),
    ).otherwise(F.arrays_zip(F.col("names").alias("name"), F.col("pairs.value").alias("value")))
    bad_pair = F.when(
        F.coalesce("repeated", F.lit(False)) | (n_parsed < n_given), _first(given, _is_bad)
    )
    columns = {
        c: F.coalesce(F.get("floats", F.lit(i)), F.lit(0.0))
        for i, c in enumerate(FLOAT_METRICS.values())
    }
    columns |= {
        c: F.coalesce(F.get("ints", F.lit(i)), F.lit(0).cast("bigint"))
        for i, c in enumerate(INT_METRICS.values())
    }
    columns |= {
        c: F.coalesce(F.get("values", F.lit(n_float + n_int + i)), F.lit(""))
        for i, c in enumerate(TEXT_METRICS.values())
    }
    bad = F.col("bad_metric")
    return (
        numbers.withColumns({**columns, "bad_metric": bad_pair["name"]})
        .withColumn(
            "metric_error",
            F.concat(
                F.lit("fail to convert "),
                bad,
                F.when(bad.isin(*FLOAT_METRICS), " to float64").otherwise(" to int"),
            ),
        )
        .select(*records.columns, *columns, "metric_error")
    )


def with_query(records: DataFrame, mask: bool = False) -> DataFrame:
    """``query``: the lines after the first one starting ``SET``.

    Lines starting ``--`` or ``#`` are left out, the rest is trimmed and loses
    every ``;``; ``mask`` replaces its literals.
    """
    start = F.locate("\nSET", F.col("text"))
    tail = F.substr("text", start + 1)
    after_set = F.locate("\n", tail)
    body = F.when((start > 0) & (after_set > 0), F.substr(tail, after_set + 1)).otherwise("")
    query = strip_semicolons(trim_ws(F.regexp_replace(body, COMMENT_LINES, "")))
    return records.withColumn("query", mask_literals(query) if mask else query)


def parse_records(raw: DataFrame, mask: bool = False, split_blocks: bool = False) -> DataFrame:
    """Raw records as typed ones with ``error``: a fault of the scan, time, user or a number.

    A record leaves as one struct that is unpacked again: filters on its
    fields then work on parsed values, where the optimizer would otherwise
    repeat the parsing inside each filter.
    """
    records = with_time(split_records(raw, split_blocks))
    records = with_query(with_metrics(with_user_host(records)), mask)
    errors = F.array(
        "scan_error", F.when(F.col("time") == "", TIME_ERROR), "user_error", "metric_error"
    )
    error = _first(errors, lambda e: e.isNotNull())
    record = F.struct("file", *POSITION, "lead", *RECORD_FIELDS, error.alias("error"))
    return records.select(F.inline(F.array(record)))


def timed() -> Column:
    """Query time above zero and a query; NaN is not above zero here."""
    return (F.col("query_time") > 0) & ~F.isnan("query_time") & (F.col("query") != "")


def keep_timed(records: DataFrame) -> DataFrame:
    return records.where(timed())


def _position() -> Column:
    return F.struct(*POSITION)


def slowest_groups(records: DataFrame) -> DataFrame:
    """One row per file and kept query, plus one per file for each kind of other record.

    ``best`` is the slowest record of a query, the earliest among equals, and
    the earliest record of the other kinds (``error``, ``lead`` for text that
    may stand before a log's first record, ``dropped``). One aggregation
    serves the report and the file status. Grouping starts with a hash so that
    the sort compares numbers, and partial aggregation leaves at most one row
    per task of a hot query.
    """
    kind = (
        F.when((F.col("error") == TIME_ERROR) & F.col("lead"), "lead")
        .when(F.col("error").isNotNull(), "error")
        .when(timed(), "query")
        .otherwise("dropped")
    )
    keyed = records.withColumn("kind", kind).withColumn(
        "group_key",
        F.when(F.col("kind") == "query", F.concat(F.lit("q"), "query")).otherwise(F.col("kind")),
    )
    slowness = F.when(F.col("kind") == "query", F.col("query_time")).otherwise(0.0)
    return (
        keyed.withColumn("group_hash", F.xxhash64("file", "group_key"))
        .groupBy("group_hash", "file", "group_key")
        .agg(
            F.min_by(
                F.struct("kind", "file", *POSITION, "error", *RECORD_FIELDS),
                F.struct(-slowness, *POSITION),
            ).alias("best"),
            F.min(F.struct(*POSITION)).alias("first_at"),
            F.max(F.struct(*POSITION)).alias("last_at"),
            F.count(F.lit(1)).alias("n_records"),
        )
    )


def slowest_per_query(groups: DataFrame) -> DataFrame:
    """The kept queries of ``slowest_groups`` as records.

    All results of the aggregation are used, as ``file_status`` uses them, so
    that a plan with both runs the scan and the aggregation once.
    """
    kept = groups.where(
        (F.col("best.kind") == "query")
        & (F.col("n_records") > 0)
        & (F.col("first_at") <= F.col("last_at"))
    )
    return kept.select(*[F.col(f"best.{c}").alias(c) for c in ["file", *POSITION, *RECORD_FIELDS]])


def slowest_overall(records: DataFrame) -> DataFrame:
    """The slowest record per query over all files, for reports that merge files."""
    best = F.min_by(
        F.struct(*records.columns), F.struct(-F.col("query_time"), "file", *POSITION)
    )
    return (
        records.groupBy(F.xxhash64("query").alias("group_hash"), "query")
        .agg(best.alias("best"))
        .select("best.*")
    )


def file_status(groups: DataFrame) -> DataFrame:
    """``(file, ok, error, n_records)`` per file, also without a record: its empty piece counts as text before one.

    Text before the first record fails nothing: a ``lead`` record is an error
    only if another record of the file comes before it. ``error`` is the
    file's first; after such text, where several times are malformed, they
    count from the last one. Input is reduced to a few rows per file and task
    before it is shuffled.
    """
    kind = F.col("best.kind")
    per_file = groups.groupBy(F.col("best.file").alias("file")).agg(
        F.min("first_at").alias("file_first"),
        F.min(F.when(kind == "lead", F.col("first_at"))).alias("lead_first"),
        F.max(F.when(kind == "lead", F.col("last_at"))).alias("lead_last"),
        F.coalesce(F.sum(F.when(kind == "lead", F.col("n_records"))), F.lit(0)).alias("n_lead"),
        F.min(
            F.when(kind == "error", F.struct("first_at", F.col("best.error").alias("error")))
        ).alias("first_error"),
        F.sum("n_records").alias("n_all"),
    )
    preamble = F.coalesce(F.col("lead_first") == F.col("file_first"), F.lit(False)).cast("int")
    late_lead = F.col("n_lead") > preamble
    lead_at = F.when(preamble == 0, F.col("lead_first")).otherwise(F.col("lead_last"))
    lead_wins = late_lead & (
        F.col("first_error").isNull() | (lead_at < F.col("first_error.first_at"))
    )
    error = F.when(lead_wins, TIME_ERROR).otherwise(F.col("first_error.error"))
    return per_file.select(
        "file",
        error.isNull().alias("ok"),
        F.coalesce(error, F.lit("")).alias("error"),
        (F.col("n_all") - preamble).alias("n_records"),
    )


def overall_status(status: DataFrame) -> DataFrame:
    """One row ``(ok, error)``: errors of all failed files joined in file order.

    It holds one line per failed file, no more than the scan's file index.
    """
    failed = F.when(~F.col("ok"), F.struct("file", "error"))
    return status.agg(
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(failed)), lambda e: e["error"]), "\n"
        ).alias("error"),
    )


def apply_error_policy(
    records: DataFrame, status: DataFrame, on_error: str = "file", n_files: int | None = None
) -> DataFrame:
    """``file``: a file with an error contributes nothing. ``record``: only its good records.

    ``n_files`` is the number of scanned files where known; it bounds the list
    of failed ones.
    """
    if "error" in records.columns:
        records = records.where(F.col("error").isNull()).drop("error")
    if on_error == "record":
        return records
    if on_error != "file":
        raise ValueError(f"unknown error policy: {on_error}")
    return without_keys(records, status.where(~F.col("ok")), "file", max_keys=n_files)


def order_slowest(records: DataFrame) -> DataFrame:
    """Slowest first; equal times by file and position."""
    return records.orderBy(F.desc("query_time"), "file", *POSITION)


def top_slowest(records: DataFrame, limit: int = 0) -> DataFrame:
    """The ``limit`` slowest, or all of them when it is not positive."""
    ordered = order_slowest(records)
    return ordered.limit(limit) if limit > 0 else ordered
