"""Files and event tables that Spark derives from the given tables.

Everything here grows with the tables: logs hold every event, document files
every document. Rendered folders are kept per application and scale folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opstrail import tasks
from opstrail.operators.filesync import copy_files
from opstrail.session import work_dir
from opstrail.sources.files import scan_listing

EVENTS_PER_LOG = 2000
DOCS_PER_FILE = 20
EVENTS_PER_BINLOG = 50

IDLE_METRICS = (
    " Read_first: 0 Read_last: 0 Read_key: 0 Read_next: 0 Read_prev: 0 Read_rnd: 0 Read_rnd_next: 0"
    " Sort_merge_passes: 0 Sort_range_count: 0 Sort_rows: 0 Sort_scan_count: 0"
    " Created_tmp_disk_tables: 0 Created_tmp_tables: 0 Count_hit_tmp_table_size: 0 "
)

#: Input folders are new and read only once they are whole, so tasks may put their files in place
#: themselves; the driver would move them one by one, and there are as many as chunks or dumps.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

_made: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, label: str, make: Callable[[str], None]) -> str:
    """The folder ``make`` filled for this application and scale, filled at first use."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _made:
        path = work_dir(spark, label)
        make(path)
        _made[key] = path
    return _made[key]


def _log_text(faulty: bool) -> Column:
    """One event as a slow-log record; some are malformed in the faulty logs."""
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    number = event.cast("string")
    time_text, user_text, sent = F.concat(stamp, F.lit("Z")), F.concat(F.lit("u"), user), user
    if faulty:
        time_text = F.when(event % 1009 == 7, F.lit("at noon")).otherwise(time_text)
        user_text = F.when(event % 1013 == 11, F.lit("")).otherwise(user_text)
        sent = F.when(event % 997 == 5, F.concat(user, F.lit(".5"))).otherwise(sent)
    query_time = F.when(event % 10 == 0, F.lit("0")).otherwise(F.col("value").cast("string"))
    comment = F.when(event % 3 == 0, F.lit("-- a note; 12\n")).otherwise("")
    return F.concat(
        F.lit("# Time: "), time_text,
        F.lit("\n# User@Host: "), user_text, F.lit("["), user_text, F.lit("] @ host"),
        (F.col("user_id") % 7).cast("string"), F.lit(" [10.0.0."),
        (F.col("user_id") % 250).cast("string"), F.lit("]  Id: "), number,
        F.lit("\n# Query_time: "), query_time, F.lit("  Lock_time: 0.00"),
        (event % 7).cast("string"), F.lit(" Rows_sent: "), sent,
        F.lit("  Rows_examined: "), number,
        F.lit(" Thread_id: 4 Errno: 0 Killed: 0 Bytes_received: 0 Bytes_sent: "),
        F.when(event % 6 == 0, F.concat(F.lit("7 Bytes_sent: "), number)).otherwise(number),
        F.when(event % 4 == 1, F.lit(" Unknown:\t5")).otherwise(""), F.lit(IDLE_METRICS),
        F.lit(" Start: "), stamp, F.lit("Z End: "), stamp, F.lit("Z \nuse app;\nSET timestamp="),
        number, F.lit(";\nSELECT * FROM "), F.col("event_type"), F.lit("_"),
        (F.col("user_id") % 20).cast("string"), F.lit(" -- x\n"), comment,
        F.lit("WHERE user_id = "), user, F.lit(" AND props = '"), F.col("props"),
        F.lit("' AND shard = \"s"), (event % 5).cast("string"), F.lit("\";\n"),
    )


def log_lines(spark: SparkSession, sf_dir: str, faulty: bool = False, kinds: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Events as lines of log files, in order; ``kinds`` are the remainders by four of the chunks wanted.

    Records are rendered after the shuffle and the sort, which take the events' own columns,
    a small part of the text. The number of tasks is fixed: adaptive execution would take
    the events for little and render all their text in a few tasks.
    """
    events = table(spark, sf_dir, "events").withColumn("chunk", F.floor(F.col("event_id") / EVENTS_PER_LOG))
    if len(kinds) < 4:
        events = events.where(F.pmod("chunk", F.lit(4)).isin(*kinds))
    dealt = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        events.repartition(dealt, "event_type", "chunk")
        .sortWithinPartitions("event_type", "chunk", "event_id")
        .select("event_type", "chunk", _log_text(faulty).alias("value"))
    )


def _write_logs(path: str, lines: DataFrame, **options) -> None:
    lines.write.options(**BY_TASKS, **options).partitionBy("event_type", "chunk").text(path)


def slow_logs(spark: SparkSession, sf_dir: str) -> str:
    """All events as log files ``event_type=…/chunk=…/…``."""
    return once(spark, sf_dir, "slowlogs", lambda p: _write_logs(p, log_lines(spark, sf_dir)))


def faulty_logs(spark: SparkSession, sf_dir: str) -> str:
    """The same with malformed records in some files."""
    return once(spark, sf_dir, "faulty", lambda p: _write_logs(p, log_lines(spark, sf_dir, faulty=True)))


def log_place(file: Column) -> list[Column]:
    """``event_type`` and ``chunk`` of a log file."""
    return [
        F.regexp_extract(file, "event_type=([^/,]*)", 1).alias("event_type"),
        F.regexp_extract(file, "chunk=([0-9]*)", 1).cast("long").alias("chunk"),
    ]


def flat_logs(spark: SparkSession, sf_dir: str) -> str:
    """Log files in one folder: plain and gzip content, each under plain and ``.gz`` names."""

    def make(path: str) -> None:
        plain, zipped = work_dir(spark, "plain"), work_dir(spark, "zipped")
        _write_logs(plain, log_lines(spark, sf_dir, kinds=(0, 1)))
        _write_logs(zipped, log_lines(spark, sf_dir, kinds=(2, 3)), compression="gzip")
        kind = F.pmod("chunk", F.lit(4))
        named = scan_listing(spark, [plain, zipped], recursive=True).select("*", *log_place(F.col("uri")))
        ending = F.when(kind.isin(1, 2), ".log.gz").otherwise(".log")
        name = F.concat(
            F.lit("event_type="), "event_type", F.lit(",chunk="), F.col("chunk").cast("string"), ending
        )
        copied = copy_files(named.withColumn("name", name), path)
        copied.write.parquet(work_dir(spark, "copied"))

    return once(spark, sf_dir, "mixed", make)


def doc_folders(spark: SparkSession, sf_dir: str) -> str:
    """All documents as text files ``bucket=…/…``.

    Tasks write the files themselves: Spark's writer takes some 40 ms of a core for each
    file of a local folder, and there are as many files as buckets.
    """

    def make(path: str) -> None:
        docs = table(spark, sf_dir, "documents").select(
            F.floor(F.col("doc_id") / DOCS_PER_FILE).alias("bucket"),
            "doc_id",
            F.col("text").cast("binary").alias("value"),
        )
        folder = F.coalesce(F.col("bucket").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        (
            docs.repartition("bucket")
            .sortWithinPartitions("bucket", "doc_id")
            .select(F.concat(F.lit("bucket="), folder).alias("folder"), "value")
            .mapInArrow(tasks.write_lines(path, "docs.txt"), "folder string, n_lines long")
            .write.parquet(f"{path}/_written")
        )

    return once(spark, sf_dir, "docfolders", make)


def doc_files(spark: SparkSession, sf_dir: str) -> str:
    """Document files and a copy of each in one folder."""

    def make(path: str) -> None:
        files = scan_listing(spark, doc_folders(spark, sf_dir), recursive=True)
        bucket = F.regexp_extract("uri", "bucket=([0-9]*)", 1)
        ending = F.explode(F.array(F.lit(".txt"), F.lit(".copy.txt")))
        named = files.select("*", ending.alias("ending")).withColumn(
            "name", F.concat(F.lit("docs-"), bucket, "ending")
        )
        copy_files(named, path).write.parquet(work_dir(spark, "copied"))

    return once(spark, sf_dir, "docfiles", make)


def binlog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in consecutive log files of ``EVENTS_PER_BINLOG``."""
    seq = F.floor(F.col("event_id") / EVENTS_PER_BINLOG).cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("binlog."), F.lpad(seq.cast("string"), 6, "0")).alias("log_file"),
        seq.alias("log_seq"),
        ((F.col("event_id") + 1) * 100).alias("log_pos"),
        F.col("ts").alias("event_ts"),
        "event_id",
    )


def interleaved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes dealt out to seven log files in turn, each covering all times."""
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("event_id") % 7).alias("log_seq"),
        F.col("event_id").alias("log_pos"),
        F.col("ts").alias("event_ts"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        "user_id",
        (F.col("event_id") % 100).alias("item"),
        "event_type",
        "value",
    )


def dump_files(spark: SparkSession, sf_dir: str) -> str:
    """Orders as dump files, plain and gzip, with log coordinates on some lines."""

    def make(path: str) -> None:
        key = F.col("o_orderkey")
        word = F.when(key % 2 == 0, "MASTER").otherwise("source")
        line = F.when(
            key % 250 == 7,
            F.concat(
                F.lit("-- CHANGE TO "), word, F.lit("_LOG_FILE = 'mysql-bin.00"),
                (key % 89).cast("string"), F.lit("', "), word, F.lit("_LOG_POS="),
                F.col("o_custkey").cast("string"), F.lit(";"),
            ),
        ).otherwise(F.concat(F.lit("INSERT INTO o VALUES ("), key.cast("string"), F.lit(");")))
        lines = table(spark, sf_dir, "orders").select(
            F.floor(key / 1000).alias("dump"), key.alias("key"), line.alias("value")
        )
        for parity, codec in ((0, "none"), (1, "gzip")):
            (
                lines.where(F.col("dump") % 2 == parity)
                .repartition("dump")
                .sortWithinPartitions("dump", "key")
                .drop("key")
                .write.options(compression=codec, **BY_TASKS)
                .partitionBy("dump")
                .text(f"{path}/{codec}")
            )

    return once(spark, sf_dir, "dumps", make)
