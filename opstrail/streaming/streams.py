"""Continuous forms of the slow-log report, content intake and change apply.

Keyed tables are kept as parts, one folder per stream and micro-batch, and merged
when read. A batch that runs again overwrites its own part, and only that: a
stream that starts anew with another checkpoint has another id. The merge takes
a maximum per key, so it does not depend on the order in which batches arrive,
and reading a row twice changes nothing.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from opstrail import tasks
from opstrail.operators import changelog
from opstrail.operators import slowlog as ops
from opstrail.operators.filesync import fingerprint
from opstrail.plans.slowlog import REPORT_COLUMNS, parser_for
from opstrail.sources.files import qualified
from opstrail.sources.slowlog import RECORD_SEPARATOR
from opstrail.streaming.state import FirstSeen

CONTENT_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _start(
    df: DataFrame, target: str, checkpoint: str, trigger: dict | None, parts_of
) -> StreamingQuery:
    """Write ``parts_of(batch)`` of every micro-batch as a part of ``target``.

    A part is named by the stream's id, which its checkpoint keeps, and the batch.
    """
    started, ids = threading.Event(), []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        _write_part(parts_of(batch), target, ids[0], batch_id)

    query = (
        df.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    ids.append(query.id)
    started.set()
    return query


def _write_part(df: DataFrame, target: str, stream_id: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{target}/stream_id={stream_id}/batch_id={batch_id}")


def _read_parts(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("stream_id", "batch_id")


def stream_slowlog(
    spark: SparkSession,
    directory: str,
    target: str,
    checkpoint: str,
    engine: str = "mysql",
    mask: bool = False,
    trigger: dict | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Keep the slowest record per file and query of closed log files as they appear.

    A file belongs in ``directory`` once it is no longer written to. The stream
    is one of names; each file is opened in a task, which tells gzip by content
    and reports a file that it cannot read as that file's error.
    """
    parse = parser_for(engine)
    names = _names(spark, directory, max_files).select(
        F.col("_metadata.file_path").alias("uri"), "path"
    )
    pieces = names.mapInArrow(
        tasks.read_pieces(RECORD_SEPARATOR.encode()),
        "file string, row_id long, bytes binary, scan_error string",
    ).select(
        "file",
        F.lit(0).cast("long").alias("block_start"),
        "row_id",
        F.col("bytes").cast("string").alias("value"),
        "scan_error",
    )
    # Parsing is part of the stream: set up for every batch, it would take longer than a batch's files.
    return _start(parse(pieces, mask=mask), target, checkpoint, trigger, ops.slowest_groups)


def _names(spark: SparkSession, directory: str, max_files: int | None) -> DataFrame:
    """Stream of the files below a folder; their content column is never read."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(CONTENT_SCHEMA)
        .option("recursiveFileLookup", "true")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(directory)


def _merged_groups(parts: DataFrame) -> DataFrame:
    """The parts of a file, equal or partial, as one group per file and key."""
    query = F.col("best.kind") == "query"
    slowness = F.when(query, F.col("best.query_time")).otherwise(0.0)
    order = F.struct(-slowness, *[F.col(f"best.{c}") for c in ops.POSITION])
    return parts.groupBy("group_hash", "file", "group_key").agg(
        F.min_by("best", order).alias("best"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max("n_records").alias("n_records"),
    )


def read_slow_table(spark: SparkSession, target: str, on_error: str = "file") -> DataFrame:
    """The slowest record per file and query over all batches so far."""
    groups = _merged_groups(_read_parts(spark, target))
    records = ops.apply_error_policy(
        ops.slowest_per_query(groups), ops.file_status(groups), on_error
    )
    return records.select("file", *REPORT_COLUMNS)


def stream_new_content(
    spark: SparkSession, directory: str, max_files: int | None = None, keep_seconds: int | None = None
) -> DataFrame:
    """Streaming table of files, one per content: ``(path, length, sha256)``.

    A hash is kept once, as state in RocksDB on the executors' disks, not on the heap. With
    ``keep_seconds`` it is forgotten that long after its content was given, so the state
    does not grow without end, and the content counts as new after that. Copies are
    dropped where they are hashed, so one content with many files sends a row per Arrow
    batch at most. The store is set on a session of the stream's own, with one partition a core
    at most, and one for ``FILES_PER_STORE`` files of a micro-batch; a checkpoint keeps the number
    it began with.
    """
    own = spark.newSession()
    for key, value in {**{k: spark.conf.get(k) for k in KEPT_CONF if spark.conf.get(k, None)}, **STATE_STORE}.items():
        own.conf.set(key, value)
    if tasks._local(qualified(spark, directory)) is not None:
        for key, value in LOCAL_FILES.items():
            own.conf.set(key, value)
        if not own.conf.get(FILE_MANAGER, None):
            own.conf.set(FILE_MANAGER, f"{CHECKPOINTING}.FileSystemBasedCheckpointFileManager")
    cores = spark.sparkContext.defaultParallelism
    # Parts are never quite full: a part more than cores would be a second wave of tasks.
    own.conf.set("spark.sql.files.minPartitionNum", str(cores - cores // 6))
    # Every partition is a store and a Python state server that open and commit in every batch.
    stores = min(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if max_files:
        stores = min(stores, -(-max_files // FILES_PER_STORE))
    own.conf.set("spark.sql.shuffle.partitions", str(stores))
    # Fingerprints stream each file in chunks.
    names = _names(own, directory, max_files).select("path", "length")
    hashed = fingerprint(names).mapInArrow(tasks.first_of_each("sha256", "path"), "path string, length bigint, sha256 string")
    return hashed.groupBy("sha256").transformWithStateInPandas(
        statefulProcessor=FirstSeen(keep_seconds),
        outputStructType="path string, length bigint, sha256 string",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


#: Files of a micro-batch for each partition of its state. What a task costs besides is that of some 50 files.
FILES_PER_STORE = 25
# The state store that keeps named variables and their times. Batches without files
# are left out, or a stream that is to end would go on making them for the sake of the times.
# A commit writes the changes of its batch, and whole stores are saved in the background. Files are
# packed by size into a task a core: Spark counts 4 MB for opening one, and a task costs more than its files.
STATE_STORE = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.files.openCostInBytes": "64k",
}
# Of a local folder, the driver looks up the files of a batch itself, without a job, and checkpoint
# files are renamed by the plain file system, where file contexts start several processes a file.
LOCAL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.threshold": "1000"}
FILE_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
CHECKPOINTING = "org.apache.spark.sql.execution.streaming.checkpointing"
KEPT_CONF = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", FILE_MANAGER)


def stream_apply(
    events: DataFrame,
    target: str,
    keys: list[str],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the last change per key of a stream of change-log events.

    Events may arrive in any order: the change with the highest place in the
    log counts, whichever batch it came in.
    """

    return _start(
        events, target, checkpoint, trigger, lambda b: changelog.latest_changes(b, keys)
    )


def read_applied(
    spark: SparkSession, target: str, keys: list[str], base: DataFrame | None = None
) -> DataFrame:
    """The last change per key so far, or ``base`` with those changes applied."""
    changes = _read_parts(spark, target)
    if base is None:
        return changelog.latest_changes(changes, keys)
    return changelog.restore_table(base, changes, keys)


def compact_parts(spark: SparkSession, target: str, dest: str, keys: list[str] | None = None) -> None:
    """Merge all parts of a table into one part below ``dest``.

    ``keys`` are those of a change table; without them it is a slow-log table.
    Streams may go on writing to ``target``.
    """
    parts = _read_parts(spark, target)
    merged = changelog.latest_changes(parts, keys) if keys else _merged_groups(parts)
    _write_part(merged, dest, "merged", 0)


def compact_in_place(spark: SparkSession, target: str, keys: list[str] | None = None) -> int:
    """Replace the parts of a table by one; returns how many there were.

    Only parts that are there at the start are read and, once their merge is
    written, deleted: streams may go on adding parts, and if this stops in
    between, a row is merely there twice, which changes nothing. A reader that
    has planned its scan before should start again.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/stream_id=*/batch_id=*")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.globStatus(folder) or []]
    if len(old) < 2:
        return len(old)
    parts = spark.read.option("basePath", target).parquet(*[p.toString() for p in old])
    parts = parts.drop("stream_id", "batch_id")
    merged = changelog.latest_changes(parts, keys) if keys else _merged_groups(parts)
    _write_part(merged, target, f"merged-{uuid.uuid4().hex}", 0)
    for path in old:
        fs.delete(path, True)
    return len(old)
