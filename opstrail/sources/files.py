"""File listings as DataFrames."""

from __future__ import annotations

import contextlib
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opstrail import tasks
from opstrail.functions.paths import base_name, glob_to_regex, relative_key
from opstrail.sources import lines

#: Tasks of a listing for each core, at most.
TASKS_PER_CORE = 8


def as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def decoded(uri: Column) -> Column:
    """A file name as it is, from its percent-encoded form in scan metadata."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def name_filter(pattern: str, name: Column, uri: Column, paths: list[str]) -> Column:
    """Glob on the base name; a path given in full is kept whatever its name."""
    keep = name.rlike(glob_to_regex(pattern))
    for path in paths:
        keep = keep | uri.endswith("/" + path.split(":", 1)[-1].lstrip("/"))
    return keep


def listing_tasks(spark: SparkSession) -> int:
    """The most tasks a listing is dealt out to."""
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


@contextlib.contextmanager
def folders_listed(spark: SparkSession):
    """Reads planned here list folders, as Spark does at ``load``, by at most ``listing_tasks``.

    Spark plans a task for each folder, up to 10,000, and starting one takes longer than its folder.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), listing_tasks(spark))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scan_listing(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """Every file as ``(path, name, length, modificationTime, uri)``.

    File content is never selected, so the scan reads none. Names starting
    with ``_`` or ``.`` are hidden by Spark.

    Spark plans a task for about 32 files, or for fewer large ones. Merely starting Python
    takes longer than a digest or a copy of 32 small files, so tasks are merged to at most
    ``TASKS_PER_CORE`` a core.
    """
    with folders_listed(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(as_list(paths))
    return (
        found.select(
            "path",
            base_name(F.col("path")).alias("name"),
            "length",
            "modificationTime",
            F.col("_metadata.file_path").alias("uri"),
        )
        .coalesce(listing_tasks(spark))
    )


def qualified(spark: SparkSession, path: str) -> str:
    """A path as listings show it: absolute, with its scheme, without a closing slash."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toString().rstrip("/")


def list_files(
    spark: SparkSession,
    directory: str,
    pattern: str = "",
    skip_ext: str = "",
    recursive: bool = False,
) -> DataFrame:
    """Regular files below ``directory``: ``(path, name, length, modificationTime)``.

    One level deep, unless ``recursive``; then ``name`` is the path below
    ``directory``. ``pattern`` and ``skip_ext`` look at the last part of the name.
    Order by ``name`` where name order matters; the listing itself is unordered.
    """
    files = scan_listing(spark, directory, recursive)
    if pattern:
        files = files.where(F.col("name").rlike(glob_to_regex(pattern)))
    if skip_ext.strip():
        files = files.where(~F.col("name").endswith(skip_ext))
    if recursive:
        below = len(qualified(spark, directory)) + 2
        files = files.withColumn("name", F.substr("path", F.lit(below)))
    return files.drop("uri")


def list_prefix(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Objects whose key below ``root`` starts with ``prefix``, at any depth.

    ``key`` is the name below ``root`` and ``name`` the key without the
    prefix. Only the deepest folder the prefix names is listed.
    """
    root = qualified(spark, root)
    folder = prefix.rpartition("/")[0]
    start = f"{root}/{folder}" if folder else root
    files = scan_listing(spark, start, recursive=True)
    keyed = files.withColumn("key", F.substr("path", F.lit(len(root) + 2)))
    return keyed.where(F.col("key").startswith(prefix)).select(
        "path",
        "key",
        relative_key(F.col("key"), prefix).alias("name"),
        "length",
        "modificationTime",
    )


#: Path schemes that tasks open by themselves; others are left to Spark's text source.
REACHED = ("", "file", "s3", "s3a", "gs", "hdfs")


def existing(spark: SparkSession, paths) -> list[str]:
    """Paths with wildcards resolved; one that does not exist is an error, as for Spark's own scans."""
    out = []
    for path in as_list(paths):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(hadoop):
            out.append(path)
            continue
        found = fs.globStatus(hadoop) or []
        if not len(found):
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
        out += [x.getPath().toString() for x in found]
    return out


def _bytes_conf(spark: SparkSession, key: str, default: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, default))


def split_sizes(spark: SparkSession, files: list[tuple[str, int]]) -> tuple[int, int]:
    """(bytes of a split, cost of opening a file) by the rule of Spark's own file scans."""
    most = _bytes_conf(spark, "spark.sql.files.maxPartitionBytes", "128m")
    cost = _bytes_conf(spark, "spark.sql.files.openCostInBytes", "4m")
    each = sum(size + cost for _, size in files) // max(spark.sparkContext.defaultParallelism, 1)
    return min(most, max(cost, each)), cost


def _as_lines(pieces: DataFrame) -> DataFrame:
    return pieces.select("file", "block_start", "row_id", F.col("bytes").cast("string").alias("value"), "scan_error")


def read_lines(
    spark: SparkSession,
    paths,
    separator: str,
    pattern: str = "",
    recursive: bool = False,
    sniff: bool = True,
) -> DataFrame:
    """Text between separators as ``(file, block_start, row_id, value, scan_error)``.

    Files are listed here, once; byte ranges of them are read in tasks, where the content
    tells gzip. No Spark job runs before the result is asked for. A file that cannot be
    read, because it went meanwhile, shrank or is corrupt, ends in a row with
    ``scan_error``; an empty file is one empty piece. ``(block_start, row_id)`` is the
    order inside a file.

    This is the data source of ``sources.lines`` as an operator: Spark does not share an
    exchange between two uses of a Python data source, and reports use a scan twice.
    ``sniff=False``, and file systems that tasks cannot open, take Spark's own text source,
    which trusts names.
    """
    return scan_lines(spark, paths, separator, pattern, recursive, sniff)[0]


def scan_lines(
    spark: SparkSession, paths, separator: str, pattern: str = "", recursive: bool = False, sniff: bool = True
) -> tuple[DataFrame, int | None]:
    """``read_lines`` and the number of files it is planned over, where known."""
    paths = as_list(paths)
    if not sniff or any(p.split(":", 1)[0] not in REACHED for p in paths if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", p)):
        return _read_by_name(spark, paths, separator, pattern, recursive), None
    files = tasks.list_inputs(found := existing(spark, paths), recursive)
    if pattern:
        named = tasks.name_test(glob_to_regex(pattern))
        files = [(p, n) for p, n in files if p in found or named(p.rsplit("/", 1)[-1])]
    parts = tasks.plan_ranges(files, *split_sizes(spark, files))
    schema = "ranges array<struct<path: string, uri: string, start: bigint, stop: bigint, size: bigint>>"
    # From one partition, a row each: every task gets one list of ranges.
    dealt = spark.createDataFrame([(x,) for x in parts], schema).coalesce(1).repartition(max(1, len(parts)))
    return _as_lines(dealt.mapInArrow(tasks.read_dealt(separator.encode()), lines.SCHEMA)), len(files)


def first_lines(spark: SparkSession, paths, having: str, recursive: bool = False) -> DataFrame:
    """The first line of each file in which a pattern is found, like ``read_lines``; the rest is not read."""
    lines.register(spark)
    options = {"paths": json.dumps(existing(spark, paths)), "recursive": str(recursive).lower(), "first": having}
    return _as_lines(spark.read.format(lines.Lines.name()).options(**options).load())


def _read_by_name(spark: SparkSession, paths: list[str], separator: str, pattern: str, recursive: bool) -> DataFrame:
    """``read_lines`` by Spark's text source; a file that goes meanwhile fails the job."""
    meta_path = F.col("_metadata.file_path")
    plain = (
        spark.read.option("lineSep", separator)
        .option("ignoreMissingFiles", "false")
        .option("recursiveFileLookup", str(recursive).lower())
        .text(paths)
    )
    if pattern:
        name = decoded(F.col("_metadata.file_name"))
        plain = plain.where(name_filter(pattern, name, decoded(meta_path), paths))
    return plain.select(
        meta_path.alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
        F.lit(None).cast("string").alias("scan_error"),
    )
