"""Large files as byte ranges: digests as a tree, copies by many tasks, differences named by range.

A file is a row of leaves of ``LEAF_BYTES``; a node is the SHA-256 of the hex digests of its two
children, and a node without a sibling stands for itself one level up. A range holds a power of two of
leaves, so its digest is a node of its file's tree, and a file's root does not depend on the
length of the ranges or on how many tasks read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opstrail import tasks

LEAF_BYTES = 1 << 20
RANGE_BYTES = 128 << 20
_RANGE = "path string, name string, length long, nth long, start long, end long, digest string, error string"


def byte_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``(path, name, length, nth, start, end)`` of each range of each listed file; an empty file has one empty range."""
    leaves = range_bytes // leaf_bytes
    if leaves < 1 or leaves * leaf_bytes != range_bytes or leaves & (leaves - 1):
        raise ValueError(f"a range is a power of two of leaves: {range_bytes} / {leaf_bytes}")
    size = F.lit(range_bytes).cast("long")
    last = F.call_function("div", F.greatest(F.col("length"), F.lit(1)) - 1, size)
    nth = F.explode(F.sequence(F.lit(0).cast("long"), last))
    rows = files.select("path", "name", F.col("length").cast("long").alias("length"), nth.alias("nth"))
    start = F.col("nth") * size
    return rows.select("*", start.alias("start"), F.least(start + size, F.col("length")).alias("end"))


def spread_ranges(ranges: DataFrame, tasks_wanted: int) -> DataFrame:
    """Ranges dealt out by path and number, so that those of one file are read by many tasks."""
    return ranges.repartition(tasks_wanted, "path", "nth")


def digest_ranges(ranges: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Adds ``digest``, the tree node of each range, and ``error`` of those that could not be read."""
    return ranges.mapInArrow(tasks.digest_byte_ranges(leaf_bytes), _RANGE)


def copy_ranges(ranges: DataFrame, dest: str, run: str, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Write each range at its place in ``dest``, in a hidden file of ``run``; digests are of the bytes written.

    A repeated task writes the same bytes at the same place. ``dest`` must be a file system that
    takes writes at a position (local or mounted); others raise. Write the result as a table, then
    ``finish_copies`` shows the files.
    """
    if tasks.local_path(dest) is None:
        raise ValueError(f"ranges need a file system with writes at a position: {dest}")
    return ranges.mapInArrow(tasks.copy_byte_ranges(dest.rstrip("/"), run, leaf_bytes), _RANGE)


def _one_level(nodes: Column) -> Column:
    def parent(i: Column) -> Column:
        left, right = F.get(nodes, i * 2), F.get(nodes, i * 2 + 1)
        return F.coalesce(F.sha2(F.concat(left, right).cast("binary"), 256), left)

    pairs = F.call_function("div", F.size(nodes) + 1, F.lit(2)).cast("int")
    return F.transform(F.sequence(F.lit(0), pairs - 1), parent)


def file_digests(ranges: DataFrame) -> DataFrame:
    """``(path, name, length, n_ranges, tree, error)`` per file from its ranges' digests.

    A file's group is a digest for each of its ranges, some 600 KB a TB. ``tree`` is NULL if any range failed.
    """
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("nth", "digest"))), lambda x: x["digest"])
    files = ranges.groupBy("path", "name", "length").agg(
        F.count("*").alias("n_ranges"), nodes.alias("nodes"), F.min("error").alias("error")
    )
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n_ranges"))).cast("int"))
    root = F.get(F.aggregate(levels, F.col("nodes"), lambda a, _: _one_level(a)), 0)
    tree = F.when(F.col("error").isNull(), root)
    return files.select("path", "name", "length", "n_ranges", tree.alias("tree"), F.coalesce("error", F.lit("")).alias("error"))


def finish_copies(copied: DataFrame, dest: str, run: str) -> DataFrame:
    """Show the files whose ranges were all written: ``(path, name, ok, error, bytes, tree)``.

    A file with a failed range does not appear. Renaming twice does no harm.
    """
    return file_digests(copied).mapInArrow(
        tasks.show_copies(dest.rstrip("/"), run),
        "path string, name string, ok boolean, error string, bytes long, tree string",
    )


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(name, nth, start, end)`` of the ranges whose digests differ or that one side lacks."""
    a, b = (
        side.select("name", "nth", F.struct("start", "end").alias(f"{s}_span"), F.col("digest").alias(f"{s}_digest"))
        for s, side in (("a", left), ("b", right))
    )
    both = a.join(b, ["name", "nth"], "full").where(~F.col("a_digest").eqNullSafe(F.col("b_digest")))
    return both.select("name", "nth", F.coalesce("a_span", "b_span").alias("span")).select("name", "nth", "span.*")
