"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its low bits are zero.
Chunking is normalised: before ``NORMAL`` bytes a boundary needs two bits more than
average, after it two bits less, so chunk lengths gather around ``NORMAL``, between
``LEAST`` and ``MOST``. An insertion moves boundaries only until the next one that both
texts share. A fingerprint is the set of chunk digests with their lengths; the likeness
of one to another is the share of its bytes in chunks that the other has too:
containment, weighted by length. Two empty texts are alike, an empty one and another not.

A null text is empty. Texts are read whole; a task holds one text's hashes at a time. Repeated
rows are neighbours of each other, an empty table gives no rows, other columns are not
carried and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opstrail.llm.common import stored, table, whole

LEAST, NORMAL, MOST = 16, 64, 256
#: Bits that must be zero before and after the normal length.
STRICT, LOOSE = 8, 4
#: Ids per block of neighbours; see ``with_next``.
BLOCK_BITS = 8
#: Rows a block may hold however few there are, and into how many parts an id's rows are dealt beyond.
CROWD, MARK_BITS = 4096, 10
#: Fixed value: the seed of the gear table, one random number per byte.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: each byte's number, shifted left once per later byte.

    32 bits forget a byte after 32 steps, so five doublings of the reach give all hashes at once."""
    h = GEAR[data]
    reach = 1
    while reach < 32:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = more, reach * 2
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes, the last one included."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    # High bits have seen most bytes.
    h = gear_hashes(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0) + 1
    strict = loose[h[loose - 1] >> np.uint32(32 - STRICT) == 0]
    loose, strict = loose.tolist(), strict.tolist()
    ends, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        while i < len(strict) and strict[i] < at + LEAST:
            i += 1
        if i < len(strict) and strict[i] <= at + NORMAL:
            end = strict[i]
        else:
            while j < len(loose) and loose[j] <= at + NORMAL:
                j += 1
            end = min(loose[j] if j < len(loose) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(text: bytes) -> dict[bytes, int]:
    """Digest (8 bytes) and length of the distinct chunks, in order of first appearance."""
    out, at = {}, 0
    for end in boundaries(np.frombuffer(text, np.uint8)):
        out[xxhash.xxh3_64_digest(text[at:end])] = end - at
        at = end
    return out


def written(found: dict[bytes, int]) -> str:
    """digest:length of each chunk, in order of digest, comma-joined."""
    return ",".join(f"{d.hex()}:{n}" for d, n in sorted(found.items()))


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """The share of the bytes of ``a``'s distinct chunks that lie in chunks of ``b`` too."""
    if not a:
        return float(not b)
    return sum(a[d] for d in a.keys() & b.keys()) / sum(a.values())


def edit(text: str, after: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, body and the next document's body, in descending order of doc_id.

    Rows of one id, and rows without one, which come last, follow in order of a hash of the
    text; the last row is followed by the first. Rows are dealt into blocks of 2 **
    BLOCK_BITS ids. A block that holds more than ``CROWD`` rows and a thousandth of all (rows
    without id, an id that repeats) is dealt further, by id and by ranges of that hash. Texts
    are shuffled once, by block, and meet their successor in it; only the first text of each
    block is sent on, to the block before. Which block that is comes from ids and hashes alone.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("body"))
    rows = rows.withColumns({"wide": wide_block(F.col("doc_id")), "mark": F.xxhash64("body")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.select(wide_block(F.col("doc_id").cast("bigint")).alias("wide")).groupBy("wide").agg(F.count("*").alias("n"))
    counts = stored(spark, counts, "block-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Fewer than a thousand blocks can hold over a thousandth.
    crowded = [r["wide"] for r in counts.filter(F.col("n") > max(CROWD, total // 1000)).collect()]
    blocked = rows.withColumn("block", block_of(crowded))
    dealt = blocked.drop("wide").repartition(parts, "block")
    ids = blocked.select("block").distinct() if crowded else counts.select(block_of([]).alias("block"))
    order = F.col("doc_id").desc_nulls_last(), "mark", "body"
    heads = (
        dealt.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy(*order)))
        .filter("n = 1")
        .select(F.col("block").alias("from"), F.col("body").alias("guest"))
    )
    targets = followed(spark, ids).withColumnRenamed("block", "target")
    guests = heads.join(targets, F.col("from") == F.col("follower")).select("target", "guest")
    inside = dealt.withColumn("later", F.lead("body").over(Window.partitionBy("block").orderBy(*order)))
    met = inside.join(guests, F.col("block") == F.col("target"), "left")
    return met.select("doc_id", "body", F.coalesce("later", "guest").alias("next"))


def wide_block(doc_id: Column) -> Column:
    """The block of an id; rows without one have a block below all others."""
    return F.coalesce(F.shiftright(doc_id, BLOCK_BITS), F.lit(-(1 << 63)))


def _digits(x: Column) -> Column:
    """16 hex digits of a whole number, in the numbers' order."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def block_of(crowded: list[int]) -> Column:
    """The block of a row by its wide block, and in ``crowded`` ones by id and the hash's first bits, as
    text: a plain column, so that Spark reads one exchange twice. Later blocks come first in its order."""
    if not crowded:
        return _digits(F.col("wide"))
    further = F.concat(_digits(F.coalesce("doc_id", F.lit(0).cast("bigint"))), _digits(-F.shiftright("mark", 64 - MARK_BITS)))
    return F.concat(_digits(F.col("wide")), F.when(F.col("wide").isin(crowded), further).otherwise(""))


def followed(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """block and follower, the block that comes next in descending order, the first after the last.

    Blocks are sorted in ranges; each range finds followers inside, and between ranges only
    the first block of each, one row per range, is looked at together."""
    down = F.col("block").desc()
    placed = stored(spark, blocks.repartitionByRange(down).withColumn("part", F.spark_partition_id()), "block-order")
    near = Window.partitionBy("part").orderBy(down)
    inside = placed.withColumns({"n": F.row_number().over(near), "after": F.lead("block").over(near)})
    firsts = inside.filter("n = 1").select("part", F.col("block").alias("head"))
    parts = Window.orderBy("part")
    across = firsts.select(
        F.col("part").alias("part_"),
        F.coalesce(
            F.lead("head").over(parts),
            F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("head"),
    )
    both = inside.join(across, F.col("part") == F.col("part_"))
    return both.select("block", F.coalesce("after", "head").alias("follower"))


def _compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for part in parts:
        out = [[] for _ in names[1:]]
        for text, after in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            changed = edit(text, after).encode()
            own, other, later = chunks(text.encode()), chunks(changed), chunks(after.encode())
            row = (
                len(text),
                hashlib.sha256(changed).hexdigest(),
                written(own),
                written(other),
                containment(own, other),
                containment(own, later),
            )
            for column, v in zip(out, row, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out)], names)


def compare_with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its text edited with the next document's, and both likenesses.

    A null text is empty. With a single row, that row is its own next."""
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(spark, docs).mapInArrow(_compared, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of every row of ``documents``."""
    return compare_with_next(spark, table(spark, sf_dir, "documents"))
