"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

1. Documents are dealt into batches of about ``BATCH_BYTES`` by a hash of id and text.
2. Each batch hashes every window of ``WINDOW`` words with two rolling polynomials and
   sends, to each shard of the hash space, its distinct hashes in one packed cell:
   64 bits of the first hash in order, 24 of the second.
3. Each shard counts: for every hash of every cell, does another batch hold it too? The
   answer goes back as one bit per hash, so shards never send hashes.
4. Each batch hashes its windows again, marks those that it holds twice itself or whose
   bit is set, and merges marked windows into maximal intervals.

The text is shuffled once (steps 2 and 4 read one exchange) and a window costs eleven
bytes, or a bit, in the others. A passage in a third of all documents is one entry per
batch. Batches and shards are bounded by their byte targets, not by any key: both keys
are hashes. There are at most ``MOST_PARTITIONS`` partitions of texts, each read batch by batch,
and a batch visits just the shards its own hashes fall in: on inputs so large that a batch has
about one hash a shard, the cells become a row per window, and the work stays that of
the windows. Raise ``BATCH_BYTES`` with the executors' memory to keep cells long. Two windows count as equal if 88 bits agree; among 1.6e13 windows (100 TB)
less than one pair is expected to do so by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import batches_for, table, whole

WINDOW = 35
BATCH_BYTES = 8 << 20
SHARD_BYTES = 32 << 20
#: Bases of the two polynomials, any odd numbers.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Shuffle partitions of the texts; with more batches than that a partition holds several, one in memory at a time.
MOST_PARTITIONS = 20_000
#: Words whose hash a task remembers.
REMEMBERED = 500_000


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class WindowHashes:
    """Rolling hashes of the word windows of texts, with what a task can reuse between them."""

    def __init__(self, window: int):
        self.window = window
        self.known: dict[bytes, int] = {}
        self.forward = self.back = None

    def words(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        """The words and their two hashes (n x 2). bytes.split() knows just the six ASCII spaces."""
        w = text.split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for x in set(w):
            if x not in known:
                known[x] = xxhash.xxh3_128_digest(x)
        joined = b"".join([known[x] for x in w])
        return w, np.frombuffer(joined, np.uint64).reshape(-1, 2)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """(m x 2): hash of the window that starts at each word."""
        n, k = len(hashes), self.window
        if n < k:
            return np.empty((0, 2), np.uint64)
        if self.forward is None or len(self.forward) <= n:
            size = 2 * n + k
            self.forward = np.stack([_powers(b, size) for b in BASES], axis=1)
            self.back = np.stack([_powers(pow(b, -1, 1 << 64), size) for b in BASES], axis=1)
        sums = np.zeros((n + 1, 2), np.uint64)
        np.cumsum(hashes * self.forward[:n], axis=0, out=sums[1:])
        return (sums[k:] - sums[:-k]) * self.back[: n - k + 1]


def _batch_hashes(texts: pa.ChunkedArray, roll: WindowHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All window hashes of a batch: (hash, check, windows of each text); check has 24 bits."""
    each = [roll(roll.words(t.as_py() or b"")[1]) for t in texts]
    both = np.concatenate(each) if each else np.empty((0, 2), np.uint64)
    return both[:, 0], both[:, 1] >> np.uint64(40), np.array([len(x) for x in each], np.int64)


def _distinct(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, entry, starts): an order by (h, c), the entry each ordered row falls in, and where entries start."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    # Equal hashes with other checks are so rare that only then both columns are sorted.
    if np.any((s[1:] == s[:-1]) & (c[order][1:] != c[order][:-1])):
        order = np.lexsort((c, h))
        s = h[order]
    k = c[order]
    new = np.concatenate((np.ones(min(len(s), 1), bool), (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _pack(h: np.ndarray, c: np.ndarray) -> bytes:
    """Entries in order: byte planes, so that the slowly growing high bytes compress."""
    a = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    b = c.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    return np.concatenate((a, b), axis=1).T.tobytes()


def _unpack(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(cell, np.uint8).reshape(11, -1).T
    h = np.ascontiguousarray(planes[:, :8]).view(">u8").ravel().astype(np.uint64)
    c = np.zeros((len(planes), 4), np.uint8)
    c[:, 1:] = planes[:, 8:]
    return h, c.view(">u4").ravel().astype(np.uint64)


def _parts(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, edges): which of two shards or more ordered hashes fall in, and where each one's part starts, with the end.

    The work is that of the hashes, however many shards there are.
    """
    if not len(h):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    shard = (h // np.uint64(-(-(1 << 64) // shards))).astype(np.int64)
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return shard[starts], np.append(starts, len(h))


def _senders(window: int, shards: int):
    def run(batch: pa.Table) -> pa.Table:
        h, c, _ = _batch_hashes(batch.column("body"), WindowHashes(window))
        order, _, starts = _distinct(h, c)
        h, c = h[order][starts], c[order][starts]
        full, edges = _parts(h, shards)
        number = batch.column("batch")[0].as_py()
        return pa.table(
            {
                "shard": pa.array(full, pa.int32()),
                "batch": pa.array([number] * len(full), pa.int32()),
                "cell": pa.array([_pack(h[a:b], c[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            }
        )

    return run


def _count(shard: pa.Table) -> pa.Table:
    """Which entries of each cell another batch holds too, as packed bits."""
    cells = [_unpack(x.as_py()) for x in shard.column("cell")]
    sizes = [len(h) for h, _ in cells]
    h, c = (np.concatenate([x[i] for x in cells]) for i in (0, 1))
    order, entry, starts = _distinct(h, c)
    again = np.empty(len(h), bool)
    again[order] = np.diff(np.append(starts, len(h)))[entry] > 1
    bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
    return pa.table({"shard": shard.column("shard"), "batch": shard.column("batch"), "bits": pa.array(bits, pa.binary())})


def _intervals(marked: np.ndarray, window: int) -> np.ndarray:
    """Maximal (start, end) word intervals covered by the marked windows, in order."""
    at = np.flatnonzero(marked)
    if not len(at):
        return np.empty((0, 2), np.int64)
    apart = np.flatnonzero(at[1:] > at[:-1] + window)
    return np.stack([at[np.append(0, apart + 1)], at[np.append(apart, len(at) - 1)] + window], axis=1)


def _cutters(window: int, shards: int):
    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        roll = WindowHashes(window)
        h, c, sizes = _batch_hashes(docs.column("body"), roll)
        order, entry, starts = _distinct(h, c)
        again = np.diff(np.append(starts, len(h))) > 1
        full, edges = _parts(h[order][starts], shards)
        answered = np.searchsorted(full, bits.column("shard").to_numpy())
        for a, b, cell in zip(edges[answered], edges[answered + 1], bits.column("bits").to_pylist(), strict=True):
            again[a:b] |= np.unpackbits(np.frombuffer(cell, np.uint8), count=b - a).astype(bool)
        marked = np.zeros(len(h), bool)
        marked[order] = again[entry]
        ends = np.cumsum(sizes)
        words, cuts, kept = [], [], []
        for text, size, end in zip(docs.column("body"), sizes, ends, strict=True):
            w = (text.as_py() or b"").split()
            spans = _intervals(marked[end - size : end], window)
            rest, at = [], 0
            for s, e in spans.tolist():
                rest += w[at:s]
                at = e
            words.append(len(w))
            cuts.append([{"start": s, "end": e} for s, e in spans.tolist()])
            kept.append(b" ".join(rest + w[at:]))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(words, pa.int64()),
                "removed": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (maximal word intervals) and kept_text of every row of ``docs``.

    A word goes if a window of ``window`` words that covers it starts anywhere else too, in
    the same or another row; windows are judged on the input. So both of two repeated rows
    lose their words. Null and empty texts, and those shorter than a window, lose none; a
    null doc_id is a row like any other.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    batches = batches_for(spark, size, BATCH_BYTES)
    shards = batches_for(spark, 2 * size, SHARD_BYTES)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "body"), F.lit(batches)).cast("int"))
    dealt = dealt.repartition(min(batches, MOST_PARTITIONS), "batch")
    cells = dealt.groupBy("batch").applyInArrow(_senders(window, shards), "shard int, batch int, cell binary")
    bits = cells.groupBy("shard").applyInArrow(_count, "shard int, batch int, bits binary")
    return (
        dealt.groupBy("batch")
        .cogroup(bits.groupBy("batch"))
        .applyInArrow(
            _cutters(window, shards),
            "doc_id bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string",
        )
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every row of ``documents``, and the digest of the rest."""
    done = remove_repeats(spark, table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_OP5 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
one AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
starts AS (SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
grams AS (SELECT s.rid, s.i, sha256(array_to_string(d.w[s.i : s.i + {WINDOW - 1}], ' ')) AS g FROM starts s JOIN d USING (rid)),
marked AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM grams) WHERE c > 1),
near AS (SELECT o.rid, o.i, o.word, max(m.i) OVER (PARTITION BY o.rid ORDER BY o.i) AS last
  FROM one o LEFT JOIN marked m ON o.rid = m.rid AND o.i = m.i),
per AS (SELECT rid, count(*) FILTER (last > i - {WINDOW}) AS n_removed,
  string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - {WINDOW}) AS kept FROM near GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (rid)
"""
