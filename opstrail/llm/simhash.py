"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is split into segments of 22, 21 and 21 bits, each read
as a 23-bit word of the binary Golay code. That code is perfect: every word has
exactly one codeword within 3 bits. All codewords within 4 bits are one or six;
their 12-bit indices are the segment's keys. Two words up to 2 bits apart have a
word midway whose codeword lies within 4 bits of both, so they share a key.

Pigeonhole for at most ``MAX_BITS`` = 4 differing bits over three segments: either
a segment is equal and a second one differs in at most 2 bits, or no segment is
equal, and then each differs in at most 2. So the join keys are (equal segment,
Golay key of another) for the six ordered pairs, and the Golay keys of all three.
These have 33 to 36 bits, so unrelated fingerprints rarely meet. Rows that meet are
verified on all 64 bits, inside their key's run, and only links that join two
so far unconnected parts of a run are written: at most one per row and key.

Equal fingerprints are one row before any key is made, so copies cost nothing
further and a hot group of copies is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import free_name, stored, table, whole
from opstrail.llm.components import connected_components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Generator polynomial of the binary Golay code and the segments (shift, bits).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows taken into memory at once when runs of equal keys are compared.
ROWS_AT_ONCE = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text; zero without words."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(w) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    # Blocks bound the memory a very long text takes.
    for at in range(0, len(starts), 50_000):
        h = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 50_000], stops[at : at + 50_000], strict=True)),
            np.uint64,
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            carried = {n: part.column(n) for n in part.schema.names[2:]}
            made = {"doc_id": part.column(0), "fp": pa.array(found.view(np.int64)), **carried}
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return run


def text_digest(docs: DataFrame) -> Column:
    """16 bytes that tell texts apart; a null text counts as empty."""
    return F.unhex(F.md5(whole(docs["text"]).cast("binary")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row, and the text's digest if wanted; a null text counts as empty."""
    rows = docs.select(
        F.col("doc_id").cast("bigint"), whole(F.col("text")).alias("text"), *([text_digest(docs).alias("digest")] if digest else [])
    )
    return rows.mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint" + (", digest binary" if digest else ""))


def _remainder(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome of 23-bit words: the rest after division by the generator."""
    rest = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return rest


def _error_table() -> np.ndarray:
    """For each syndrome the patterns of at most 4 bits that have it, 6 at most; unused places repeat the first."""
    patterns = np.array(
        [sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)], np.uint32
    )
    syndromes = _remainder(patterns)
    order = np.argsort(syndromes, kind="stable")
    patterns, syndromes = patterns[order], syndromes[order]
    first = np.searchsorted(syndromes, np.arange(2048))
    count = np.searchsorted(syndromes, np.arange(2048), side="right") - first
    place = np.arange(6)[None, :]
    return patterns[first[:, None] + np.where(place < count[:, None], place, 0)]


ERRORS = _error_table()


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fresh): six codeword indices of each 23-bit word, and which of them are no repeats."""
    near = words[:, None] ^ ERRORS[_remainder(words)]
    keys = near >> np.uint32(11)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :1]
    return keys.astype(np.uint64), fresh


def join_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in ``fp``) of all join keys; the kind of key is in its top bits."""
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)) for s, n in SEGMENTS]
    golay = [segment_keys(p.astype(np.uint32)) for p in parts]
    out, places = [], []
    where = np.arange(len(fp))

    def emit(kind: int, key: np.ndarray, fresh: np.ndarray, place: np.ndarray) -> None:
        out.append(((np.uint64(kind) << np.uint64(40)) | key)[fresh])
        places.append(np.broadcast_to(place, fresh.shape)[fresh])

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                keys, fresh = golay[j]
                emit(kind, (parts[i][:, None] << np.uint64(12)) | keys, fresh, where[:, None])
                kind += 1
    (a, fa), (b, fb), (c, fc) = golay
    key = (a[:, :, None, None] << np.uint64(24)) | (b[:, None, :, None] << np.uint64(12)) | c[:, None, None, :]
    fresh = fa[:, :, None, None] & fb[:, None, :, None] & fc[:, None, None, :]
    emit(kind, key, fresh, where[:, None, None, None])
    return np.concatenate(out), np.concatenate(places)


def _keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        fps = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 1000):
            block = fps[at : at + 1000]
            keys, places = join_keys(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(block[places].view(np.int64))], ["key", "fp"]
            )


def _linked_run(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the distinct fingerprints of one run into the components they form within it.

    Each pivot is compared with the whole run at once. Pivots stop when all rows outside
    the largest component have been one: any link between two components has an end there.
    So a dense group costs a few passes, and the pairs inside it are never listed.
    """
    n = len(fp)
    label = np.arange(n)
    done = np.zeros(n, bool)
    links: list[tuple[int, int]] = []
    ones = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    middle = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    pivot = int(np.argmin(np.bitwise_count(fp ^ middle)))
    while True:
        done[pivot] = True
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[pivot]) <= max_bits)
        groups, first = np.unique(label[near], return_index=True)
        if len(groups) > 1:
            own = label[pivot]
            links += [(int(fp[pivot]), int(fp[near[f]])) for g, f in zip(groups, first, strict=True) if g != own]
            label[np.isin(label, groups)] = own
        values, counts = np.unique(label, return_counts=True)
        rest = np.flatnonzero(~done & (label != values[np.argmax(counts)]))
        if not len(rest):
            return links
        pivot = int(rest[0])


def _links_of(key: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Links (n x 2) within runs of equal keys; rows come sorted by key and have no doubles."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    of = np.repeat(np.arange(len(starts)), sizes)
    head = fp[starts[of]]
    near = np.bitwise_count(fp ^ head) <= max_bits
    # Runs wholly linked to their first row, most of them, and runs of two, need no more.
    odd = np.bincount(of, weights=~near, minlength=len(starts)) > 0
    simple = near & ~odd[of] & (fp != head)
    out = [np.stack([head[simple], fp[simple]], axis=1)]
    for run in np.flatnonzero(odd & (sizes > 2)):
        links = _linked_run(fp[starts[run] : starts[run] + sizes[run]], max_bits)
        if links:
            out.append(np.array(links, np.uint64))
    return np.concatenate(out)


def _linker(max_bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            found = np.sort(_links_of(key, fp, max_bits), axis=1)
            found = np.unique(found, axis=0) if len(found) else found
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"]
            )

        for part in parts:
            keys.append(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            fps.append(part.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(part)
            if held >= ROWS_AT_ONCE:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = np.searchsorted(key.view(np.int64), key.view(np.int64)[-1])  # the last run may go on
                if cut:
                    yield links(key[:cut], fp[:cut])
                keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
        if held:
            yield links(np.concatenate(keys), np.concatenate(fps))

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp``; their components are
    those of all pairs at most ``max_bits`` apart. ``max_bits`` is 4 or less."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be from 0 to {MAX_BITS}: the keys promise no more")
    keyed = fps.select("fp").mapInArrow(_keyed, "key bigint, fp bigint")
    runs = keyed.repartition("key").sortWithinPartitions("key")
    return runs.mapInArrow(_linker(max_bits), "a bigint, b bigint").distinct()


def with_component(spark: SparkSession, distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``distinct``, a row for each ``fp``, with ``component``: the smallest fingerprint reachable over links."""
    parts = connected_components(spark, link_fingerprints(distinct, max_bits))
    found = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    return found.withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, null ids aside; it is null
    only if a component has null ids alone. Texts without words have fingerprint zero and
    are linked like others. Repeated rows and ties share a component. Components with null
    ids alone, or with the same smallest id, share a component_id without being one.
    """
    rows = stored(spark, fingerprints(docs, shingle), "simhash-rows")
    distinct = stored(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    known = with_component(spark, distinct, max_bits)
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    member = known.join(lowest, "component").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id, null ids last.

    Rows without words share a fingerprint and so are one group. Of different texts under
    that id in one component the one of the smallest digest stays, and of rows equal in id
    and text one. Each component keeps its own row, whatever ids other components have.
    """
    at, id_, body, kept_body = (free_name(docs, n) for n in ("row_at", "row_id", "row_digest", "kept_digest"))
    rows = stored(spark, fingerprints(docs, shingle, digest=True), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    distinct = stored(spark, rows.groupBy("fp").agg(first.alias("low")), "simhash-distinct")
    low = with_component(spark, distinct, max_bits).groupBy("component").agg(F.min("low").alias("low"))
    repeated = rows.groupBy("doc_id", "digest").count().filter("count > 1")
    many = repeated.select(F.col("doc_id").alias("again"), F.col("digest").alias("again_digest"))
    kept = low.select(F.col("low.doc_id").alias(id_), F.col("low.digest").alias(kept_body))
    kept = kept.join(many, F.col(id_).eqNullSafe(F.col("again")) & (F.col(kept_body) == F.col("again_digest")), "left")
    kept = stored(spark, kept.select(id_, kept_body, F.col("again_digest").isNotNull().alias(at)), "simhash-kept")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(body) == F.col(kept_body))
    read = docs.withColumn(body, text_digest(docs))
    once = read.join(kept.filter(~F.col(at)), same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    rest = kept.filter(F.col(at))
    if rest.isEmpty():
        return once
    # Rows equal in id and text: one for each such pair, the same one in every run.
    again = read.join(rest, same, "left_semi")
    one = again.groupBy("doc_id", body).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(at))
    return once.unionByName(one.select(f"{at}.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
