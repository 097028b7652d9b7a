"""SimHash groups, repeated passages, fingerprints."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opstrail.llm import fingerprints as fp
from opstrail.llm import simhash as sh
from opstrail.llm import substring_dedup as sd
from opstrail.llm.components import connected_components


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, bits=4):
    """Component number of each of distinct 64-bit values, by comparing all."""
    arr, label = np.array(values, np.uint64), list(range(len(values)))
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= bits):
            a, b = label[i], label[j]
            if a != b:
                label = [a if x == b else x for x in label]
    return label


def test_golay_table():
    assert sh.ERRORS.shape == (2048, 6)
    weights = np.bitwise_count(sh.ERRORS)
    assert weights.max() == 4 and (np.sort(weights, axis=1)[:, 0] <= 3).all()
    assert (sh._remainder(sh.ERRORS) == np.arange(2048)[:, None]).all()


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) << np.uint64(1)
    for n in range(5):
        flips = np.zeros(2000, np.uint64)
        for i in range(2000):
            for b in rng.choice(64, n, replace=False):
                flips[i] |= np.uint64(1) << np.uint64(b)
        a, b = (set(zip(*map(np.ndarray.tolist, sh.join_keys(x)), strict=True)) for x in (fps, fps ^ flips))
        assert len({place for _, place in a & b}) == 2000


@pytest.mark.parametrize("size", [300, 3000])
def test_dense_groups_like_brute_force(spark, size):
    rng = np.random.default_rng(size)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = set()
    while len(fps) < size:
        c = int(centre[rng.integers(5)])
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            c ^= 1 << int(b)
        fps.add(c)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = sh.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    got = {r.node: r.component for r in connected_components(spark, links).collect()}
    want = components(fps)
    groups = lambda label: sorted(sorted(signed[i] for i in range(size) if label(i) == x) for x in {label(i) for i in range(size)})
    assert groups(lambda i: got.get(signed[i], signed[i])) == groups(lambda i: want[i])


def test_simhash_of_odd_rows(spark, odd, none, rows):
    found = sh.near_duplicates(spark, odd).collect()
    fps = {t: plain_fingerprint(t) for _, t, *_ in rows}
    distinct = sorted(set(fps.values()))
    label = dict(zip(distinct, components(distinct), strict=True))
    low = {}
    for i, t, *_ in rows:
        if i is not None:
            low[label[fps[t]]] = min(low.get(label[fps[t]], i), i)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found)
    assert got == Counter((i, fps[t], low.get(label[fps[t]])) for i, t, *_ in rows)
    kept = sh.keep_one(spark, odd)
    assert kept.columns == odd.columns
    # One row of each component, though two may have the same smallest id.
    assert Counter(r.doc_id for r in kept.collect()) == Counter(low.get(x) for x in set(label.values()))
    assert sh.near_duplicates(spark, none).count() == 0 and sh.keep_one(spark, none).count() == 0


def test_one_row_is_kept_of_each_component(spark, odd, rows):
    own = [(None, "alone " + "a b c d e " * 9, "en", "s", 1), (None, "quite another text of words " * 7, "en", "s", 1)]
    own += [own[0], (106, rows[1][1], "en", "s9", 1), (106, None, "en", "s9", 1)]
    every = [*rows, *own]
    docs = odd.unionByName(spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    fps = {t: plain_fingerprint(t) for _, t, *_ in every}
    distinct = sorted(set(fps.values()))
    group = dict(zip(distinct, components(distinct), strict=True))
    first = {}
    for i, t, *_ in every:
        key = (i is None, i or 0, hashlib.md5((t or "").encode()).digest())
        first[group[fps[t]]] = min(first.get(group[fps[t]], key), key)
    kept = sh.keep_one(spark, docs).collect()
    got = Counter((group[fps[r.text]], (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).digest())) for r in kept)
    assert got == Counter(first.items())
    assert sum(r.doc_id is None for r in kept) == 3 and sum(r.doc_id == 106 for r in kept) == 2


def test_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def plain_removal(texts, k):
    words = [(t or "").encode().split() for t in texts]
    grams = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for j in range(k)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_passages_of_odd_rows(spark, odd, none, rows):
    got = sd.remove_repeats(spark, odd).collect()
    have = Counter((r.doc_id, r.n_words, sum(x["end"] - x["start"] for x in r.removed), r.kept_text) for r in got)
    assert have == Counter((i, *x) for (i, *_), x in zip(rows, plain_removal([t for _, t, *_ in rows], 35), strict=True))
    assert sd.remove_repeats(spark, none).count() == 0


@pytest.mark.parametrize("shard_bytes, partitions", [(500, 100), (500, 3), (1, 2)])
def test_passages_across_batches(spark, monkeypatch, shard_bytes, partitions):
    """Many batches, one or several a partition, and shards that most batches have no hash of."""
    monkeypatch.setattr(sd, "BATCH_BYTES", 300)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(sd, "MOST_PARTITIONS", partitions)
    rng = random.Random(4)
    shared = [f"w{rng.randint(0, 9)}" for _ in range(40)]
    texts = []
    for _ in range(80):
        w = [f"w{rng.randint(0, 200)}" for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            at, n = rng.randint(0, len(w)), rng.randint(3, 30)
            w[at:at] = shared[rng.randint(0, 10) :][:n]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, sum(x["end"] - x["start"] for x in r.removed), r.kept_text) for r in sd.remove_repeats(spark, df, 6).collect()}
    assert got == dict(enumerate(plain_removal(texts, 6)))


def test_cells_round_trip():
    rng = np.random.default_rng(1)
    h, c = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * 2), rng.integers(0, 1 << 24, 1000, dtype=np.uint64)
    back = sd._unpack(sd._pack(h, c))
    assert (back[0] == h).all() and (back[1] == c).all()


def plain_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(fp.GEAR[b])) % (1 << 32)
        out.append(h)
    return out


def test_gear_hash_rolls():
    data = np.random.default_rng(3).integers(0, 256, 500, dtype=np.uint8)
    assert fp.gear_hashes(data).tolist() == plain_gear(data)


def test_chunk_lengths_and_shift():
    text = np.random.default_rng(5).integers(97, 123, 40_000, dtype=np.uint8)
    ends = fp.boundaries(text)
    lengths = np.diff([0, *ends])
    assert ends[-1] == len(text) and lengths[:-1].min() >= fp.LEAST and lengths.max() <= fp.MOST
    a, b = fp.chunks(text.tobytes()), fp.chunks(b"inserted" + text.tobytes())
    assert fp.containment(a, b) > 0.98 and fp.containment(a, a) == 1.0
    assert fp.containment({}, {}) == 1.0 and fp.containment({}, a) == 0.0


def by_id_and_mark(row):
    """Descending ids, nulls last; then the text's hash."""
    text = (row[1] or "").encode()
    mark = xxhash.xxh64_intdigest(text, 42)
    return row[0] is None, -(row[0] or 0), mark - (1 << 64) * (mark >> 63), text


def plain_chunks(text):
    """Cut byte by byte: a boundary by the strict test up to the normal length, by the loose one after."""
    out, start, hashes = [], 0, plain_gear(text)
    for i in range(len(text)):
        size = i + 1 - start
        bits = fp.STRICT if size <= fp.NORMAL else fp.LOOSE
        if size >= fp.LEAST and (hashes[i] >> (32 - bits) == 0 or size == fp.MOST):
            out.append(text[start : i + 1])
            start = i + 1
    return [*out, text[start:]] if start < len(text) else out


def plain_likeness(a, b):
    a, b = ({xxhash.xxh3_64_digest(c): len(c) for c in plain_chunks(x)} for x in (a, b))
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def test_boundaries_like_byte_by_byte():
    rng = random.Random(6)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 15, 16, 17, 18, 64, 255, 256, 257, 300, *range(400, 3000, 130)]]
    texts += [b"a" * 2_000, b"ab" * 700, "ünï çødé ".encode() * 200, " ".join(f"w{rng.randrange(300)}" for _ in range(3_000)).encode()]
    for t in texts:
        assert fp.boundaries(np.frombuffer(t, np.uint8)) == np.cumsum([len(c) for c in plain_chunks(t)]).tolist()
    for a in texts[-6:]:
        for b in (*texts[-6:], a[7:], a[: len(a) // 2] + texts[-1]):
            assert fp.containment(fp.chunks(a), fp.chunks(b)) == pytest.approx(plain_likeness(a, b))


def test_fingerprints_of_odd_rows(spark, odd, none, rows):
    got = fp.compare_with_next(spark, odd).collect()
    order = sorted(rows, key=by_id_and_mark)
    texts = [r[1] or "" for r in order]
    want = Counter()
    for n, r in enumerate(order):
        text, after = texts[n], texts[(n + 1) % len(texts)]
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        near = plain_likeness(text.encode(), edited), plain_likeness(text.encode(), after.encode())
        prints = (",".join(sorted({f"{xxhash.xxh3_64_hexdigest(c)}:{len(c)}" for c in plain_chunks(x)})) for x in (text.encode(), edited))
        want[r[0], len(text), hashlib.sha256(edited).hexdigest(), *prints, *near] += 1
    names = "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert fp.compare_with_next(spark, none).count() == 0


def test_next_across_blocks(spark):
    rng = random.Random(8)
    ids = rng.sample(range(-5000, 5000), 300) + [1 << 40, -(1 << 50)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.next for r in fp.with_next(spark, df).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"t{down[(n + 1) % len(down)]}" for n, i in enumerate(down)}


def test_crowded_ids_are_dealt_out(spark, monkeypatch):
    """Rows without id, and rows of one id, meet in many blocks and keep their order."""
    monkeypatch.setattr(fp, "CROWD", 50)
    rows = [(None, f"n{i}") for i in range(900)] + [(300, f"t{i}") for i in range(700)] + [(i, f"s{i}") for i in range(0, 3000, 7)]
    rows += [(None, "n1"), (300, "t1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = fp.with_next(spark, df)
    order = sorted(rows, key=by_id_and_mark)
    assert Counter(map(tuple, found.collect())) == Counter((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
    monkeypatch.undo()
    many = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").cast("string").alias("text"))
    marked = many.withColumns({"wide": fp.wide_block(F.col("doc_id")), "mark": F.xxhash64("text")})
    per_block = marked.groupBy(fp.block_of([-(1 << 63)]).alias("block")).count().collect()
    assert len(per_block) == 1 << fp.MARK_BITS and max(r["count"] for r in per_block) < 60
    assert fp.with_next(spark, many).count() == 20_000
