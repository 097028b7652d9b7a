"""Exact top-k by inner product: vectors in order of length, rotated partial sums, residual bounds.

1. Equal rows (id and vector) become one with a count; each vector's length is taken.
2. The Gram matrix of all vectors, summed in Spark, gives a rotation that puts most of
   every vector into its first components (the right singular vectors; in slices of
   ``SLICE`` components, so the driver sees a bounded matrix per slice).
3. Lengths are cut into ``BANDS`` bands by quantiles, and a band into as many groups as its
   bytes ask for. The ``SEEDS`` longest vectors give every query a first k-th score.
4. By Cauchy-Schwarz a query can only gain from bands where its length times the band's
   greatest reaches that score, and bands are in descending order: it goes to the groups
   of a prefix of them. In a group, longest vectors first, blocks are left out or ended by
   the same bound; in a block, the inner product of the leading rotated components plus
   the product of the residual lengths bounds each pair, and only pairs that may still
   enter are computed, exactly, on the integers.
5. A query's best of each group meet in one ranking, cut to k before it is shuffled.

A task holds one group (``GROUP_BYTES``) and one Arrow batch of queries. Nothing is
approximate: the rotation and the seeds decide how much is pruned, not what is found.

Scores are exact below 2 ** 63 and held at that limit beyond. Vectors that are null or hold
a null or non-finite component take no part; of unequal lengths, the shorter is filled up
with zeros. Rows with equal id and vector are each a query and candidates of each other.
Ties go to the smaller id, null ids last; a null id is never a query. Empty tables and
tables without query give no rows; other columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opstrail.llm.common import stored, table

K = 5
SCALE = 256
EVERY = 50
SLICE = 128
BANDS = 32
GROUP_BYTES = 16 << 20
SEEDS = 1024
#: Candidates bounded at once, and queries looked at together.
BLOCK, TOGETHER = 1024, 512
#: Share of rotated components in a partial sum.
LEADING = 4
#: Room for rounding in the rotated sums, relative to the product of lengths.
ROUNDING = 1e-9
#: Components beyond are held there: their scores lie beyond the limit, their squares do not overflow.
HUGE = 1e100
#: Most tasks the groups are dealt to; a task takes one after another.
TASKS = 20_000
#: Id that stands for null inside tasks; the flag beside it tells which is which.
LAST = np.iinfo(np.int64).max
#: The double next below 2 ** 63.
EDGE = float(np.nextafter(2.0**63, 0))


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, vec (components times ``scale``, floored, as doubles) of rows that take part."""
    x = F.col("v")
    ok = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    made = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return made.filter(ok).select("vec_id", F.transform(x, lambda c: c * scale).alias("v"))


def _packed(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(1)
            made = np.zeros((len(lists), width))
            at = np.asarray(lists.offsets)
            size = np.diff(at)
            row = np.repeat(np.arange(len(lists)), size)
            flat = np.asarray(lists.values)[at[0] : at[-1]]
            made[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = np.clip(np.floor(flat), -HUGE, HUGE)
            made += 0.0  # no negative zeros: equal vectors have equal bytes
            body = pa.array([r.tobytes() for r in made], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), body, pa.array(np.sqrt((made**2).sum(axis=1)))], ["vec_id", "vec", "length"])

    return run


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors from their bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), "<f8")
    return raw.reshape(len(column), width)


def _gram(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = range(0, width, SLICE)
        sums = [np.zeros((min(SLICE, width - s),) * 2) for s in starts]
        for part in parts:
            x = matrix(part.column(0), width)
            scale = np.maximum(np.abs(x).max(axis=1, initial=1.0), 1.0)[:, None]  # directions count, and no sum overflows
            x = x / scale
            for g, s in zip(sums, starts, strict=True):
                y = x[:, s : s + SLICE]
                g += y.T @ y
        for n, g in enumerate(sums):
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), n)), pa.array(i), pa.array(j), pa.array(g[i, j])], ["slice", "i", "j", "value"]
            )

    return run


def rotation(packed: DataFrame, width: int) -> list[np.ndarray]:
    """An orthogonal matrix per slice of components, strongest directions first."""
    found = packed.select("vec").mapInArrow(_gram(width), "slice bigint, i bigint, j bigint, value double")
    # width * SLICE / 2 sums at most.
    sums = found.groupBy("slice", "i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = []
    for n, start in enumerate(range(0, width, SLICE)):
        size = min(SLICE, width - start)
        g = np.zeros((size, size))
        here = sums.filter(pa.compute.equal(sums["slice"], n))
        g[here["i"].to_numpy(), here["j"].to_numpy()] = here["value"].to_numpy()
        _, vectors = np.linalg.eigh(g + np.triu(g, 1).T)
        out.append(vectors[:, ::-1])
    return out


def rotated(x: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated components of vectors, and the length of all others."""
    head, rest, at = [], np.zeros(len(x)), 0
    for t in turns:
        y = x[:, at : at + len(t)] @ t
        cut = -(-len(t) // LEADING)
        head.append(y[:, :cut])
        rest += (y[:, cut:] ** 2).sum(axis=1)
        at += len(t)
    return np.concatenate(head, axis=1), np.sqrt(rest)


def exact(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers; ``most`` bounds their size."""
    if most < 1 << 53:
        return (q @ c.T).astype(np.int64)
    if most < 1 << 63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    s = q @ c.T
    return np.where(s >= 2.0**63, LAST, np.where(s <= -(2.0**63), -LAST, np.clip(s, -EDGE, EDGE).astype(np.int64)))


class Best:
    """The best entries of each of some queries: candidates with counts, k in all, ties by id."""

    def __init__(self, n: int, k: int, floor: np.ndarray, floor_id: np.ndarray):
        self.n, self.k = n, k
        self.floor, self.floor_id = floor.copy(), floor_id.copy()
        self.row, self.at = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)

    def add(self, row: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, copies: np.ndarray) -> None:
        row, at, score = (np.concatenate(x) for x in ((self.row, row), (self.at, at), (self.score, score)))
        order = np.lexsort((null[at], ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        n = np.minimum(copies[at], self.k)
        before = np.cumsum(n) - n
        first = np.searchsorted(row, np.arange(self.n))
        before -= np.append(before, 0)[np.minimum(first, len(before))][row]
        keep = before < self.k
        full = keep & (before + n >= self.k)  # a query's k-th: one entry, no worse than its floor so far
        self.floor[row[full]], self.floor_id[row[full]] = score[full], ids[at[full]]
        self.row, self.at, self.score = row[keep], at[keep], score[keep]


class Group:
    """Candidates held by a task, in descending order of length."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, vectors: np.ndarray, copies: np.ndarray, turns: list[np.ndarray]):
        length = np.sqrt((vectors**2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.null, self.vectors, self.copies, self.length = (x[order] for x in (ids, null, vectors, copies, length))
        self.head, self.rest = rotated(self.vectors, turns)
        self.turns = turns

    def search(self, q: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> Best:
        """The entries of the best k of each query, those at or above its floor only."""
        best = Best(len(q), k, floor, floor_id)
        long = np.sqrt((q**2).sum(axis=1))
        head, rest = rotated(q, self.turns)
        for at in range(0, len(self.ids), BLOCK):
            top = self.length[at]
            live = np.flatnonzero(long * top * (1 + ROUNDING) >= best.floor)
            if not len(live):
                break  # all that follow are shorter
            part = slice(at, at + BLOCK)
            room = ROUNDING * long[live] * top
            bound = head[live] @ self.head[part].T + rest[live, None] * self.rest[None, part] + room[:, None]
            may = np.maximum(bound, -(2.0**63)) >= best.floor[live, None]  # scores are held there
            rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if not len(rows):
                continue
            score = exact(q[live[rows]], self.vectors[at + cols], float(long[live].max() * top))
            least, ids = best.floor[live[rows], None], best.floor_id[live[rows], None]
            enter = may[np.ix_(rows, cols)] & ((score > least) | (score == least) & (self.ids[None, at + cols] <= ids))
            r, c = np.nonzero(enter)
            if len(r):
                best.add(live[rows[r]], at + cols[c], score[r, c], self.ids, self.null, self.copies)
        return best


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(int(LAST)).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _floors(seeds: pa.Table, width: int, k: int, turns: list[np.ndarray]):
    """Adds to queries the k-th best score and id among the seeds."""
    ids, null = _ids(seeds["vec_id"].combine_chunks())
    vectors, copies = matrix(seeds["vec"], width), seeds["copies"].to_numpy()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(ids, null, vectors, copies, turns)
        for part in parts:
            q = matrix(part.column(1), width)
            floor, floor_id = np.full(len(q), -LAST), np.full(len(q), LAST)
            for at in range(0, len(q), TOGETHER):
                here = slice(at, at + TOGETHER)
                best = group.search(q[here], k, floor[here], floor_id[here])
                floor[here], floor_id[here] = best.floor, best.floor_id
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor), pa.array(floor_id)], ["vec_id", "vec", "copies", "length", "floor", "floor_id"])

    return run


def _searched(width: int, k: int, turns: list[np.ndarray]):
    """Streams a partition sorted by group, candidates before queries."""
    names = ["query", "query_id", "times", "vec_id", "score", "copies"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, group = None, [], None
        for part in parts:
            numbers = part.column(0).to_numpy()
            asks = part.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                piece = part.slice(a, b - a)
                if numbers[a] != now:
                    now, held, group = numbers[a], [], None
                ids, null = _ids(piece.column(2))
                vectors, copies = matrix(piece.column(3), width), piece.column(4).to_numpy()
                if not asks[a]:
                    held.append((ids, null, vectors, copies))
                    continue
                if not held:
                    continue
                if group is None:
                    group = Group(*(np.concatenate(x) for x in zip(*held, strict=True)), turns)
                    held = [None]
                key, floor, floor_id = (piece.column(i).to_numpy() for i in (5, 6, 7))
                for at in range(0, len(ids), TOGETHER):
                    here = slice(at, at + TOGETHER)
                    best = group.search(vectors[here], k + 1, floor[here], floor_id[here])
                    row, c = best.row + at, best.at
                    own = (group.ids[c] == ids[row]) & ~group.null[c]
                    own[own] = (group.vectors[c[own]] == vectors[row[own]]).all(axis=1)
                    left = group.copies[c] - own  # a row is not its own neighbour
                    keep = left > 0
                    row, c, left = row[keep], c[keep], left[keep]
                    found = pa.array(group.ids[c], mask=group.null[c])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[row]), pa.array(ids[row]), pa.array(copies[row]), found, pa.array(best.score[keep]), pa.array(np.minimum(left, k))], names
                    )

    return run


def nearest(
    spark: SparkSession,
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` greatest inner products of every query row with every other row.

    ``is_query`` is a condition on vec_id. Results do not depend on how rows are dealt."""
    floored = whole_vectors(vectors, id_col, vector_col, scale)
    width = floored.agg(F.max(F.size("v"))).first()[0] or 1
    made = floored.mapInArrow(_packed(width), "vec_id bigint, vec binary, length double")
    packed = stored(spark, made.groupBy("vec_id", "vec").agg(F.count("*").alias("copies"), F.first("length").alias("length")), "vectors")
    turns = rotation(packed, width)
    # BANDS - 1 cuts, and the count of each band.
    share = [F.lit(1 - i / BANDS) for i in range(1, BANDS)]
    cuts = sorted(set(packed.agg(F.percentile_approx("length", F.array(*share), F.lit(10_000))).first()[0] or []), reverse=True)
    band = reduce(lambda n, c: n + (F.col("length") < c).cast("int"), cuts, F.lit(0))
    sizes = {r["band"]: (r["n"], r["top"]) for r in packed.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()}
    groups = [-(-sizes.get(b, (0, 0))[0] * width * 8 // GROUP_BYTES) for b in range(len(cuts) + 1)]
    first = np.concatenate([[0], np.cumsum(groups)]).tolist()
    longest = packed.orderBy(F.desc("length"), F.col("vec_id").asc_nulls_last(), "vec").limit(SEEDS).select("vec_id", "vec", "copies")
    key = F.xxhash64("vec_id", "vec")
    asked = packed.filter(F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull())
    asked = asked.select("vec_id", "vec", "copies", "length").mapInArrow(
        _floors(longest.toArrow(), width, k + 1, turns),
        "vec_id bigint, vec binary, copies bigint, length double, floor bigint, floor_id bigint",
    )
    asked = asked.withColumn("query", key)
    # A query's groups are those of the bands before the first that is too short for it.
    last = F.lit(0)
    for b, (n, top) in sorted(sizes.items()):
        if n:
            enough = F.col("length") * top * (1 + ROUNDING) >= F.col("floor")
            last = F.when(enough, F.lit(first[b + 1])).otherwise(last)
    sent = asked.withColumn("group", F.explode(F.sequence(F.lit(1), last.cast("int")))).filter("group > 0")
    sent = sent.select((F.col("group") - 1).cast("int").alias("group"), F.lit(True).alias("ask"), "vec_id", "vec", "copies", "query", "floor", "floor_id")
    starts, counts = F.array(*map(F.lit, first)), F.array(*map(F.lit, [max(g, 1) for g in groups]))
    group = F.get(starts, band) + F.pmod(key, F.get(counts, band)).cast("int")
    zero = F.lit(0).cast("bigint")
    held = packed.select(
        group.cast("int").alias("group"), F.lit(False).alias("ask"), "vec_id", "vec", "copies", zero.alias("query"), zero.alias("floor"), zero.alias("floor_id")
    )
    met = held.unionByName(sent).repartition(min(max(first[-1], 1), TASKS), "group").sortWithinPartitions("group", "ask")
    found = met.mapInArrow(_searched(width, k, turns), "query bigint, query_id bigint, times bigint, vec_id bigint, score bigint, copies bigint")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    by = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = each.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    # Equal query rows are one so far.
    return ranked.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest inner products of every fiftieth id of ``embeddings``."""
    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_OP12 = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v, row_number() OVER () AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n
  WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
