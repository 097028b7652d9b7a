"""Periodic runs: maximal pairs from the LCP-interval tree.

A run with smallest period q over [i, j) is a pair of equal stretches, at i and at i + q,
that cannot be made longer on either side: a maximal pair with distance q and length
j - i - q. The other way round, a maximal pair whose distance is at most its length spans
a stretch that repeats with that distance and cannot be extended, so it is a run; pairs at
multiples of q span the same stretch, and the least distance is kept.

A task takes documents together until they have ``TOGETHER`` words. Words become numbers
per document, so that documents share none.

1. Suffixes are sorted by doubling. Those whose first words occur once drop out, which is
   nearly all in plain text; only suffixes that share ``SHARED`` words with another one are
   looked at further, as a run's pair agrees on more.
2. Their common prefixes come from the ranks that the doubling went through.
3. The tree of LCP intervals is walked from its leaves. An interval holds its positions in
   order and class lists of them by the word to their left. Where a child joins, each
   position of the smaller side asks the larger one for positions of another class within
   the interval's length. All occurrences within that reach to the right of one position
   have the same left word (the stretch repeats there), so one class list is read to the
   right, and to the left only the farthest position can differ. What is read is what is
   found, and the number of runs and of their multiples grows no faster than the text.

There is no shuffle; a task's memory is bounded by ``TOGETHER`` words or one document.
Null texts are empty and have no run; repeated rows are worked on each; empty tables give no
rows; very long texts are read whole; other columns are not carried and may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import table, whole, words

LEAST = 12
TOGETHER = 200_000
#: A run of LEAST words with period q <= LEAST / 2 has a pair of LEAST - q words at least.
SHARED = 4


def ranks(w: np.ndarray, end: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(k, rank of every suffix by its first k words) for k = 1, 2, 4 ... until all differ.

    ``end`` is where each position's document ends. Equal ranks mean k equal words; a suffix
    with fewer words is alone in its rank."""
    n = len(w)
    order = np.argsort(w, kind="stable")
    head = np.append(True, np.diff(w[order]) != 0)
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    single = head & np.append(head[1:], True)
    live, k, out = order[~single], 1, []
    while True:
        out.append((k, rank.astype(np.int32)))
        if not len(live):
            return out
        at = live + k
        later = np.where(at < end[live], rank[np.minimum(at, n - 1)], -1)
        key = rank[live] * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        old = rank[live]
        new_head = np.append(True, np.diff(key) != 0)
        old_head = np.append(True, np.diff(old) != 0)
        spot = np.arange(len(live))
        group = np.maximum.accumulate(np.where(new_head, spot, 0))
        base = np.maximum.accumulate(np.where(old_head, spot, 0))
        rank = rank.copy()
        rank[live] = old + group - base
        live = live[~(new_head & np.append(new_head[1:], True))]
        k *= 2


def shared_suffixes(levels: list[tuple[int, np.ndarray]], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, sorted by suffix, that share SHARED words with another, and each one's LCP with the one before."""
    at = next((r for k, r in levels if k == SHARED), None)
    if at is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(end)
    many = np.bincount(at, minlength=n)[at] > 1
    some = np.flatnonzero(many)
    some = some[np.argsort(levels[-1][1][some])]
    if not len(some):
        return some, some
    i, j = some[:-1], some[1:]
    lcp = np.zeros(len(i), np.int64)
    for k, rank in reversed(levels):
        a, b = i + lcp, j + lcp
        equal = (a < end[i]) & (b < end[j]) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        lcp += k * equal
    return some, np.append(0, lcp)


class Interval:
    """An LCP interval: its positions in order, and by class of the word to their left."""

    __slots__ = ("lcp", "positions", "classes")

    def __init__(self, position: int, left: int):
        self.lcp = 0
        self.positions, self.classes = [position], {left: [position]}

    def join(self, child: Interval, left: list[int], least: int, found: dict) -> Interval:
        """This interval with a child in it; pairs of both that are runs go to ``found``."""
        reach = self.lcp
        small, large = (self, child) if len(self.positions) < len(child.positions) else (child, self)
        held, classes = large.positions, large.classes
        for e in small.positions:
            own = left[e]
            nth = bisect_right(held, e)
            if nth < len(held) and held[nth] - e <= reach and left[held[nth]] != own:
                others = classes[left[held[nth]]]
                for f in others[bisect_right(others, e) : bisect_right(others, e + reach)]:
                    if f - e + reach >= least:
                        span = e, f + reach
                        found[span] = min(found.get(span, f - e), f - e)
            far = bisect_left(held, e - reach)
            if far < nth and left[held[far]] != own:
                f = held[far]
                if e - f + reach >= least:
                    span = f, e + reach
                    found[span] = min(found.get(span, e - f), e - f)
        if small.positions[0] > held[-1]:
            held += small.positions
        else:
            for e in small.positions:
                insort(held, e)
        for c, positions in small.classes.items():
            mine = classes.get(c)
            if mine is None:
                classes[c] = positions
            elif positions[0] > mine[-1]:
                mine += positions
            else:
                for e in positions:
                    insort(mine, e)
        large.lcp = reach
        return large


def maximal_pairs(some: list[int], lcp: list[int], left: list[int], least: int) -> dict[tuple[int, int], int]:
    """Least distance of the maximal pairs that are runs of ``least`` words or more, by (start, end)."""
    found: dict[tuple[int, int], int] = {}
    floor = -(-least // 2)  # shorter common prefixes belong to no such run
    open_: list[Interval] = []
    child = None
    for position, shared in zip(some, lcp, strict=True):
        while open_ and open_[-1].lcp > shared:
            top = open_.pop()
            child = top.join(child, left, least, found)
        if shared < floor:
            child = Interval(position, left[position])
            continue
        if open_ and open_[-1].lcp == shared:
            open_[-1] = open_[-1].join(child, left, least, found)
        else:
            child.lcp = shared
            open_.append(child)
        child = Interval(position, left[position])
    while open_:
        child = open_.pop().join(child, left, least, found)
    return found


def find_runs(texts: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period.

    A run has a smallest period q, at least max(``least``, 2 q) words and no neighbour that keeps q."""
    if least < 2 * SHARED:
        raise ValueError(f"runs shorter than {2 * SHARED} words are not looked for")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = [len(t) for t in texts]
    n = sum(sizes)
    if not n:
        return out
    starts = np.cumsum([0, *sizes[:-1]])
    w = np.empty(n, np.int64)
    for at, text in zip(starts.tolist(), texts, strict=True):
        number = dict.fromkeys(text)
        for i, word in enumerate(number):
            number[word] = at + i  # no two documents share a number
        w[at : at + len(text)] = np.fromiter(map(number.__getitem__, text), np.int64, len(text))
    end = np.repeat(starts + sizes, sizes)
    some, lcp = shared_suffixes(ranks(w, end), end)
    if not len(some):
        return out
    left = np.append(-1, w[:-1])
    left[starts[np.array(sizes) > 0]] = -1
    found = maximal_pairs(some.tolist(), lcp.tolist(), left.tolist(), least)
    firsts = np.fromiter((s for s, _ in found), np.int64, len(found))
    # The last document that begins there is the one with words.
    which = np.searchsorted(starts, firsts, side="right") - 1
    for ((start, stop), period), d in zip(found.items(), which.tolist(), strict=True):
        if stop - start >= 2 * period:
            out[d].append((start - int(starts[d]), stop - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(text: list, runs: list[tuple[int, int, int]]) -> list:
    """The words left when every run keeps its first period alone."""
    if not runs:
        return text
    change = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, n in zip(text, np.cumsum(change).tolist(), strict=False) if not n]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list, texts: list) -> pa.RecordBatch:
            runs = find_runs(texts, least)
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
            kept = [b" ".join(collapsed(t, rs)) for t, rs in zip(texts, runs, strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

        ids, texts, n = [], [], 0
        for part in parts:
            for id_, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                split = text.as_buffer().to_pybytes().split()  # at the six ASCII spaces
                if texts and n + len(split) > TOGETHER:
                    yield told(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(id_)
                texts.append(split)
                n += len(split)
        if texts:
            yield told(ids, texts)

    return run


def periodic_runs(docs: DataFrame, text: Column | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period) and the collapsed text of every row.

    ``text`` stands for the column of that name if given."""
    body = whole(F.col("text") if text is None else text)
    schema = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col("doc_id").cast("bigint"), body).mapInArrow(_found(least), schema)


def planted(doc_id: Column, text: Column) -> Column:
    """Every tenth text by checksum, periodic from a word on; the others, and those without id or words, as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    w = words(text)
    n = F.size(w).cast("bigint")
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    times = F.ceil((n - a) / p)
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times.cast("int"))), F.lit(1), (n - a).cast("int"))
    head = F.slice(w, F.lit(1), a.cast("int"))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(head, tail), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every row of ``documents``, some made periodic."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, planted(F.col("doc_id"), F.col("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    made = found.select("*", best.alias("best"))
    return made.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
