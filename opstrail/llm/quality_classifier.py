"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good; all other training rows are documents
as they come, their labels unseen. With the class prior p, the risk is

    p R+(g) + max(0, Ru(g) - p R-(g))

where R+ is the loss of positives as positives, R- that of positives as negatives and Ru
that of unlabelled rows as negatives: unbiased, and kept from going below zero, which it
could only by overfitting. When a batch falls below, the step undoes the overfit part.

Features are rates of a text's surface (letters, case, symbols, repeats, lines). They are
worked out once for every document and written to the shared folder; what follows reads
those numbers. Of all documents there is

- a histogram of every rate, counted in Spark by value to 8 binary places; it sets the
  quantiles at which a rate is cut into cells, out to 1 in 100,000 at both ends, and
  the number of documents in every cell;
- the stratum of each document: how rare its rarest cell is, in powers of two;
- the histogram of scores behind the prior: two classifiers of positives against
  unlabelled rows, each fitted on one half of the ids, score all documents of the other
  half. In the best-scored part of the corpus all are good, so the share of all documents
  there over the share of positives there, at the cut with the lowest upper bound, is
  the share of good documents.

Gradient steps alone use a sample: at most ``most`` positives, and about ``most``
documents drawn by a hash of the id within each stratum, rare strata whole, weighted by
the stratum's count, so that rare kinds of text are in the risk with their true weight.

Null and empty texts have rates of zero; texts are read whole, however long. Repeated rows
and ties score alike; rows equal in id and rates are sampled as one with a count. An id
that repeats in the labels counts once, one that repeats in the documents teaches by its
least rates. Without positives, or for an empty table, all scores are the same. Other
columns are not read and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import stored, table, whole
from opstrail.llm.learning import MAX_ROWS, Adam, bounded, held_out, sigmoid

FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
#: Quantiles at which a rate is cut, finer at the ends, where odd texts are.
ENDS = (0.00001, 0.0001, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35)
CUTS = (*ENDS, 0.5, *(1 - x for x in reversed(ENDS)))
BINS = len(CUTS) + 1
#: A rate is counted by its sign, exponent and first 8 binary places: at most 23 x 2 ** 19 counts.
DROPPED = 44
#: Strata: the rarest cell of a document holds a share of about 2 ** -stratum.
STRATA = 20
#: Score cuts that the prior is looked for at.
LEVELS = np.linspace(0, 0.95, 96)
ROUNDS, BATCHES, RATE, RIDGE = 60, 10, 0.05, 1e-4
#: Share of the estimate's sampling error that is added before the lowest is taken.
CONFIDENCE = 0.1
SYMBOLS = re.compile(r"[#*$%&|<>{}=\\^~_]")
MARKS = re.compile(r"[.,;:!?]")


def rates(text: str) -> list[float]:
    """The surface of a text in numbers; zeros for an empty one."""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    if not n:
        return [0.0] * N_RATES
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    runs = sum(a == b for a, b in pairwise(words))
    letters = max(sum(map(len, words)), 1)
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    trigrams = max(n - 2, 1)
    return [
        float(np.log1p(n)),
        letters / n,
        distinct / n,
        distinct / n**0.8,
        runs / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / trigrams,
        upper / letters,
        len(SYMBOLS.findall(text)) / letters,
        len(MARKS.findall(text)) / n,
        text.count("!") / n,
        text.count("|") / n,
        sum(map(text.count, "0123456789")) / letters,
        sum(w[-1] in ".!?" for w in words) / n,
        sum(w.isupper() for w in words) / n,
        sum(w[0].isupper() for w in words) / n,
        max(map(len, words)) / 10,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
        (chars - letters) / chars,
        text.count("http") / n,
        float(text.rstrip()[-1] in ".!?\"'"),
        float(text.lstrip()[0].isupper()),
    ]


N_RATES = 23


def _rated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        made = [rates(t) for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "rates"])


def rate_all(docs: DataFrame) -> DataFrame:
    """doc_id and rates of every row, as a working table."""
    made = docs.select(F.col("doc_id").cast("bigint"), whole(F.col("text"))).mapInArrow(_rated, "doc_id bigint, rates array<double>")
    return stored(docs.sparkSession, made, "quality-rates")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(-1, N_RATES)


def bucket(x: np.ndarray) -> np.ndarray:
    """Numbers that keep the order of rates, which are not negative."""
    return (x + 0.0).view(np.int64) >> DROPPED


def upper(buckets: np.ndarray) -> np.ndarray:
    """The greatest rate of each bucket."""
    return (((buckets + 1) << DROPPED) - 1).view(np.float64)


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, int] = {}
    for part in parts:
        keys = (np.arange(N_RATES) << 24) + bucket(matrix(part.column(0)))
        for k, n in zip(*map(np.ndarray.tolist, np.unique(keys, return_counts=True)), strict=True):
            seen[k] = seen.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["key", "n"])


class Bins:
    """One-hot places of rates: feature i of value v lies in cell i * BINS + bin.

    ``histograms``: for each rate its buckets in order and their counts."""

    def __init__(self, histograms: list[tuple[np.ndarray, np.ndarray]]):
        self.cuts, self.held = [], np.zeros(N_RATES * BINS, np.int64)
        for i, (buckets, n) in enumerate(histograms):
            sums = np.cumsum(n)
            at = np.searchsorted(sums, np.array(CUTS) * (sums[-1] if len(sums) else 0), side="left")
            self.cuts.append(upper(np.unique(buckets[np.minimum(at, len(buckets) - 1)])) if len(buckets) else np.empty(0))
            np.add.at(self.held, self._cells(i, upper(buckets)), n)

    def _cells(self, i: int, column: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts[i], column, side="left") + i * BINS

    def __call__(self, x: np.ndarray) -> np.ndarray:
        cells = [self._cells(i, col) for i, col in enumerate(x.T)]
        return np.stack(cells, axis=1) if len(x) else np.empty((0, N_RATES), np.int64)

    def stratum(self, cells: np.ndarray) -> np.ndarray:
        """How rare each row's rarest cell is."""
        n = max(int(self.held[:BINS].sum()), 1)
        share = n / np.maximum(self.held[cells].min(axis=1, initial=n), 1)
        return np.minimum(np.log2(share).astype(np.int64), STRATA - 1)


def bins_of(rated: DataFrame) -> Bins:
    """Cuts and cell counts from the rates of all rows."""
    counted = rated.select("rates").mapInArrow(_counted, "key bigint, n bigint")
    got = counted.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    at = [(key >> 24) == i for i in range(N_RATES)]
    return Bins([(key[x] & ((1 << 24) - 1), n[x]) for x in at])


def value(w: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return w[:-1][cells].sum(axis=1) + w[-1]


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float, weight: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Weights and intercept that minimise the non-negative unbiased risk; rows of cells, ``weight`` of each of ``unl``."""
    weight = np.ones(len(unl)) if weight is None else weight
    rng = np.random.default_rng(seed)
    w = np.zeros(N_RATES * BINS + 1)
    w[-1] = np.log(prior / (1 - prior))
    adam = Adam(len(w), RATE)
    for _ in range(ROUNDS):
        p_parts = np.array_split(rng.permutation(len(pos)), BATCHES)
        u_parts = np.array_split(rng.permutation(len(unl)), BATCHES)
        for pi, ui in zip(p_parts, u_parts, strict=True):
            if not len(pi) or not len(ui):
                continue
            p, u = pos[pi], unl[ui]
            gp, gu, wu = value(w, p), value(w, u), weight[ui] / weight[ui].sum()
            # Losses ln(1 + e^-g) as positive and ln(1 + e^g) as negative.
            negative = (wu * np.logaddexp(0, gu)).sum() - prior * np.logaddexp(0, gp).mean()
            d_pos = -prior * (1 - sigmoid(gp)) / len(gp)
            d_neg_p, d_neg_u = -prior * sigmoid(gp) / len(gp), wu * sigmoid(gu)
            if negative < 0:  # overfit: step back on that part alone
                on_p, on_u = -d_neg_p, -d_neg_u
            else:
                on_p, on_u = d_pos + d_neg_p, d_neg_u
            back = sum(
                np.bincount(x.ravel(), weights=np.repeat(on, x.shape[1]), minlength=len(w) - 1)
                for x, on in ((p, on_p), (u, on_u))
            )
            grad = np.append(back + RIDGE * w[:-1], on_p.sum() + on_u.sum())
            adam.step(w, grad)
    return w


def prior_of(above_pos: np.ndarray, above_all: np.ndarray, n_pos: int, n_all: int) -> float:
    """Share of positives among all rows, from the shares of both at or above each cut."""
    error = np.sqrt(1 / n_pos) + np.sqrt(1 / n_all)
    best = np.argmin((above_all + CONFIDENCE * error) / np.maximum(above_pos, 1e-9) + 1e9 * (above_pos < 0.05))
    return float(np.clip(above_all[best] / max(above_pos[best], 1e-9), 0.02, 0.98))


def reached(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many scores lie at or above each cut, cuts in order."""
    return len(scores) - np.searchsorted(np.sort(scores), cuts, side="left")


def half_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("half")), F.lit(2)).cast("int")


def _levels(bins: Bins, models: list[tuple[np.ndarray, np.ndarray]]):
    """Counts rows by the number of score cuts they reach, each half by the other's classifier."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LEVELS) + 1, np.int64)
        for part in parts:
            half, cells = part.column(0).to_numpy(), bins(matrix(part.column(1)))
            for h, (w, cuts) in enumerate(models):
                total += np.bincount(np.searchsorted(cuts, value(w, cells[half == h]), side="right"), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["level", "n"])

    return run


def estimate_prior(rated: DataFrame, bins: Bins, pos: np.ndarray, pos_half: np.ndarray, unl: np.ndarray, unl_half: np.ndarray, weight: np.ndarray) -> float:
    """The share of good documents among all rows."""
    if not all((half == h).any() for half in (pos_half, unl_half) for h in (0, 1)):
        return 0.5
    models, above_pos = [], np.zeros(len(LEVELS))
    for h in (0, 1):  # scores half h, fitted on the other
        a, b = pos_half != h, unl_half != h
        w = fit_pu(pos[a], unl[b], 0.5, weight[b])
        own = value(w, pos[~a])
        cuts = np.quantile(own, LEVELS)
        models.append((w, cuts))
        above_pos += reached(own, cuts)
    counts = rated.select(half_of(F.col("doc_id")), "rates").mapInArrow(_levels(bins, models), "level bigint, n bigint")
    got = counts.groupBy("level").agg(F.sum("n").alias("n")).orderBy("level").toArrow().column("n").to_numpy()
    above_all = np.cumsum(got[::-1])[::-1][1:]
    return prior_of(above_pos / len(pos), above_all / got.sum(), len(pos), int(got.sum()))


def _strata(bins: Bins):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = bins.stratum(bins(matrix(part.column(1))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], ["doc_id", "rates", "stratum"])

    return run


def draw(rated: DataFrame, bins: Bins, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates, half, weight) of about ``most`` rows: strata by the root of their counts, rows by a hash of
    the id, the lowest of each stratum in any case."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 40))
    placed = rated.mapInArrow(_strata(bins), "doc_id bigint, rates array<double>, stratum bigint").withColumn("place", place)
    found = placed.groupBy("stratum").agg(F.count("*").alias("n"), F.min("place").alias("lowest")).collect()  # STRATA at most
    count = {r["stratum"]: r["n"] for r in found}
    roots = sum(n**0.5 for n in count.values())
    least = F.lit(-1)
    for r in found:
        share = min(1.0, most / (roots * r["n"] ** 0.5))
        least = F.when(F.col("stratum") == r["stratum"], F.lit(max(round(share * (1 << 40)) - 1, r["lowest"]))).otherwise(least)
    taken = placed.filter(F.col("place") <= least).groupBy("doc_id", "rates", "stratum").agg(F.count("*").alias("n"))
    got = taken.select(half_of(F.col("doc_id")).alias("half"), "rates", "stratum", "n").toArrow().combine_chunks()
    stratum, n = got.column("stratum").to_numpy(), got.column("n").to_numpy().astype(float)
    drawn = {s: n[stratum == s].sum() for s in count}
    weight = n * np.array([count[s] / drawn[s] for s in stratum.tolist()])
    return matrix(got.column("rates").combine_chunks()), got.column("half").to_numpy(), weight


def train_rated(rated: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> tuple[Bins, np.ndarray, float]:
    """``train`` from the working table of rates."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    trusted = bounded(good.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", most)  # at most ``most`` ids
    once = rated.join(F.broadcast(trusted), "doc_id").groupBy("doc_id").agg(F.min("rates").alias("rates"))
    got = once.select(half_of(F.col("doc_id")).alias("half"), "rates").toArrow().combine_chunks()
    bins = bins_of(rated)
    rows, half, weight = draw(rated, bins, most)
    kind = np.repeat([1, 0], [len(got), len(rows)])
    x = np.concatenate([matrix(got.column("rates").combine_chunks()), rows])
    half, weight = np.concatenate([got.column("half").to_numpy(), half]), np.concatenate([np.ones(len(got)), weight])
    if not len(got) or not len(rows):
        return bins, np.zeros(N_RATES * BINS + 1), 0.5
    order = np.lexsort((*x.T, weight, half, kind))  # the same order, and so the same fit, in every run
    order = order[np.random.default_rng(3).permutation(len(order))]
    cells, half, weight, kind = bins(x[order]), half[order], weight[order], kind[order]
    pos, unl = kind == 1, kind == 0
    prior = estimate_prior(rated, bins, cells[pos], half[pos], cells[unl], half[unl], weight[unl])
    return bins, fit_pu(cells[pos], cells[unl], prior, weight[unl]), prior


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> tuple[Bins, np.ndarray, float]:
    """(bins, weights, prior); only labels of at most ``most`` positives are used, none of the held-out fold."""
    return train_rated(rate_all(docs), labels, most)


def _scorer(bins: Bins, w: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = sigmoid(value(w, bins(matrix(part.column(1)))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    return run


def score_rated(rated: DataFrame, model: tuple[Bins, np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    return rated.mapInArrow(_scorer(*model[:2]), "doc_id bigint, score double")


def score(docs: DataFrame, model: tuple[Bins, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row; a null text counts as empty."""
    rated = docs.select(F.col("doc_id").cast("bigint"), whole(F.col("text"))).mapInArrow(_rated, "doc_id bigint, rates array<double>")
    return score_rated(rated, model)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``."""
    rated = rate_all(table(spark, sf_dir, "documents"))
    found = score_rated(rated, train_rated(rated, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
