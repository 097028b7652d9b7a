"""Toxicity by a linear classifier with counterfactual regularisation.

Features are the distinct lower-case words of a text and their first letters. Labelled
sentences that mention a group get a twin in which the group's term is swapped for
another one of its kind; the fit minimises

    log loss + RIDGE |w|^2 / n + BALANCE mean (score(x) - score(twin of x))^2

so a group's name cannot carry the label, and neutral mentions are not held against a text.

Fitted on at most ``learning.MAX_ROWS`` labelled rows, one per id, which reach their texts by
a broadcast of that many ids. Only numbers of at most ``VOCABULARY`` features come to the
driver. The model, as many pairs of word and weight, is what scoring carries to executors;
scoring is one pass without shuffle.

``reject_toxic`` drops rows only by a certified model: fitted without every ``CHECKED``-th
labelled row it must call toxic, among those rows, more toxic ones than chance would
(exact binomial test at ``RISK``); and only rows that some feature speaks against. With no
labels, few, of one class or without bearing on the texts nothing is certified and all
rows stay. Scores are given in any case.

Null and empty texts score by the intercept; texts are read whole, however long. Repeated
rows and ties score alike and are kept or dropped alike. An id that repeats in the labels is
toxic if any row says so; one that repeats in the documents teaches by its least text. An
empty table scores no rows. Other columns pass through ``reject_toxic`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, lgamma, log, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import free_name, stored, table, whole
from opstrail.llm.learning import MAX_ROWS, Adam, Sparse, bounded, held_out, sigmoid

FOLDS, FOLD = 4, 2
THRESHOLD = 0.3
VOCABULARY = 5_000
SEEN_IN = 4
PREFIX = 5
#: Features must tell the labels apart by so many standard deviations: chance ones would drown
#: the others where labels are few.
LEAST_Z = 4.0
#: RIDGE is for the whole sample and so counts less the more rows there are.
RIDGE, BALANCE = 2.0, 1.0
STEPS, RATE = 300, 0.05
#: One in so many labelled rows checks a model fitted on the others; chance of passing by luck.
CHECKED, RISK = 5, 0.01
#: Rows whose words a task holds at a time.
SLICE = 256
#: Terms for groups, swapped within a row.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "transgender", "queer", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "healthy"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
)
#: Terms and the next of their kind.
SWAPS = {term: row[(i + 1) % len(row)] for row in GROUPS for i, term in enumerate(row)}
WORD = re.compile(r"\w+")


class Model(NamedTuple):
    """Weight of each feature, intercept, and whether rows may be rejected by it."""

    weights: dict[str, float]
    bias: float
    certified: bool = False


def features(words: set[str]) -> set[str]:
    """Distinct words, and "^" with the first letters of longer ones."""
    return words | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def slices(parts: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows, so that no more texts become Python strings at a time."""
    return (part.slice(at, rows) for part in parts for at in range(0, part.num_rows, rows))


def _featured(swaps: dict[str, str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            own, twin = [], []
            for text in part.column(2).to_pylist():
                words = words_of(text)
                own.append(sorted(features(words)))
                named = words & swaps.keys()
                swapped = words - named | {swaps[w] for w in named}
                twin.append(sorted(features(swapped)) if named else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(own, pa.list_(pa.string())), pa.array(twin, pa.list_(pa.string()))],
                ["checks", "label", "own", "twin"],
            )

    return run


def vocabulary(rows: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The features that tell the labels apart best, by the z-score of their share; ``most`` at most."""
    seen = rows.select("label", F.explode("own").alias("f"))
    # A twin's terms need weights too, or a swap would always seem free.
    twins = rows.filter("twin IS NOT NULL").select("label", F.explode(F.array_except("twin", "own")).alias("f"))
    counts = seen.groupBy("f").agg(F.count("*").alias("n"), F.sum("label").alias("k")).filter(f"n >= {SEEN_IN}")
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    if not total["n"] or not total["k"]:
        return []
    rate = total["k"] / total["n"]
    z = F.abs(F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate) + 1e-9))
    best = {r["f"] for r in counts.filter(z >= LEAST_Z).orderBy(z.desc(), "f").limit(most).collect()}
    best |= {r["f"] for r in twins.groupBy("f").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "f").limit(most // 10).collect()}
    return sorted(best)


def fit(rows: DataFrame, balance: float = BALANCE) -> tuple[dict[str, float], float]:
    """(weight of each feature, intercept) from rows of label, own, twin; bounded rows only."""
    rows = rows.select("label", "own", "twin")
    names = vocabulary(rows)
    number = {f: i for i, f in enumerate(names)}
    known = rows.sparkSession.sparkContext.broadcast(set(names))

    def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        for part in slices(parts):
            lists = [[[f for f in x or () if f in keep] for x in part.column(i).to_pylist()] for i in (1, 2)]
            has = [x is not None for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(x, pa.list_(pa.string())) for x in lists], pa.array(has)],
                ["label", "own", "twin", "has_twin"],
            )

    got = rows.mapInArrow(numbered, "label int, own array<string>, twin array<string>, has_twin boolean").toArrow()
    y = got.column("label").to_numpy().astype(float)
    if not len(y):
        return {}, 0.0
    own = [[number[f] for f in r] for r in got.column("own").to_pylist()]
    twin = [[number[f] for f in r] for r in got.column("twin").to_pylist()]
    pairs = [i for i, x in enumerate(got.column("has_twin").to_pylist()) if x]
    x = Sparse(own, len(names))
    a, b = (Sparse([r[i] for i in pairs], len(names)) for r in (own, twin))
    w, bias = np.zeros(len(names) + 1), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    w[-1] = bias
    adam = Adam(len(w), RATE)
    for _ in range(STEPS):
        miss = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / len(y)
        grad = np.append(x.back(miss) + RIDGE / len(y) * w[:-1], miss.sum())
        if pairs:
            gap = a.dot(w[:-1]) - b.dot(w[:-1])
            grad[:-1] += 2 * balance * (a.back(gap) - b.back(gap)) / len(pairs)
        adam.step(w, grad)
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1])


def sums_of(model: Model, texts) -> np.ndarray:
    """What the features of each text add to the intercept."""
    known = set(model.weights)
    return np.array([sum(model.weights[f] for f in sorted(features(words_of(t)) & known)) for t in texts], float)


def _scorer(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            score = sigmoid(sums_of(model, part.column(1).to_pylist()) + model.bias)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def at_least(k: int, n: int, p: float) -> float:
    """Chance of ``k`` or more of ``n`` where each has chance ``p``."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    one = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)
    return min(1.0, sum(exp(one(i)) for i in range(k, n + 1)))


def certify(rows: DataFrame, balance: float) -> bool:
    """Whether a model of the rows that do not check tells toxic ones among those that do."""
    weights, bias = fit(rows.filter("NOT checks"), balance)
    if not weights:
        return False
    held = rows.filter("checks").select("label", "own").toArrow()  # a part of the bounded sample
    y = held.column("label").to_numpy()
    sums = np.array([sum(weights.get(f, 0.0) for f in x) for x in held.column("own").to_pylist()], float)
    called = (sigmoid(sums + bias) >= THRESHOLD) & (sums > 0)
    n, k = int(called.sum()), int(y[called].sum())
    return bool(n) and at_least(k, n, float(y.mean())) <= RISK


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS, balance: float = BALANCE) -> Model:
    """The model from at most ``most`` rows of ``labels`` (doc_id, toxic) outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = bounded(known, "doc_id", most)
    rows = docs.select("doc_id", whole(F.col("text")).alias("body")).join(F.broadcast(sample), "doc_id")
    once = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("body").alias("body"))
    checks = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("check")), F.lit(CHECKED)) == 0
    made = once.select(checks.alias("checks"), "label", "body").mapInArrow(
        _featured(SWAPS), "checks boolean, label int, own array<string>, twin array<string>"
    )
    kept = stored(docs.sparkSession, made, "toxicity-features")
    model = Model(*fit(kept, balance), certify(kept, balance))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null texts count as empty, which score by the intercept."""
    return docs.select("doc_id", whole(F.col("text"))).mapInArrow(_scorer(model), "doc_id bigint, score double")


def reject_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """``docs`` without rows that a certified model scores ``threshold`` or more, and above its intercept.

    Rows and columns are otherwise as they were; without a certified model all rows stay."""
    if not model.certified:
        return docs
    mark = free_name(docs, "toxic_score")

    @F.pandas_udf("boolean")
    def clean(text):
        sums = np.concatenate([sums_of(model, text.iloc[at : at + SLICE]) for at in range(0, max(len(text), 1), SLICE)])
        return text.__class__((sigmoid(sums + model.bias) < threshold) | (sums <= 0))

    return docs.withColumn(mark, clean(whole(F.col("text")))).filter(F.col(mark)).drop(mark)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
