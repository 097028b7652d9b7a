"""Quality rules whose cutoffs are chosen under a guaranteed rate of false rejections.

Each rule rejects a document whose statistic lies above a cutoff. Cutoffs come from
a fixed grid, so labelled documents are a pure holdout: nothing was fitted to them.
A cutoff is certified in a stratum if an exact binomial test shows that it rejects
less than ``ALPHA`` / number of rules of the good documents. The rules together then
reject at most ``ALPHA`` of the good documents of every stratum, with probability
1 - ``DELTA`` at once for all. That takes a correction for many tests: a rule's cutoffs
are tried from the highest down until one fails, a fixed sequence, which needs none,
and ``DELTA`` is divided by the number of sequences (strata x rules). Counts of
rejections only rise on the way down, so the lowest cutoff that passes is where the
sequence ends; a stratum without one lets everything pass.

All native: one pass computes the statistics of a row into a working table, the
labelled ones are counted by (stratum, rule, grid cell), which is a few thousand
rows whatever the input, and the chosen cutoffs, one row per stratum, come back
by broadcast. Null text counts as empty; null or unknown languages form a stratum
of their own; repeated rows count once each; no labels means no rejection beyond
the base rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import SPACES, stored, table, whole, words

#: Eight words; window hashes are joined from halves three times.
WINDOW = 8
ALPHA, DELTA = 0.03, 0.05
#: Strata that are told apart; any other language is one stratum.
STRATA = ("de", "en", "es", "fr")
#: Each rule's statistic as (numerator, denominator) and its grid of cutoffs, in thousandths.
GRID = tuple(range(0, 1000, 10))
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouting": ("n_upper", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "runs": ("n_runs", "n_words"),
    "bars": ("n_bars", "n_words"),
}


def joined(hashes: str, reach: int) -> Column:
    """Hashes of windows twice ``reach`` words long, each from the two halves."""
    n = F.size(hashes) - reach
    pairs = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, reach + 1, n), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<bigint>"))


def ranked_repeats(hashes: Column) -> Column:
    """(hash, place) of all windows in order of hash; empty if no hash occurs twice, as in most texts."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    plain = (F.size(hashes) == 0) | (F.size(F.array_distinct(hashes)) == F.size(hashes))
    return F.when(plain, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(ranked)


def repeated_words(ranked: str) -> Column:
    """Words inside windows that occur twice or more; a window does if a neighbour in ``ranked`` has its hash."""

    def same(v: Column, i: Column) -> Column:
        return F.coalesce(F.get(F.col(ranked), i)["h"] == v["h"], F.lit(False))

    places = F.array_sort(
        F.transform(
            F.filter(F.col(ranked), lambda v, i: F.when(i > 0, same(v, i - 1)).otherwise(False) | same(v, i + 1)),
            lambda v: v["i"],
        )
    )
    return F.aggregate(
        places,
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"),
            (acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).cast("bigint").alias("n"),
        ),
        lambda acc: acc["n"],
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the statistics of every row."""
    body = whole(F.col("text"))
    step = docs.select(
        "doc_id",
        F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(F.lit("other")).alias("stratum"),
        words(body).alias("w"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(body, r"[^A-Z]+", "")).cast("bigint").alias("n_upper"),
    )
    step = step.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    n = F.size("wh")
    for reach, (short, long) in {1: ("wh", "w2"), 2: ("w2", "w4"), 4: ("w4", "windows")}.items():
        step = step.withColumn(long, joined(short, reach))
    step = step.withColumn("ranked", ranked_repeats(F.col("windows")))
    again = F.zip_with(F.slice("wh", 2, F.greatest(n, F.lit(1))), "wh", lambda a, b: a == b)
    return step.select(
        "doc_id",
        "stratum",
        n.cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_upper",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        repeated_words("ranked").alias("n_repeat_words"),
        F.size(F.filter(again, lambda x: x)).cast("bigint").alias("n_runs"),
        (n - F.size(F.array_remove("w", "|"))).cast("bigint").alias("n_bars"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def cell(rule: str) -> Column:
    """The statistic in grid steps: cutoff number c rejects a document if its cell exceeds c."""
    above, below = RULES[rule]
    step = GRID[1] - GRID[0]
    # ceil(1000 * a / b / step) in whole numbers
    b = f"(greatest({below}, 1) * {step})"
    return F.least(F.lit(len(GRID)), F.expr(f"({above} * 1000 + {b} - 1) div {b}")).cast("int")


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1 by Stirling's series after eight steps up."""
    z = x + 8
    low = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - low


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exact to double precision.

    Terms are summed from j = k down. Below the mean they shrink, and 14 standard
    deviations on, nothing is left of them in a double; at or above the mean 1 is
    returned, since no test passes there.
    """
    first = F.exp(
        log_gamma(n + 1.0)
        - log_gamma(k + 1.0)
        - log_gamma(n - k + 1.0)
        + k * math.log(p)
        + (n - k) * math.log1p(-p)
    )
    steps = F.least(k, F.ceil(14 * F.sqrt(n * (p * (1 - p)))) + 60).cast("int")
    odds = (1 - p) / p
    sums = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * (k - i) / (n - k + i + 1.0) * odds).alias("term"),
            (acc["sum"] + acc["term"] * (k - i) / (n - k + i + 1.0) * odds).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(sums)


def certified_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum a map from rule to the lowest certified cutoff number.

    ``stats`` should be a written table, so that no filter works its statistics out again.
    ``labels``: doc_id, quality (1 is good). Counts are summed by (stratum, rule,
    cell) before they are gathered: at most strata x rules x (grid + 1) rows.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = stats.filter(~base_failed()).join(good, "doc_id")
    cells = held.select(
        "stratum",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), cell(r).alias("cell")) for r in RULES])).alias("x"),
    ).select("stratum", "x.*")
    counts = cells.groupBy("stratum", "rule", "cell").agg(F.count("*").alias("n"))
    rows = counts.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("cell", "n")).alias("cells")
    )
    tests = (len(STRATA) + 1) * len(RULES)
    tried = rows.select("stratum", "rule", "n", "cells", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("cut"))
    tried = tried.withColumn(
        "k",
        F.aggregate(
            "cells", F.lit(0).cast("bigint"), lambda a, c: a + F.when(c["cell"] > F.col("cut"), c["n"]).otherwise(0)
        ),
    )
    chance = binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES))
    passed = tried.filter(chance <= delta / tests)
    best = passed.groupBy("stratum", "rule").agg(F.min("cut").alias("cut"))
    return best.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cutoffs")
    )


def apply_rules(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``stats`` with base_failed, the rules that reject a row, and kept.

    ``cutoffs`` has one row per stratum, at most ``len(STRATA) + 1``: it is broadcast.
    """
    judged = stats.join(F.broadcast(cutoffs), "stratum", "left").withColumn("base_failed", base_failed())
    rejecting = F.array_compact(
        F.array(*[F.when(cell(r) > F.col("cutoffs")[r], F.lit(r)) for r in RULES])
    )
    return judged.withColumn("rejected_by", F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(rejecting)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)
    )


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = stored(spark, statistics(docs), "quality-statistics")
    return apply_rules(stats, certified_cutoffs(stats, labels))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row of ``documents``."""
    judged = quality_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )


def _duck_cell(rule: str) -> str:
    above, below = RULES[rule]
    b = f"(greatest({below}, 1) * {GRID[1] - GRID[0]})"
    return f"least({len(GRID)}, ({above} * 1000 + {b} - 1) // {b})"


_P = ALPHA / len(RULES)
ORACLE_OP1 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body,
    CASE WHEN lang IN {STRATA} THEN lang ELSE 'other' END AS stratum FROM documents),
w AS (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM d),
one AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
grams AS (SELECT rid, i, len(g) AS n, list_aggregate(g, 'string_agg', ' ') AS g FROM (SELECT rid, i,
    list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g FROM one)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams WHERE n = {WINDOW}) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM again, range({WINDOW}) AS r(j) GROUP BY rid),
runs AS (SELECT rid, count(*) FILTER (word = before) AS n_runs, count(*) FILTER (word = '|') AS n_bars,
    sum(length(word))::BIGINT AS word_chars, count(*) AS n_words
    FROM (SELECT *, lag(word) OVER (PARTITION BY rid ORDER BY i) AS before FROM one) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT doc_id, d.rid, stratum, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(body, '[^A-Z]+', '', 'g')) AS n_upper,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_runs, 0) AS n_runs, coalesce(n_bars, 0) AS n_bars
    FROM d LEFT JOIN rep USING (rid) LEFT JOIN runs USING (rid) LEFT JOIN lines USING (rid)),
c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    {', '.join(f'{_duck_cell(r)} AS c_{r}' for r in RULES)} FROM s),
good AS (SELECT * FROM c WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cells AS ({' UNION ALL '.join(f"SELECT stratum, '{r}' AS rule, c_{r} AS cell FROM good" for r in RULES)}),
tried AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (cell > cut) AS k
    FROM cells, range({len(GRID)}) AS g(cut) GROUP BY ALL),
chance AS (SELECT *, CASE WHEN k >= n * {_P!r} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda j:
    exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({_P!r}) + (n - j) * ln(1 - {_P!r})))) END AS p
    FROM tried),
best AS (SELECT stratum, rule, min(cut) AS cut FROM chance
    WHERE p <= {DELTA / ((len(STRATA) + 1) * len(RULES))!r} GROUP BY ALL),
wide AS (SELECT stratum, {', '.join(f"min(cut) FILTER (rule = '{r}') AS k_{r}" for r in RULES)} FROM best GROUP BY stratum),
judged AS (SELECT c.*, concat_ws(',', {', '.join(f"CASE WHEN c_{r} > k_{r} THEN '{r}' END" for r in RULES)}) AS rejected_by
    FROM c LEFT JOIN wide USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM judged
"""
