"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share all words;
a target stops at ``MAX_COPIES`` times its source and what is left is shared anew by
weight. Within a source a document is wanted m times: a level times its preference,
at most ``MAX_COPIES``, so that the wanted words make the target. floor(m) whole copies
are certain. The rest p = m - floor(m) is the inclusion probability of one more copy:
documents are ranked by u / (1 - u) over p / (1 - p), u being uniform by a hash of id
and text, and taken in rank order until the source's words come nearest to the target.

Rank order needs no sort of a source. Ranks are counted in 4096 cells per source,
the cell in which the sum crosses the target is found, and it alone is cut into cells
again; only documents of the last cell are sorted. So a source with a third of all rows
is summed in parallel like any other, and rerunning gives the same documents.

Null texts have size 0; null sources are one source; rows that repeat are ranked alike, so
both or none get another copy; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opstrail.llm.common import free_name, stored, table, words

#: Weights of the sources in order.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents below this many words are preferred half as much as others.
SHORT = 50
#: A rank has RANK_BITS bits; a round looks at CELL_BITS of them.
RANK_BITS, CELL_BITS, ROUNDS = 48, 12, 2
#: A table with a row for each of so many sources is a few megabytes and is broadcast; a longer one is
#: joined by a shuffle, in which Spark splits the partition of a hot source.
FEW_SOURCES = 50_000
SEED = "mix"


def with_targets(spark: SparkSession, sums: DataFrame) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sharing anew until no target is above its bound ends at one level: target =
    least(bound, level x weight). Each round is a sum over the table of sources, and a
    source once at its bound stays there, so the level only rises.
    """
    ranked = _numbered(spark, sums)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))
    ranked = stored(spark, ranked.withColumn("weight", weight).drop("nth"), "mix-sources")
    level = 0.0
    while True:
        full = F.col("source_size") * MAX_COPIES <= level * F.col("weight")
        seen = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size") * MAX_COPIES)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not seen["open"]:
            break
        higher = ((seen["all"] or 0) - (seen["full"] or 0)) / seen["open"]
        if higher <= level:
            break
        level = higher
    bound = (F.col("source_size") * MAX_COPIES).cast("double")
    return ranked.withColumn("target", F.least(bound, F.lit(float(level)) * F.col("weight")))


def _numbered(spark: SparkSession, sums: DataFrame) -> DataFrame:
    """Number the sources in order without one task that sees them all: sorted ranges,
    numbered inside, and the sizes of the ranges (one row each) summed up."""
    placed = sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = stored(spark, placed, "mix-order")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return placed.withColumn("nth", inside).join(starts, "part").withColumn("nth", F.col("nth") + F.col("start")).drop("part", "start")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from a hash of ``parts``."""
    hashed = F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, source_size, target, copies of every row; key is a digest of the text."""
    text_key = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        text_key.alias("key"),
    )
    rows = rows.withColumn("u", uniform(F.col("doc_id"), F.col("key")))
    rows = rows.withColumn("pref", F.when(F.col("size") < SHORT, 1).otherwise(2))
    rows = stored(spark, rows, "mix-rows")
    sums = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.when(F.col("pref") == 1, F.col("size")).otherwise(0)).alias("s1"),
        F.sum(F.when(F.col("pref") == 2, F.col("size")).otherwise(0)).alias("s2"),
    )
    plan = with_targets(spark, sums)
    # The level at which wanted copies, preference x level but at most MAX_COPIES, make the target.
    level = F.col("target") / F.greatest(F.col("s1") + 2 * F.col("s2"), F.lit(1))
    capped = (F.col("target") - MAX_COPIES * F.col("s2")) / F.greatest(F.col("s1"), F.lit(1))
    m2 = F.least(F.lit(float(MAX_COPIES)), 2 * level)
    m1 = F.least(F.lit(float(MAX_COPIES)), F.when(2 * level > MAX_COPIES, capped).otherwise(level))
    plan = stored(spark, plan.select("source", "source_size", "target", m1.alias("m1"), m2.alias("m2")), "mix-plan")
    few = plan.count() <= FEW_SOURCES
    wanted = _with_plan(rows, plan, few)
    wanted = wanted.withColumn("m", F.when(F.col("pref") == 1, F.col("m1")).otherwise(F.col("m2")))
    wanted = wanted.withColumn("sure", F.floor("m").cast("bigint")).withColumn("p", F.col("m") - F.floor("m"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    # Ranks are whole numbers of RANK_BITS bits; a document that may not get another copy has none.
    rank = F.floor(odds / (1 + odds) * float(1 << RANK_BITS)).cast("bigint")
    wanted = wanted.withColumn("rank", F.when(F.col("p") > 0, rank))
    chosen = _with_plan(wanted, _cutoffs(spark, wanted, few), few, "left")
    prefix = F.shiftright("rank", RANK_BITS - ROUNDS * CELL_BITS)
    upto = F.struct("rank", F.coalesce("doc_id", F.lit(-1)), "key") <= F.col("edge")
    first = (prefix < F.col("prefix")) | ((prefix == F.col("prefix")) & F.coalesce(upto, F.lit(False)))
    more = F.when(F.coalesce(first, F.lit(False)), 1).otherwise(0)
    return chosen.select(
        "doc_id", "source", "key", "size", "source_size", "target", (F.col("sure") + more).alias("copies")
    )


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with their source's row of ``plan``; ``few`` says that sources are few enough to send."""
    other = plan.withColumnRenamed("source", "source_")
    other = F.broadcast(other) if few else other
    return rows.join(other, F.col("source").eqNullSafe(F.col("source_")), how).drop("source_")


def _cutoffs(spark: SparkSession, wanted: DataFrame, few: bool) -> DataFrame:
    """source, prefix and edge: documents whose rank starts with less than ``prefix`` get another copy,
    and of those that start with it the ones up to ``edge``, a (rank, id, key)."""
    ranked = wanted.filter("rank IS NOT NULL")
    need = wanted.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("need"))
    state = stored(
        spark,
        need.withColumns({"prefix": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")}),
        "mix-state",
    )
    bits = RANK_BITS
    for _ in range(ROUNDS):
        now = bits - CELL_BITS
        cells = (
            _with_plan(ranked.select("source", "rank", "size"), state, few)
            .filter(F.shiftright("rank", bits) == F.col("prefix"))
            .groupBy("source", F.shiftright("rank", now).alias("cell"))
            .agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("before").alias("before"))
        )
        # At most 2 ** CELL_BITS rows of a source meet here.
        order = Window.partitionBy("source").orderBy("cell")
        sums = cells.withColumn("to", F.col("before") + F.sum("words").over(order))
        here = F.struct("cell", (F.col("to") - F.col("words")).alias("before"))
        first = sums.groupBy("source").agg(
            F.coalesce(F.min(F.when(F.col("to") >= F.col("need"), here)), F.max(here)).alias("hit"),
            F.first("need").alias("need"),
        )
        state = stored(
            spark, first.select("source", "need", F.col("hit.cell").alias("prefix"), F.col("hit.before").alias("before")), "mix-state"
        )
        bits = now
    near = _with_plan(ranked.select("source", "rank", "doc_id", "key", "size"), state, few)
    order = Window.partitionBy("source").orderBy("rank", F.coalesce("doc_id", F.lit(-1)), "key")
    last = near.filter(F.shiftright("rank", bits) == F.col("prefix")).withColumn(
        "to", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    # A document is taken if that brings the sum nearer to what is needed.
    taken = last.filter(F.abs(F.col("to") - F.col("need")) <= F.abs(F.col("to") - F.col("size") - F.col("need")))
    edges = taken.groupBy("source").agg(F.max(F.struct("rank", F.coalesce("doc_id", F.lit(-1)).alias("id"), "key")).alias("edge"))
    return _with_plan(state.select("source", "prefix"), edges, few, "left")


def repeat_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, columns as they are."""
    id_, key, origin, copies = (free_name(docs, n) for n in ("mix_id", "mix_key", "mix_source", "mix_copies"))
    shares = mix(spark, docs).groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("source").alias(origin))
    shares = shares.agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    # The digest comes first in the join: it spreads rows whatever the ids are.
    same = (F.md5(F.coalesce("text", F.lit(""))) == F.col(key)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_))
    both = docs.join(shares, same & F.col("source").eqNullSafe(F.col(origin)))
    many = both.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every row of ``documents``."""
    done = mix(spark, table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_W = "CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END"
ORACLE_OP4 = rf"""
WITH RECURSIVE r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(text, '')) AS key FROM documents),
d AS (SELECT *, CASE WHEN size < {SHORT} THEN 1 ELSE 2 END AS pref,
    (CAST('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || key), 1, 12) AS BIGINT)::DOUBLE + 0.5)
      / 281474976710656.0 AS u FROM r),
s AS (SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(size) FILTER (pref = 1), 0)::BIGINT AS s1,
    coalesce(sum(size) FILTER (pref = 2), 0)::BIGINT AS s2,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, {_W} AS weight FROM s),
levels(level, round) AS (SELECT 0.0::DOUBLE, 0 UNION ALL
  SELECT ((SELECT sum(source_size) FROM w)
     - (SELECT coalesce(sum(3 * source_size) FILTER (3 * source_size <= level * weight), 0) FROM w))::DOUBLE
     / (SELECT sum(weight) FILTER (NOT 3 * source_size <= level * weight) FROM w), round + 1
  FROM levels WHERE round < 100 AND (SELECT count(*) FROM w WHERE NOT 3 * source_size <= level * weight) > 0),
t AS (SELECT *, least((3 * source_size)::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM w),
p AS (SELECT *, target / greatest(s1 + 2 * s2, 1) AS level FROM t),
m AS (SELECT source, source_size, target, least(3.0::DOUBLE, 2 * level) AS m2,
    least(3.0::DOUBLE, CASE WHEN 2 * level > 3 THEN (target - 3 * s2) / greatest(s1, 1) ELSE level END) AS m1 FROM p),
x AS (SELECT d.*, source_size, target, CASE WHEN pref = 1 THEN m1 ELSE m2 END AS m
    FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
y AS (SELECT *, floor(m)::BIGINT AS sure, m - floor(m) AS p FROM x),
z AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds,
    target - sum(sure * size) OVER (PARTITION BY source) AS need FROM y),
o AS (SELECT *, sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source
    ORDER BY floor(odds / (1 + odds) * 281474976710656.0) NULLS LAST, coalesce(doc_id, -1), key ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY source ORDER BY floor(odds / (1 + odds) * 281474976710656.0) NULLS LAST, coalesce(doc_id, -1), key) AS place FROM z),
e AS (SELECT source, max(place) FILTER (odds IS NOT NULL AND abs(upto - need) <= abs(upto - size - need)) AS edge FROM o GROUP BY source)
SELECT doc_id, size, source_size, target,
  (sure + CASE WHEN odds IS NOT NULL AND place <= edge THEN 1 ELSE 0 END) * size AS taken
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""
