"""Quality rules and personal data."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from opstrail.llm import pii
from opstrail.llm import quality_rules as q
from opstrail.llm.common import stored


def repeated(words, k=8):
    seen, twice = {}, set()
    for i in range(len(words) - k + 1):
        g = tuple(words[i : i + k])
        if g in seen:
            twice |= {i, seen[g]}
        else:
            seen[g] = i
    return len({i + j for i in twice for j in range(k)})


def test_statistics_of_odd_rows(odd, rows):
    got = sorted(map(tuple, q.statistics(odd).select("n_words", "word_chars", "n_repeat_words", "n_dup_lines").collect()))
    want = []
    for _, text, *_ in rows:
        w = (text or "").encode().split()
        w = [x.decode() for x in w]
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        want.append((len(w), sum(map(len, w)), repeated(w), len(lines) - len(set(lines))))
    assert got == sorted(want)


def test_repeats_by_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.n_repeat_words for r in q.statistics(df).collect()}
    assert got == {i: repeated(t.split()) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.3), (500, 1, 0.01), (4000, 20, 0.0083), (100, 60, 0.5), (7, 7, 0.2), (250_000, 2000, 0.0085)])
def test_binomial_tail_is_exact(spark, n, k, p):
    got = spark.range(1).select(q.binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
    terms = [
        math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
        for j in range(k + 1)
    ]
    assert got == pytest.approx(1.0 if k >= n * p else math.fsum(terms), rel=1e-7)


def test_false_rejections_stay_below_the_limit(spark):
    stats = stored(spark, q.statistics(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")), "t")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = q.apply_rules(stats, q.certified_cutoffs(stats, labels)).join(labels, "doc_id").filter("NOT base_failed")
    per = judged.groupBy("stratum", "quality").agg(F.avg((~F.col("kept")).cast("int")).alias("rejected"), F.count("*").alias("n")).collect()
    assert all(r.rejected <= q.ALPHA for r in per if r.quality == 1)
    assert sum(r.rejected * r.n for r in per if r.quality == 0) > 0.5 * sum(r.n for r in per if r.quality == 0)


def test_rules_without_labels_or_rows(spark, odd, none, rows):
    labels = odd.select("doc_id", F.lit(1).alias("quality")).filter("1 = 0")
    stats = stored(spark, q.statistics(odd), "t")
    judged = q.apply_rules(stats, q.certified_cutoffs(stats, labels)).collect()
    assert len(judged) == len(rows) and all(r.kept == (not r.base_failed) for r in judged)
    empty = stored(spark, q.statistics(none), "t")
    assert q.apply_rules(empty, q.certified_cutoffs(empty, labels)).count() == 0


def plain_spans(text):
    """The base kinds, read off the contract with Python's own patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def base_of(df):
    return {r.doc_id: r.spans for r in pii.find_spans(df).select("doc_id", pii.written(F.filter("spans", lambda x: x["base"])).alias("spans")).collect()}


def test_base_spans_by_brute_force(spark):
    rng = random.Random(9)
    parts = ["a@b.c", "_d@e.f", "x.y@z-1.co.uk", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (555) 123-4567", "+49 30 1234", "12", " ", "é", "𝒳", ".", "-", "+", "5500005555555559", "007.08.9.0255"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert base_of(df) == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_many_spans_and_long_runs(spark):
    texts = {
        0: ("a@b.cc " * 1500, 1500),
        1: ("7" * 200_000, 0),
        2: ("a" * 300_000 + "@x.y", 1),
        3: ("+1" + " " * 100_000 + "23456789", 1),
        4: ("1.1.1." * 4_000, 3_000),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id bigint, text string")
    assert {i: len([x for x in s.split(",") if x]) for i, s in base_of(df).items()} == {i: n for i, (_, n) in texts.items()}


def test_checksums_and_context(spark):
    texts = {
        0: "IBAN DE89 3704 0044 0532 0130 00 here",
        1: "IBAN DE88 3704 0044 0532 0130 00 here",
        2: "GB82WEST12345698765432.",
        3: "my ssn 219-09-9999 is",
        4: "order 219-09-9999 is",
        5: "ssn 000-09-9999",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: [(x["kind"], texts[r.doc_id][x["s"] : x["e"]]) for x in r.spans if not x["base"]] for r in pii.find_spans(df).collect()}
    assert got == {0: [("iban", "DE89 3704 0044 0532 0130 00")], 1: [], 2: [("iban", "GB82WEST12345698765432")], 3: [("ssn", "219-09-9999")], 4: [], 5: []}


def test_ibans_before_words_and_lists_of_ssns(spark):
    es, be, de, no = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    ssns = [f"{a}-{b}-{c}" for a, b, c in zip(range(219, 819), [*range(10, 60)] * 12, range(9000, 9600), strict=True) if a != 666]
    listed = ", ".join(ssns)
    texts = {
        0: (f"{es} El banco", [es]),
        1: (f"{be} BIC GKCCBEBB", [be]),
        2: (f"{be} EURO, {be} {de} {no} AND {es}", [be, be, de, no, es]),
        3: (f"REF AB12 {es} x", [es]),
        4: ("SSN: 219-09-9999, 457-55-5462", ["219-09-9999", "457-55-5462"]),
        5: ("SSN 219-09-9999, 000-12-3456, 457-55-5462", ["219-09-9999", "457-55-5462"]),
        6: (f"name | ssn\n{listed}", ssns),
        7: ("ssn 219-09-9999 " + "x " * 40 + "457-55-5462", ["219-09-9999"]),
        8: ("ssn 219-09-9999, order 457-55-5462", ["219-09-9999"]),
        9: ("219-09-9999, 457-55-5462", []),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id bigint, text string")
    got = {r.doc_id: [texts[r.doc_id][0][x["s"] : x["e"]] for x in r.spans if not x["base"]] for r in pii.find_spans(df).collect()}
    assert got == {i: want for i, (_, want) in texts.items()}
    assert "-9001" not in pii.redact(df).filter("doc_id = 6").first().text


def test_redaction_keeps_rows_and_columns(spark, odd, none, rows):
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.filter("doc_id IN (100, 101, 107)").collect()}
    assert texts[100] is None and texts[101] == "" and texts[107].endswith("mail me at [EMAIL]")
    assert pii.redact(none).count() == 0
    two = spark.createDataFrame([("x 1.2.3.4 a@b.cc, 12@1.2.3.4 end",)], "text string")
    assert pii.redact(two).first().text == "x [IP] [EMAIL], [EMAIL] end"
