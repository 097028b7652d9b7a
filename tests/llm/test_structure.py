"""Conversation repair, exact top-k and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from opstrail.llm import conversation_repair as cr
from opstrail.llm import periodic_runs as pr
from opstrail.llm import topk as tk

SPACE = " \t\n\x0b\x0c\r"
SF_DIR = "/root/testdata/sf0.001"


# Conversation repair ---------------------------------------------------------------------------------------


def plain_repair(kinds):
    """(cost, audit) by trying all edits, row by row."""

    @cache
    def after(i, state, room):
        best = (0, "") if i == len(kinds) and state in "0a" else (1 << 30, "")
        nexts = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
        options = []
        if room:  # two insertions in a row are enough between two rows
            options += [(2, "I", i, r, room - 1) for r in nexts if r in "ua"]
        if i < len(kinds):
            kind = kinds[i]
            options.append((3, "D", i + 1, state, 3))
            for r in nexts if kind != "-" else "":
                if r == kind.lower():
                    options.append((int(kind.isupper()), "K", i + 1, r, 3))
                elif r in "ua":
                    options.append((2 + kind.isupper(), "R", i + 1, r, 3))
        for cost, letter, j, r, left in options:
            far, rest = after(j, r, left)
            best = min(best, (cost + far, letter + rest))
        return best

    return after(0, "0", 3)


@pytest.mark.parametrize("seed", range(6))
def test_search_like_all_edits(seed):
    rng = random.Random(seed)
    assert cr.search("") == (0, "")
    for _ in range(400):
        kinds = "".join(rng.choice("suaxSUAX-" if seed % 2 else "uaua-sU") for _ in range(rng.randint(1, 9)))
        assert cr.search(kinds) == plain_repair(kinds), kinds


def test_search_of_a_long_conversation():
    kinds = "s" + "ua" * 40_000
    assert cr.search(kinds) == (0, "K" * len(kinds))
    cost, audit = cr.search("ua" * 5_000 + "u-x" + "ua" * 5_000)
    assert cost == 5 and audit == "K" * 10_001 + "DR" + "K" * 10_000


def plain_report(rows):
    """Contract's columns of one conversation from its rows after damage, in order."""
    fault, seen, kinds = [], set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        f = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        fault.append(f)
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        kinds.append("-" if f in ("blank", "duplicate") else kind.upper() if f else kind)
    cost, audit = cr.search("".join(kinds))
    out, left = [], iter(rows)
    for letter in audit:
        role, text = next(left)[1:] if letter != "I" else ("", "")
        if letter in "IR":
            role = "assistant" if out and out[-1][:1] == "u" else "user"
        if letter != "D":
            out.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    n = Counter(fault)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_damage(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        x = zlib.crc32(":".join(shown).encode()) % 20
        here = convs[conv]
        if x == 1:
            text = ""
        if x == 2:
            text = "".join(c for c in text if c not in ".!?")
        if x == 4:
            role = "user"
        here += [(turn, role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return {c: plain_report(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in convs.items()}


def compare_damaged(df):
    got = cr.report(cr.repair(cr.damage(df), F.col("present"))).collect()
    want = plain_damage([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    compare_damaged(df)
    assert cr.op11_conversation_repair(spark, SF_DIR).count() == df.select("conv_id").distinct().count()


def test_repair_of_odd_rows(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "u", "agent"]
    texts = ["Hi.", "Yes!", "No", "", " \n", None, "ünï?", "x" * 200_000 + ".", "Hi."]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("present", "repeated", "edit", "step", "fault", "copy", "kinds")})
    compare_damaged(df)
    compare_damaged(df.filter("false"))


def test_one_large_conversation(spark, monkeypatch):
    """A third of all rows in one conversation, with a text common to all; texts go through the spool's disk."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", "same." if i % 3 == 0 else f"text {i}.") for i in range(2_000)]
    rows += [(100 + i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(4_000)]
    compare_damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7))
    monkeypatch.setattr(cr, "SPOOL", 10)
    small = cr.Rows()
    for row in ((1, "user", "Hi.", False), (None, "assistant", "ünï?", False)):
        small.add(*row)
    assert small.spool._rolled and list(small) == [(1, "user", "Hi.", None), (None, "assistant", "ünï?", None)]


def test_edits_are_the_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hm."), (1, 2, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    got = [(r.edit, r.fault, r.old_role, r.role, r.text) for r in cr.repair(df).orderBy("step").collect()]
    assert got == [("K", None, "user", "user", "Hi."), ("R", None, "user", "assistant", "Hm."), ("D", "duplicate", "user", None, None)]


# Exact top-k -----------------------------------------------------------------------------------------------


def plain_topk(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(ok):
        if i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(q, c, strict=False)), j is None, j or 0, j) for b, (j, c) in enumerate(ok) if b != a]
        out.update((i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(sorted(found)[:k]))
    return out


def topk_rows(df):
    return Counter(tuple(r) for r in tk.nearest(df.sparkSession, df, F.col("vec_id") % 50 == 0).collect())


@pytest.mark.parametrize("width", [1, 8, 300])
def test_topk_like_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(tk, "GROUP_BYTES", 1 << 14)
    monkeypatch.setattr(tk, "BLOCK", 16)
    monkeypatch.setattr(tk, "SEEDS", 20)
    monkeypatch.setattr(tk, "TOGETHER", 7)
    rng = np.random.default_rng(width)
    decay = 1 / (1 + np.arange(width))
    rows = [(i, (rng.normal(size=width) * decay * rng.choice([0.1, 1, 3])).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert topk_rows(df) == plain_topk(rows)


def test_topk_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tk, "GROUP_BYTES", 1 << 12)
    monkeypatch.setattr(tk, "SEEDS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]  # many ties
    rows += [(50, [1.0, 0, 0, 1]), (50, [1.0, 0, 0, 1]), (100, [0.5, 2, 0, 1])]  # equal rows, an id with other vectors
    rows += [(i, [2.0, 2, 2, 2]) for i in range(200, 280)]  # one very common vector
    rows += [(None, [2.0, 2, 2, 2]), (None, [9.0, 0, 0, 0]), (400, None), (450, [1.0, None, 2, 3]), (500, [float("nan"), 1, 1, 1])]
    rows += [(550, [float("inf"), 1, 1, 1]), (600, []), (650, [1.0]), (700, [1.0, 2, 3, 4, 5, 6]), (-50, [-0.0, 0.0, -0.001, 0])]
    rows = [(i, v and [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("v", "vec", "length", "copies", "group", "ask", "query", "score", "label")})
    assert topk_rows(df) == plain_topk(rows)
    assert not topk_rows(df.filter("false")) and not topk_rows(df.filter("vec_id = 51"))
    assert topk_rows(df.filter("vec_id = 50").limit(1)) == Counter()
    wide = [(i, [x]) for i, x in enumerate([2.0**30, 2.0**20 + 0.5, -(2.0**22), 1e300, 3.0])]
    most = 2**63 - 1  # where scores are held
    got = topk_rows(spark.createDataFrame(wide, "vec_id bigint, embedding array<double>"))
    assert got == Counter([(0, 1, 1, most), (0, 2, 3, most), (0, 3, 4, 3 * 2**46), (0, 4, 2, -most)])


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(200, 40)))
    turns = [np.linalg.qr(rng.normal(size=(n, n)))[0] for n in (24, 16)]
    head, rest = tk.rotated(x, turns)
    room = tk.ROUNDING * np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    assert (head @ head.T + np.outer(rest, rest) + room >= x @ x.T).all()
    assert np.allclose((head**2).sum(axis=1) + rest**2, (x**2).sum(axis=1))


# Periodic runs ---------------------------------------------------------------------------------------------


def plain_runs(w, least=12):
    """Every run by trying each period: longest stretches that repeat with it, where it is the smallest."""
    n, out = len(w), []
    spans = {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                spans.setdefault((i, j + q), q)
            i = j
    for (i, j), q in spans.items():
        if j - i >= max(least, 2 * q):
            out.append((i, j - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 4])
def test_runs_like_plain_search(letters):
    rng = random.Random(letters)
    texts = [[rng.choice("abcd"[:letters]) for _ in range(rng.randint(0, 90))] for _ in range(150)]
    for _ in range(100):  # periodic stretches, with and without faults
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        t = [rng.choice("abcd") for _ in range(rng.randint(0, 9))] + unit * rng.randint(2, 9) + unit[: rng.randint(0, len(unit))]
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "z"
        texts.append(t + [rng.choice("abcd") for _ in range(rng.randint(0, 9))])
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts += [list(fib[-1]), [], list("abc" * 100)]
    got = pr.find_runs(texts)
    for t, runs in zip(texts, got, strict=True):
        assert runs == plain_runs(t), "".join(t)
    assert [pr.find_runs([t], 8)[0] for t in texts[:40]] == [plain_runs(t, 8) for t in texts[:40]]


def test_runs_of_one_word_and_of_common_passages():
    assert pr.find_runs([["a"] * 50_000]) == [[(0, 50_000, 1)]]
    rng = random.Random(8)
    line = [f"l{i}" for i in range(10)]
    text = [w for i in range(3_000) for w in (f"x{rng.randrange(10**9)}", *line)]  # as many left words as lines
    assert pr.find_runs([text]) == [[]]


def plain_planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def plain_row(doc_id, text):
    w = plain_planted(doc_id, text)
    runs = pr.find_runs([w])[0] if len(w) > 3_000 else plain_runs(w)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * length // period if runs else None
    return (doc_id, len(runs), start, length, period, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_the_table(spark):
    got = pr.op13_periodic_runs(spark, SF_DIR).collect()
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert Counter(map(tuple, got)) == Counter(plain_row(r.doc_id, r.text) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > len(got) // 20


def test_runs_of_odd_rows(spark, odd, none, rows, tmp_path):
    some = odd.withColumns({c: F.lit("x") for c in ("runs", "collapsed", "best", "n_runs")})
    extra = spark.createDataFrame([(i, " ".join(["a b c"] * (i % 7)), "en", "s", 0) for i in range(1000, 1100)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    some.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(plain_row(i, t) for i, t, *_ in rows) + Counter(plain_row(i, " ".join(["a b c"] * (i % 7))) for i in range(1000, 1100))
    assert Counter(map(tuple, pr.op13_periodic_runs(spark, str(tmp_path)).collect())) == want
    assert pr.periodic_runs(none).count() == 0
