"""Mixing, packing, token counts, classifiers and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opstrail.llm import mixing as mx
from opstrail.llm import packing as pk
from opstrail.llm import quality_classifier as qc
from opstrail.llm import token_counts as tc
from opstrail.llm import toxicity as tx
from opstrail.llm.learning import held_out


def plain_targets(sums):
    """Share by weight, cut at three times the source, share the rest again."""
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sums.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * sums[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sums[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_of_odd_rows(spark, odd, none, rows):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
    want = plain_targets(sizes)
    got = mx.mix(spark, odd).collect()
    assert len(got) == len(rows)
    taken, most = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    again = mx.mix(spark, odd.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mx.mix(spark, none).count() == 0


def test_repeated_documents(spark, odd, none):
    copies = Counter()
    for r in mx.mix(spark, odd).collect():
        copies[r.doc_id, r.source] += r.copies
    mixed = mx.repeat_documents(spark, odd)
    assert mixed.columns == odd.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +copies
    assert mx.repeat_documents(spark, none).count() == 0


@pytest.mark.parametrize("few", [50_000, 1])
def test_hot_source_near_target(spark, monkeypatch, few):
    monkeypatch.setattr(mx, "FEW_SOURCES", few)
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([1, 5, 60, 300]), "hot" if i % 3 == 0 else f"s{i % 40:02}") for i in range(3000)]
    got = mx.mix(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        per[r.source][0] += r.copies * r.size
        per[r.source][1] = r.target
    assert all(abs(a - b) <= 300 for a, b in per.values())


def test_cuts_fill_bins():
    for capacity in (64, 2048):
        for rest in range(capacity):
            pieces = pk.cut_rest(rest, capacity)
            assert sum(n for n, _ in pieces) == rest
            assert all(0 < n <= size <= capacity for n, size in pieces)


def test_packing_of_odd_rows(spark, odd, none, rows):
    path = pk.tokenizer_path()
    got = pk.pack(spark, odd, keep_ids=True).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    want = Counter((i, bytes(np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))) for i, t, *_ in rows)
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= pk.CAPACITY
    # Repeated rows have equal pieces: each start appears as often as the row.
    have = Counter()
    for (i, _), parts in docs.items():
        by_start = defaultdict(Counter)
        for start, ids in parts:
            by_start[start][ids] += 1
        singles = [by_start[s] for s in sorted(by_start)]
        if all(len(c) == 1 for c in singles):
            have[i, b"".join(next(iter(c)) for c in singles)] += next(iter(singles[0].values()))
    assert all(want[k] == n for k, n in have.items()) and sum(len(r.ids) for r in got) == sum(len(k[1]) * n for k, n in want.items())
    assert pk.pack(spark, none).count() == 0


def test_ids_like_the_unchanged_library():
    from tokenizers import Tokenizer

    encode, exact = pk.Ids(pk.tokenizer_path()), Tokenizer.from_file(pk.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a  b \n\n c", "x" * 5000, " " * 400_000 + "a", "\U0001d4b3 ü"]
    for text in texts:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert encode(texts[0]).tolist() == [64, 220, 50256, 275]


def plain_count(word, pieces, byte):
    token = tc.MARKER + word
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        options += [(best[s][0] + pieces[token[s:end]], best[s][1] - 1) for s in range(end) if token[s:end] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_of_odd_rows(spark, odd, none, rows):
    pieces = tc.load_pieces(tc.vocabulary_path())
    byte = tc.TrieCounter(pieces).byte
    short = odd.filter("doc_id IS NULL OR doc_id NOT IN (107, 109)")
    got = Counter(map(tuple, tc.count_tokens(short).collect()))
    want = Counter()
    for i, t, *_ in rows:
        if i not in (107, 109):
            w = (t or "").encode().split()
            want[i, len(w), sum(plain_count(x.decode(), pieces, byte) for x in w)] += 1
    assert got == want
    long = {r.doc_id: r.n_words for r in tc.count_tokens(odd.filter("doc_id IN (107, 109)")).collect()}
    assert long == {107: 30_004, 109: 1}
    assert tc.count_tokens(none).count() == 0


def test_unigram_library_agrees():
    from tokenizers import Tokenizer, models

    pieces = tc.load_pieces(tc.vocabulary_path())
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
    words = {"training", "tokens", "counts", "prefix", "prefixes", "a", "zzz", "internationalisation", "data" * 20}
    got = tc.TrieCounter(pieces).counts({tc.MARKER + w for w in words})
    assert got == {tc.MARKER + w: len(library.encode(tc.MARKER + w).tokens) for w in words}


def accuracy(found, labels, column):
    both = found.filter("held_out").join(labels, "doc_id").select("score", "predicted", column).toPandas()
    y, rank = both[column].to_numpy(), both["score"].rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0), (both["predicted"].to_numpy() == y).mean()


@pytest.mark.parametrize("query,column", [(tx.op8_toxicity, "toxic"), (qc.op9_quality_classifier, "quality")])
def test_held_out_accuracy(spark, query, column):
    sf_dir = "/root/testdata/sf0.1"
    auc, right = accuracy(query(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), column)
    assert auc > 0.97 and right > 0.95


def test_fold_is_crc32(spark):
    ids = [0, 7, -3, 10**15, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    assert [r.h for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_classifiers_on_odd_rows(spark, odd, none, rows):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    for docs, n in ((odd, len(rows)), (none, 0)):
        for held in (labels, labels.filter("1 = 0")):
            for module in (tx, qc):
                got = module.score(docs, module.train(docs, held)).collect()
                assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    kept = tx.reject_toxic(odd, tx.Model({"nothing": 9.0}, -5.0, True), 0.3)
    assert kept.columns == odd.columns and kept.count() == len(rows)


def labelled(spark, n, toxic, seed=4):
    """Documents of common words, labelled; ``toxic`` gives label and further words of a row."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label, more = toxic(i, rng)
        rows.append((i, " ".join([*(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(8)), *more]), label))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic").filter("toxic IS NOT NULL")


@pytest.mark.parametrize(
    "n,toxic",
    [
        (200, lambda i, rng: (None, [])),
        (30, lambda i, rng: (i % 2, [])),
        (200, lambda i, rng: (1, ["scum"])),
        (200, lambda i, rng: (0, [])),
        (600, lambda i, rng: (int(rng.random() < 0.5), [f"w{rng.randrange(200)}"])),  # noise, with chance features
        (20, lambda i, rng: (i % 2, ["scum"] * (i % 2))),  # too few to be sure
    ],
    ids=["none", "few", "toxic", "clean", "noise", "twenty"],
)
def test_nothing_goes_without_a_certified_model(spark, n, toxic):
    docs, labels = labelled(spark, n, toxic)
    model = tx.train(docs, labels)
    assert not model.certified and tx.reject_toxic(docs, model, tx.THRESHOLD).count() == n


def test_certified_model_drops_what_it_knows(spark):
    docs, labels = labelled(spark, 400, lambda i, rng: (int(i % 2 == 0), ["scum", "vile"] if i % 2 == 0 else []))
    model = tx.train(docs, labels)
    more = docs.unionByName(spark.createDataFrame([(1000, ""), (1001, None), (1002, "unheard of words")], docs.schema))
    kept = {r.doc_id for r in tx.reject_toxic(more, model, tx.THRESHOLD).collect()}
    assert model.certified and kept == {i for i in range(400) if i % 2} | {1000, 1001, 1002}


def test_chance_of_at_least():
    assert tx.at_least(0, 5, 0.2) == 1 and tx.at_least(3, 3, 0.5) == pytest.approx(0.125) and tx.at_least(1, 4, 0.0) == 0
    assert tx.at_least(2, 10, 0.1) == pytest.approx(1 - 0.9**10 - 10 * 0.1 * 0.9**9)


def plain_features(text):
    words = set(re.findall(r"\w+", text.lower()))
    return words | {"^" + w[:5] for w in words if len(w) > 5}


def test_toxicity_score_like_plain_sum(spark, odd, rows):
    docs, labels = labelled(spark, 300, lambda i, rng: (int(i % 3 == 0), ["scum"] if i % 3 == 0 else ["women"]))
    model = tx.train(docs, labels)
    assert model.weights
    for df, texts in ((docs, {r.doc_id: r.text for r in docs.collect()}), (odd.filter("doc_id < 106"), {i: t for i, t, *_ in rows if i is not None and i < 106})):
        got = {r.doc_id: r.score for r in tx.score(df, model).collect()}
        want = {i: 1 / (1 + math.exp(-model.bias - sum(w for f, w in model.weights.items() if f in plain_features(t or "")))) for i, t in texts.items()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_a_repeated_id_is_one_row_of_the_fit(spark, monkeypatch):
    docs, labels = labelled(spark, 40, lambda i, rng: (i % 2, []))
    many = docs.unionByName(docs.crossJoin(spark.range(50).select(F.col("id").alias("n"))).drop("n"))
    seen = []
    monkeypatch.setattr(tx, "fit", lambda rows, balance: (seen.append(rows.count()), ({}, 0.0))[1])
    tx.train(many, labels, most=5)
    rated = qc.rate_all(many)
    assert seen[0] == 5
    fitted = []
    monkeypatch.setattr(qc, "fit_pu", lambda pos, *a: (fitted.append(len(pos)), np.zeros(qc.N_RATES * qc.BINS + 1))[1])
    qc.train_rated(rated, labels.withColumnRenamed("toxic", "quality"), most=5)
    assert fitted[-1] == 5


def test_counterfactual_penalty(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(8)]
        if toxic:
            words.append("scum" if rng.random() < 0.7 else "beta")
        if rng.random() < (0.8 if toxic else 0.05):  # the term goes with the label
            words.append("women")
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    probe = spark.createDataFrame([(0, "alpha beta gamma women"), (1, "alpha beta gamma men"), (2, "alpha beta gamma")], "doc_id bigint, text string")
    gaps = []
    for balance in (0.0, 20.0):
        model = tx.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), balance=balance)
        s = {r.doc_id: r.score for r in tx.score(probe, model).collect()}
        gaps.append(abs(s[0] - s[1]))
    assert gaps[1] < 0.5 * gaps[0]


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    cells = np.arange(qc.N_RATES) * qc.BINS

    def draw(n, top):
        return cells + rng.integers(0, qc.BINS, (n, qc.N_RATES)) // (1 if top else 3)

    pos, unl = draw(4000, False), rng.permutation(np.concatenate([draw(2400, False), draw(1600, True)]))
    w = qc.fit_pu(pos[::2], unl[::2], 0.5)
    own, all_ = qc.value(w, pos[1::2]), qc.value(w, unl[1::2])
    cuts = np.quantile(own, qc.LEVELS)
    found = qc.prior_of(qc.reached(own, cuts) / len(own), qc.reached(all_, cuts) / len(all_), len(own), len(all_))
    assert found == pytest.approx(0.6, abs=0.08)


def plain_pu_risk(w, pos, unl, weight, prior):
    g = lambda row: w[-1] + sum(w[c] for c in row)
    plus = sum(math.log1p(math.exp(-g(r))) for r in pos) / len(pos)
    minus = sum(math.log1p(math.exp(g(r))) for r in pos) / len(pos)
    rest = sum(x * math.log1p(math.exp(g(r))) for r, x in zip(unl, weight, strict=True)) / sum(weight)
    return prior * plus + max(0.0, rest - prior * minus)


def test_fit_lowers_the_plain_risk():
    rng = np.random.default_rng(4)
    cells = np.arange(qc.N_RATES) * qc.BINS
    pos, unl = cells + rng.integers(0, 5, (300, qc.N_RATES)), cells + rng.integers(0, 9, (400, qc.N_RATES))
    weight = rng.random(400) + 0.5
    w = qc.fit_pu(pos, unl, 0.4, weight)
    start = np.append(np.zeros(qc.N_RATES * qc.BINS), np.log(0.4 / 0.6))
    best = plain_pu_risk(w, pos, unl, weight, 0.4)
    assert best < 0.3 * plain_pu_risk(start, pos, unl, weight, 0.4)
    # Weights are counts: a row of weight 2 is two rows.
    twice = np.concatenate([unl, unl[:50]])
    heavy = np.append(np.full(50, 2.0), np.ones(350))
    assert plain_pu_risk(w, pos, twice, np.ones(450), 0.4) == pytest.approx(plain_pu_risk(w, pos, unl, heavy, 0.4))


def test_quality_score_like_plain_cells(spark):
    """Scores from rates, cuts and weights, one by one; cuts from plain sorting of all rates."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bins, w, prior = qc.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    made = {i: qc.rates(t) for i, t in texts.items()}
    for i, cuts in enumerate(bins.cuts):
        column = sorted(r[i] for r in made.values())
        at = [column[max(math.ceil(q * len(column) - 1e-9) - 1, 0)] for q in qc.CUTS]
        want = sorted(set(at))
        # A cut is the upper end of a bucket: no less than the quantile, and 1 in 256 more at most.
        assert all(any(x <= c <= x * (1 + 2**-8) + 1e-300 for c in cuts) for x in want)
        cells = [sum(c < v for c in cuts) for v in column]
        assert [bins.held[i * qc.BINS + b] for b in range(qc.BINS)] == [cells.count(b) for b in range(qc.BINS)]
    got = {r.doc_id: r.score for r in qc.score(docs, (bins, w, prior)).collect()}
    for i, r in made.items():
        g = w[-1] + sum(w[j * qc.BINS + sum(c < v for c in bins.cuts[j])] for j, v in enumerate(r))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, g)))))


def test_junk_of_one_in_fifty_thousand(spark):
    """A kind of text that one document in 50,000 has sets a cut, and is in the sample with its true weight."""
    n = 50_000
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(500 + k)).cast("string")) for k in range(12)])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 31_415, F.lit("| ! " * 40)).otherwise(text).alias("text"))
    rated = qc.rate_all(docs)
    bins = qc.bins_of(rated)
    junk = np.array([qc.rates("| ! " * 40)])
    place = qc.rates("").__len__() and [i for i in range(qc.N_RATES) if bins.held[bins(junk)[0, i]] == 1]
    assert len(place) >= 3 and bins.stratum(bins(junk))[0] == 15
    rows, _, weight = qc.draw(rated, bins, 3_000)
    mine = (rows == junk).all(axis=1)
    assert mine.sum() == 1 and weight[mine] == pytest.approx(1.0) and weight.sum() == pytest.approx(n) and len(rows) < 4_000


def test_stages_on_odd_rows(spark, odd, none, tmp_path, rows):
    sf_dir = str(tmp_path)
    odd.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        assert got.count() > 0 and stage(spark, none, sf_dir).count() == 0, name
        if name != "packing":
            assert got.columns == odd.columns
            assert dict(got.dtypes) == dict(odd.dtypes)


def test_pipeline_like_plain_python(spark):
    """Each stage's decisions over the small table, from plain readings of its operator."""
    from tests.llm.test_similarity import components, plain_fingerprint

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(i in texts for i, toxic in labels.items() if not toxic)
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    distinct = sorted(set(fps.values()))
    group = dict(zip(distinct, components(distinct), strict=True))
    low = {}
    for i in sorted(fps):
        low.setdefault(group[fps[i]], i)
    assert sorted(r.doc_id for r in single.collect()) == sorted(low.values())
    clean = corpus_pipeline.redact_pii(spark, single, sf_dir)
    assert all(r.n_chars == len(r.text) and "@mail" not in r.text for r in clean.collect())
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.agg(F.sum("length")).first()[0] > 0 and {r.doc_id for r in done.collect()} <= set(low.values())


def test_last_stages_like_plain_python(spark):
    """Mixing by plain targets; packing by the library's ids of every mixed text, all there and in place."""
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).localCheckpoint()
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir).localCheckpoint()
    size = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    sums, taken, most = Counter(), Counter(), Counter()
    for source, n in size.values():
        sums[source] += n
        most[source] = max(most[source], n)
    copies = Counter(r.doc_id for r in mixed.collect())
    for i, n in copies.items():
        taken[size[i][0]] += n * size[i][1]
    assert max(copies.values()) <= 3 and all(abs(taken[s] - t) <= most[s] for s, t in plain_targets(sums).items())
    exact = Tokenizer.from_file(pk.tokenizer_path())
    want = {r.doc_id: np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, pk.END_ID], "<u4").tobytes() for r in mixed.distinct().collect()}
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in corpus_pipeline.pack_sequences(spark, mixed, sf_dir).collect():
        pieces[r.doc_id][r.start, bytes(r.ids)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: b"".join(ids for _, ids in sorted(p)) for i, p in pieces.items()} == want
    assert all(set(p.values()) == {copies[i]} for i, p in pieces.items())
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [at for at, _ in parts] == [0, *ends[:-1]] and ends[-1] <= pk.CAPACITY
