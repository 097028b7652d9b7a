import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from opstrail.operators import filesync as ops
from opstrail.operators import known
from opstrail.operators import matching, ranges
from opstrail.plans import filesync
from opstrail.plans.filesync import copy_by_ranges, mirror_prefix, sync_run
from opstrail.sources import list_files, list_prefix


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "src"
    (folder / "below").mkdir(parents=True)
    (folder / "below" / "binlog.000009").write_text("deep")
    for name, text in {
        "binlog.000001": "same", "binlog.000002": "same", "binlog.000003": "other",
        "binlog.index": "x", "a b%20c.log": "odd name",
    }.items():
        (folder / name).write_text(text)
    return folder


def names(df):
    return sorted(r.name for r in df.select("name").collect())


def test_listing(spark, source):
    assert len(names(list_files(spark, str(source)))) == 5
    assert names(list_files(spark, str(source), "binlog.*", ".index")) == [
        "binlog.000001", "binlog.000002", "binlog.000003"
    ]
    assert names(list_files(spark, str(source), "[invalid]")) == []
    plan = list_files(spark, str(source))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_fingerprints(spark, source):
    got = {r.name: r.sha256 for r in ops.fingerprint(list_files(spark, str(source))).collect()}
    assert got["binlog.000001"] == got["binlog.000002"] == hashlib.sha256(b"same").hexdigest()
    assert got["a b%20c.log"] == hashlib.sha256(b"odd name").hexdigest()


def test_sync_runs(spark, source, tmp_path):
    dest, state, log = (str(tmp_path / n) for n in ("dest", "state", "log"))

    def run(**options):
        return sync_run(spark, str(source), dest, state, log, pattern="binlog.0*", **options)

    assert names(run()) == ["binlog.000001", "binlog.000003"]
    assert (tmp_path / "dest" / "binlog.000003").read_text() == "other"
    assert names(run()) == []
    (source / "binlog.000004").write_text("new")
    (source / "binlog.000003").write_text("other and more")
    assert names(run()) == ["binlog.000003", "binlog.000004"]
    assert len(names(run(checksum=False))) == 4
    known.reset_known(spark, state)
    assert len(names(run())) == 3
    rows = [json.loads(line) for f in (tmp_path / "log" / "runs").glob("part*") for line in f.read_text().splitlines()]
    assert sorted(r["n_files"] for r in rows) == [0, 2, 2, 3, 4]
    assert all(r["ok"] and r["n_failed"] == 0 and r["finished_at"] for r in rows)
    assert len({r["run_id"] for r in rows}) == 5
    assert not list((tmp_path / "dest").glob(".tmp*"))


def test_copy_pins_the_listed_length(spark, source, tmp_path):
    files = list_files(spark, str(source), "binlog.000003").cache()
    files.count()
    (source / "binlog.000003").write_text("other, grown since")
    copied = ops.copy_files(files, str(tmp_path / "d")).collect()
    assert [(r.ok, r.bytes, r.sha256) for r in copied] == [(True, 5, hashlib.sha256(b"other").hexdigest())]
    (source / "binlog.000003").write_text("cut")
    bad = ops.copy_files(files, str(tmp_path / "d")).collect()
    assert not bad[0].ok and "shrank" in bad[0].error
    assert (tmp_path / "d" / "binlog.000003").read_text() == "other"


def test_copies_are_dealt_out(spark, source, monkeypatch):
    files = list_files(spark, str(source))
    assert filesync._spread(files).rdd.getNumPartitions() == 5
    monkeypatch.setattr(filesync, "TASK_BYTES", 1)
    many = spark.range(100).select(F.lit(3).alias("length"))
    assert filesync._spread(many).rdd.getNumPartitions() == 100


def test_run_log_has_one_layout(spark):
    for n in (0, 3, 2500):
        copied = spark.range(n).select(
            F.concat(F.lit("/f"), "id").alias("path"), (F.col("id") != 2).alias("ok"),
            F.when(F.col("id") == 2, "broken\nfor a reason").otherwise("").alias("error"),
        )
        run = ops.run_log(copied, "r").collect()
        assert [(r.run_id, r.n_files, r.n_failed, r.ok) for r in run] == [("r", n, int(n > 2), n <= 2)]
        rows = ops.run_log_files(copied, "r").collect()
        assert len(rows) == n and [r.error for r in rows if not r.ok] == ["broken\nfor a reason"] * (n > 2)


def test_recursive_sync_keeps_folders_apart(spark, tmp_path):
    source = tmp_path / "src"
    for folder, text in (("a", "one"), ("b", "two"), ("a/deep", "three")):
        (source / folder).mkdir(parents=True, exist_ok=True)
        (source / folder / "log.1").write_text(text)
    (source / "b" / "log.idx").write_text("skipped")
    (source / "b" / "other").write_text("no match")
    dest, state = str(tmp_path / "dest"), str(tmp_path / "state")
    relative = os.path.relpath(source)
    for root in (relative, str(source)):
        copied = sync_run(spark, root, dest, state, pattern="log*", skip_ext=".idx", recursive=True)
        assert names(copied) == (["a/deep/log.1", "a/log.1", "b/log.1"] if root == relative else [])
    got = {str(p.relative_to(dest)): p.read_text() for p in (tmp_path / "dest").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert got == {"a/log.1": "one", "b/log.1": "two", "a/deep/log.1": "three"}


def test_relative_root_of_a_prefix(spark, tmp_path):
    (tmp_path / "root" / "p").mkdir(parents=True)
    (tmp_path / "root" / "p" / "x.txt").write_text("x")
    assert names(list_prefix(spark, os.path.relpath(tmp_path / "root"), "p/")) == names(list_prefix(spark, str(tmp_path / "root"), "p/")) == ["x.txt"]


def test_prefix(spark, tmp_path):
    for key in ("logs/2024/a.txt", "logs/2024-01/b.txt", "logs/x/c.txt", "other/d.txt"):
        path = tmp_path / "root" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(key)
    root = str(tmp_path / "root")
    got = {r.key: r.name for r in list_prefix(spark, root, "logs/2024").collect()}
    assert got == {"logs/2024/a.txt": "a.txt", "logs/2024-01/b.txt": "-01/b.txt"}
    mirror_prefix(spark, root, "logs", str(tmp_path / "copy"))
    assert (tmp_path / "copy" / "2024" / "a.txt").read_text() == "logs/2024/a.txt"
    assert (tmp_path / "copy" / "x" / "c.txt").exists() and not (tmp_path / "copy" / "d.txt").exists()


@pytest.mark.parametrize("max_keys", [None, 10, 10**9])
def test_hot_keys_are_spread_and_matched(spark, monkeypatch, max_keys):
    monkeypatch.setattr(matching, "HOT_ROWS", 100)
    df = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm")
        .otherwise(F.concat(F.lit("k"), "id")).alias("k"),
    )
    keys = spark.createDataFrame([("hot",), ("k2",), ("k5",), ("hot",), ("none",)], "k string")
    assert matching.with_keys(df, keys, "k", max_keys).count() == 3002
    assert matching.without_keys(df, keys, "k", max_keys).count() == 5998
    hot = {r.k for r in matching.hot_keys(df, "k").collect()}
    assert hot == {"hot", "warm"}


def test_state_in_runs(spark, tmp_path):
    state = str(tmp_path / "s")
    assert known.read_known(spark, state).count() == 0
    one = spark.createDataFrame([("a" * 64,), ("b" * 64,)], "sha256 string")
    known.append_known(one, state)
    known.append_known(one, state)
    assert known.read_known(spark, state).count() == 4
    assert ops.merged_state(known.read_known(spark, state), one).count() == 2


def hashes(spark, ids, salt):
    return spark.range(ids).select(F.sha2(F.concat(F.lit(salt), "id").cast("binary"), 256).alias("sha256"))


def test_known_hashes_by_prefix(spark, tmp_path, monkeypatch):
    """No known hash is missed, no new one is taken for known, and only prefixes that are asked for are read."""
    state = str(tmp_path / "s")
    for salt in ("a", "b"):
        known.append_known(hashes(spark, 3_000, salt), state)
    some = hashes(spark, 3_000, "b").union(hashes(spark, 2_000, "new")).union(spark.createDataFrame([(None,)], "sha256 string"))
    some.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    maybe = known.maybe_known(spark, asked, state)
    found = known.known_among(spark, asked, state)
    want = {r.sha256 for r in hashes(spark, 3_000, "b").collect()}
    assert {r.sha256 for r in found.collect()} == want <= {r.sha256 for r in maybe.collect()}
    assert maybe.count() < 3_010
    # A full filter says "perhaps" to all, and the second look still tells.
    few = hashes(spark, 5, "new").cache()
    asked_for = {r.sha256[:2] for r in few.collect()}
    for table in (known.maybe_known(spark, few, state), known._only(known.read_known(spark, state), sorted(asked_for))):
        scan = next(x for x in table._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
        folders = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert all(p in folders for p in asked_for)
    monkeypatch.setattr(known, "maybe_known", lambda spark, h, state: h.select("sha256").distinct())
    assert known.known_among(spark, few, state).count() == 0


def test_bits_set_before_hashes_cost_a_look_only(spark, tmp_path):
    state = str(tmp_path / "s")
    known.append_known(hashes(spark, 10, "a"), state)
    folder = tmp_path / "s" / "hashes"
    folder.rename(tmp_path / "lost")  # as if the run had stopped after its filters
    assert known.known_among(spark, hashes(spark, 10, "a"), state).count() == 0


def plain_tree(data, leaf):
    nodes = [hashlib.sha256(data[i : i + leaf]).hexdigest() for i in range(0, max(len(data), 1), leaf)]
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), 2):
            up.append(hashlib.sha256("".join(nodes[i : i + 2]).encode()).hexdigest() if i + 1 < len(nodes) else nodes[i])
        nodes = up
    return nodes[0]


def test_large_file_by_ranges(spark, tmp_path):
    rng = random.Random(5)
    sizes = {"big": 70_001, "even": 16 * 1024, "leaf": 1024, "none": 0, "odd": 5 * 1024 + 1}
    source = tmp_path / "source"
    source.mkdir()
    for name, n in sizes.items():
        (source / name).write_bytes(rng.randbytes(n))
    # Spark's listing leaves empty files out; a row of one is a file like any other.
    empty = spark.createDataFrame([(str(source / "none"), "none", 0)], "path string, name string, length long")
    files = list_files(spark, str(source)).select("path", "name", "length").union(empty)
    for span in (1024, 4096, 1 << 20):
        dest = tmp_path / f"dest-{span}"
        done = {r.name: r for r in copy_by_ranges(files, str(dest), span, 1024).collect()}
        assert sorted(p.name for p in dest.iterdir()) == sorted(sizes)
        for name, n in sizes.items():
            data = (source / name).read_bytes()
            assert (dest / name).read_bytes() == data
            assert (done[name].ok, done[name].bytes, done[name].tree) == (True, n, plain_tree(data, 1024))
    dealt = ranges.spread_ranges(ranges.byte_ranges(files.where("name = 'big'"), 4096, 1024), 8)
    used = dealt.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= 6  # of 8 tasks for 18 ranges of one file


def test_flipped_byte_names_its_range(spark, tmp_path):
    for side in ("a", "b"):
        (tmp_path / side).mkdir()
        data = bytearray(bytes(range(256)) * 200)
        if side == "b":
            data[9000] ^= 1
        (tmp_path / side / "log").write_bytes(data)
    a, b = (ranges.digest_ranges(ranges.byte_ranges(list_files(spark, str(tmp_path / s)), 4096, 1024), 1024) for s in "ab")
    assert [tuple(r) for r in ranges.differing_ranges(a, b).collect()] == [("log", 2, 8192, 12288)]
    assert ranges.differing_ranges(a, a).count() == 0


def test_file_that_shrinks_does_not_appear(spark, tmp_path):
    source, dest = tmp_path / "source", tmp_path / "dest"
    source.mkdir()
    for name in ("cut", "gone", "whole"):
        (source / name).write_bytes(b"x" * 9000)
    listed = [tuple(r) for r in list_files(spark, str(source)).select("path", "name", "length").collect()]
    files = spark.createDataFrame(listed, "path string, name string, length long")
    (source / "cut").write_bytes(b"x" * 5000)
    (source / "gone").unlink()
    done = {r.name: r for r in copy_by_ranges(files, str(dest), 4096, 1024).collect()}
    assert [done[n].ok for n in ("cut", "gone", "whole")] == [False, False, True]
    assert "shrank" in done["cut"].error and done["gone"].tree is None
    assert [p.name for p in dest.iterdir()] == ["whole"]


def test_ranges_are_powers_of_two_of_leaves(spark, tmp_path):
    with pytest.raises(ValueError):
        ranges.byte_ranges(list_files(spark, str(tmp_path)), 3072, 1024)
