"""Byte ranges of files: cuts anywhere, gzip by content, jobs, first matches."""

import gzip
import json
import random

import pytest

from opstrail import tasks
from opstrail.operators import changelog
from opstrail.sources import lines, read_dump_heads
from opstrail.sources.files import read_lines


def pieces(text, separator):
    out = text.split(separator)
    return out[:-1] if not out[-1] else out


@pytest.mark.parametrize("separator", ["\n", "\n# Time"])
def test_cuts_anywhere(tmp_path, separator):
    rng = random.Random(1)
    for n in range(40):
        text = "".join(rng.choice(["\n", "\n# Time", "\n# Tim", "a", "# Time", "\n\n", "bc" * 9]) for _ in range(rng.randint(0, 40)))
        path = tmp_path / f"{n}"
        path.write_text(text)
        size = len(text)
        for split in (1, 2, 3, 7, 8, 9, 31, 1000):
            parts = tasks.plan_ranges([(str(path), size)], split, 0)
            got = [x for p in parts for b in tasks.read_ranges(p, separator.encode()) for x in b.to_pylist()]
            assert [x["bytes"].decode() for x in got] == (pieces(text, separator) or [""]), (text, split)
            assert all(x["scan_error"] is None for x in got)
            places = [(x["block_start"], x["row_id"]) for x in got]
            assert places == sorted(set(places))


def test_pieces_longer_than_a_chunk(tmp_path, monkeypatch):
    monkeypatch.setattr(tasks, "CHUNK", 5)
    text = "\n".join("x" * n for n in (0, 3, 4, 5, 6, 11, 40, 0, 1))
    (tmp_path / "a").write_text(text)
    (tmp_path / "b").write_bytes(gzip.compress(text.encode()))
    for name, split in (("a", 1000), ("a", 4), ("b", 4)):
        parts = tasks.plan_ranges([(str(tmp_path / name), (tmp_path / name).stat().st_size)], split, 0)
        got = [x["bytes"].decode() for p in parts for b in tasks.read_ranges(p, b"\n") for x in b.to_pylist()]
        assert got == text.split("\n")


def test_small_files_share_a_task():
    files = [(f"/f{i}", 10) for i in range(10)] + [("/big", 250)]
    parts = tasks.plan_ranges(files, 100, 15)
    assert [len(p) for p in parts[:2]] == [4, 4] and sum(e - s for p in parts for _, _, s, e, _ in p) == 350
    assert all(sum(e - s for _, _, s, e, _ in p) <= 100 for p in parts)


def jobs_during(spark, action):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_job_before_the_action(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.log").write_bytes(gzip.compress(b"a\nb") if i % 2 else b"a\nb\nc")
    plain, n = jobs_during(spark, lambda: read_lines(spark, str(tmp_path), "\n"))
    assert n == 0
    heads, n = jobs_during(spark, lambda: read_dump_heads(spark, str(tmp_path), "b"))
    assert n == 0
    assert plain.count() == 100 and heads.count() == 40
    _, n = jobs_during(spark, plain.count)
    assert n >= 1


def test_as_a_data_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    names = ["a.log", "b +%ü.log", "_hidden.log", "sub/c.log", "d.txt"]
    for name in names:
        (tmp_path / name).write_text(name)
    lines.register(spark)

    def load(**options):
        df = spark.read.format("opstrail_lines").options(**options).load(str(tmp_path))
        return sorted(r.bytes.decode() for r in df.collect())

    assert load() == ["a.log", "b +%ü.log", "d.txt"]
    assert load(recursive="true", pattern="*.log") == ["a.log", "b +%ü.log", "sub/c.log"]
    assert load(separator=".") == sorted(x for n in ("a.log", "b +%ü.log", "d.txt") for x in n.split("."))
    # File names as scan metadata writes them.
    mine = {r.file for r in read_lines(spark, str(tmp_path), "\n").collect()}
    assert mine == {r.f for r in spark.read.text(str(tmp_path)).selectExpr("_metadata.file_path AS f").collect()}


def test_a_dump_is_left_after_its_coordinates(spark, tmp_path):
    head = "".join(f"-- line {i}\n" for i in range(19)) + "-- CHANGE MASTER TO MASTER_LOG_FILE='west.000042', MASTER_LOG_POS=777;\n"
    with open(tmp_path / "big.sql", "wb") as f:
        f.write(head.encode())
        f.truncate(1 << 30)  # the rest is empty space
    rest = "".join(f"INSERT {i};\n" for i in range(300_000)).encode()
    (tmp_path / "zipped.sql").write_bytes(gzip.compress(head.replace("777", "778").encode() + rest, 1))
    (tmp_path / "none.sql").write_text("-- nothing here\n")
    reader = lines.LinesReader({"paths": json.dumps([str(tmp_path)]), "first": changelog.COORDINATES})
    tasks.CountedReads.taken = 0
    found = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert len(found) == 2 and tasks.CountedReads.taken < 2 << 20 and len(reader.partitions()) == 3
    got = changelog.dump_coordinates(read_dump_heads(spark, str(tmp_path), changelog.COORDINATES)).collect()
    assert {(r.log_file, r.log_pos) for r in got} == {("west.000042", 777), ("west.000042", 778)}
