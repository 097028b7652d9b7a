import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opstrail.operators import changelog as ops
from opstrail.operators import ranking
from opstrail.plans.restore import restore_job
from opstrail.sources import read_changelog, read_dump_heads, read_dump_lines, write_changelog

T0 = datetime(2024, 1, 1)


def listing(spark, names):
    return spark.createDataFrame([(f"/logs.d/{n}",) for n in names], "path string")


def events(spark, rows):
    return spark.createDataFrame(
        [(s, p, T0 + timedelta(seconds=t)) for s, p, t in rows],
        "log_seq long, log_pos long, event_ts timestamp_ntz",
    )


def stop(seconds):
    return (T0 + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


@pytest.mark.parametrize("word", ["MASTER", "SOURCE", "source"])
def test_coordinates(spark, tmp_path, word):
    text = f"-- dump\nCHANGE X TO {word}_LOG_FILE='quay-log.000071', {word}_LOG_POS=90412;\n"
    (tmp_path / "d.sql").write_text(text + text.replace("90412", "77"))
    assert tuple(ops.one_coordinate(read_dump_lines(spark, str(tmp_path))).first()) == ("quay-log.000071", 90412)


def test_no_coordinates(spark, tmp_path):
    (tmp_path / "d.sql").write_text("nothing here\n")
    with pytest.raises(Exception, match="could not extract"):
        ops.one_coordinate(read_dump_lines(spark, str(tmp_path))).collect()


def test_log_order(spark):
    names = [f"tide.{i:04d}" for i in range(31, 53)] + ["tide.index"]
    got = ops.log_sequence(listing(spark, names), "tide.0044").orderBy("log_seq").collect()
    assert [r.name for r in got] == names[13:-1]
    with pytest.raises(Exception, match="current log tide.0099 not found"):
        ops.log_sequence(listing(spark, names), "tide.0099").collect()
    # Position 1 comes after 9, so numbers are compared, not names.
    got = ops.log_sequence(listing(spark, ["b.9", "b.10", "b.8"]), "b.9").orderBy("log_seq").collect()
    assert [r.name for r in got] == ["b.9", "b.10"]


def plan_of(spark, n, start, stop_at=None):
    files = ops.log_sequence(listing(spark, [f"m.{i:05d}" for i in range(1, n + 1)]))
    at = None
    if stop_at is not None:
        at = spark.createDataFrame([(n, stop_at)], "log_seq long, log_pos long")
    return ops.replay_plan(files, start, at)


@pytest.mark.parametrize(
    "n, stop_at, want",
    [
        (1, 4410, []),
        (1, None, ["m.00001 --start-position=4410"]),
        (1, 5821, ["m.00001 --start-position=4410 --stop-position=5821"]),
        (3, None, ["m.00001 --start-position=4410", "m.00002", "m.00003"]),
        (3, 5821, ["m.00001 --start-position=4410", "m.00002", "m.00003 --stop-position=5821"]),
        (23, 5821, ["m.00001 --start-position=4410", " ".join(f"m.{i:05d}" for i in range(2, 12)),
                    " ".join(f"m.{i:05d}" for i in range(12, 22)), "m.00022", "m.00023 --stop-position=5821"]),
    ],
)
def test_commands(spark, n, stop_at, want):
    got = ops.replay_commands(plan_of(spark, n, 4410, stop_at)).orderBy("batch_id").collect()
    assert [r.command for r in got] == want


def test_ordinals_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 7)
    numbers = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(n, f"f{n}") for n in numbers], "n long, name string")
    got = {r.n: r.ord for r in ranking.with_ordinal(df, "n", "name").collect()}
    assert got == {n: i for i, n in enumerate(sorted(numbers))}


def test_stop_is_a_prefix(spark):
    rng = random.Random(1)
    rows = [(s, p, rng.randint(0, 100)) for s in range(4) for p in range(1, 200)]
    for limit in (1, 40, 99, 1000):
        log = sorted(rows)
        want = []
        for row in log:
            if row[2] >= limit:
                break
            want.append(row[:2])
        got = ops.before_stop(events(spark, rows), stop(limit)).select("log_seq", "log_pos").collect()
        assert sorted(map(tuple, got)) == want
        at = ops.stop_coordinate(events(spark, rows), stop(limit), strict=False).first()
        assert tuple(at) == (want[-1] if want else (None, None))
    with pytest.raises(Exception, match="stop position not found"):
        ops.stop_coordinate(events(spark, rows), stop(0)).collect()


def test_stop_before_start_is_empty(spark):
    df = events(spark, [(1, 10, 1), (1, 20, 50), (1, 30, 2), (2, 5, 3)])
    assert ops.replay_window(df, 1, 20, stop(40)).count() == 0
    assert ops.replay_window(df, 1, 10, stop(60)).count() == 3
    assert ops.replay_window(df, 1, 10).count() == 3


def test_stop_does_not_depend_on_the_session_zone(spark):
    df = events(spark, [(1, 10, 0), (1, 20, 7200)]).withColumn(
        "event_ts", F.timestamp_seconds(F.lit(1704067200) + F.when(F.col("log_pos") == 20, 7200).otherwise(0))
    )
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert ops.before_stop(df, "2024-01-01 01:00:00").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_restore(spark):
    rng = random.Random(2)
    base = {k: f"b{k}" for k in range(50)}
    changes = [(s, p, rng.choice(["upsert", "delete"]), rng.randint(0, 80), f"c{s}-{p}")
               for s in range(3) for p in range(60)]
    want = dict(base)
    for _, _, op, key, value in sorted(changes):
        want.pop(key, None) if op == "delete" else want.update({key: value})
    rng.shuffle(changes)
    got = ops.restore_table(
        spark.createDataFrame(list(base.items()), "k long, v string"),
        spark.createDataFrame(changes, "log_seq long, log_pos long, op string, k long, v string"),
        ["k"],
    )
    assert dict(map(tuple, got.collect())) == want


def test_changelog_source(spark, tmp_path):
    for name in ("bin.000002", "bin.000003", "bin.index"):
        (tmp_path / name).write_text('{"log_pos": 7, "v": 1}\n')
    got = read_changelog(spark, str(tmp_path), "json", "log_pos long, v long")
    assert sorted((r.log_file, r.log_seq) for r in got.collect()) == [("bin.000002", 2), ("bin.000003", 3)]


def test_null_keys_are_replaced(spark):
    base = spark.createDataFrame([(None, "old"), (1, "one")], "k int, v string")
    changes = spark.createDataFrame([(None, "new", "upsert", 1, 5)], "k int, v string, op string, log_seq long, log_pos long")
    got = {(r.k, r.v) for r in ops.restore_table(base, changes, ["k"]).collect()}
    assert got == {(None, "new"), (1, "one")}


def test_position_out_of_range_fails(spark):
    line = "CHANGE MASTER TO MASTER_LOG_FILE='bin.7', MASTER_LOG_POS=99999999999999999999;"
    lines = spark.createDataFrame([("f", 0, 0, line)], "file string, block_start long, row_id long, value string")
    with pytest.raises(Exception, match="log position out of range: 99999999999999999999"):
        ops.dump_coordinates(lines).collect()


def test_restore_from_a_dump(spark, tmp_path):
    dump = tmp_path / "dump.sql"
    dump.write_text("-- a dump\n-- CHANGE MASTER TO MASTER_LOG_FILE='bin.000003', MASTER_LOG_POS=40;\nINSERT 1\n")
    schema = "log_seq long, log_pos long, event_ts timestamp_ntz, op string, k int, v string"
    day = datetime(2030, 1, 1)
    rows = [
        (2, 90, day + timedelta(hours=9), "upsert", 1, "before the dump, but late by its clock"),
        (3, 40, day, "upsert", 1, "in the dump"),
        (3, 70, day + timedelta(hours=1), "upsert", 2, "new"),
        (4, 20, day + timedelta(hours=2), "delete", 3, "gone"),
        (5, 10, day + timedelta(hours=8), "upsert", 1, "too late"),
    ]
    events = spark.createDataFrame(rows, schema)
    base = spark.createDataFrame([(1, "in the dump"), (3, "old")], "k int, v string")
    files = spark.createDataFrame([(f"bin.00000{i}",) for i in (1, 2, 3, 4, 5)], "name string")
    job = restore_job(spark, str(dump), files, events, base, ["k"], "2030-01-01 08:00:00")
    assert {tuple(r) for r in job.table.collect()} == {(1, "in the dump"), (2, "new")}
    assert [r.command for r in job.commands.orderBy("batch_id").collect()] == ["bin.000003 --start-position=40", "bin.000004 --stop-position=20"]
    whole = restore_job(spark, str(dump), files, events, base, ["k"])
    assert {tuple(r) for r in whole.table.collect()} == {(1, "too late"), (2, "new")} and whole.plan.count() == 3
    dump.write_text("no place named")
    with pytest.raises(Exception, match="could not extract log file and position"):
        restore_job(spark, str(dump), files, events, base, ["k"])


def test_earlier_logs_are_not_read(spark, tmp_path):
    """By number in the names, by folder with a start at hand, and by folder with a start the query finds."""
    events = spark.range(4_000).select(
        (F.col("id") % 40 + 1).alias("log_seq"), F.col("id").alias("log_pos"), F.format_string("quay.%04d", F.col("id") % 40 + 1).alias("log_file")
    )
    for n in (7, 8, 39):
        events.where(F.col("log_seq") == n).coalesce(1).write.parquet(str(tmp_path / "made" / str(n)))
        part = next((tmp_path / "made" / str(n)).glob("part*.parquet"))
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / f"quay.{n:04}.parquet").write_bytes(part.read_bytes())
    late = read_changelog(spark, str(tmp_path / "logs"), start="quay.0008")
    assert sorted(f.rsplit("/", 1)[1] for f in late.inputFiles()) == ["quay.0008.parquet", "quay.0039.parquet"]
    assert late.count() == 200
    with pytest.raises(ValueError, match="no log from"):
        read_changelog(spark, str(tmp_path / "logs"), start="quay.0040")
    write_changelog(events, str(tmp_path / "by"))
    by = read_changelog(spark, str(tmp_path / "by"))
    want = events.where("log_seq > 38 OR (log_seq = 38 AND log_pos > 2000)").count()

    def folders_read(df):
        assert df.count() == want
        rows = df.select("log_seq", "log_pos")
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        scan = [x for x in plan.splitlines() if "FileScan" in x][0]
        return scan, rows

    scan, _ = folders_read(ops.after_start(by, 38, 2000))
    assert "PartitionFilters: [isnotnull(log_seq" in scan and ">= 38" in scan
    (tmp_path / "d.sql").write_text("CHANGE MASTER TO MASTER_LOG_FILE='quay.0038', MASTER_LOG_POS=2000;\n")
    at = ops.one_coordinate(read_dump_heads(spark, str(tmp_path / "d.sql"), ops.COORDINATES))
    seq = at.select(F.substring_index("log_file", ".", -1).cast("bigint")).scalar()
    scan, rows = folders_read(ops.after_start(by, seq, at.select("log_pos").scalar()))
    filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "Subquery" in filters or "subquery" in filters, scan
