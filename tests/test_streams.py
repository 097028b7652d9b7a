import gzip
import shutil
import time

from pyspark.sql import functions as F

from opstrail.operators.changelog import latest_changes
from opstrail.plans.slowlog import slow_report
from opstrail.session import get_session
from opstrail.streaming import (
    compact_in_place,
    compact_parts,
    read_applied,
    read_slow_table,
    stream_apply,
    stream_new_content,
    stream_slowlog,
)
from tests.test_slowlog import AGAIN, LONG, SHORT


def test_slow_table_grows_with_the_folder(spark, tmp_path):
    folder, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    folder.mkdir()
    for i, text in enumerate([SHORT, AGAIN, LONG, "# Time: bad\n" + SHORT]):
        (folder / f"{i}.log").write_text(text)
        stream_slowlog(spark, str(folder), table, mark, mask=True, max_files=1).awaitTermination()
    want = slow_report(spark, str(folder), mask=True).records
    got = read_slow_table(spark, table)
    assert got.columns == want.columns
    assert sorted(map(repr, (tuple(r)[1:] for r in got.collect()))) == sorted(
        map(repr, (tuple(r)[1:] for r in want.collect()))
    )
    compact_parts(spark, table, str(tmp_path / "merged"))
    # Parts and their merge together still count once.
    shutil.copytree(tmp_path / "merged" / "stream_id=merged", tmp_path / "table" / "stream_id=merged")
    assert read_slow_table(spark, table).count() == got.count() == want.count()


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.log").write_text(SHORT)
    stream_slowlog(spark, str(folder), table, str(tmp_path / "mark")).awaitTermination()
    before = read_slow_table(spark, table).count()
    (folder / "a.log").unlink()
    (folder / "z.log").write_text(AGAIN)
    stream_slowlog(spark, str(folder), table, str(tmp_path / "other")).awaitTermination()
    assert {r.file[-5:] for r in read_slow_table(spark, table).collect()} == {"a.log", "z.log"}
    assert read_slow_table(spark, table).count() > before


def test_streams_tell_gzip_by_content(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "zipped.log").write_bytes(gzip.compress(SHORT.encode()))
    (folder / "plain.gz").write_text(SHORT)
    (folder / "cut.log").write_bytes(gzip.compress(SHORT.encode() * 50)[:-20])
    stream_slowlog(spark, str(folder), table, str(tmp_path / "mark")).awaitTermination()
    want = slow_report(spark, str(folder)).records
    assert read_slow_table(spark, table).count() == want.count() > 0


def test_content_is_taken_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for drop in (0, 1):
        for i in range(40):
            (folder / f"{drop}-{i}.bin").write_text("copy" if i % 2 else f"own {i} {drop * (i % 4)}")
        (
            stream_new_content(spark, str(folder), max_files=15)
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "mark"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"))
            .awaitTermination()
        )
    out = spark.read.parquet(str(tmp_path / "out"))
    contents = {p.read_text() for p in folder.iterdir()}
    assert out.count() == out.select("sha256").distinct().count() == len(contents)


def test_apply_in_any_order(spark, tmp_path):
    changes = spark.range(2000).select(
        (F.col("id") % 5).alias("log_seq"), F.col("id").alias("log_pos"),
        F.when(F.col("id") % 7 == 0, "delete").otherwise("upsert").alias("op"),
        (F.hash("id") % 50).alias("k"), F.col("id").cast("string").alias("v"),
    )
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for newer in (True, False):
        changes.where((F.col("log_seq") >= 3) == newer).write.mode("append").parquet(source)
        stream = spark.readStream.schema(changes.schema).parquet(source)
        stream_apply(stream, table, ["k"], str(tmp_path / "mark")).awaitTermination()
    want = sorted(map(tuple, latest_changes(changes, ["k"]).select("k", "log_pos", "v").collect()))
    def answer():
        return sorted(map(tuple, read_applied(spark, table, ["k"]).select("k", "log_pos", "v").collect()))

    assert answer() == want
    assert compact_in_place(spark, table, ["k"]) == 2 and answer() == want
    assert len(list((tmp_path / "table").glob("*/batch_id=*"))) == 1 == compact_in_place(spark, table, ["k"])


def intake(spark, folder, tmp_path, **options):
    """Paths given by one run of a stream of new content."""
    out, rows = tmp_path / "out", "path string, length bigint, sha256 string"
    taken = lambda: [r.path.rsplit("/", 1)[1] for r in spark.read.schema(rows).parquet(str(out)).collect()] if out.exists() else []
    before = taken()
    (
        stream_new_content(spark, str(folder), **options)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "mark"))
        .trigger(availableNow=True)
        .start(str(out))
        .awaitTermination()
    )
    return sorted(set(taken()) - set(before))


def test_hashes_are_kept_once_and_forgotten_in_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(30):
        (folder / f"copy{n:02}").write_text("one content")
    (folder / "other").write_text("another")
    early = time.time()
    assert intake(spark, folder, tmp_path, keep_seconds=45) == ["copy00", "other"]
    begun = time.time()  # the hashes are remembered since some time in between
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "mark"))
    assert state.count() == 2  # each hash once
    (folder / "soon").write_text("one content")
    assert intake(spark, folder, tmp_path, keep_seconds=45) == [] or time.time() - early > 45
    time.sleep(max(0, 47 - (time.time() - begun)))
    (folder / "later").write_text("one content")
    assert intake(spark, folder, tmp_path, keep_seconds=45) == ["later"]


def test_hashes_are_kept_without_a_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("x")
    assert intake(spark, folder, tmp_path) == ["a"]
    (folder / "b").write_text("x")
    assert intake(spark, folder, tmp_path) == []
    assert "RocksDB" in get_session().conf.get("spark.sql.streaming.stateStore.providerClass")
