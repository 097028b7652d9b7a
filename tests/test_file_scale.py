"""Tasks and files of sync and mirror runs do not grow with the number of small files."""

from pyspark.sql import types as T

from checks import inputs
from opstrail.operators import known
from opstrail.operators import filesync as ops
from opstrail.plans.filesync import mirror_prefix
from opstrail.sources import files, list_files


def stage_tasks(spark, group):
    """The number of tasks of every stage run under a job group."""
    tracker = spark.sparkContext.statusTracker()
    return [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]


def test_document_folders(spark, tmp_path, monkeypatch):
    """A line a document in order of its id, null texts and ids included, and nothing beside the files."""
    rows = [(21, "b\nc"), (20, None), (5, ""), (3, "ä"), (3, "ä"), (None, "lost"), (-1, "minus")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    made = tmp_path / "made"
    monkeypatch.setattr(inputs, "work_dir", lambda *_: str(made))
    assert inputs.doc_folders(spark, str(tmp_path)) == str(made)
    got = {str(p.relative_to(made)): p.read_text() for p in made.glob("bucket=*/*")}
    assert got == {
        "bucket=-1/docs.txt": "minus\n",
        "bucket=0/docs.txt": "ä\nä\n\n",
        "bucket=1/docs.txt": "\nb\nc\n",
        "bucket=__HIVE_DEFAULT_PARTITION__/docs.txt": "lost\n",
    }
    assert not list(made.glob("bucket=*/.*"))
    copied = mirror_prefix(spark, str(made), "bucket=", str(tmp_path / "copy")).collect()
    assert {r.name: r.bytes for r in copied} == {n.removeprefix("bucket="): len(t.encode()) for n, t in got.items()}


def test_listings_take_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(600):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "x.txt").write_text(str(i))
    monkeypatch.setattr(files, "TASKS_PER_CORE", 1)
    most = spark.sparkContext.defaultParallelism
    spark.sparkContext.setJobGroup("listed", "")
    try:
        listed = list_files(spark, str(tmp_path), recursive=True)
        hashed = ops.fingerprint(listed)
        assert hashed.select("name", "length", "sha256").distinct().count() == 600
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = stage_tasks(spark, "listed")
    assert found and max(found) <= most
    assert listed.rdd.getNumPartitions() == most
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_state_files_are_dealt_out(spark, tmp_path):
    """Every prefix has one file a run, and no task writes all of them."""
    hashes = spark.range(2000).selectExpr("sha2(string(id), 256) AS sha256").localCheckpoint()
    state = tmp_path / "state"
    known.append_known(hashes, str(state))
    for part in ("hashes", "filter"):
        written = [p for p in (state / part).glob("prefix=*/part-*")]
        assert len(written) == len({p.parent for p in written}) > 200
        assert len({p.name.split("-")[1] for p in written}) > 1
    assert known.known_among(spark, hashes, str(state)).count() == 2000
