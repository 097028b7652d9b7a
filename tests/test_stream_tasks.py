"""Little to set up for a micro-batch."""

from opstrail.streaming import stream_new_content, stream_slowlog, streams


def _wide(spark):
    """Sets many shuffle partitions; gives the cores and the number to set back."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    return spark.sparkContext.defaultParallelism, was


def test_content_state_has_a_partition_a_core_at_most(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(20):
        (tmp_path / "in" / f"f{n}").write_text(f"own {n % 5}")
    cores, was = _wide(spark)
    try:
        (
            stream_new_content(spark, str(tmp_path / "in")).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
            .start(str(tmp_path / "out")).awaitTermination()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    stores = [p for p in (tmp_path / "mark" / "state" / "0").iterdir() if p.name.isdigit()]
    assert 0 < len(stores) <= cores


def test_a_batch_of_content_has_few_stores_files_and_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(120):
        (tmp_path / "in" / f"f{n:03}").write_text(f"own {n % 50}")
    _, was = _wide(spark)
    try:
        query = (
            stream_new_content(spark, str(tmp_path / "in"), max_files=40).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
            .start(str(tmp_path / "out"))
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 50 == out.select("sha256").distinct().count()
    stores = [p for p in (tmp_path / "mark" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == 2  # of 25 files each
    # A commit writes the changes of its batch; three batches are a job each, which looks up no files.
    assert all(len(list(p.glob("*.changelog"))) == 3 for p in stores)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) == 3


def test_the_least_path_of_a_batch_is_given_and_known_content_is_not(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def given():
        (
            stream_new_content(spark, str(tmp_path / "in")).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
            .start(str(tmp_path / "out")).awaitTermination()
        )
        return sorted((r.path[-3:], r.length) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for n in range(90):
        (tmp_path / "in" / f"f{89 - n:02}").write_text(f"own {n % 3}")
    assert given() == [("f00", 5), ("f01", 5), ("f02", 5)]
    for n in range(40):
        (tmp_path / "in" / f"a{n:02}").write_text(f"own {n % 4}")
    assert given() == [("a03", 5), ("f00", 5), ("f01", 5), ("f02", 5)]


def test_a_set_checkpoint_manager_is_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert stream_new_content(spark, str(tmp_path / "in")).sparkSession.conf.get(streams.FILE_MANAGER).endswith("FileSystemBasedCheckpointFileManager")
    chosen = f"{streams.CHECKPOINTING}.FileContextBasedCheckpointFileManager"
    spark.conf.set(streams.FILE_MANAGER, chosen)
    try:
        own = stream_new_content(spark, str(tmp_path / "in")).sparkSession
        assert own.conf.get(streams.FILE_MANAGER) == chosen
    finally:
        spark.conf.unset(streams.FILE_MANAGER)


def test_parsing_is_set_up_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.log").write_text(
            "# Time: 2024-01-01T00:00:00Z\n# User@Host: u[u] @ h [1.1.1.1]\n# Query_time: 1.5\nSET timestamp=1;\nSELECT 1;\n"
        )
    made, parse = [], streams.parser_for("mysql")
    monkeypatch.setattr(streams, "parser_for", lambda engine: lambda raw, **options: made.append(1) or parse(raw, **options))
    table = str(tmp_path / "table")
    stream_slowlog(spark, str(tmp_path / "in"), table, str(tmp_path / "mark"), max_files=1).awaitTermination()
    parts = spark.read.parquet(table)
    assert parts.count() == 3 == parts.select("batch_id").distinct().count() and len(made) == 1
