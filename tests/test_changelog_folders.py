"""Logs of more numbers than folders."""

from pyspark.sql import functions as F

from opstrail.operators import changelog
from opstrail.sources import read_changelog, write_changelog


def test_many_logs_share_folders(spark, tmp_path):
    events = spark.range(3_000).select(
        (F.col("id") / 3 + 5).cast("long").alias("log_seq"), (F.col("id") * 100).alias("log_pos"),
        F.format_string("quay.%06d", (F.col("id") / 3 + 5).cast("long")).alias("log_file"),
    )
    write_changelog(events, str(tmp_path / "by"), folders=16)
    folders = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "by").glob("log_seq_to=*"))
    assert 0 < len(folders) <= 16 and not list((tmp_path / "by").glob("log_seq=*"))
    by = read_changelog(spark, str(tmp_path / "by"))
    rows = lambda df: sorted(map(tuple, df.select("log_seq", "log_pos", "log_file").collect()))
    assert rows(by) == rows(events)
    for seq, pos in ((5, -1), (500, 148_600), (folders[3], 0), (folders[3] + 1, 0), (1004, 299_800), (2000, 0)):
        late = changelog.after_start(by, seq, pos)
        assert rows(late) == rows(events.where((F.col("log_seq") > seq) | ((F.col("log_seq") == seq) & (F.col("log_pos") > pos))))
    at = spark.range(1).select(F.lit(folders[-1]).alias("s")).scalar()
    late = changelog.after_start(by, at, -1).select("log_seq", "log_pos")
    assert late.count() == events.where(F.col("log_seq") >= folders[-1]).count()
    scan = [x for x in late._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x][0]
    assert "log_seq_to" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
