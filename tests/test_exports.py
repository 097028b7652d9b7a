import random
import struct
from datetime import date, datetime, time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opstrail.errors import error_text
from opstrail.functions.literals import sql_float
from opstrail.operators import literals
from opstrail.operators.jobs import batch_outcome, result_text
from opstrail.plans import export
from opstrail.sources import tables
from opstrail.sources import jdbc_options, list_tables, read_table

SCHEMA = (
    "i int, l bigint, u decimal(20,0), f float, d double, n decimal(10,2), day date, at timestamp_ntz, "
    "t time, y smallint, s string, fixed binary, raw binary, bit boolean, b boolean, one binary, j string, v string"
)
TYPES = {"y": "YEAR", "fixed": "BINARY", "bit": "BIT", "one": "BIT", "j": "JSON", "v": "ENUM"}
ROW = (
    -1, 2**40, Decimal(2**64 - 1), 1.5, 1.1, Decimal("12.30"), date(2024, 2, 3), datetime(2024, 2, 3, 4, 5, 6),
    time(4, 5, 6), 2024, "it's", b"ab\0\0", b"ab\0", True, False, b"\x01", '{"a": "b\'c"}', "x",
)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([ROW, (None,) * len(ROW)], SCHEMA)


def test_row_literals(table):
    got = [r.row_sql for r in literals.to_sql_literals(table, source_types=TYPES).collect()]
    assert got[0] == (
        "(-1,1099511627776,18446744073709551615,1.500000,1.100000,12.30,'2024-02-03','2024-02-03 04:05:06',"
        "'04:05:06','2024','it''s',x'6162',x'616200',b'1',false,b'1','{\\\"a\\\": \\\"b''c\\\"}','x')"
    )
    assert got[1] == "(" + ",".join(["NULL"] * len(ROW)) + ")"


def test_unsupported_types_raise_before_any_job(spark):
    df = spark.range(1).select(F.array(F.lit(1)).alias("a"))
    with pytest.raises(ValueError, match="unsupported database type"):
        literals.to_sql_literals(df)
    with pytest.raises(ValueError, match="unsupported database type: GEOMETRY"):
        literals.to_sql_literals(spark.range(1), source_types={"id": "GEOMETRY"})
    bits = spark.createDataFrame([(b"\x01\x02",)], "b binary")
    with pytest.raises(Exception, match="expected length 1, got 2"):
        literals.to_sql_literals(bits, source_types={"b": "BIT"}).collect()


def test_statements(spark):
    df = spark.range(0, 2500, numPartitions=3).withColumn("t", F.lit("x"))
    by_key = literals.insert_statements(df, "a`b", batch_by=("id", 1000)).orderBy("batch").collect()
    assert [(r.batch, r.n_rows) for r in by_key] == [(0, 1000), (1, 1000), (2, 500)]
    assert by_key[2].statement.startswith("INSERT INTO `a``b` (`id`, `t`) VALUES (2000,'x'),(2001,'x')")
    free = literals.insert_statements(df, "t", batch_rows=100).collect()
    assert sum(r.n_rows for r in free) == 2500 and max(r.n_rows for r in free) == 100
    ids = [int(v.split(",")[0]) for r in free for v in r.statement.split(" VALUES (")[1].split("),(")]
    assert sorted(ids) == list(range(2500))
    plan = literals.insert_statements(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # A range that holds more rows than a statement may is split, not lost.
    same = spark.range(250).select(F.lit(1).alias("k"), "id")
    assert sorted(r.n_rows for r in literals.insert_statements(same, "t", 100, ("k", 10)).collect()) == [50, 100, 100]


def test_ddl(table):
    ddl = literals.table_ddl(table.schema, "t")
    assert ddl[0] == "DROP TABLE IF EXISTS `t`;"
    assert "`u` DECIMAL(20,0)" in ddl[1] and "`at` DATETIME(6)" in ddl[1] and "`t` TIME(6)" in ddl[1]
    assert len(literals.table_ddl(table.schema, "t", drop=False)) == 1


def test_script_order_and_empty_tables(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("tst_b")
    spark.range(0).createOrReplaceTempView("tst_a")
    assert sorted(r.table_name for r in list_tables(spark, like="tst_*").collect()) == ["tst_a", "tst_b"]
    assert read_table(spark, "tst_b").count() == 3
    dest = export.export_database(spark, str(tmp_path / "s"), like="tst_*", locks=False)
    lines = [r.value for r in export.read_script(spark, dest).orderBy("part").collect()]
    kinds = [line.split(" ")[0] for line in lines]
    assert kinds[0] == "--" and lines.index("DROP TABLE IF EXISTS `tst_a`;") < kinds.index("INSERT")
    assert not any("LOCK" in line for line in lines)
    assert sum("`tst_a`" in line for line in lines) == 2  # defined, but no rows and no keys
    assert kinds.index("INSERT") < lines.index(export.SCRIPT_FOOTER[0])


def test_fan_out(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(count, "id long")
    (tmp_path / "file").write_text("in the way")
    where = [
        export.Destination(str(tmp_path / "file" / "below"), "parquet"),
        export.Destination(str(tmp_path / "one"), "json"),
        export.Destination(str(tmp_path / "two"), "parquet"),
        export.Destination(str(tmp_path / "three"), "csv"),
    ]
    got = {r.dest.rsplit("/", 1)[1]: r for r in export.export_many(df, where, gzip=True).collect()}
    assert {k: r.ok for k, r in got.items()} == {"below": False, "one": True, "two": True, "three": False}
    assert got["three"].error == "unsupported format: csv" and got["one"].path.endswith("one.gz")
    assert spark.read.json(got["one"].path).count() == spark.read.parquet(got["two"].path).count() == 100
    assert calls.value == 100


def test_batch(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    job = export.ExportJob("good", "parquet", str(tmp_path / "t"), [export.Destination(str(tmp_path / "o"), "text")])
    lost = export.ExportJob("lost", "parquet", str(tmp_path / "none"), job.destinations)
    results = export.run_exports(spark, [job, lost], max_parallel=2)
    outcome = {r.job_name: r for r in results.collect()}
    assert outcome["good"].ok and not outcome["lost"].ok
    assert outcome["lost"].error.startswith("failed to store dump file ")
    assert not batch_outcome(results).first().ok
    assert spark.read.text(str(tmp_path / "o")).first().value.startswith("INSERT INTO `good` (`id`) VALUES (")


def test_job_faults():
    dest = [export.Destination("/x")]
    jobs = [export.ExportJob("", "d", "s", dest), export.ExportJob("a", "d", " ", dest),
            export.ExportJob("b", "", "s", dest), export.ExportJob("c", "d", "s")]
    with pytest.raises(ValueError) as fault:
        export.validate_jobs(jobs, 1)
    assert str(fault.value).splitlines() == [
        "job name is required", "database dsn is required", "database driver is required",
        "job c has no destination",
    ]
    with pytest.raises(ValueError, match="max jobs should be greater than 0, got 0"):
        export.validate_jobs([], 0)


def test_result_text(spark):
    df = spark.createDataFrame(
        [("job1", True, "", 1000), ("job1", False, "test err", 1000)],
        "job_name string, ok boolean, error string, elapsed_ms long",
    )
    assert [r.text for r in result_text(df).collect()] == [
        "job1 succeeded, it took 1s", "job1 failed, it took 1s with error: test err"
    ]
    assert [r.text for r in result_text(df, markup=True).collect()] == [
        ":white_check_mark: `job1` succeeded, it took *1s*", ":x: `job1` failed, it took *1s* ```test err```"
    ]


def test_jdbc_options():
    got = jdbc_options("jdbc:x", "t", "id", (0, 100), 4, user="u")
    assert got["numPartitions"] == "4" and got["partitionColumn"] == "id" and got["user"] == "u"
    assert "numPartitions" not in jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "id")


def test_large_and_negative_keys(spark):
    ids = [-(1 << 62), -4, -3, -1, 0, 2, 3, (1 << 53) + 1, (1 << 53) + 2]
    df = spark.createDataFrame([(i,) for i in ids], "k bigint")
    got = {r.batch: r.statement for r in literals.insert_statements(df, "t", batch_by=("k", 3)).collect()}
    want = {}
    for i in ids:
        want.setdefault(i // 3, []).append(f"({i})")
    assert got == {b: f"INSERT INTO `t` (`k`) VALUES {','.join(v)};" for b, v in want.items()}


def test_float_text_is_exact(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-7, 1.5e-6, 2.5e-6, 0.0000005, 1e-300, 123456.7890125, -2.5e-6, 8999999999.0000005]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 9) for _ in range(3000)]
    values += [1e15 + 0.25, 123456789012.123456, 2.0**70, 2.0**53, 2.0**53 - 1, 2.0**63, 2.0**124, 1.7976931348623157e308, -1e300, 5e-324]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(9, 307) for _ in range(1000)]
    values += [struct.unpack("<d", rng.randbytes(7) + b"\x3f")[0] for _ in range(1000)]
    values += [(2 * rng.randint(0, 10**7) + 1) / 2e6 for _ in range(3000)] + [k / 128 for k in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [r.t for r in df.select(sql_float(F.col("d")).alias("t")).collect()]
    assert got == ["%.6f" % v for v in values]
    assert df.limit(0).union(spark.createDataFrame([(None,)], "d double")).select(sql_float(F.col("d"))).first()[0] is None
    for strange in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="no SQL literal for"):
            spark.createDataFrame([(strange,)], "d double").select(sql_float(F.col("d"))).collect()


def test_script_replaces_an_older_one(spark, tmp_path):
    dest = str(tmp_path / "s")
    one, two = spark.range(2), spark.range(3)
    export.export_sql({"a": one, "b": two}, dest)
    export.export_sql({"a": one}, dest)
    assert not any("`b`" in r.value for r in export.read_script(spark, dest).collect())
    export.export_sql({}, dest)
    assert {r.part for r in export.read_script(spark, dest).collect()} == {"1-header", "4-footer"}
    (tmp_path / "s" / "letter.txt").write_text("mine")
    with pytest.raises(ValueError, match="more than a script"):
        export.export_sql({"a": one}, dest)
    assert (tmp_path / "s" / "letter.txt").read_text() == "mine"


def test_job_formats_and_options(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    where = {fmt: export.Destination(str(tmp_path / fmt), fmt) for fmt in ("text", "parquet", "script")}
    job = export.ExportJob("j", "parquet", str(tmp_path / "t"), list(where.values()), table="t",
                           dump={"batch_by": ("id", 2), "locks": False, "source_types": {"id": "YEAR"}})
    assert export.run_job(spark, job).where("ok").count() == 3
    assert spark.read.parquet(where["parquet"].path).count() == 5
    assert sorted(r.value for r in spark.read.text(where["text"].path).collect())[0] == "INSERT INTO `t` (`id`) VALUES ('0'),('1');"
    script = [r.value for r in export.read_script(spark, where["script"].path).collect()]
    assert any("CREATE TABLE `t` (`id` YEAR" in x for x in script) and not any("LOCK" in x for x in script)
    assert sum(x.startswith("INSERT") for x in script) == 3 and export.SCRIPT_FOOTER[-1] in script


def test_errors_are_whole(spark, tmp_path):
    assert error_text(ValueError()) == "ValueError" and error_text(ValueError("a\nb")) == "a\nb"
    (tmp_path / "file").write_text("in the way")
    spark.range(1).write.parquet(str(tmp_path / "t"))
    bad = [export.Destination(str(tmp_path / "file" / n), "parquet") for n in ("x", "y")]
    job = export.ExportJob("j", "parquet", str(tmp_path / "t"), bad)
    error = export.run_exports(spark, [job]).first().error
    assert error.startswith("failed to store dump file ") and error.count(str(tmp_path / "file")) >= 2
    assert "calling o" not in error


def test_statements_are_bounded(spark):
    """By rows, by bytes and by batch, whatever the Arrow batches; a longer row is a statement of its own."""
    rng = random.Random(9)
    texts = ["x" * rng.choice([1, 5, 40, 300]) for _ in range(700)]
    made = [f"({i},'{t}')" for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    try:
        for rows, size, by in ((7, 1 << 20, ("k", 1000)), (1000, 120, ("k", 1000)), (4, 90, ("k", 10)), (1, 1, ("k", 50))):
            got = literals.insert_statements(df, "t", rows, by, size).collect()
            want, now, batch = [], [], None
            for i, m in enumerate(made):
                if now and (i // by[1] != batch or len(now) == rows or len(",".join([*now, m])) + 1 > size):
                    want.append((batch, now))
                    now = []
                batch = i // by[1]
                now.append(m)
            want.append((batch, now))
            head = "INSERT INTO `t` (`k`, `t`) VALUES "
            key = lambda r: (r[0], int(r[1][len(head) + 1 :].split(",")[0]))
            assert sorted(map(tuple, got), key=key) == [(b, head + ",".join(w) + ";", len(w)) for b, w in want]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_ranges_of_a_skewed_key(spark):
    """Nine tenths of the rows in a hundredth of the range, and one key with many rows."""
    spread = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, F.col("id") * 1000).otherwise(F.col("id")).alias("k"))
    cuts = even = tables.key_cuts(spread, "k", 32)  # sketches differ a little from run to run
    sizes = [spread.where(p).count() for p in tables.cut_predicates("k", cuts)]
    assert len(sizes) == 32 and sum(sizes) == 100_000 and max(sizes) < 2 * sorted(sizes)[16]
    numbered = spread.select(tables.range_of(F.col("k"), cuts).alias("r")).groupBy("r").count().orderBy("r").collect()
    assert [r["count"] for r in numbered] == sizes
    hot = spark.range(10_000).select(F.when(F.col("id") < 6_000, 7).when(F.col("id") < 9_000, F.col("id")).alias("k"))
    cuts = tables.key_cuts(hot, "k", 8)
    parts = [hot.where(p) for p in tables.cut_predicates("k", cuts)]
    assert sum(p.count() for p in parts) == 10_000 and parts[0].where("k IS NULL").count() == 1_000
    assert tables.key_cuts(spark.range(0), "id", 4) == [] and tables.cut_predicates("k", []) == ["1 = 1"]
    made = literals.insert_statements(spread, "t", batch_rows=10_000, batch_by=("k", even))
    assert sorted(r.n_rows for r in made.collect()) == sorted(sizes)
