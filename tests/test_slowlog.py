import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from opstrail.operators import matching
from opstrail.operators import slowlog as ops
from opstrail.plans.slowlog import slow_envelope, slow_report, write_envelope, write_report
from opstrail.sources import read_slowlog


def entry(time, user, host, metrics, query, stamp=1935940801):
    return (
        f"# Time: {time}\n# User@Host: {user}[{user}] @ {host}\n# {metrics}\n"
        f"SET timestamp={stamp};\n{query};\n"
    )


# What the logs say: time, user, host, seconds, rows sent, rows examined, query.
HARBOUR = [
    ("2031-05-09T17:20:01.25Z", "pilot", "tug.example [192.0.2.7]", 4.5, 3, 70, "SELECT berth FROM quay WHERE depth > 14 AND flag = 'open'"),
    ("2031-05-09T17:21:40Z", "clerk", "[192.0.2.9]", 0.75, 0, 12, "DELETE FROM crane_shift WHERE week = 19"),
    ("2031-05-09T17:22:13Z", "pilot", "tug.example [192.0.2.7]", 6.125, 3, 71, "SELECT berth FROM quay WHERE depth > 14 AND flag = 'open'"),
    ("2031-05-09T17:23:59Z", "clerk", "[192.0.2.9]", 0, 1, 1, "SELECT now()"),
    ("2031-05-09T17:30:00Z", "buoy", "sea.example []", 2.25, 40, 900, "INSERT INTO drift SELECT * FROM wave"),
    ("2031-05-09T17:31:00Z", "pilot", "tug.example [192.0.2.7]", 1.5, 3, 65, "SELECT berth FROM quay WHERE depth > 9 AND flag = 'shut'"),
]
TIDES = [
    ("2031-05-10T06:00:00Z", "buoy", "sea.example []", 8.5, 1, 24, "SELECT level FROM tide WHERE hour = 6"),
    ("2031-05-10T18:00:00Z", "buoy", "sea.example []", 11.25, 1, 24, "SELECT level FROM tide WHERE hour = 18"),
    ("2031-05-10T18:30:00Z", "buoy", "sea.example []", 5, 1, 24, "SELECT level FROM tide WHERE hour = 18"),
]


def render(records):
    return "\n".join(
        entry(time, user, host, f"Query_time: {seconds}  Lock_time: 0.5 Rows_sent: {sent}  Rows_examined: {examined}", query)
        for time, user, host, seconds, sent, examined, query in records
    )


def slowest(records, mask=False):
    """The slowest record of each query, slowest first."""
    best = {}
    for r in records:
        key = re.sub(r"'[^']*'|\b[0-9]+\b", "?", r[6]) if mask else r[6]
        if r[3] and (key not in best or r[3] > best[key][3]):
            best[key] = (*r[:6], key)
    return sorted(best.values(), key=lambda r: -r[3])


def seconds(*logs, mask=False):
    return sorted((r[3] for log in logs for r in slowest(log, mask)), reverse=True)


SHORT, AGAIN = render(HARBOUR), render(TIDES)
# Every whole-number metric with a value of its own.
NUMBERS = {name: 1000 + 7 * i for i, name in enumerate(ops.INT_METRICS)}
LONG = entry(
    "2031-05-11T00:00:09.5Z", "keeper", "light.example [192.0.2.44]  Id:    31",
    "Query_time: 0.0625  Lock_time: 0.03125 " + " ".join(f"{k}: {v}" for k, v in NUMBERS.items())
    + " Start: 2031-05-11T00:00:09.4Z End: 2031-05-11T00:00:09.5Z",
    "REPLACE INTO lamp (colour, turns) VALUES ('red;white', @n)",
)


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    (folder / "below").mkdir(parents=True)
    (folder / "below" / "deep.log").write_text(SHORT)
    (folder / "short.log").write_text(SHORT)
    (folder / "short.log.gz").write_bytes(gzip.compress(SHORT.encode()))
    (folder / "again.log").write_text(AGAIN)
    return folder


def rows(report, *columns):
    return [tuple(r) for r in report.records.select(*columns).collect()]


def parse_text(spark, tmp_path, text, **options):
    path = tmp_path / "one.log"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return slow_report(spark, str(path), **options)


def test_one_file(spark, logs):
    report = slow_report(spark, str(logs / "short.log"))
    assert rows(report, "query_time", "user", "host_ip", "rows_sent", "rows_examined", "query") == [
        (t, f"{user}[{user}]", host, sent, examined, query)
        for _, user, host, t, sent, examined, query in slowest(HARBOUR)
    ]


def test_directory_has_no_dedup_across_files(spark, logs):
    every = seconds(HARBOUR, HARBOUR, TIDES, mask=True)
    report = slow_report(spark, str(logs), mask=True)
    assert [t for t, in rows(report, "query_time")] == every
    assert report.status.where("ok").count() == 3
    top = slow_report(spark, str(logs), mask=True, limit=2)
    assert rows(top, "query_time", "query") == [
        (r[3], r[6]) for r in (slowest(TIDES, True)[0], slowest(HARBOUR, True)[0])
    ]
    merged = slow_report(spark, str(logs), dedup="global")
    assert [t for t, in rows(merged, "query_time")] == seconds(HARBOUR + TIDES)


def test_pattern_applies_to_directories_only(spark, logs):
    assert slow_report(spark, str(logs), pattern="again*").records.count() == len(slowest(TIDES))
    assert slow_report(spark, str(logs), pattern="[invalid]").records.count() == 0
    assert slow_report(spark, str(logs / "short.log"), pattern="again*").records.count() == len(slowest(HARBOUR))
    (logs / "a+b c%20.log").write_text(AGAIN)
    (logs / "a+b c%20.log.old").write_bytes(gzip.compress(AGAIN.encode()))
    assert slow_report(spark, str(logs), pattern="a+b c%20*").records.count() == 2 * len(slowest(TIDES))
    assert slow_report(spark, str(logs / "a+b c%20.log"), pattern="x").records.count() == len(slowest(TIDES))
    with pytest.raises(ValueError):
        slow_report(spark, str(logs), pattern="[a")


def test_gzip_is_told_by_content(spark, tmp_path):
    (tmp_path / "zipped.log").write_bytes(gzip.compress(SHORT.encode()))
    (tmp_path / "plain.gz").write_text(SHORT)
    (tmp_path / "two.gz").write_bytes(gzip.compress(SHORT.encode()[:300]) + gzip.compress(SHORT.encode()[300:]))
    report = slow_report(spark, str(tmp_path))
    assert report.records.count() == 3 * len(slowest(HARBOUR))
    assert report.status.where("ok").count() == 3


def test_corrupt_gzip_fails_its_file_only(spark, tmp_path):
    (tmp_path / "good.log").write_text(AGAIN)
    big = "".join(SHORT + "\n" for _ in range(200))
    (tmp_path / "bad.log.gz").write_bytes(gzip.compress(big.encode())[:-20])
    report = slow_report(spark, str(tmp_path))
    assert [t for t, in rows(report, "query_time")] == seconds(TIDES)
    bad = report.status.where("NOT ok").collect()
    assert len(bad) == 1 and bad[0].error.startswith("fail to read gzip file")


def test_all_metrics(spark, tmp_path):
    row = parse_text(spark, tmp_path, LONG).records.collect()[0].asDict()
    row.pop("file")
    assert list(row) == ops.RECORD_FIELDS and len(row) == 29
    known = {k: v for k, v in row.items() if k not in {n.lower() for n in NUMBERS}}
    assert known == {
        "query": "REPLACE INTO lamp (colour, turns) VALUES ('redwhite', @n)",
        "time": "2031-05-11T00:00:09.5Z", "user": "keeper[keeper]", "host_ip": "light.example [192.0.2.44]",
        "query_time": 0.0625, "lock_time": 0.03125,
        "start": "2031-05-11T00:00:09.4Z", "end": "2031-05-11T00:00:09.5Z",
    }
    assert {n: row[n.lower()] for n in NUMBERS} == NUMBERS


@pytest.mark.parametrize(
    "text, error",
    [
        ("# Time: not-a-time", "fail to parse time"),
        ("# Time: 2024-02-03T04:05:06Z\n# User@Host: [app] @ [10.0.0.1]",
         "fail to parse user and host, line: # User@Host: [app] @ [10.0.0.1]"),
        ("# Time: 2024-02-03T04:05:06Z\n# User@Host: a[a] @ [10.0.0.1] \n# Query_time: bad  Lock_time: 0.1",
         "fail to convert Query_time to float64"),
        ("# Time: 2024-02-03T04:05:06Z\n# Query_time: 1e400", "fail to convert Query_time to float64"),
        ("# Time: 2024-02-03T04:05:06Z\n# Query_time: 1d", "fail to convert Query_time to float64"),
        ("# Time: 2024-02-03T04:05:06Z\n# Query_time: 1 Rows_sent: 1.5 Rows_sent: 2",
         "fail to convert Rows_sent to int"),
        ("# Time: 2024-02-03T04:05:06Z\n# Query_time: 1 Errno: 9223372036854775808",
         "fail to convert Errno to int"),
        (SHORT + "\n# Timer: 5\n", "fail to parse time"),
    ],
)
def test_errors(spark, tmp_path, text, error):
    report = parse_text(spark, tmp_path, text)
    assert report.records.count() == 0
    assert [(s.ok, s.error) for s in report.status.collect()] == [(False, error)]


def test_text_before_the_first_record(spark, tmp_path):
    report = parse_text(spark, tmp_path, "harbour log, third volume\nwritten at sea\n" + SHORT)
    assert report.records.count() == len(slowest(HARBOUR))
    assert [(s.ok, s.n_records) for s in report.status.collect()] == [(True, len(HARBOUR))]
    report = parse_text(spark, tmp_path, "one line that is no log")
    assert report.records.count() == 0 and report.status.first().ok


def test_missing_path_and_engine(spark, tmp_path):
    envelope = json.loads(slow_envelope(spark, str(tmp_path / "none.log"), 2).first().envelope)
    assert envelope["ok"] is False and envelope["error"] and envelope["results"] is None
    with pytest.raises(ValueError, match="unsupported database type: postgresql"):
        slow_report(spark, str(tmp_path), engine="postgresql")


def test_envelope_and_files(spark, logs, tmp_path):
    envelope = json.loads(slow_envelope(spark, str(logs), 2, mask=True).first().envelope)
    assert list(envelope) == ["ok", "error", "results"] and envelope["ok"] and envelope["error"] == ""
    assert [list(r) for r in envelope["results"]] == [ops.RECORD_FIELDS] * 2
    assert [r["query_time"] for r in envelope["results"]] == seconds(HARBOUR, HARBOUR, TIDES, mask=True)[:2]
    with pytest.raises(ValueError):
        slow_envelope(spark, str(logs), 0)
    write_report(slow_report(spark, str(logs)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "results")).count() == len(seconds(HARBOUR, HARBOUR, TIDES))


def test_blocks_without_time_line(spark, tmp_path):
    text = (
        "# Time: 2024-02-03T04:05:06Z\n# User@Host: a[a] @ [h]\n# Query_time: 1 Lock_time: 0\n"
        "SET timestamp=1;\nselect 1;\n# User@Host: b[b] @ [h]\n# Query_time: 2 Lock_time: 0\n"
        "SET timestamp=2;\nselect 2;\n"
    )
    merged = parse_text(spark, tmp_path, text)
    assert rows(merged, "user", "query_time", "query") == [
        ("b[b]", 2.0, "select 1\nSET timestamp=2\nselect 2")
    ]
    split = parse_text(spark, tmp_path, text, split_blocks=True)
    assert rows(split, "user", "query_time", "query", "time") == [
        ("b[b]", 2.0, "select 2", "2024-02-03T04:05:06Z"),
        ("a[a]", 1.0, "select 1", "2024-02-03T04:05:06Z"),
    ]


def test_time_with_offset(spark):
    raw = spark.createDataFrame(
        [(": 2024-02-03T04:05:06.5-05:30\n",), (": 2024-02-03 04:05:06\n",), (": 2024-02-03T04:05:06+0200",)],
        "text string",
    )
    got = ops.with_time(raw, as_instant=True).select("time", F.unix_micros("time_ts").alias("t")).collect()
    base = 1706933106
    assert [r.time for r in got] == ["2024-02-03T04:05:06.5", "2024-02-03 04:05:06", "2024-02-03T04:05:06+0200"]
    assert [r.t for r in got] == [(base + 19800) * 10**6 + 500000, base * 10**6, (base - 7200) * 10**6]


# Single header lines and what a log of one record with that line says: user and rows, or the fault.
HEADERS = [
    ("# User@Host: a[a] @ h.x [1.2.3.4]  Id: 5", ("a[a]", 0)),
    ("# User@Host: b[b] @  []", ("b[b]", 0)),
    ("# Query_time: 2.5 Rows_sent 3 Rows_sent: 9", ("", 9)),
    ("# Query_time: 2.5 Lock_time: 0.1 Unknown: 7\tRows_sent: 6 \r", ("", 6)),
    ("# Query_time: .5 Query_time: 4.", ("", 0)),
    ("# Query_time: 3\u00a0Rows_sent: 8", ("", 8)),
    ("# remark", ("", 0)),
    ("# User x", "fail to parse user and host"),
    ("# Query_time: x", "fail to convert Query_time to float64"),
    ("# Query_time: 1 Rows_sent: 2.5", "fail to convert Rows_sent to int"),
]


def test_headers_of_many_files(spark, tmp_path):
    """Each file holds one known record and one with the header under test; every second is gzip."""
    folder = tmp_path / "headers"
    folder.mkdir()
    for i, (line, _) in enumerate(HEADERS):
        text = f"# Time: 2031-01-01T00:00:00Z\n# Query_time: 1.25\n{line}\nSET timestamp=1;\nselect {i};\n" + AGAIN
        data = text.encode()
        (folder / f"{i:03d}.log").write_bytes(gzip.compress(data) if i % 2 else data)
    report = slow_report(spark, str(folder))
    status = {int(r.file[-7:-4]): r.error for r in report.status.collect()}
    found = {int(r.file[-7:-4]): (r.user, r.rows_sent) for r in report.records.collect() if r.query.startswith("select")}
    for i, (_, want) in enumerate(HEADERS):
        if isinstance(want, str):
            assert status[i].startswith(want) and i not in found
        else:
            assert status[i] == "" and found[i] == want


def test_splits_inside_a_file(spark, tmp_path):
    path = tmp_path / "big.log"
    body = "".join(
        entry("2024-02-03T04:05:06Z", f"u{i}", "[h]", f"Query_time: {i + 1}.5 Lock_time: 0 Rows_sent: {i}",
              f"select {i}\nfrom\n\nt{i}") + ("\n" if i % 3 else "")
        for i in range(3000)
    )
    path.write_text("banner\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        raw = read_slowlog(spark, str(path))
        assert raw.rdd.getNumPartitions() > 20
        report = slow_report(spark, str(path))
        assert report.records.count() == 3000
        assert report.status.first().ok
        # Equal times: the earlier record wins, wherever the file is cut.
        masked = slow_report(spark, str(path), mask=True).records
        assert masked.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_scan_for_records_and_status(spark, logs):
    report = slow_report(spark, str(logs), pattern="*.log")
    report.records.collect()
    final = report.records._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("MapInArrow") == 1


def test_many_files_are_not_broadcast(spark, logs, monkeypatch):
    monkeypatch.setattr(matching, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(matching, "HOT_ROWS", 2)
    (logs / "bad.log").write_text(SHORT + "\n# Time: bad\n")
    report = slow_report(spark, str(logs), pattern="*.log")
    assert [r.query_time for r in report.records.collect()] == seconds(HARBOUR, TIDES)
    final = report.records._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("MapInArrow") == 1


def test_idle_files_have_a_status(spark, logs):
    (logs / "empty.log").write_text("")
    (logs / "notes.log").write_text("no record here\n")
    status = {r.file.rsplit("/", 1)[1]: (r.ok, r.error, r.n_records) for r in slow_report(spark, str(logs), pattern="*.log").status.collect()}
    assert status["empty.log"] == status["notes.log"] == (True, "", 0)
    assert status["short.log"] == (True, "", len(HARBOUR)) and len(status) == 4


def test_files_that_vanish(spark, logs):
    """A plain file that goes at any time, or shrinks, is that file's error and no other's."""
    whole = (logs / "short.log").read_text()
    for name in ("gone.log", "cut.log"):
        (logs / name).write_text(whole)
    report = slow_report(spark, str(logs), pattern="*.log")
    (logs / "gone.log").unlink()
    (logs / "cut.log").write_text(whole[:-7])
    status = {r.file.rsplit("/", 1)[1]: (r.ok, r.error) for r in report.status.collect()}
    assert {n for n, (ok, _) in status.items() if not ok} == {"gone.log", "cut.log"}
    assert all(e.startswith("fail to read file: ") for ok, e in status.values() if not ok)
    assert [r.query_time for r in report.records.collect()] == seconds(HARBOUR, TIDES)


def test_whole_envelope_as_lines(spark, logs, tmp_path):
    report = slow_report(spark, str(logs), mask=True)
    write_envelope(report, str(tmp_path / "e"))
    text = "".join(p.read_text() for part in sorted((tmp_path / "e").iterdir()) for p in sorted(part.glob("part*")))
    document = json.loads(text)
    assert document["ok"] and document["error"] == ""
    assert [r["query_time"] for r in document["results"]] == seconds(HARBOUR, HARBOUR, TIDES, mask=True)
