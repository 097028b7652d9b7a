import itertools
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from opstrail import functions as fn


def one(spark, expression, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    return df.select(expression(*[F.col(n) for n in names]).alias("v")).first().v


@pytest.mark.parametrize(
    "text, masked",
    [
        ("a1 12.5 0xFF -5 '2023-01-01'", "a1 ?.? 0xFF -? ?"),
        ("café5 7", "café? ?"),
        ("'it''s' \"q 'x' \" 'open", "?? ? 'open"),
        ("x_9 9_x 9", "x_9 9_x ?"),
    ],
)
def test_mask(spark, text, masked):
    assert one(spark, fn.mask_literals, text) == masked


def test_trim_and_words(spark):
    text = "　\t a  b ; c;\x85\r\n"
    assert one(spark, fn.trim_ws, text) == "a  b ; c;"
    assert one(spark, fn.tokens, text) == ["a", "b", ";", "c;"]
    assert one(spark, fn.strip_semicolons, "a;';';") == "a''"


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("+5", "int", 5), ("-7", "int", -7), ("1.0", "int", None), ("", "int", None),
        ("9223372036854775807", "int", 2**63 - 1), ("9223372036854775808", "int", None),
        ("1e3", "float", 1000.0), (".5", "float", 0.5), ("4.", "float", 4.0), ("1f", "float", None),
        ("1e400", "float", None), ("Inf", "float", float("inf")), ("0x10", "float", None),
    ],
)
def test_numbers(spark, text, kind, value):
    assert one(spark, lambda c: fn.to_number(c, kind), text) == value


def test_literals(spark):
    assert one(spark, fn.sql_text, "a'b\\c\nd") == "'a''b\\\\c\\nd'"
    assert one(spark, lambda c: fn.sql_text(c, parity=True), "a'b\\c") == "'a''b\\c'"
    assert one(spark, lambda c: fn.sql_json(c, parity=True), '{"a": "x"}') == "'{\\\"a\\\": \\\"x\\\"}'"
    assert one(spark, fn.sql_float, 1.1) == "1.100000"
    assert one(spark, lambda c: fn.sql_float(c, lossless=True), 0.1234567891) == "0.1234567891"
    assert one(spark, fn.rtrim_nul, bytearray(b"\x10\x00\xa0\x00\x00")) == "1000A0"
    assert one(spark, fn.sql_bit, True) == "b'1'" and one(spark, fn.sql_bool, False) == "false"
    assert one(spark, fn.is_gzip, bytearray(b"\x1f\x8b\x08")) is True


def test_names(spark):
    assert one(spark, fn.log_number, "/a.b/mysql-bin.000012") == 12
    for odd in ("mysql-bin", "a.b.1", "a.x", "a.99999999999999999999"):
        assert one(spark, fn.log_number, odd) == 0
    assert one(spark, lambda c: fn.relative_key(c, "logs/2024"), "logs/2024-01/x") == "-01/x"
    assert one(spark, lambda c: fn.relative_key(c, "logs"), "logs//a/b") == "a/b"
    assert one(spark, fn.base_name, "/a/b") == "b" and one(spark, fn.dir_name, "/a/b") == "/a"
    now = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    assert fn.dest_name("d/x.sql", True, True, now) == "d/20240506070809-x.sql.gz"
    assert fn.dest_name("d/x.sql.gz", True, False) == "d/x.sql.gz"
    assert fn.dest_name("d/x.sql", False, False) == "d/x.sql"


def glob_brute(pattern, name):
    """Whether the name matches, by trying every split."""
    if not pattern:
        return not name
    head = pattern[0]
    if head == "*":
        return any(glob_brute(pattern[1:], name[k:]) for k in range(len(name) + 1) if "/" not in name[:k])
    if not name:
        return False
    if head == "?":
        return name[0] != "/" and glob_brute(pattern[1:], name[1:])
    if head == "[":
        end = pattern.index("]", 2)
        body = pattern[1:end]
        negated = body[0] == "^"
        body = body[negated:]
        hit = any(
            lo <= name[0] <= hi
            for lo, hi in ([(body[0], body[2])] if body[1:2] == "-" else [(c, c) for c in body])
        )
        return hit != negated and glob_brute(pattern[end + 1:], name[1:])
    return head == name[0] and glob_brute(pattern[1:], name[1:])


def test_globs(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("ab./-1", k=rng.randint(0, 6))) for _ in range(200)]
    parts = ["*", "?", "a", "b", ".", "[ab]", "[^a]", "[a-b]", "1"]
    patterns = ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(30)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", *[fn.glob_match(F.col("n"), p).alias(f"p{i}") for i, p in enumerate(patterns)])
    for row in got.collect():
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == glob_brute(p, row.n), (p, row.n)
    for bad in ("[a", "[]", "a\\", "[a-]", "[-a]"):
        with pytest.raises(ValueError):
            fn.glob_to_regex(bad)


@pytest.mark.parametrize(
    "ms, text",
    [(0, "0s"), (250, "250ms"), (1000, "1s"), (1500, "1.5s"), (61000, "1m1s"), (60250, "1m0.25s"),
     (3600000, "1h0m0s"), (7205010, "2h0m5.01s")],
)
def test_elapsed(spark, ms, text):
    assert one(spark, fn.elapsed_text, ms) == text


def test_times(spark):
    assert one(spark, lambda c: F.unix_seconds(fn.instant(c)), 1706933106) == 1706933106
    stamp = spark.range(1).select(F.unix_seconds(fn.utc_literal("2024-02-03 04:05:06")).alias("t"))
    assert stamp.first().t == 1706933106
    with pytest.raises(ValueError):
        fn.utc_literal("2024-02-03")


TEXTS = [
    None, "", " \t\u3000a1 12.5 'x''y' \"q\";\u2003", "back\\slash\nline\rend 'q' \"j\"", "+17", "-9223372036854775809",
    "1e400", "-.5e3", "1.", "Inf", "NaN", "0x1p3", "/a/b.c/bin.000012", "bin.+7", "a.b.3", "/k/rest", "k/x", "k", "caf\u00e95 7",
]
FLOATS = [None, 0.0, -0.0, 1.5, -2.0000005, 0.0000005, 1e15 + 0.25, 123456789012.123456, 2.0**70, -(2.0**200), 5e-324]
TIMES = [None, 0, 1, 250, 999, 1000, 1500, 59_999, 60_000, 60_250, 3_599_999, 3_600_000, 7_205_000, 7_205_050]


def test_sql_names_like_columns(spark):
    """Every function by its SQL name gives what the column function gives, in a plan without Python."""
    names = fn.register_functions(spark)
    s, v, ms = F.col("s"), F.col("v"), F.col("ms")
    b = s.cast("binary")
    like = {
        "mask_literals(s)": fn.mask_literals(s), "trim_ws(s)": fn.trim_ws(s), "strip_semicolons(s)": fn.strip_semicolons(s),
        "text_tokens(s)": fn.tokens(s), "to_int(s)": fn.to_number(s, "int"), "to_float(s)": fn.to_number(s, "float"),
        "is_gzip(unhex('1F8B08'))": F.lit(True), "is_gzip(cast(s as binary))": fn.is_gzip(b), "content_hash(s)": F.sha2(b, 256),
        "base_name(s)": fn.base_name(s), "dir_name(s)": fn.dir_name(s), "log_number(s)": fn.log_number(s),
        "relative_key(s, '/k')": fn.relative_key(s, "/k"), "relative_key(s, 'k')": fn.relative_key(s, "k"),
        "sql_text(s)": fn.sql_text(s), "sql_json(s)": fn.sql_json(s), "sql_binary(cast(s as binary))": fn.sql_binary(b),
        "sql_float(v)": fn.sql_float(v), "sql_bit(v > 1)": fn.sql_bit(v > 1), "sql_bool(v > 1)": fn.sql_bool(v > 1),
        "elapsed_text(ms)": fn.elapsed_text(ms),
    }
    assert {"ot_" + c.split("(")[0] for c in like} == set(names)
    rows = [(t, f, m) for t, f, m in itertools.zip_longest(TEXTS, FLOATS, TIMES)]
    spark.createDataFrame(rows, "s string, v double, ms bigint").createOrReplaceTempView("odd_values")
    got = spark.sql("SELECT " + ", ".join(f"ot_{c} AS c{i}" for i, c in enumerate(like)) + " FROM odd_values")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = spark.table("odd_values").select(*[c.alias(f"c{i}") for i, c in enumerate(like.values())])
    for a, b in zip(got.collect(), want.collect(), strict=True):
        for call, x, y in zip(like, a, b, strict=True):
            assert repr(x) == repr(y), call
    with pytest.raises(Exception, match="no SQL literal"):
        spark.sql("SELECT ot_sql_float(double('NaN'))").collect()
