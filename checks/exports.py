"""Export queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs
from opstrail.functions.literals import sql_float
from opstrail.operators import literals
from opstrail.operators.jobs import batch_outcome, result_text
from opstrail.plans import export
from opstrail.session import work_dir
from opstrail.sources import tables

NAMED_TABLES = ["nation", "orders", "part", "region"]
BATCH = 500


def sql_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several tables, with a column for each kind of literal."""

    def get(name: str) -> DataFrame:
        return inputs.table(spark, sf_dir, name)

    part = get("part").select(
        "p_partkey",
        F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("000000"))).alias("padded"),
        F.encode("p_brand", "UTF-8").alias("raw"),
        F.col("p_size").cast("smallint").alias("p_size"),
        F.col("p_retailprice").cast("float").alias("price"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"),
    )
    orders = get("orders").select(
        "*",
        (F.col("o_orderstatus") == "F").alias("is_f"),
        (F.col("o_totalprice") > 100_000).alias("is_big"),
        F.year("o_orderdate").alias("o_year"),
        F.to_date("o_orderdate").alias("o_day"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("exact"),
        F.col("o_orderkey").cast("decimal(20,0)").alias("wide"),
    )
    types = {
        "part": {"padded": "BINARY"},
        "orders": {"is_f": "BIT", "o_year": "YEAR", "o_orderpriority": "ENUM"},
        "events": {"props": "JSON"},
    }
    tables = {
        "region": get("region"),
        "part": part,
        "orders": orders,
        "events": get("events"),
        "documents": get("documents").select("doc_id", "text", "lang"),
    }
    rows = None
    for name, df in tables.items():
        rendered = literals.to_sql_literals(df, source_types=types.get(name)).select(
            F.lit(name).alias("table_name"), "row_sql"
        )
        rows = rendered if rows is None else rows.unionAll(rendered)
    return rows


def insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders")
    return literals.insert_statements(orders, "orders", batch_by=("o_orderkey", BATCH))


def insert_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all lines, cut where they are scanned, split back into rows: an order-free digest of those by return flag."""
    lines = inputs.table(spark, sf_dir, "lineitem")
    head = literals.insert_head(lines, "lineitem")
    statements = literals.insert_statements(lines, "lineitem", batch_rows=BATCH)
    inside = F.substring("statement", len(head) + 2, F.length("statement") - F.lit(len(head) + 3))
    rows = statements.select(
        (F.col("statement").startswith(head + "(") & F.col("statement").endswith(");") & (F.col("n_rows") <= BATCH)).alias("formed"),
        "n_rows",
        F.split(inside, r"\),\(").alias("rows"),
    ).select((F.col("formed") & (F.size("rows") == F.col("n_rows"))).alias("formed"), F.explode("rows").alias("row"))
    digest = F.conv(F.substring(F.md5(F.col("row").cast("binary")), 1, 12), 16, 10).cast("bigint")
    return rows.groupBy(F.substring(F.md5(F.col("row").cast("binary")), 13, 1).alias("part")).agg(
        F.count("*").alias("n_rows"), F.bool_and("formed").alias("formed"), F.sum(digest.cast("decimal(38,0)")).cast("string").alias("digest")
    )


def key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under a key with nine tenths of its rows in a hundredth of its range, read range by range
    as a database would be: what all ranges give together, and whether the largest is near the median."""
    near = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = inputs.table(spark, sf_dir, "lineitem")
    rows = lines.select(F.when(F.pmod(F.col("l_orderkey"), F.lit(10)) == 0, near * 1000).otherwise(near).alias("k"), "l_returnflag")
    parts = None
    for i, predicate in enumerate(tables.cut_predicates("k", tables.key_cuts(rows, "k", 32))):
        part = rows.where(predicate).withColumn("part", F.lit(i).cast("bigint"))
        parts = part if parts is None else parts.unionAll(part)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.median("n").alias("middle"))
    return parts.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"),
        F.sum("k").alias("keys"),
    ).withColumn("balanced", sizes.select(F.col("most") < 2 * F.col("middle")).scalar())


def _views(spark: SparkSession, sf_dir: str) -> str:
    for name in NAMED_TABLES:
        inputs.table(spark, sf_dir, name).createOrReplaceTempView(f"dump_{name}")
    inputs.table(spark, sf_dir, "nation").where("false").createOrReplaceTempView("dump_zero")
    return "dump_*"


def export_sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = work_dir(spark, "script")
    keys = {"nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey", "region": "r_regionkey"}
    export.export_database(
        spark,
        dest,
        like=_views(spark, sf_dir),
        gzip=True,
        batch_by={f"dump_{n}": (key, BATCH) for n, key in keys.items()},
    )
    return export.read_script(spark, dest)


def export_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "fanout")
    orders = inputs.table(spark, sf_dir, "orders")
    formats = ["json", "parquet", "orc"]
    done = export.export_many(orders, [export.Destination(f"{root}/{f}", f) for f in formats], gzip=True)
    paths = {row.dest.rsplit("/", 1)[1]: row.path for row in done.where("ok").collect()}
    out = None
    for fmt in formats:
        back = spark.read.schema(orders.schema).format(fmt).load(paths[fmt])
        summed = back.groupBy(F.lit(fmt).alias("dest"), "o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("o_orderkey").alias("keys"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        )
        out = summed if out is None else out.unionAll(summed)
    return out


def _batch(spark: SparkSession, sf_dir: str) -> str:
    """A batch of exports of whole tables, one of them without a source; results as a table."""

    def make(path: str) -> None:
        def job(name: str, source: str, fmt: str = "parquet") -> export.ExportJob:
            dest = export.Destination(f"{path}/out/{name}", fmt)
            return export.ExportJob(name, "parquet", f"{sf_dir}/{source}.parquet", [dest])

        jobs = [job(t, t) for t in (*NAMED_TABLES, "lineitem", "customer")]
        jobs += [job("script", "orders", "text"), job("broken", "no_such_table")]
        export.run_exports(spark, jobs, max_parallel=4).write.parquet(f"{path}/results")

    return inputs.once(spark, sf_dir, "batch", make)


def export_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _batch(spark, sf_dir)
    results = spark.read.parquet(f"{path}/results")
    counts = None
    for name in (*NAMED_TABLES, "lineitem", "customer"):
        n = spark.read.parquet(f"{path}/out/{name}").agg(F.count(F.lit(1)).alias("n_rows"))
        n = n.select(F.lit(name).alias("job_name"), "n_rows")
        counts = n if counts is None else counts.unionAll(n)
    return results.join(counts, "job_name", "left").select(
        "job_name",
        "ok",
        F.regexp_replace("error", r"exist: \S*/", "exist: ").alias("error"),
        F.when(F.col("job_name") == "script", _rows_in(spark, f"{path}/out/script").scalar())
        .otherwise(F.coalesce("n_rows", F.lit(0)))
        .alias("n_rows"),
    )


def _rows_in(spark: SparkSession, path: str) -> DataFrame:
    """Rows inside written INSERT statements; a row of orders ends in a quoted text."""
    joints = F.size(F.split("value", r"'\),\("))
    return spark.read.text(path).agg(F.sum(joints).alias("n"))


def export_job_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of jobs whose destinations are whole scripts, read back with the outcome of each job."""
    root = work_dir(spark, "jobs")
    jobs = [
        export.ExportJob(
            t, "parquet", f"{sf_dir}/{t}.parquet", [export.Destination(f"{root}/{t}", "script")],
            dump={"database": "shop", "batch_by": (KEY[t], BATCH)},
        )
        for t in NAMED_TABLES
    ]
    results = export.run_exports(spark, jobs, max_parallel=2).select(F.col("job_name").alias("job"), "ok", "error")
    scripts = None
    for t in NAMED_TABLES:
        script = export.read_script(spark, f"{root}/{t}").select(F.lit(t).alias("job"), "*")
        scripts = script if scripts is None else scripts.unionAll(script)
    return scripts.join(F.broadcast(results), "job", "left")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a hundred events, each event a job that failed if it is an error."""
    results = inputs.table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 100).alias("batch"),
        F.format_string("job%012d", "event_id").alias("job_name"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("no "), "props", F.lit("\nat "), F.col("event_id").cast("string")).alias("error"),
    )
    return batch_outcome(results, ("batch",))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from parts: some lack a name, a source, a driver or a destination."""
    k = F.col("p_partkey")
    jobs = inputs.table(spark, sf_dir, "part").select(
        k.alias("job"),
        F.when(k % 11 == 0, "  ").otherwise(F.col("p_name")).alias("name"),
        F.when(k % 7 != 0, F.col("p_brand")).alias("dsn"),
        F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("driver"),
        (F.col("p_size") % 4).cast("int").alias("n_destinations"),
    )
    return export.job_faults(jobs).select("job", "fault")


def large_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by ranges of keys that a double cannot tell apart, below zero too."""
    big = F.lit((1 << 53) - 20) + F.col("o_orderkey")
    rows = inputs.table(spark, sf_dir, "orders").select(big.alias("big"), "o_orderpriority")
    rows = rows.union(rows.select(-F.col("big"), "o_orderpriority"))
    made = literals.insert_statements(rows, "big", batch_by=("big", 3))
    return made.select("batch", "n_rows", F.md5(F.col("statement").cast("binary")).alias("digest"))


def float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and small shares of them as float literals."""
    value = F.col("l_extendedprice") / F.pow(F.lit(10.0), F.col("l_linenumber") + F.lit(4))
    half = (F.col("l_orderkey") * 2 + 1) / F.lit(2000000.0)
    price = F.col("l_extendedprice")
    columns = {
        "small": value,
        "tie": -half,
        "quarter": 1e15 + F.col("l_orderkey") * 0.25,
        "wide": price * 2.0**40,
        "huge": -price * 2.0**70 * F.col("l_orderkey"),
    }
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[sql_float(x).alias(n) for n, x in columns.items()]
    )


def results_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = inputs.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("job"), F.col("event_id").cast("string")).alias("job_name"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.col("props")).otherwise("").alias("error"),
        (F.round(F.col("value") * 100).cast("long") * (1 + F.col("event_id") % 400)).alias("elapsed_ms"),
    )
    chat = result_text(results, markup=True).select("event_id", F.col("text").alias("chat"))
    return result_text(results).select("event_id", "text").join(chat, "event_id")


QUERIES = {
    "sql_literals": sql_literals,
    "insert_statements": insert_statements,
    "insert_unordered": insert_unordered,
    "export_sql_script": export_sql_script,
    "export_fanout": export_fanout,
    "export_batch": export_batch,
    "export_job_script": export_job_script,
    "batch_outcome": outcomes,
    "job_faults": faults,
    "insert_large_keys": large_keys,
    "float_text": float_text,
    "key_ranges": key_ranges,
    "result_text": results_as_text,
}


def text_sql(c: str) -> str:
    for raw, safe in (("'\\'", "'\\\\'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("''''", "''''''")):
        c = f"replace({c}, {raw}, {safe})"
    return f"'''' || {c} || ''''"


def tuple_sql(*values: str) -> str:
    return "'(' || " + " || ',' || ".join(f"coalesce({v}, 'NULL')" for v in values) + " || ')'"


def digits_sql(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def stamp_sql(c: str) -> str:
    return f"'''' || CAST({c} AS VARCHAR) || ''''"


def float_sql(c: str) -> str:
    return f"printf('%f', {c})"


ROWS = {
    "region": tuple_sql(digits_sql("r_regionkey"), text_sql("r_name")),
    "nation": tuple_sql(digits_sql("n_nationkey"), text_sql("n_name"), digits_sql("n_regionkey")),
    "orders": tuple_sql(
        digits_sql("o_orderkey"), digits_sql("o_custkey"), text_sql("o_orderstatus"),
        float_sql("o_totalprice"), stamp_sql("o_orderdate"), text_sql("o_orderpriority"),
    ),
    "part": tuple_sql(
        digits_sql("p_partkey"), text_sql("p_name"), text_sql("p_brand"), text_sql("p_type"),
        digits_sql("p_size"), float_sql("p_retailprice"),
    ),
}
LINE_ROW = "(" + tuple_sql(
    digits_sql("l_orderkey"), digits_sql("l_partkey"), digits_sql("l_suppkey"), digits_sql("l_linenumber"),
    float_sql("l_quantity"), float_sql("l_extendedprice"), float_sql("l_discount"), float_sql("l_tax"),
    text_sql("l_returnflag"), text_sql("l_linestatus"), stamp_sql("l_shipdate"),
) + ")[2:-2]"
KINDS = {"INTEGER": "INT", "BIGINT": "BIGINT", "VARCHAR": "LONGTEXT", "DOUBLE": "DOUBLE", "TIMESTAMP": "DATETIME(6)"}
COLUMNS = {
    "nation": ("n_nationkey INTEGER", "n_name VARCHAR", "n_regionkey INTEGER"),
    "orders": (
        "o_orderkey BIGINT", "o_custkey BIGINT", "o_orderstatus VARCHAR", "o_totalprice DOUBLE",
        "o_orderdate TIMESTAMP", "o_orderpriority VARCHAR",
    ),
    "part": (
        "p_partkey BIGINT", "p_name VARCHAR", "p_brand VARCHAR", "p_type VARCHAR", "p_size INTEGER",
        "p_retailprice DOUBLE",
    ),
    "region": ("r_regionkey INTEGER", "r_name VARCHAR"),
}
KEY = {t: c[0].split()[0] for t, c in COLUMNS.items()}


def _insert_sql(source: str, name: str) -> str:
    names = ", ".join(f"`{c.split()[0]}`" for c in COLUMNS[source])
    return f"""SELECT {KEY[source]} // {BATCH} AS batch,
      'INSERT INTO `{name}` ({names}) VALUES ' || string_agg({ROWS[source]}, ',' ORDER BY {KEY[source]})
        || ';' AS statement, count(*) AS n_rows FROM {source} GROUP BY 1"""


def _lines_sql(part: str, lines: list[str]) -> str:
    values = ", ".join("('" + line.replace("'", "''") + "')" for line in lines)
    return f"SELECT '{part}' AS part, v AS value FROM (VALUES {values}) t(v)"


def _ddl(name: str, columns: tuple[str, ...]) -> list[str]:
    defined = ", ".join(f"`{c.split()[0]}` {KINDS[c.split()[1]]}" for c in columns)
    return [f"DROP TABLE IF EXISTS `{name}`;", f"CREATE TABLE `{name}` ({defined});"]


def _script_sql(tables: list[str] = NAMED_TABLES, prefix: str = "dump_", database: str = "") -> str:
    """All parts of a script; that of a whole database has an empty table too."""
    ddl = [s for t in tables for s in _ddl(f"{prefix}{t}", COLUMNS[t])]
    if not database:
        ddl += _ddl("dump_zero", COLUMNS["nation"])
    parts = [
        _lines_sql("1-header", [f"-- Database: {database}", *export.SCRIPT_HEADER]),
        _lines_sql("2-structure", ddl),
        _lines_sql("4-footer", export.SCRIPT_FOOTER),
    ]
    for i, t in enumerate(tables):
        name, part = f"{prefix}{t}", f"3-{i:06d}-{prefix}{t}"
        parts += [
            _lines_sql(
                f"{part}-1-open",
                [f"LOCK TABLES `{name}` WRITE;", f"/*!40000 ALTER TABLE `{name}` DISABLE KEYS */;"],
            ),
            f"SELECT '{part}-2-rows' AS part, statement AS value FROM ({_insert_sql(t, name)})",
            _lines_sql(
                f"{part}-3-close",
                [f"/*!40000 ALTER TABLE `{name}` ENABLE KEYS */;", "UNLOCK TABLES;"],
            ),
        ]
    return " UNION ALL ".join(parts)


PADDED = "'x''' || hex(encode(p_name)) || ''''"
LITERALS = {
    "region": ROWS["region"],
    "part": tuple_sql(
        digits_sql("p_partkey"), PADDED, "'x''' || hex(encode(p_brand)) || ''''", digits_sql("p_size"),
        float_sql("CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE)"),
        f"CASE WHEN p_size > 25 THEN {text_sql('p_type')} END",
    ),
    "orders": ROWS["orders"][: -len(" || ')'")] + " || ',' || " + tuple_sql(
        "CASE WHEN o_orderstatus = 'F' THEN 'b''1''' ELSE 'b''0''' END",
        "CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END",
        "'''' || year(o_orderdate) || ''''", stamp_sql("CAST(o_orderdate AS DATE)"),
        "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)", digits_sql("o_orderkey"),
    )[len("'(' || "):],
    "events": tuple_sql(
        digits_sql("event_id"), stamp_sql("ts"), digits_sql("user_id"), text_sql("event_type"),
        float_sql("value"), f"replace({text_sql('props')}, '\"', '\\\"')",
    ),
    "documents": tuple_sql(digits_sql("doc_id"), text_sql("text"), text_sql("lang")),
}
FANOUT = " UNION ALL ".join(
    f"""SELECT '{fmt}' AS dest, o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 2"""
    for fmt in ("json", "parquet", "orc")
)
STORE_ERROR = (
    "failed to store dump file [PATH_NOT_FOUND] Path does not exist: no_such_table.parquet. SQLSTATE: 42K03"
)
TEXT_RESULTS = """r AS (SELECT event_id, 'job' || event_id AS j, event_type <> 'error' AS ok, props AS e,
    CAST(round(value * 100) AS BIGINT) * (1 + event_id % 400) AS ms FROM events),
  s AS (SELECT *, (ms // 1000 % 60) || rtrim(rtrim('.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0'), '0'), '.')
    || 's' AS sec FROM r),
  t AS (SELECT *, CASE WHEN ms = 0 THEN '0s' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN sec
    WHEN ms < 3600000 THEN (ms // 60000) || 'm' || sec
    ELSE (ms // 3600000) || 'h' || (ms // 60000 % 60) || 'm' || sec END AS d FROM s)"""

ORACLE = {
    "sql_literals": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {row} AS row_sql FROM {t}" for t, row in LITERALS.items()
    ),
    "insert_statements": _insert_sql("orders", "orders"),
    "insert_unordered": f"""WITH r AS (SELECT md5({LINE_ROW}) AS m FROM lineitem)
      SELECT m[13:13] AS part, count(*) AS n_rows, true AS formed,
        CAST(sum(CAST('0x' || m[1:12] AS BIGINT)) AS VARCHAR) AS digest FROM r GROUP BY 1""",
    "export_sql_script": _script_sql(),
    "export_fanout": FANOUT,
    "export_batch": " UNION ALL ".join(
        f"SELECT '{t}' AS job_name, true AS ok, '' AS error, count(*) AS n_rows FROM {t}"
        for t in (*NAMED_TABLES, "lineitem", "customer")
    )
    + f""" UNION ALL SELECT 'script', true, '', count(*) FROM orders
      UNION ALL SELECT 'broken', false, '{STORE_ERROR}', 0""",
    "batch_outcome": """SELECT event_id // 100 AS batch, bool_and(event_type <> 'error') AS ok,
      coalesce(string_agg('no ' || props || chr(10) || 'at ' || event_id, chr(10) ORDER BY event_id)
        FILTER (event_type = 'error'), '') AS error FROM events GROUP BY 1""",
    "job_faults": """SELECT p_partkey AS job, CASE WHEN p_partkey % 11 = 0 THEN 'job name is required'
      WHEN p_partkey % 7 = 0 THEN 'database dsn is required'
      WHEN p_partkey % 5 = 0 THEN 'database driver is required'
      WHEN p_size % 4 = 0 THEN 'job ' || p_name || ' has no destination' END AS fault FROM part""",
    "insert_large_keys": """WITH k AS (SELECT 9007199254740972 + o_orderkey AS big, o_orderpriority AS p FROM orders),
      b AS (SELECT * FROM k UNION ALL SELECT -big, p FROM k),
      n AS (SELECT *, (big - ((big % 3) + 3) % 3) // 3 AS batch FROM b)
      SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_rows,
        md5('INSERT INTO `big` (`big`, `o_orderpriority`) VALUES ' || string_agg('(' || big || ',' || chr(39) || p
          || chr(39) || ')', ',' ORDER BY big) || ';') AS digest FROM n GROUP BY batch""",
    "float_text": """SELECT l_orderkey, l_linenumber,
      printf('%.6f', l_extendedprice / pow(10.0, l_linenumber + 4)) AS small,
      printf('%.6f', -((l_orderkey * 2 + 1) / 2000000.0::DOUBLE)) AS tie,
      printf('%.6f', 1e15::DOUBLE + l_orderkey * 0.25::DOUBLE) AS quarter,
      printf('%.6f', l_extendedprice * pow(2.0, 40)) AS wide,
      printf('%.6f', -l_extendedprice * pow(2.0, 70) * l_orderkey) AS huge FROM lineitem""",
    "key_ranges": """SELECT l_returnflag, count(*) AS n_rows, CAST(sum((l_orderkey * 8 + l_linenumber)
        * CASE WHEN l_orderkey % 10 = 0 THEN 1000 ELSE 1 END) AS BIGINT) AS keys, true AS balanced
      FROM lineitem GROUP BY 1""",
    "export_job_script": " UNION ALL ".join(
        f"SELECT '{t}' AS job, part, value, true AS ok, '' AS error FROM ({_script_sql([t], '', 'shop')})" for t in NAMED_TABLES
    ),
    "result_text": f"""WITH {TEXT_RESULTS} SELECT event_id,
        CASE WHEN ok THEN j || ' succeeded, it took ' || d
          ELSE j || ' failed, it took ' || d || ' with error: ' || e END AS text,
        CASE WHEN ok THEN ':white_check_mark: `' || j || '` succeeded, it took *' || d || '*'
          ELSE ':x: `' || j || '` failed, it took *' || d || '* ```' || e || '```' END AS chat FROM t""",
}
