"""File-sync queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs
from checks.exports import text_sql
from checks.slowlog import masked_sql
from opstrail.functions import register_functions, strip_semicolons, to_number, tokens, trim_ws
from opstrail.operators import filesync as ops
from opstrail.operators import known, ranges
from opstrail.plans.filesync import copy_by_ranges, mirror_prefix, sync_run
from opstrail.session import work_dir
from opstrail.sources import list_files
from opstrail.sources.files import folders_listed
from opstrail.streaming import stream_new_content


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", ops.content_hash(F.col("text")).alias("sha256"))


def _bucket(name: str) -> list:
    return [
        F.regexp_extract(name, "docs-([0-9]*)", 1).cast("long").alias("bucket"),
        F.col(name).endswith(".copy.txt").alias("is_copy"),
    ]


def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = list_files(spark, inputs.doc_files(spark, sf_dir), pattern="docs-[0-9]*")
    return ops.fingerprint(files).select(*_bucket("name"), "length", "sha256")


LEAF, SPAN = 1024, 4096


def range_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files copied range by range: the tree digest of each copy, and of it read in ranges of another length."""
    dest = work_dir(spark, "ranged")
    files = list_files(spark, inputs.doc_files(spark, sf_dir), pattern="docs-[0-9]*")
    copied = copy_by_ranges(files, dest, SPAN, LEAF)
    cut = ranges.byte_ranges(list_files(spark, dest), 4 * SPAN, LEAF)
    again = ranges.file_digests(ranges.digest_ranges(ranges.spread_ranges(cut, 7), LEAF))
    other = again.select("name", F.col("tree").alias("tree_again"), (F.col("n_ranges")).alias("n_long_ranges"))
    return copied.join(other, "name").select(*_bucket("name"), "ok", "bytes", "tree", "tree_again", "n_long_ranges")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document hashes as a table, hashed once."""
    path = inputs.once(
        spark, sf_dir, "hashed", lambda p: fingerprint(spark, sf_dir).write.parquet(p)
    )
    return spark.read.parquet(path)


def sync_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _hashed(spark, sf_dir)
    return ops.pending_files(hashed, hashed.where("doc_id % 2 = 0"))


def sync_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _hashed(spark, sf_dir)
    return ops.synced_files(hashed, hashed.where("doc_id % 2 = 0"))


def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state filled in two runs by half of the documents, asked for all: what it holds, found by prefix and filter."""
    hashed, state = _hashed(spark, sf_dir), work_dir(spark, "known")
    for rest in (0, 2):
        known.append_known(hashed.where(f"doc_id % 4 = {rest}"), state)
    return known.known_among(spark, hashed, state)


def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over files and copies of them: all new, nothing new, all new after a reset."""
    source, run = inputs.doc_files(spark, sf_dir), work_dir(spark, "runs")
    runs = []
    for i in (1, 2, 3):
        if i == 3:
            known.reset_known(spark, f"{run}/state")
        copied = sync_run(
            spark, source, f"{run}/dest", f"{run}/state", f"{run}/log-{i}", skip_ext=".index"
        )
        log = spark.read.schema(
            "run_id string, finished_at timestamp, n_files long, n_failed long, ok boolean"
        ).json(f"{run}/log-{i}/runs")
        logged = log.agg(F.sum("n_files").alias("n"), F.bool_and("ok").alias("ok"))
        runs.append(
            copied.agg(
                F.count(F.lit(1)).alias("n_files"),
                F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"),
                F.count_if(F.col("name").endswith(".txt")).alias("n_named"),
            ).select(
                F.lit(i).alias("run"),
                "*",
                logged.select("n").scalar().alias("n_logged"),
                logged.select("ok").scalar().alias("ok"),
            )
        )
    total = known.read_known(spark, f"{run}/state").agg(F.count_distinct("sha256").alias("n")).scalar()
    return runs[0].unionAll(runs[1]).unionAll(runs[2]).withColumn("n_known", total)


def sync_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders with equal file names and other content: both are kept, and a second run copies none."""
    source, run = work_dir(spark, "folders"), work_dir(spark, "recursive")
    files = list_files(spark, inputs.doc_files(spark, sf_dir), pattern="docs-[0-9]*")
    bucket = F.regexp_extract("name", "docs-([0-9]*)", 1).cast("long")
    twice = files.where(~F.col("name").endswith(".copy.txt")).withColumn(
        "name", F.format_string("half=%d/docs-%d.log", bucket % 2, F.expr("bigint(regexp_extract(name, 'docs-([0-9]*)', 1)) div 2"))
    )
    ops.copy_files(twice, source).write.parquet(f"{run}/made")
    sync_run(spark, source, f"{run}/dest", f"{run}/state", pattern="docs-*", recursive=True)
    again = sync_run(spark, source, f"{run}/dest", f"{run}/state", pattern="docs-*", recursive=True)
    found = ops.fingerprint(list_files(spark, f"{run}/dest", recursive=True))
    half = F.regexp_extract("name", "half=([01])/", 1).cast("long")
    place = F.regexp_extract("name", "docs-([0-9]*)[.]log$", 1).cast("long")
    return found.select(
        (place * 2 + half).alias("bucket"), "length", "sha256",
        again.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_again"),
    )


def run_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log of as many paths as there are documents, some of them failed."""
    bad = F.col("doc_id") % 100 == 7
    copied = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/docs/"), "doc_id").alias("path"),
        (~bad).alias("ok"),
        F.when(bad, F.concat(F.lit("lost "), "source")).otherwise("").alias("error"),
    )
    dest = work_dir(spark, "log")
    ops.append_run_log(copied, dest, "r1")
    files = spark.read.schema("run_id string, path string, ok boolean, error string").json(f"{dest}/files")
    runs = spark.read.schema("run_id string, n_files long, n_failed long, ok boolean").json(f"{dest}/runs")
    return files.join(
        runs.select("run_id", "n_files", "n_failed", F.col("ok").alias("run_ok")), "run_id"
    )


def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = work_dir(spark, "mirror")
    copied = mirror_prefix(spark, inputs.doc_folders(spark, sf_dir), "bucket=", dest)
    with folders_listed(spark):
        lines = spark.read.option("recursiveFileLookup", "true").text(dest)
    found = lines.agg(F.count(F.lit(1)).alias("n"))
    bucket = F.regexp_extract("name", "^([0-9]*)/", 1).cast("long")
    return copied.select(
        bucket.alias("bucket"), "ok", "error", "bytes", "sha256", found.scalar().alias("n_lines")
    )


def stream_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = work_dir(spark, "stream")
    files = list_files(spark, inputs.doc_files(spark, sf_dir))
    for drop in (0, 1):
        part = files.where(F.pmod(F.xxhash64("name"), F.lit(2)) == drop)
        ops.copy_files(part, f"{run}/in").write.parquet(f"{run}/copied-{drop}")
        (
            stream_new_content(spark, f"{run}/in", max_files=100)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{run}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{run}/out")
            .awaitTermination()
        )
    return spark.read.parquet(f"{run}/out").select("sha256", "length")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    words = tokens(F.col("text"))
    numbers = F.filter(F.transform(words, lambda w: to_number(w, "int")), lambda n: n.isNotNull())
    return docs.select(
        "doc_id",
        F.md5(trim_ws(F.concat(F.lit(" \t"), "text", F.lit(" \n　"))).cast("binary")).alias("trimmed"),
        F.length(strip_semicolons(F.col("text"))).cast("long").alias("n_left"),
        F.size(words).cast("long").alias("n_words"),
        F.size(numbers).cast("long").alias("n_numbers"),
    )


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the functions as SQL names them."""
    register_functions(spark)
    return spark.sql(
        r"""SELECT doc_id, md5(ot_mask_literals(text)) AS masked, md5(ot_trim_ws(concat(char(9), text, '　'))) AS trimmed,
          length(ot_strip_semicolons(text)) AS n_left, cast(size(ot_text_tokens(text)) AS bigint) AS n_words,
          ot_to_int(ot_base_name(concat('x/', doc_id))) AS named, ot_to_float(concat(doc_id, '.5e0')) AS half,
          ot_content_hash(text) AS sha256, md5(ot_sql_text(text)) AS literal, ot_sql_float(doc_id / 7D) AS seventh,
          ot_base_name(concat('/', source, '/b.', doc_id)) AS base, ot_dir_name(concat('/', source, '/b.', doc_id)) AS dir,
          ot_log_number(concat('/', source, '/b.', doc_id)) AS number, ot_sql_bool(lang = 'en') AS english
        FROM {docs}""",
        docs=inputs.table(spark, sf_dir, "documents"),
    ).withColumn("n_left", F.col("n_left").cast("bigint"))


QUERIES = {
    "fingerprint": fingerprint,
    "file_fingerprint": file_fingerprint,
    "range_copies": range_copies,
    "sync_pending": sync_pending,
    "sync_done": sync_done,
    "known_hashes": known_hashes,
    "sync_run": sync_runs,
    "sync_recursive": sync_recursive,
    "run_log_rows": run_log_rows,
    "mirror_prefix": mirror,
    "stream_content_dedup": stream_contents,
    "text_functions": text_functions,
    "sql_functions": sql_functions,
}

BUCKETS = f"""buckets AS (
  SELECT doc_id // {inputs.DOCS_PER_FILE} AS bucket,
    string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body, count(*) AS n_docs
  FROM documents GROUP BY 1)"""
SPACE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORDS = f"list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')"

ORACLE = {
    "fingerprint": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "file_fingerprint": f"""WITH {BUCKETS}
      SELECT bucket, is_copy, strlen(body) AS length, sha256(body) AS sha256
      FROM buckets, (VALUES (true), (false)) c(is_copy)""",
    "range_copies": f"""WITH RECURSIVE {BUCKETS},
      leaves AS (SELECT bucket, strlen(body) AS bytes, list_transform(range(0, greatest((strlen(body) + {LEAF - 1}) // {LEAF}, 1)),
        lambda i: sha256(unhex(substr(hex(encode(body)), 2 * {LEAF} * i + 1, 2 * {LEAF})))) AS nodes FROM buckets),
      tree AS (SELECT bucket, bytes, nodes FROM leaves
        UNION ALL SELECT bucket, bytes, list_transform(range(0, (len(nodes) + 1) // 2),
          lambda i: CASE WHEN 2 * i + 1 < len(nodes) THEN sha256(nodes[2 * i + 1] || nodes[2 * i + 2]) ELSE nodes[2 * i + 1] END)
        FROM tree WHERE len(nodes) > 1)
      SELECT bucket, is_copy, true AS ok, bytes, nodes[1] AS tree, nodes[1] AS tree_again,
        greatest((bytes + {4 * SPAN - 1}) // {4 * SPAN}, 1) AS n_long_ranges
      FROM tree, (VALUES (true), (false)) c(is_copy) WHERE len(nodes) = 1""",
    "sync_pending": """SELECT doc_id, sha256(text) AS sha256 FROM documents
      WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""",
    "sync_done": """SELECT doc_id, sha256(text) AS sha256 FROM documents
      WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""",
    "known_hashes": "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0",
    "sync_run": f"""WITH {BUCKETS},
      once AS (SELECT count(*) AS n, CAST(sum(strlen(body)) AS BIGINT) AS b
        FROM (SELECT DISTINCT body FROM buckets))
      SELECT run, CASE WHEN run = 2 THEN 0 ELSE n END AS n_files,
        CASE WHEN run = 2 THEN 0 ELSE b END AS n_bytes,
        CASE WHEN run = 2 THEN 0 ELSE n END AS n_named,
        CASE WHEN run = 2 THEN 0 ELSE n END AS n_logged, true AS ok, n AS n_known
      FROM once, (VALUES (1), (2), (3)) r(run)""",
    "sync_recursive": f"""WITH {BUCKETS}
      SELECT min(bucket) AS bucket, strlen(body) AS length, sha256(body) AS sha256, 0 AS n_again
      FROM buckets GROUP BY body""",
    "run_log_rows": """SELECT 'r1' AS run_id, '/docs/' || doc_id AS path, doc_id % 100 <> 7 AS ok,
        CASE WHEN doc_id % 100 = 7 THEN 'lost ' || source ELSE '' END AS error,
        count(*) OVER () AS n_files, count(*) FILTER (doc_id % 100 = 7) OVER () AS n_failed,
        count(*) FILTER (doc_id % 100 = 7) OVER () = 0 AS run_ok FROM documents""",
    "mirror_prefix": f"""WITH {BUCKETS},
      total AS (SELECT CAST(sum(strlen(body) - strlen(replace(body, chr(10), ''))) AS BIGINT) AS n FROM buckets)
      SELECT bucket, true AS ok, '' AS error, strlen(body) AS bytes, sha256(body) AS sha256, n AS n_lines
      FROM buckets, total""",
    "stream_content_dedup": f"""WITH {BUCKETS}
      SELECT DISTINCT sha256(body) AS sha256, strlen(body) AS length FROM buckets""",
    "sql_functions": f"""SELECT doc_id, md5({masked_sql('text')}) AS masked,
        md5(regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '')) AS trimmed,
        length(replace(text, ';', '')) AS n_left, len({WORDS}) AS n_words,
        doc_id AS named, doc_id + 0.5::DOUBLE AS half,
        sha256(text) AS sha256, md5({text_sql('text')}) AS literal, printf('%f', doc_id / 7.0::DOUBLE) AS seventh,
        'b.' || doc_id AS base, '/' || source AS dir, doc_id AS number, CASE WHEN lang = 'en' THEN 'true' ELSE 'false' END AS english
      FROM documents""",
    "text_functions": f"""SELECT doc_id,
        md5(regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '')) AS trimmed,
        length(replace(text, ';', '')) AS n_left, len({WORDS}) AS n_words,
        len(list_filter({WORDS}, lambda w: regexp_full_match(w, '[+-]?[0-9]+')
          AND TRY_CAST(w AS BIGINT) IS NOT NULL)) AS n_numbers
      FROM documents""",
}
