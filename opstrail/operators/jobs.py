"""Outcome tables of export jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opstrail.functions.times import elapsed_text


def result_text(results: DataFrame, markup: bool = False) -> DataFrame:
    """Adds ``text``, one line per job result; ``markup`` is the chat form."""
    took = elapsed_text(F.col("elapsed_ms"))
    # The four texts.
    if markup:
        good = F.format_string(":white_check_mark: `%s` succeeded, it took *%s*", "job_name", took)
        bad = F.format_string(":x: `%s` failed, it took *%s* ```%s```", "job_name", took, "error")
    else:
        good = F.format_string("%s succeeded, it took %s", "job_name", took)
        bad = F.format_string("%s failed, it took %s with error: %s", "job_name", took, "error")
    return results.withColumn("text", F.when(F.col("ok"), good).otherwise(bad))


def batch_outcome(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row ``(ok, error)`` per batch: errors of the failed jobs by job name.

    A batch is the list of jobs one driver call was given; ``by`` are the columns
    that tell batches apart where ``results`` holds several.
    """
    failed = F.when(~F.col("ok"), F.struct("job_name", "error"))
    return results.groupBy(*by).agg(
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(failed)), lambda e: e["error"]), "\n"
        ).alias("error"),
    )
