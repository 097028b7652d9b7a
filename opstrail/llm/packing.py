"""Harmonic packing of token ids into sequences of fixed capacity.

A document's ids, with an end id, are cut: whole sequences first, then the rest is cut
at the largest reciprocal size floor(capacity / k) that fits, and so on. A rest that
nearly fills its class stays whole (``SLACK``), and rests below the smallest size form
a class for each length. Class k's bins hold k pieces each, so the n-th piece of a
class lies in bin n div k: numbering needs the counts of (worker, class) alone, and
every class fills its bins independently of the others and of the order of workers.

Each class leaves at most one bin unfilled. These few, at most one per class, are put
together first-fit decreasing; they are the only pieces that meet in one task, fewer
than capacity x number of classes tokens however large the input.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opstrail.llm.common import stored, table, whole

CAPACITY = 2048
END_ID = 1
#: Reciprocal sizes go down to capacity / CLASSES.
CLASSES = 64
#: A bin may lose one part in SLACK to leave pieces whole.
SLACK = 64
TOKENIZER = "byte_bpe_50k.json"


def cut_rest(rest: int, capacity: int) -> list[tuple[int, int]]:
    """(length, class size) of the pieces of a rest below the capacity. A class is named by its size."""
    sizes = [capacity // k for k in range(1, CLASSES + 1)]
    out = []
    while rest:
        above = min((s for s in sizes if s >= rest), default=capacity)
        below = max((s for s in sizes if s <= rest), default=0)
        if above == rest or (above - rest) * (capacity // above) <= capacity // SLACK:
            out.append((rest, above))
            break
        if not below:  # shorter than every reciprocal size
            out.append((rest, rest))
            break
        out.append((below, below))
        rest -= below
    return out


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Token ids of texts; the vocabulary file is read once per worker.

    The file's own library, as it comes, sets what is right: the string of an added token is
    that token. Where the file's merges are plain byte pairs, texts without such a string get
    the same ids several times faster from the same vocabulary read as ranks; a text on which
    that reader's pattern engine runs out of stack goes to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = None
        ranks, self.added = self._ranks(path)
        if ranks:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(path: str) -> tuple[dict[bytes, int] | None, list[str]]:
        """Bytes to id for a byte-level vocabulary without normalizer, else None; strings of added tokens."""
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None, []
        # The format writes a byte that prints as itself, any other as the next character from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return ranks, sorted(special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(x in text for x in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as fault:  # a panic of the reader's engine on a very long run is no Exception
                if type(fault).__name__ != "PanicException":
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Ids(path)
        seen: dict[int, int] = defaultdict(int)  # pieces of each class so far in this task
        cuts: dict[int, list[tuple[int, int]]] = {}
        for part in parts:
            out = defaultdict(list)
            for id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                full, rest = divmod(len(ids), capacity)
                if rest not in cuts:
                    cuts[rest] = cut_rest(rest, capacity)
                at = 0
                for length, size in [(capacity, capacity)] * full + cuts[rest]:
                    body = ids[at : at + length].tobytes()
                    for name, value in zip(
                        ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "nth", "ids"),
                        (id_, at, length, zlib.crc32(body), len(ids), size, seen[size], body if keep_ids else None),
                        strict=True,
                    ):
                        out[name].append(value)
                    seen[size] += 1
                    at += length
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in out.items()], list(out)
                )

    return run


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens, size (its class),
    nth (its number in this worker's class), ids (little-endian, if wanted) and part (the worker)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "nth"]
    schema = ", ".join(f"{n} bigint" for n in names) + ", ids binary"
    rows = docs.select(F.col("doc_id").cast("bigint"), whole(F.col("text")))
    return rows.mapInArrow(_pieces(path, capacity, end_id, keep_ids), schema).withColumn("part", F.spark_partition_id())


def _fit(bins: pa.Table, capacity: int) -> pa.Table:
    """First-fit decreasing of unfilled bins, at most one per class: sequence and offset of each."""
    rows = sorted(bins.to_pylist(), key=lambda r: (-r["tokens"], r["size"]))
    free: list[int] = []
    out = []
    for r in rows:
        for i, room in enumerate(free):
            if room >= r["tokens"]:
                break
        else:
            i, room = len(free), capacity
            free.append(capacity)
        out.append((r["size"], i, capacity - room))
        free[i] = room - r["tokens"]
    return pa.table({n: pa.array([x[k] for x in out], pa.int64()) for k, n in enumerate(("size", "joint", "base"))})


def pack(
    spark: SparkSession,
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of all rows of ``docs`` with their sequence_id and offset in it.

    A null text counts as empty and is one piece, the end id. Rows that repeat are packed
    each. Other columns are not carried. An empty table gives no pieces.
    """
    pieces = stored(spark, cut(docs, path or tokenizer_path(), capacity, end_id, keep_ids), "pieces")
    counts = pieces.groupBy("part", "size").agg(F.max("nth").alias("last"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part",
        "size",
        F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("skipped"),
        F.sum(F.col("last") + 1).over(Window.partitionBy("size")).alias("all"),
    )
    held = F.floor(F.lit(capacity) / F.col("size")).cast("bigint")
    place = pieces.join(offsets, ["part", "size"]).withColumn("nth", F.col("nth") + F.col("skipped"))
    place = place.withColumn("bin", F.expr(f"nth div (({capacity}) div size)")).withColumn(
        "open", F.col("bin") >= F.expr(f"`all` div (({capacity}) div size)")
    )
    in_bin = Window.partitionBy("size", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    place = place.withColumn("inside", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    # What is left open: the last bin of each class, a row each.
    left = (
        pieces.join(offsets, ["part", "size"])
        .filter((F.col("nth") + F.col("skipped")) >= F.col("all") - F.pmod(F.col("all"), held))
        .groupBy("size")
        .agg(F.sum("length").alias("tokens"))
    )
    fitted = left.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda t: _fit(t, capacity), "size bigint, joint bigint, base bigint"
    )
    # At most one row per class of cut_rest(): CLASSES reciprocal sizes and those below the smallest.
    joined = place.join(F.broadcast(fitted), "size", "left")
    span = 1 << 44
    return joined.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.when(F.col("open"), F.col("joint")).otherwise(F.col("size") * span + F.col("bin")).alias("sequence_id"),
        F.when(F.col("open"), F.col("base") + F.col("inside")).otherwise(F.col("inside")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all rows of ``documents``."""
    return pack(spark, table(spark, sf_dir, "documents"))
