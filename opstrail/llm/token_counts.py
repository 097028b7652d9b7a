"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with a leading marker. Its best segmentation into pieces of the
vocabulary maximises the sum of their log probabilities; the forward score of a prefix
is the best over the pieces that end there, so it depends on the prefix alone. New
distinct pre-tokens of a batch are put into a trie and scored depth first: the score of a
prefix is computed once for all pre-tokens that share it, and only the path that leads to
the current node is held. What is stored of a terminal node is its token count.

Counts of a task's pre-tokens are kept up to ``REMEMBERED`` of them and computed anew
beyond, so memory is bounded and no word needs a shuffle, however frequent.

Log probabilities follow the vocabulary's order of frequency by Zipf's law; the vocabulary
file is a parameter and no tokenizer is trained. A character outside of the vocabulary
costs one token per UTF-8 byte. Of equal scores the one with fewer tokens counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import table, whole

MARKER = "▁"
VOCABULARY = "piece_bpe_32k.model"
REMEMBERED = 1_000_000
#: Zipf's law: the log probability of rank r is -ln(r + OFFSET), and that of a byte as of this rank.
OFFSET, BYTE_RANK = 2.7, 1e6


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_pieces(path: str) -> dict[str, float]:
    """Log probability of every piece of a vocabulary file, control and byte pieces aside."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {p: -math.log(r + OFFSET) for r, p in enumerate(plain)}


class TrieCounter:
    """Token counts of pre-tokens; scores are shared along common prefixes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = -math.log(BYTE_RANK)

    def counts(self, tokens: set[str]) -> dict[str, int]:
        """Token count of each pre-token. Sorted order walks the trie depth first."""
        pieces, longest = self.pieces, self.longest
        out: dict[str, int] = {}
        path: list[tuple[float, int]] = [(0.0, 0)]  # (score, -tokens) of each prefix of the current one
        before = ""
        for token in sorted(tokens):
            shared = len(commonprefix((before, token)))
            del path[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                n = len(token[end - 1].encode())
                score, count = path[end - 1]
                best = (score + n * self.byte, count - n)
                for start in range(max(0, end - longest), end):
                    p = pieces.get(token[start:end])
                    if p is not None:
                        score, count = path[start]
                        found = (score + p, count - 1)
                        if found > best:
                            best = found
                path.append(best)
            out[token] = -path[-1][1]
            before = token
        return out


def _counted(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieCounter(load_pieces(path))
        known: dict[bytes, int] = {}
        for part in parts:
            texts = [t.split() for t in part.column(1).cast(pa.binary()).to_pylist()]
            fresh = {w for words in texts for w in set(words) if w not in known}
            if len(known) + len(fresh) > REMEMBERED:
                known = {}
                fresh = {w for words in texts for w in words}
            terminal = trie.counts({MARKER + w.decode() for w in fresh})
            known |= {t[1:].encode(): n for t, n in terminal.items()}
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([sum([known[w] for w in words]) for words in texts], pa.int64()),
                ],
                ["doc_id", "n_words", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every row; a null or empty text has none.

    Words are runs of anything but the six ASCII white-space characters. Repeated rows
    count each, null ids too, and other columns do not matter."""
    rows = docs.select(F.col("doc_id").cast("bigint"), whole(F.col("text")))
    return rows.mapInArrow(_counted(path or vocabulary_path()), "doc_id bigint, n_words bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"))
