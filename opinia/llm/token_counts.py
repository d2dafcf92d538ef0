"""Token counts: each distinct pre-token is encoded once, documents only add up.

Documents are cut into pre-tokens in blocks of bounded size.  A block keeps, per
document, how often each of its distinct pre-tokens occurs, as packed positions in
the block's own list of pre-tokens.  The lists of all blocks are brought together by
pre-token: where its rows meet, in order, the pieces are counted once and joined to
each block that has it.  Back in the blocks they are summed per document.  Ids are
never made.  One small row per block and distinct pre-token is shuffled, not one per
document or occurrence; a pre-token that every block has comes to one row a block,
that is per 32 MB of text.

Special strings inside a text are split off first, as the library does, and count
as one pre-token with one piece.

Defined results: NULL and empty texts have no bytes and no tokens; any length is
counted whole; rows of equal (or NULL) doc_id are all returned.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinia.llm.common import bounded_batches, cut, in_small_batches, numbers, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Text that a block holds about; a document beyond it is a block of its own.
BLOCK_BYTES = 32 << 20
BLOCK = ("block long, doc_ids array<long>, n_bytes array<long>, sizes array<int>, "
         "words binary, times binary, pieces array<string>")


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> tuple[Tokenizer, frozenset[str], re.Pattern | None]:
    """The tokenizer with its special strings and a pattern that finds those."""
    with open(path, encoding="utf-8") as source:
        special = [t["content"] for t in json.load(source)["added_tokens"]]
    longest = sorted(special, key=len, reverse=True)
    return Tokenizer.from_file(path), frozenset(special), re.compile(
        "(" + "|".join(map(re.escape, longest)) + ")") if special else None


def pre_tokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a text in order; special strings stay whole."""
    _, special, finder = _tokenizer(path)
    parts = finder.split(text) if finder and finder.search(text) else [text]
    found: list[str] = []
    for part in parts:
        if part in special:
            found.append(part)
        else:
            found += _words().findall(part)
    return found


@lru_cache(maxsize=1)
def _words():
    return regex.compile(PATTERN)


def packed(values: np.ndarray) -> bytes:
    """Small integers: byte planes of their differences, compressed."""
    steps = np.diff(values.astype(np.int32), prepend=np.int32(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(stored: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(stored), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)


def _blocks(path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        place: dict[str, int] = {}
        ids, n_bytes, sizes, words, times, held = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            join = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number]), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([n_bytes], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([packed(join(words))]), pa.array([packed(join(times))]),
                 pa.array([list(place)], pa.list_(pa.string()))],
                ["block", "doc_ids", "n_bytes", "sizes", "words", "times", "pieces"])

        for batch in bounded_batches(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                counts = Counter(pre_tokens(text, path))
                ids.append(doc_id)
                n_bytes.append(len(text.encode()))
                sizes.append(len(counts))
                at = np.fromiter((place.setdefault(w, len(place)) for w in counts), np.int32, len(counts))
                order = np.argsort(at)  # ascending positions pack well
                words.append(at[order])
                times.append(np.fromiter(counts.values(), np.int32, len(counts))[order])
                held += n_bytes[-1]
                if held >= block_bytes:
                    yield block()
                    place, ids, n_bytes, sizes, words, times, held = {}, [], [], [], [], [], 0
                    number += 1
        if ids:
            yield block()

    return run


def _pieces(path: str):
    """Rows sorted by piece; every run of one piece is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)[0]
        last, last_count = None, 0
        for batch in batches:
            runs = batch.column("piece").dictionary_encode()
            names = runs.dictionary.to_pylist()
            known = int(bool(names) and names[0] == last)  # a run may go on from the batch before
            found = tokenizer.encode_batch_fast(names[known:], add_special_tokens=False)
            counts = np.array([last_count] * known + [len(e.ids) for e in found], np.int32)
            if names:
                last, last_count = names[-1], counts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("of"), batch.column("at"), pa.array(counts[numbers(runs.indices)])], ["of", "at", "n"])

    return run


def _sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document of one block, the pieces of its pre-tokens times their frequency."""
    of = np.zeros(counts.num_rows, np.int64)
    of[numbers(counts.column("at"))] = numbers(counts.column("n"))
    parts = []
    for row in docs.select(["doc_ids", "n_bytes", "sizes", "words", "times"]).to_batches():
        ids, n_bytes, sizes = (column.flatten() for column in row.columns[:3])
        words, times = (unpacked(column[0].as_py()) for column in row.columns[3:])
        totals = np.concatenate([[0], np.cumsum(of[words] * times)])
        ends = np.cumsum(numbers(sizes))
        parts.append(pa.table({"doc_id": ids, "n_bytes": n_bytes,
                               "n_tokens": totals[ends] - totals[ends - numbers(sizes)]}))
    return pa.concat_tables(parts)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id",
                 text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    rows = in_small_batches(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    blocks = cut(rows.mapInArrow(_blocks(path, block_bytes), BLOCK), "token-blocks")
    pieces = blocks.select(F.col("block").alias("of"), F.posexplode("pieces").alias("at", "piece"))
    found = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(
        _pieces(path), "of long, at int, n int")
    summed = blocks.drop("pieces").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(
        _sums, "doc_id long, n_bytes long, n_tokens long")
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the byte-level tokenizer of 50,257 ids."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
