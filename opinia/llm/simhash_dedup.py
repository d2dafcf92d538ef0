"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where over half of the shingle hashes have it.  Every
distinct fingerprint gets a row of Hamming distances to reference fingerprints
(pivots).  For two fingerprints x, y and any pivot p, |d(x,p) - d(y,p)| <= d(x,y),
so a pair with a coordinate difference above the allowed distance is discarded
unseen; survivors are verified by the distance itself.

Which pairs are looked at also comes from the table.  The pivots are a base, its
64 one-bit neighbours and some random fingerprints.  The coordinates of the
neighbours of one block of bits say, relative to that of the base, how a
fingerprint stands to the base within the block.  With two blocks more than the
allowed distance, every linked pair has the same coordinates in at least two of
them, so fingerprints are grouped by each choice of two blocks: 15 groupings for
distance 4, on 21 bits each, and no link can be missed.

Equal fingerprints are one node, so copies cost nothing.  Within a group the links
found are those of a spanning forest, found breadth first: each fingerprint is
compared only with those that are not connected yet, so a dense crowd of near
copies takes about one pass, and no pairs are written out.  Large groups are cut
into chunk pairs (`buckets`).

Defined results: NULL texts and texts without words have fingerprint zero, which
links like any other; a text of fewer words than a shingle is one shingle; a
component whose rows all lack a doc_id has component_id NULL; rows that share a
doc_id are all returned.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm.buckets import sorted_cells, whole_cells
from opinia.llm.common import bounded_batches, cut, in_small_batches, numbers, table
from opinia.llm.components import LINK, components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Random pivots beside the base and its neighbours.
PIVOTS = 16
#: Rows of a group beyond which it is cut into chunks.
GROUP_ROWS = 4096
#: Groups up to this size are compared pair by pair, all at once.
SMALL = 24


def fingerprint(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[i:j], seed) for i, j in zip(starts, ends[words - 1:].tolist(), strict=True)])
    counts = np.zeros(64, np.int64)
    table_ = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(table_), 1 << 16):
        counts += np.unpackbits(table_[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(table_)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded_batches(batches, "text"):
        prints = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and print (the fingerprint as a signed long) of every row."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return in_small_batches(texts).mapInArrow(_fingerprints, "doc_id long, print long")


def pivots(count: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """The base, its 64 one-bit neighbours (from the highest bit) and random pivots."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, count + 1, np.uint64)
    bits = np.uint64(1) << np.arange(63, -1, -1).astype(np.uint64)
    return np.concatenate([drawn[:1], drawn[0] ^ bits, drawn[1:]])


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for every fingerprint."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def group_keys(rows: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For every fingerprint a key per choice of two blocks, from its pivot row."""
    nearer = (rows[:, 1:65] < rows[:, :1]).astype(np.uint64)
    blocks = [nearer[:, part] @ (np.uint64(1) << np.arange(len(part)).astype(np.uint64))
              for part in np.array_split(np.arange(64), distance + 2)]
    return np.stack([(np.uint64(k) << np.uint64(48)) | (blocks[i] << np.uint64(24)) | blocks[j]
                     for k, (i, j) in enumerate(combinations(range(distance + 2), 2))], axis=1).astype(np.int64)


def _grouped(distance: int):
    references = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = numbers(batch.column("print"))
            keys = group_keys(distances(prints.view(np.uint64), references), distance)
            yield pa.RecordBatch.from_pydict({
                "bucket": keys.ravel(), "print": np.repeat(prints, keys.shape[1])})

    return run


def spanning_links(prints: np.ndarray, rows: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints at the distance or nearer."""
    left, ends = np.arange(len(prints)), []
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            near = (np.abs(rows[left] - rows[at]) <= distance).all(axis=1)
            near[near] = np.bitwise_count(prints[left[near]] ^ prints[at]) <= distance
            found = left[near]
            ends.append((np.full(len(found), at), found))
            waiting.extend(found.tolist())
            left = left[~near]
    a, b = (np.concatenate([e[i] for e in ends]) if ends else np.zeros(0, np.int64) for i in (0, 1))
    return prints[a], prints[b]


def _linked(distance: int):
    references = pivots()
    references = np.concatenate([references[:1], references[65:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_cells(batches):
            prints = numbers(part.column("print")).view(np.uint64)
            sizes = np.diff(np.append(starts, len(prints)))
            cell = np.repeat(np.arange(len(starts)), sizes)
            rows = distances(prints, references)
            small = np.repeat(sizes <= SMALL, sizes)
            found = []
            for step in range(1, min(SMALL, int(sizes.max()))):
                at = np.flatnonzero(small[:-step] & (cell[:-step] == cell[step:]))
                at = at[(np.abs(rows[at] - rows[at + step]) <= distance).all(axis=1)]
                at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= distance]
                found.append((prints[at], prints[at + step]))
            for k in np.flatnonzero(sizes > SMALL):
                own = slice(starts[k], starts[k] + sizes[k])
                found.append(spanning_links(prints[own], rows[own], distance))
            if found:
                a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return run


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at the distance or nearer."""
    grouped = prints.mapInArrow(_grouped(distance), "bucket long, print long")
    return sorted_cells(grouped, "print", GROUP_ROWS).select("bucket", "cell_a", "cell_b", "print").mapInArrow(
        _linked(distance), LINK)


def simhash_dedup(docs: DataFrame, distance: int = DISTANCE, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id (smallest doc_id)."""
    printed = cut(fingerprints(docs, id_column, text_column), "fingerprints")
    distinct = cut(printed.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("print"), distance))
    rooted = distinct.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("print", "component_id")
    return printed.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return simhash_dedup(table(spark, sf_dir, "documents"))
