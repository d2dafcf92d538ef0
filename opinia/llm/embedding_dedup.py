"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Within a group of vectors every projection is sorted; the window of a query is the
range of ranks whose projection lies within `HALF_WINDOW` of its own.  A pair collides
in as many projections as the one lies in the windows of the other.  Pairs with at
least `least_collisions` collisions are verified by their cosine in double precision.
That number is calibrated: a pair at the limit has a known chance to collide, and the
count keeps `RECALL` of such pairs.

Counting over all pairs would grow with the square of the table, so vectors are
grouped first by the signs of some other projections, in several independent tables.
A group has about `GROUP` vectors, whatever the size of the table: the number of signs
grows with the logarithm of the number of vectors, and the number of tables follows
from the recall that a pair at the limit is to have.  Recall below 1 is part of the
method; pairs with a cosine below the limit are never linked.

Equal vectors are one node with a number of copies.  Large groups are cut into chunk
pairs (`buckets`), so a crowd of near copies is spread over tasks.  A pair is counted
in the first table whose group it shares, so links need no distinct; only link counts
per vector and a spanning forest of the links leave a task.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite
components link with nothing; vectors of different lengths do not link; vectors that
share a vec_id are vectors of their own; a NULL vec_id never names a component that
has another id.  Labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm.buckets import sorted_cells, whole_cells
from opinia.llm.common import cut, numbers, table
from opinia.llm.components import components, forest

COSINE = 0.9
#: Vectors of a group about, and rows beyond which one is cut into chunks.
GROUP, GROUP_ROWS = 1024, 2048
#: Sorted projections, and half the width of a window.
PROJECTIONS, HALF_WINDOW = 32, 0.67
#: Recall at the cosine limit of the grouping and of the collision count, each.
RECALL = 0.998
SEED = 20
FOUND = "node long, other long, n long"


def _chance(cosine: float) -> float:
    """The chance that a pair at the cosine collides in one projection."""
    return math.erf(HALF_WINDOW / math.sqrt(2 - 2 * cosine) / math.sqrt(2))


def least_collisions(cosine: float = COSINE, recall: float = RECALL, projections: int = PROJECTIONS) -> int:
    """The largest count that a pair at the cosine reaches with the wanted chance."""
    p, tail = _chance(cosine), 0.0
    for count in range(projections, 0, -1):
        tail += math.comb(projections, count) * p**count * (1 - p)**(projections - count)
        if tail >= recall:
            return count
    return 0


def layout(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Signs per table and number of tables for so many distinct vectors."""
    signs = min(30, max(0, round(math.log2(max(1, vectors) / GROUP))))
    together = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = numbers(column.flatten(), np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # keeps the squares in range
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _same_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("vector").value_lengths().to_numpy()
    for size in np.unique(sizes):
        yield batch.filter(pa.array(sizes == size))


def _grouped(signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _same_length(whole):
                rows = _matrix(batch.column("vector"))
                size, count = rows.shape[1], len(rows)
                planes = np.random.default_rng([SEED, size]).standard_normal((size, tables * signs))
                bits = ((rows @ planes) > 0).reshape(count, tables, signs)
                keys = bits @ (1 << np.arange(signs))
                bucket = keys + (np.arange(tables) << 31) + (size << 44)
                every = np.repeat(np.arange(count), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), count)),
                     batch.column("node").take(pa.array(every)), batch.column("copies").take(pa.array(every)),
                     pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32())).take(pa.array(every)),
                     batch.column("vector").take(pa.array(every))],
                    ["bucket", "tab", "node", "copies", "keys", "vector"])

    return run


def _candidates(projected: np.ndarray, least: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, that collide at least so often, a few queries at a time."""
    count = len(projected)
    ranks, low, high = (np.empty((projected.shape[1], count), np.int32) for _ in range(3))
    for k, values in enumerate(projected.T):
        order = np.argsort(values, kind="stable")
        ranks[k, order] = np.arange(count)
        ordered = values[order]
        low[k] = np.searchsorted(ordered, values - HALF_WINDOW, "left")
        high[k] = np.searchsorted(ordered, values + HALF_WINDOW, "right")
    width = (high - low).astype(np.uint16 if count < 1 << 16 else np.uint32)
    ranks, low = ranks.astype(width.dtype), low.astype(width.dtype)
    for start in range(0, count, rows):
        queries = slice(start, min(count, start + rows))
        hits = np.zeros((queries.stop - start, count - start), np.uint8)
        for k in range(len(ranks)):  # a rank below the window wraps round to a large number
            hits += (ranks[k, None, start:] - low[k, queries, None]) < width[k, queries, None]
        i, j = np.nonzero(hits >= least)
        later = j > i
        yield i[later] + start, j[later] + start


def _linked(cosine: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_cells(batches, 1 << 12):
            stops = np.append(starts[1:], part.num_rows)
            for start, stop in zip(starts, stops, strict=True):
                if stop - start > 1:
                    yield _cell(part.slice(start, stop - start))

    def _cell(cell: pa.Table) -> pa.RecordBatch:
        nodes, copies, chunk = (numbers(cell.column(c)) for c in ("node", "copies", "chunk"))
        keys = numbers(cell.column("keys").combine_chunks().flatten()).reshape(len(nodes), -1)
        tab, across = cell.column("tab")[0].as_py(), cell.column("cell_a")[0] != cell.column("cell_b")[0]
        rows = _matrix(cell.column("vector"))
        drawn = np.random.default_rng([SEED + 1, rows.shape[1]]).standard_normal((rows.shape[1], PROJECTIONS))
        links, tree = np.zeros(len(nodes), np.int64), (nodes[:0], nodes[:0])
        for i, j in _candidates(rows @ drawn, least):
            if across:  # pairs of one chunk belong to its own cell
                i, j = i[chunk[i] != chunk[j]], j[chunk[i] != chunk[j]]
            for at in range(0, len(i), 1 << 15):
                a, b = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
                good = np.einsum("ij,ij->i", rows[a], rows[b]) >= cosine
                good &= ~(keys[a, :tab] == keys[b, :tab]).any(axis=1)  # met in an earlier table
                a, b = a[good], b[good]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                if len(a):
                    tree = forest(np.concatenate([tree[0], nodes[a]]), np.concatenate([tree[1], nodes[b]]))
        counted = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([nodes[counted], tree[0]])),
             pa.array([None] * len(counted) + tree[1].tolist(), pa.int64()),
             pa.array(np.concatenate([links[counted], np.zeros(len(tree[0]), np.int64)]))], ["node", "other", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id",
                    vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    nodes = cut(rows.filter("vector IS NOT NULL").groupBy("vector").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"),
    ).withColumn("node", F.monotonically_increasing_id()), "vectors")
    signs, tables = layout(nodes.count(), cosine)
    vector = f"vector {nodes.schema['vector'].dataType.simpleString()}"
    grouped = nodes.select("node", "copies", "vector").mapInArrow(
        _grouped(signs, tables), f"bucket long, tab int, node long, copies long, keys array<int>, {vector}")
    found = cut(sorted_cells(grouped, "node", GROUP_ROWS).mapInArrow(
        _linked(cosine, least_collisions(cosine)), FOUND), "vector-links")
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("n").alias("linked"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        "node", "vector", "least", "copies", "linked", F.coalesce("root", "node").alias("root"))
    names = known.groupBy("root").agg(F.min("least").alias("component"))
    named = known.join(names, "root").select(
        "vector", "component", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.join(named, "vector", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of the table, whatever their labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
