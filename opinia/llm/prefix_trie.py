"""The prefix trie of conversations, found by peeling the last turn off again and again.

A node is a distinct sequence of first turns.  Peeling descends from the greatest depth: at
depth d the conversations that end there join what survives of deeper ones, whose last turn
has just been stripped; equal sequences are grouped, and a group is a node, whose counts are
sums over what was merged into it.  So every node is found once, with everything about its
subtree known by then.

Sequences are compared by 128-bit keys, one per prefix: two XORs of 64-bit hashes of the
SHA-256 of each turn and its place, which are running values of one window.  No text is
shuffled, only its digest and length.

Equal conversations are one row from the start, so copies cost nothing.  Where a prefix is
shared by few distinct conversations (`GROUP_ROWS`), all that lies below it is peeled inside
one task, many prefixes at a time, by column operations; the depth at which that holds is
found by counting prefixes.  From there to the root every depth is one grouping across the
cluster with partial sums, so a first turn that a third of all conversations share sends a
row per task.  Each such depth is written, so a lost executor costs its current tasks.

The ids of the conversations that end in a node are hashed in order without being gathered:
they are sorted by range, which splits a crowd of copies, joined to pieces of bounded length
in their tasks, and the pieces of a node stream through its digest.

Defined results: rows without a conv_id belong to no conversation; turns are ordered by turn,
NULL first, ties by the SHA-256 of role and text; NULL role or text is empty; repeated rows
are turns of their own; a conversation without turns ends in the root; no conversations give
no nodes.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinia.llm.common import crc32_sql, cut, table

#: Distinct conversations below a prefix that one task peels.
GROUP_ROWS = 1024
#: Steps that are peeled together in a task, about.
CHUNK_STEPS = 1 << 17
#: Ids of a piece of a list.
PIECE_IDS = 4096
#: Conversations of a family, and the most turns that its first one gives to the others, plus one.
FAMILY, GIVEN = 5, 9
KEY = ["x1", "x2"]
STEP = "array<struct<x1: bigint, x2: bigint, bytes: bigint>>"
NODE = ("depth long, x1 long, x2 long, p1 long, p2 long, conv_id long, n_convs long, n_children long, "
        f"n_leaves long, saved_tokens long, path {STEP}")
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and bytes of every turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(place).cast("long").alias("pos"), "digest", "bytes")


def given_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string")) % GIVEN


def rebuilt(rows: DataFrame) -> DataFrame:
    """The turns of every conversation after those from the first of its family took the place of its own.

    Columns: conv_id, order (a struct), digest and bytes; digest is NULL in rows that only say that the
    conversation is there.
    """
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    stays = (F.col("pos") > given_turns(F.col("conv_id"))) | (F.col("conv_id") == first)
    own = rows.select("conv_id", F.struct(F.lit(1).alias("own"), "pos").alias("order"),
                      F.when(stays, F.col("digest")).alias("digest"), "bytes")
    others = F.explode(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)))
    given = rows.filter((F.col("conv_id") == first) & (F.col("pos") < GIVEN)).withColumn("k", others).withColumn(
        "to", F.try_add("conv_id", "k")).filter("k != 0").filter(
        (F.col("to") - F.col("to") % FAMILY == F.col("conv_id")) & (given_turns(F.col("to")) >= F.col("pos")))
    return own.unionByName(given.select(
        F.col("to").alias("conv_id"), F.struct(F.lit(0).alias("own"), "pos").alias("order"), "digest", "bytes"))


def whole(rows: DataFrame) -> DataFrame:
    """Turns of conversations as they are, in the form of `rebuilt`."""
    return rows.select("conv_id", F.struct(F.lit(1).alias("own"), "pos").alias("order"), "digest", "bytes")


def paths(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, length, key (x1, x2) and path (keys and bytes of its prefixes)."""
    so_far = Window.partitionBy("conv_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    there = F.col("digest").isNotNull()
    numbered = rows.withColumn("depth", F.count_if(there).over(so_far))

    def key(seed: int) -> Column:
        return F.bit_xor(F.when(there, F.xxhash64(F.lit(seed), "depth", "digest"))).over(so_far)

    keyed = numbered.withColumns({"x1": key(1), "x2": key(2)})
    steps = F.array_sort(F.collect_list(F.when(there, F.struct("depth", "x1", "x2", "bytes"))))
    held = keyed.groupBy("conv_id").agg(F.max("order.own").alias("own"), steps.alias("steps")).filter("own = 1")
    last = F.element_at("steps", -1)
    return held.select(
        "conv_id", F.size("steps").cast("long").alias("length"),
        *[F.when(F.size("steps") > 0, last[k]).otherwise(F.lit(0).cast("long")).alias(k) for k in KEY],
        F.transform("steps", lambda s: F.struct(s["x1"].alias("x1"), s["x2"].alias("x2"), s["bytes"].alias("bytes")))
        .cast(STEP).alias("path"))


def shared_depth(distinct: DataFrame, most: int) -> int:
    """The least depth at which no prefix is shared by more than so many distinct conversations."""
    steps = distinct.select(F.posexplode("path").alias("at", "step"))
    crowded = steps.groupBy("at", "step.x1", "step.x2").count().filter(F.col("count") > most)
    deepest = crowded.agg(F.max("at")).first()[0]
    if deepest is not None:
        return deepest + 2
    return int(distinct.count() > most)


def _key_at(depth: int, path: str = "path") -> list[Column]:
    """The key of the prefix of that depth (0: the root)."""
    return [F.get(F.col(path), F.lit(depth - 1))[k] if depth else F.lit(0).cast("long") for k in KEY]


class Peeled:
    """Conversations of whole groups, peeled down to a depth by column operations."""

    def __init__(self, rows: pa.Table, down_to: int) -> None:
        path = rows.column("path").combine_chunks()
        path = pa.concat_arrays(path.chunks) if isinstance(path, pa.ChunkedArray) else path
        self.length = np.diff(path.offsets.to_numpy())
        self.start = path.offsets.to_numpy()[:-1] - path.offsets[0].as_py()
        flat = path.flatten()
        self.x1, self.x2, self.bytes = (flat.field(i).to_numpy() for i in range(3))
        self.conv = rows.column("conv_id").to_numpy()
        self.ended = rows.column("ended").to_numpy()
        self.down_to = down_to

    def _at(self, values: np.ndarray, row: np.ndarray, depth: int) -> np.ndarray:
        return values[self.start[row] + depth - 1] if depth else np.zeros(len(row), np.int64)

    def nodes(self) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
        """(depth, representative rows, columns) of every depth, the greatest first."""
        by_length = np.argsort(self.length, kind="stable")
        edges = np.searchsorted(self.length[by_length], np.arange(self.down_to, self.length.max() + 2))
        row = np.zeros(0, np.int64)
        sums = np.zeros((4, 0), np.int64)  # members, children, leaves, saved
        for depth in range(int(self.length.max()), self.down_to - 1, -1):
            new = by_length[edges[depth - self.down_to]:edges[depth - self.down_to + 1]]
            stripped = np.stack([sums[0], np.ones(len(row), np.int64), sums[2], sums[3]])
            ending = np.zeros((4, len(new)), np.int64)
            ending[0] = self.ended[new]
            row, sums = np.concatenate([row, new]), np.concatenate([stripped, ending], axis=1)
            x1, x2 = (self._at(x, row, depth) for x in (self.x1, self.x2))
            order = np.lexsort((self.conv[row], x2, x1))
            row, sums, x1, x2 = row[order], sums[:, order], x1[order], x2[order]
            first = np.flatnonzero(np.concatenate([[True], (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])]))
            sums = np.add.reduceat(sums, first, axis=1)
            row, x1, x2 = row[first], x1[first], x2[first]  # the smallest conv_id of each group
            sums[2] = np.where(sums[1] == 0, 1, sums[2])
            sums[3] += (sums[0] - 1) * self._at(self.bytes, row, depth)
            yield depth, row, {
                "x1": x1, "x2": x2, "p1": self._at(self.x1, row, max(0, depth - 1)),
                "p2": self._at(self.x2, row, max(0, depth - 1)), "conv_id": self.conv[row], "n_convs": sums[0],
                "n_children": sums[1], "n_leaves": sums[2], "saved_tokens": sums[3]}


def _groups(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[pa.Table]:
    """Tables of whole groups (g1, g2) with about so many steps."""
    held, count = [], 0

    def last_start(rows: pa.Table) -> int:
        keys = np.stack([rows.column(c).to_numpy() for c in ("g1", "g2")])
        return int(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))[-1])

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            count += part.num_rows + len(part.column("path").flatten())
            if count >= steps:
                rows = pa.Table.from_batches(held)
                start = last_start(rows)
                if start:
                    yield rows.slice(0, start)
                rest = rows.slice(start)
                held, count = rest.to_batches(), 0 if start else count
    if held:
        yield pa.Table.from_batches(held)


def _peel(down_to: int):
    step = pa.list_(pa.struct([("x1", pa.int64()), ("x2", pa.int64()), ("bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, CHUNK_STEPS):
            for depth, at, columns in Peeled(rows, down_to).nodes():
                path = pa.nulls(len(at), step)
                if depth == down_to:  # these go on across the cluster
                    path = rows.column("path").take(pa.array(at)).combine_chunks()
                    path = path.cast(step) if not isinstance(path, pa.ChunkedArray) else pa.concat_arrays(path.chunks)
                arrays = [pa.array(np.full(len(at), depth, np.int64)), *map(pa.array, columns.values()), path]
                yield pa.RecordBatch.from_arrays(arrays, ["depth", *columns, "path"])

    return run


def peeled(distinct: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """All nodes (`NODE`) of distinct conversations: conv_id, ended (how many are equal), length, path."""
    depth = shared_depth(distinct, most)
    low = distinct.filter(F.col("length") >= depth)
    groups = low.select("conv_id", "ended", "path", *[k.alias(g) for k, g in zip(_key_at(depth), ("g1", "g2"), strict=True)])
    groups = groups.repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    found = cut(groups.mapInArrow(_peel(depth), NODE), "peeled")
    nodes, alive = found, found.filter(F.col("depth") == depth)
    for at in range(depth - 1, -1, -1):
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        key = [k.alias(n) for k, n in zip(_key_at(at), KEY, strict=True)]
        stripped = alive.select(*key, "conv_id", "n_convs", one.alias("n_children"), "n_leaves", "saved_tokens",
                                F.slice("path", 1, at).alias("path"))
        ending = distinct.filter(F.col("length") == at).select(
            *key, "conv_id", F.col("ended").alias("n_convs"), *[none.alias(n) for n in (
                "n_children", "n_leaves", "saved_tokens")], "path")
        merged = stripped.unionByName(ending).groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), *[F.sum(n).alias(n) for n in (
                "n_convs", "n_children", "n_leaves", "saved_tokens")], F.any_value("path").alias("path"))
        size = F.get("path", F.lit(at - 1))["bytes"] if at else none
        alive = cut(merged.select(
            F.lit(at).cast("long").alias("depth"), *KEY,
            *[k.alias(n) for k, n in zip(_key_at(max(0, at - 1)), ("p1", "p2"), strict=True)], "conv_id", "n_convs",
            "n_children", F.when(F.col("n_children") == 0, one).otherwise(F.col("n_leaves")).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), "path"), f"peeled-{at}")
        nodes = nodes.unionByName(alive)
    return nodes.drop("path")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one key next to each other become pieces of text."""
    for batch in batches:
        out = []
        for key, rows in groupby(_rows([batch]), key=lambda r: r[:3]):
            ids = [r[3] for r in rows]
            out += [(*key, ids[i], ",".join(map(str, ids[i:i + PIECE_IDS]))) for i in range(0, len(ids), PIECE_IDS)]
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))),
                                             ["depth", *KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, rows in groupby(_rows(batches), key=lambda r: r[:3]):
        digest, gap = hashlib.sha256(), ""
        for row in rows:
            digest.update((gap + row[4]).encode())
            gap = ","
        out.append((*key, digest.hexdigest()))
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), ["depth", *KEY, "ends_sha256"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), ["depth", *KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending ids of the conversations that end in a node."""
    key = ["depth", *KEY]
    laid = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    pieces = laid.mapInArrow(_pieces, "depth long, x1 long, x2 long, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(
        _hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """All nodes of conversations given as turns (`whole` or `rebuilt`)."""
    convs = cut(paths(rows), "paths")
    distinct = cut(convs.groupBy("length", *KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("ended"), F.any_value("path").alias("path")), "distinct")
    nodes = cut(peeled(distinct, most), "nodes")
    ends = end_digests(convs.select(F.col("length").alias("depth"), *KEY, "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, ["depth", "p1", "p2"], "left").join(ends, ["depth", *KEY], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each rebuilt on the first one of its family."""
    return prefix_trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {crc32_sql("c::VARCHAR")} % {GIVEN} AS h, c - c % {FAMILY} AS b
        FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (SELECT c, 0 AS own, pos, role, text FROM ids JOIN t ON t.conv_id = b WHERE b <> c AND pos <= h
      UNION ALL SELECT c, 1, pos, role, text FROM ids JOIN t ON t.conv_id = c WHERE b = c OR pos > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, octet_length(encode(text)) AS bytes,
             sha256(octet_length(encode(role)) || ':' || role || text) AS k FROM r),
p AS (SELECT c, d, bytes, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS key FROM o
      UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY key, d),
up AS (SELECT substr(key, 1, (d - 1) * 64) AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
leaf AS (SELECT p.key, p.d, count(*) AS n_leaves FROM n ANTI JOIN up USING (key, d)
         JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.key, p.d),
saved AS (SELECT p.key, p.d, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
          FROM n JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.key, p.d),
ended AS (SELECT key, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
          FROM (SELECT c, arg_max(key, d) AS key, max(d) AS d FROM p GROUP BY c) GROUP BY key, d)
SELECT n.conv_id, n.d AS depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN leaf USING (key, d) JOIN saved USING (key, d) LEFT JOIN up USING (key, d) LEFT JOIN ended USING (key, d)
LEFT JOIN n AS above ON above.d = n.d - 1 AND above.key = substr(n.key, 1, (n.d - 1) * 64)
"""
