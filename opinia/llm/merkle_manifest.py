"""A Merkle manifest of a dataset, with a persistent tree for tampered versions.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a source, by doc_id, are
hashed together in runs of three, level by level, to its subroot; the subroots, by source,
likewise to the root.  The tree is cut into aligned blocks of `FAN ** HEIGHT` nodes: a block
holds whole runs on all of its levels, so a task builds its part of the tree alone, and the
tops of the blocks are the nodes of the next, `FAN ** HEIGHT` times smaller, table.  That
repeats until a source has one block, and once more over the sources, of which there may be
any number.

Going down again, every block gets the siblings above its top, one row a block.  Each
tampered leaf makes a version of the persistent tree of its block: its ancestors are
copied, all untouched nodes are shared.  The copies continue above the block along the
siblings that came down, so upper versions are made where the leaf is and a hot source
sends nothing upwards but one top a block.

Places within a source come from one range sort by source, doc_id and leaf: rows are
numbered in their partition, and the rows of earlier partitions are added.  So a source with
a third of all rows, or rows that all share a doc_id, are spread like any others.  Texts are
hashed where they are read and never shuffled.

Defined results: NULL fields are `-`; rows without a source are a source of their own, which
comes first; a NULL doc_id comes first in its source and is never tampered with; rows that
share source and doc_id are ordered by their leaf, fully equal ones in any order (their
leaves are the same, their proofs follow their places); deleting line feeds from a text that
is NULL or has none changes nothing; an empty table gives no rows.  Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinia.llm.common import crc32_sql, cut, table

FAN = 3
#: Levels of a block; it has up to 729 nodes below its top.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOPS = "grp string, at long, n long, node binary, alone boolean"
PATHS = "grp string, at long, subroot binary, path array<binary>"
PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")
#: The group of all subroots.
ALL = ""


def leaf(fields: list[Column]) -> Column:
    """The leaf of a row as 32 bytes."""
    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[shown(f) for f in fields]), 256))


def tampered_with(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (the source; a missing one comes first), id, leaf, and changed: the leaf after tampering, if it differs."""
    *others, text = [F.col(name) for name in FIELDS]
    changed = leaf([*others, F.translate(text, "\n", "")])
    touched = tampered_with(F.col("doc_id")) & F.contains(text, F.lit("\n"))
    return docs.select(F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-")).alias("grp"),
                       F.col("doc_id").cast("long").alias("id"), leaf([*others, text]).alias("node"),
                       F.when(touched, changed).alias("changed"))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with `at`, their place within `grp` from 0, and `n`, the rows of the group."""
    keys = ["grp", *order]
    laid = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
               .withColumn("seq", F.monotonically_increasing_id()), name)
    part = F.shiftright("seq", 33)
    runs = laid.groupBy("grp", part.alias("part")).agg(F.min("seq").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "part", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("held").over(Window.partitionBy("grp")).alias("n"))
    return laid.withColumn("part", part).join(runs, ["grp", "part"]).select(
        *rows.columns, (F.col("seq") + F.col("shift")).alias("at"), "n")


def parent(nodes: list[bytes]) -> bytes:
    """Digests are hashed as hex text."""
    return hashlib.sha256("".join([n.hex() for n in nodes]).encode()).digest()


class Tree:
    """The tree of a block: a fixed number of levels, or as many as lead to one node."""

    def __init__(self, nodes: list[bytes], height: int | None) -> None:
        self.levels = [nodes]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([parent(below[i:i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[bytes]:
        """Left and right siblings, joined, of a node and each of its ancestors below the top."""
        out = []
        for nodes in self.levels[:-1]:
            start = at - at % FAN
            out += [b"".join(nodes[start:at]), b"".join(nodes[at + 1:start + FAN])]
            at //= FAN
        return out

    def version(self, at: int, node: bytes) -> list[bytes]:
        """The nodes copied for a new leaf, from the leaf to the top; all others are shared."""
        copied = [node]
        for nodes in self.levels[:-1]:
            start = at - at % FAN
            copied.append(parent([*nodes[start:at], copied[-1], *nodes[at + 1:start + FAN]]))
            at //= FAN
        return copied


def continued(node: bytes, path: list[bytes]) -> bytes:
    """The version of the root above a node, along left and right siblings."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = hashlib.sha256((left.hex() + node.hex() + right.hex()).encode()).digest()
    return node


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple]]]:
    """(grp, block, rows) of a partition sorted by group, block and place."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for (grp, block), held in groupby(rows, key=lambda row: row[:2]):
        yield grp, block, list(held)  # bounded: the rows of a block


def _emitted(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TOP_SCHEMA = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("node", pa.binary()),
                         ("alone", pa.bool_())])
_PATH_SCHEMA = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("subroot", pa.binary()),
                          ("path", pa.list_(pa.binary()))])
_PROOF_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in (
    "leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def _tree(rows: list[tuple], size: int) -> Tree:
    """The tree of rows (grp, block, at, node, n): up to one node where the group has no other block."""
    n = rows[0][4]
    return Tree([row[3] for row in rows], None if n <= size else round(math.log(size, FAN)))


def _tops(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, block, held in _blocks(batches):
            n = held[0][4]
            top = _tree(held, size).top
            yield _emitted([(grp, block, -(-n // size), top, n <= size)], _TOP_SCHEMA)

    return run


def _paths(size: int):
    """For every node of a block its siblings up to the root; the block's own come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, _, held in _blocks(batches):
            (_, _, _, _, _, subroot, above), *nodes = held
            tree = _tree(nodes, size)
            yield _emitted([(grp, row[2], subroot or row[3], tree.siblings(i) + above)
                            for i, row in enumerate(nodes)], _PATH_SCHEMA)

    return run


def _proofs(size: int, root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held in _blocks(batches):
            (_, _, _, _, _, subroot, above, _, _), *nodes = held
            tree = _tree(nodes, size)
            out = []
            for i, row in enumerate(nodes):
                path = tree.siblings(i) + above
                changed = row[8]
                folded = continued(row[3], path) if changed is None else continued(
                    tree.version(i, changed)[-1], above)
                out.append((row[7], row[3].hex(), subroot.hex(), root.hex(), hashlib.sha256(
                    b"".join(path).hex().encode()).hexdigest(), folded.hex(), folded == root))
            yield _emitted(out, _PROOF_SCHEMA)

    return run


def climbed(nodes: DataFrame, size: int, name: str) -> list[DataFrame]:
    """Tables of block tops, each of the tops below it; in the last every group is alone with its own."""
    most, tops = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        rows = nodes.select("grp", F.floor(F.col("at") / size).alias("block"), "at", "node", "n")
        tops.append(cut(rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "at")
                        .mapInArrow(_tops(size), TOPS), name))
        if most <= size:
            return tops
        most, nodes = -(-most // size), tops[-1].filter("NOT alone")


def _with_above(nodes: DataFrame, above: DataFrame, size: int, *carried: str) -> DataFrame:
    """Nodes in sorted blocks; each block begins with the siblings above its top."""
    rows = nodes.select("grp", F.floor(F.col("at") / size).alias("block"), "at", "node", "n",
                        F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("array<binary>").alias("path"),
                        *carried)
    first = above.select("grp", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"),
                         F.lit(None).cast("binary").alias("node"), F.lit(None).cast("long").alias("n"), "subroot",
                         "path", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carried])
    return rows.unionByName(first).repartition("grp", "block").sortWithinPartitions("grp", "block", "at")


def descended(tops: list[DataFrame], outside: DataFrame, size: int, name: str) -> DataFrame:
    """Siblings above the tops of the lowest blocks, up to the root; `outside` has those above every group."""
    above = None
    for level in reversed(tops):
        own = level.filter("alone").join(outside, "grp").select("grp", "at", F.col("node").alias("subroot"), "path")
        if above is not None:
            own = own.unionByName(_with_above(level.filter("NOT alone"), above, size).mapInArrow(_paths(size), PATHS))
        above = cut(own, name)
    return above


def subroots(tops: list[DataFrame]) -> DataFrame:
    ended = [level.filter("alone").select("grp", "node") for level in tops]
    return reduce(DataFrame.unionByName, ended)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    size = FAN**height
    rows = placed(cut(leaves(docs), "leaves"), ["id", "node", "changed"], "leaves-in-order")
    rows = cut(rows, "leaves-placed")
    tops = climbed(rows, size, "block-tops")

    sources = subroots(tops).select(F.lit(ALL).alias("grp"), F.col("grp").alias("source"), "node")
    sources = cut(placed(sources, ["source"], "sources-in-order"), "sources-placed")
    source_tops = climbed(sources, size, "source-tops")
    top = subroots(source_tops).first()  # one row: the root
    if top is None:
        return docs.sparkSession.createDataFrame([], PROOFS)
    nothing_above = docs.sparkSession.createDataFrame([(ALL, [])], "grp string, path array<binary>")
    above_sources = descended(source_tops, nothing_above, size, "above-sources")
    outside = _with_above(sources, above_sources, size).mapInArrow(_paths(size), PATHS)
    outside = cut(outside.drop("grp", "subroot").join(sources.select("at", F.col("source").alias("grp")), "at")
                  .select("grp", "path"), "above-groups")

    above = descended(tops, outside, size, "above-blocks")
    return _with_above(rows, above, size, "id", "changed").mapInArrow(_proofs(size, bytes(top["node"])), PROOFS)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return manifest(table(spark, sf_dir, "documents"))


def _sql(levels: int = 10) -> str:
    """The tree level by level, without blocks; enough levels for 3 ** levels rows of a source."""
    field = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    shown = {c: field.format(f"{c}::VARCHAR") for c in FIELDS}
    plain = " || ".join(shown.values())
    bare = " || ".join([*list(shown.values())[:-1], field.format("replace(text, chr(10), '')")])
    parts = [f"""leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS g, sha256({plain}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN sha256({bare})
              ELSE sha256({plain}) END AS changed FROM documents),
n0 AS (SELECT g, doc_id, leaf, changed, leaf AS h, count(*) OVER (PARTITION BY g) AS n,
              row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)"""]

    def tree(base: str, key: str) -> str:
        for k in range(levels):
            parts.append(f"""{base}{k + 1} AS (
  SELECT {key}, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS hs,
         any_value((n + 2) // 3) AS n FROM {base}{k} WHERE n > 1 GROUP BY {key}, i // 3)""")
        ended = " UNION ALL ".join(f"SELECT {key}, h FROM {base}{k} WHERE n = 1" for k in range(levels + 1))
        parts.append(f"{base}_top AS ({ended})")
        return f"{base}_top"

    def climb(start: str, base: str, key: str, first: str) -> str:
        before = start
        for k in range(levels):
            m, hs = f"(f.i // {3**k}) % 3", f"{base}{k + 1}.hs"
            left, right = f"array_to_string({hs}[1:{m}], '')", f"array_to_string({hs}[{m} + 2:], '')"
            parts.append(f"""{first}{k} AS (
  SELECT f.* REPLACE (CASE WHEN {hs} IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded,
                      CASE WHEN {hs} IS NULL THEN proof ELSE proof || {left} || {right} END AS proof)
  FROM {before} f LEFT JOIN {base}{k + 1} ON f.{key} = {base}{k + 1}.{key} AND f.i // {3**(k + 1)} = {base}{k + 1}.i)""")
            before = f"{first}{k}"
        return before

    tree("n", "g")
    parts.append("s0 AS (SELECT '' AS one, g, h, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS i FROM n_top)")
    tree("s", "one")
    parts.append("f AS (SELECT g, doc_id, leaf, i, changed AS folded, '' AS proof FROM n0)")
    low = climb("f", "n", "g", "f")
    parts.append(f"u AS (SELECT '' AS one, g, doc_id, leaf, s0.i, s0.h AS subroot, folded, proof FROM {low} JOIN s0 USING (g))")
    high = climb("u", "s", "one", "u")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, s_top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = s_top.h AS verified FROM {high} JOIN s_top USING (one)"""


SQL = _sql()
