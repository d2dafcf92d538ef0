"""Connected components of a table of links, by alternating large and small stars.

Each round joins every node with the smallest neighbour (Kiveris et al., 2014);
the links shrink towards stars around the smallest node of a component.  Links of
one partition are first replaced by a spanning forest.  A node with very many
links is aggregated before the shuffle, and its join partition can be split, as
both sides are plain exchanges.  Only two numbers per round reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.llm.common import numbers, reliable_checkpoint

LINK = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, smallest node) that connect what the links a-b connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        jumped = root[root]
        while (jumped != root).any():
            root, jumped = jumped, jumped[jumped]
        if (root[x] == root[y]).all():
            away = root != np.arange(len(nodes))
            return nodes[away], nodes[root[away]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(numbers(batch.column("a")), numbers(batch.column("b")))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; links point from larger a to smaller b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lows = _smallest(both).select("a", F.least("a", "low").alias("low"))
    large = both.join(lows, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    large = large.distinct()
    lows = _smallest(large)
    small = large.join(lows, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.unionByName(lows.select("a", F.col("low").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node of its component.

    `links` has the long columns a and b; loops and repeated links do no harm,
    NULL ends are left out.  No links give no rows.
    """
    ends = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now = reliable_checkpoint(ends.mapInArrow(_forests, LINK).distinct())
    mark = None
    while True:
        before, mark = mark, now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        now = reliable_checkpoint(_round(now))
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct())
