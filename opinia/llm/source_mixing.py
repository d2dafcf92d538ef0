"""Mixing sources to target weights by proportionally fair scheduling of blocks.

The rows of a source, in a pseudo-random order of their own, form blocks; a block takes
one slot.  The target is fluid: in virtual time v a source with weight w and n blocks has
got min(w v, n), so that the slot reached is t(v), the sum of that over all sources, and
those that have ended leave the proportions of the others as they are.  Block k has the
window from its release floor(t(k / w)) to its deadline ceil(t((k+1) / w)); in every slot
the released block with the earliest deadline goes next.  Windows add up to the capacity,
so every deadline is met, no slot stays empty, and in any prefix of the whole schedule a
source is less than one block away from its target.  Weights are taken as they are: a
float is a fraction, and times are compared in whole numbers of any length.

Every row is placed once; none is dropped or repeated.  No number of sources is assumed:
the catalogue (one row per source) and the schedule (one row per block) are tables, joined
with the rows by source and block.  What goes next depends on all before it, so one task
walks through the blocks, not the rows; it reads the catalogue, holds one entry per source
and streams the schedule.  Rows are numbered within their source in buckets
(`operators.ranking`), so a source with a third of all rows is spread.

Defined results: rows without a source are a source of their own; equal (source,
doc_id) rows share a place; a source without a declared weight gets 1 / `RESOLUTION` of
the weights declared for sources that are there (if there are none, all are equal);
weights that are not positive and finite are an error; a source with a weight and no
rows has no slots; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm.common import cut, table, unused
from opinia.operators.ranking import ordinal

BLOCK_ROWS = 64
RESOLUTION = 200
#: Stands for a missing source.
NO_SOURCE = "\x00"
SLOTS = "source string, block long, slot long, release long, deadline long, phase int"
#: Rows of a batch of the schedule.
SCHEDULE_ROWS = 10_000


def checked(weights: dict[str, float]) -> dict[str, float]:
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    return weights


def exact_weights(weights: dict[str, float], sources: list[str]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights of the sources that are there."""
    exact = {s: Fraction(weights[s]) for s in sources if s in weights}
    other = sum(exact.values()) / RESOLUTION or Fraction(1)
    scale = math.lcm(other.denominator, *(w.denominator for w in exact.values()))
    return {s: int(exact.get(s, other) * scale) for s in sources}


class Fluid:
    """The slot t(v) that the fluid target reaches when a source of weight w has got k blocks."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, int]) -> None:
        ends = sorted((n / weights[s], Fraction(n, weights[s]), n, weights[s]) for s, n in blocks.items())
        self.near = [e[0] for e in ends]
        self.ends = [e[2:] for e in ends]
        self.ended = [0, *accumulate(n for n, _ in self.ends)]
        self.active = [*accumulate((w for _, w in reversed(self.ends)), initial=0)][::-1]

    def at(self, k: int, w: int) -> tuple[int, int, int]:
        """floor and ceiling of t(k / w), and how many sources have ended by then."""
        i = bisect_right(self.near, k / w)
        while i < len(self.ends) and k * self.ends[i][1] >= self.ends[i][0] * w:
            i += 1
        while i and k * self.ends[i - 1][1] < self.ends[i - 1][0] * w:
            i -= 1
        whole, rest = divmod(k * self.active[i], w)
        return self.ended[i] + whole, self.ended[i] + whole + (rest > 0), i


def slots(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, slot, release, deadline, phase) of all blocks, earliest deadline first."""
    fluid = Fluid(blocks, weights)
    coming = [(0, source, 0, 0) for source in blocks]
    heapq.heapify(coming)
    ready: list[tuple] = []
    for slot in range(sum(blocks.values())):
        while coming and coming[0][0] <= slot:
            release, source, block, phase = heapq.heappop(coming)
            w = weights[source]
            after, deadline, next_phase = fluid.at(block + 1, w)
            heapq.heappush(ready, (deadline, -w, source, block, release, phase, after, next_phase))
        deadline, _, source, block, release, phase, after, next_phase = heapq.heappop(ready)
        yield source, block, slot, release, deadline, phase
        if block + 1 < blocks[source]:
            heapq.heappush(coming, (after, source, block + 1, next_phase))


def schedule(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """As many blocks of every source as its weight: (source, turn, slot, release, deadline)."""
    return [placed[:5] for placed in slots(weights, weights)]


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights that grow with a power of the size of a source."""
    return {source: count**power for source, count in counts.items()}


def _scheduled(weights: dict[str, float] | None, block_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {s: n for batch in batches for s, n in zip(batch["source"], batch["count"].tolist(), strict=True)}
        exact = exact_weights(tempered(counts) if weights is None else weights, sorted(counts))
        blocks = {s: -(-n // block_rows) for s, n in counts.items()}
        placed = slots(blocks, exact)
        while some := list(islice(placed, SCHEDULE_ROWS)):
            yield pd.DataFrame(some, columns=["source", "block", "slot", "release", "deadline", "phase"])
    return run


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS,
        id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """One row per (source, doc_id): where it comes in the mix.

    Columns: doc_id, source, position (increasing along the mix; a last block that is not
    full leaves a gap), slot, block, phase (sources whose target has ended where the window
    of the block begins), release and deadline (slots of the whole schedule).
    Without weights, those of `tempered` are used.
    """
    if weights is not None:
        checked(weights)
    rows = cut(docs.select(F.col(id_column).cast("long").alias("doc_id"),
                           F.coalesce(F.col(source_column).cast("string"), F.lit(NO_SOURCE)).alias("source"),
                           ).distinct().withColumn("order", F.xxhash64("doc_id", F.lit(9))), "mix-rows")
    catalogue = cut(rows.groupBy("source").count(), "mix-catalogue")
    placed = catalogue.repartition(1).mapInPandas(_scheduled(weights, block_rows), SLOTS)

    most = catalogue.agg(F.max("count")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, most)) / 2))
    numbered = ordinal(rows, ["source"], F.shiftright("order", 64 - bits), ["order", "doc_id"])
    timed = numbered.withColumn("block", F.floor((F.col("ordinal") - 1) / block_rows))
    # The planner takes the schedule for as small as the catalogue and would broadcast it.
    return timed.join(placed.hint("merge"), ["source", "block"]).select(
        "doc_id", F.when(F.col("source") != NO_SOURCE, F.col("source")).alias("source"),
        (F.col("slot") * block_rows + (F.col("ordinal") - 1) % block_rows).alias("position"),
        "slot", "block", "phase", "release", "deadline")


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, id_column: str = "doc_id",
                   source_column: str = "source") -> DataFrame:
    """All rows and columns of a table, laid out along the mix (partitions, then rows)."""
    own = {name: unused(docs, name) for name in ("_mix_id", "_mix_source", "_mix_at")}
    at = mix(docs, weights, id_column=id_column, source_column=source_column).select(
        *[F.col(c).alias(own[n]) for c, n in (("doc_id", "_mix_id"), ("source", "_mix_source"), ("position", "_mix_at"))])
    same = docs[id_column].cast("long").eqNullSafe(at[own["_mix_id"]]) & docs[source_column].cast("string").eqNullSafe(
        at[own["_mix_source"]])
    placed = docs.join(at, same)
    return placed.repartitionByRange(own["_mix_at"]).sortWithinPartitions(own["_mix_at"]).drop(*own.values())


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with weights that grow with the square root of a source."""
    return mix(table(spark, sf_dir, "documents"))
