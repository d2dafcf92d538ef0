"""Links within buckets of a table, without a bucket having to fit one task.

Rows carry the long `bucket`.  A bucket of more than `most` rows is cut into
chunks, and each pair of chunks becomes a cell of its own, so work spreads over
tasks and every two rows still meet in exactly one cell (rows of one chunk in the
cell of that chunk with itself).  Nothing is dropped, and small buckets stay as
they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(rows: DataFrame, member: str, most: int) -> DataFrame:
    """The rows with `cell_a`, `cell_b` (chunks, -1 in small buckets) and `chunk`.

    A row of a bucket with c chunks is repeated c times, for small buckets once.
    Rows of a bucket are dealt to chunks by the hash of `member`.
    """
    large = rows.groupBy("bucket").agg(F.count("*").alias("held")).filter(F.col("held") > most).select(
        "bucket", F.ceil(F.col("held") / most).cast("int").alias("chunks"))
    chunk = F.when(F.col("chunks").isNotNull(),
                   F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("chunks")).cast("int")).otherwise(F.lit(-1))
    dealt = rows.join(large, "bucket", "left").withColumn("chunk", chunk)
    other = F.explode(F.when(F.col("chunks").isNotNull(), F.sequence(F.lit(0), F.col("chunks") - 1))
                      .otherwise(F.array(F.lit(-1))))
    return dealt.withColumn("other", other).select(
        *rows.columns, "chunk", F.least("chunk", "other").alias("cell_a"),
        F.greatest("chunk", "other").alias("cell_b"))


def sorted_cells(rows: DataFrame, member: str, most: int) -> DataFrame:
    """`cells`, with the rows of a cell next to each other in one partition."""
    keys = ["bucket", "cell_a", "cell_b"]
    return cells(rows, member, most).repartition(*keys).sortWithinPartitions(*keys)


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells of about so many rows, each with the starts of its cells."""
    held: list[pa.RecordBatch] = []
    count = 0

    def ready(table: pa.Table, last: bool):
        keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "cell_a", "cell_b")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        stop = table.num_rows if last else starts[-1]
        return table.slice(0, stop), starts[starts < stop], table.slice(stop)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            done, starts, rest = ready(pa.Table.from_batches(held), False)
            if done.num_rows:
                yield done, starts
            held, count = rest.to_batches(), 0
    if held:
        done, starts, _ = ready(pa.Table.from_batches(held), True)
        if done.num_rows:
            yield done, starts
