"""What several operators of this subpackage share: tables, cuts and Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from opinia.sources.scratch import reliable_checkpoint, scratch_path

__all__ = ["bounded_batches", "crc32_sql", "cut", "in_small_batches", "numbers", "reliable_checkpoint", "resident", "table", "unused"]


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them from there.

    Several consumers then read columns of one table instead of repeating the
    work, and a lost executor costs only its current tasks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame, with Arrow batches of its session cut to `BATCH_ROWS` rows.

    Whole texts cross to Python; at the default of 10,000 rows a batch of long ones
    takes hundreds of MB on either side.  A smaller setting of the session stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """The one large object that a Python worker keeps from task to task.

    Workers serve the stages of all operators in turn; asking for another object
    lets the last one go, so their sizes do not add up.
    """
    if key not in _resident:
        _resident.clear()
        pa.default_memory_pool().release_unused()
        _resident[key] = make()
    return _resident[key]


def numbers(column: pa.ChunkedArray | pa.Array, dtype=np.int64) -> np.ndarray:
    """A numeric Arrow column without NULLs as a numpy array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def bounded_batches(batches: Iterator[pa.RecordBatch], column: str,
                    most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `most_bytes` of a text column each.

    A batch always holds one row at least, so a text of any length passes whole.
    """
    for batch in batches:
        sizes = np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)),
                            np.int64, batch.num_rows) if batch.num_rows else np.zeros(0, np.int64)
        piece = np.cumsum(sizes) // most_bytes
        edges = np.flatnonzero(np.diff(piece)) + 1
        for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start)


def crc32_sql(value: str) -> str:
    """DuckDB has no CRC-32: the register is shifted once per bit, lowest bits first."""
    bits = (f"flatten(list_transform(string_split({value}, ''), lambda ch: "
            "list_transform(range(8), lambda k: (ascii(ch) >> k) & 1)))")
    step = "xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384 ELSE 0 END)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: {step}), 4294967295::BIGINT)")
