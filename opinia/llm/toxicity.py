"""Toxicity by compression distance: which of two dictionaries shortens a window more.

Two zstandard dictionaries are trained on labelled documents: one on ordinary text,
one on the windows that set toxic documents apart.  A window is one word between two
fixed strings that both dictionaries know (the codec looks for no matches in the last
bytes of its input).  Its distance is the compressed length with the ordinary
dictionary less that with both dictionaries; the thresholds on the distances of a
document's windows are calibrated by a logistic regression on labelled documents that
trained no dictionary.

The classifier is fitted on a bounded sample of labelled rows (`TOXIC_ROWS`,
`ORDINARY_ROWS`, by hash order of doc_id, texts up to `SAMPLE_BYTES`).  Scoring reads
every window of every text; a task remembers the distances of recent words, within a
bound, which changes no result.

Defined results: NULL and empty texts and texts without words have one empty window of
distance 0; without labels of both classes every score is the share of toxic labels
(0 without any label); rows without a doc_id are held_out false (crc32 is NULL);
repeated labels of a document count once, as toxic if one of them is; rows of equal
doc_id are all returned.  Labels, language, source and doc_id are never inputs of a
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm.common import bounded_batches, in_small_batches, resident, table

#: Labelled rows that the classifier is fitted on, at most, and their length.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 1200, 4800, 1 << 16
#: Bytes of the two dictionaries.
TOXIC_BYTES, ORDINARY_BYTES = 2048, 8192
LEVEL = 6
HEAD, TAIL = b"0123456789abcdefghijklmnopqrstuvwxyz#@", b"#~^`|<>+=@"
#: A word beginning marks toxic text from so many documents and such log odds.
LEAST_DOCUMENTS, LEAST_ODDS = 5, 3.5
BEGINNINGS = range(5, 13)
REMEMBERED = 1 << 17
WORD = re.compile(r"\w+")
SCORED = "doc_id long, score double"


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the weights of the standardised features with the bias last."""

    toxic: bytes
    ordinary: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _beginnings(word: str) -> list[str]:
    held = f" {word} "
    return [held[:n] for n in BEGINNINGS if n <= len(held)]


def marked_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """The words of toxic texts, in order, that begin as ordinary texts seldom do."""
    counts = []
    for side in (toxic, ordinary):
        count: Counter[str] = Counter()
        for text in side:
            count.update({b for w in set(words(text)) for b in _beginnings(w)})
        counts.append(count)
    bad, good = counts
    odds = {b: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((good[b] + 0.5) / (len(ordinary) + 1))
            for b, n in bad.items() if n >= LEAST_DOCUMENTS}
    marks = {b for b, value in odds.items() if value > LEAST_ODDS}
    return [w for text in toxic for w in words(text) if not marks.isdisjoint(_beginnings(w))]


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    marked = [f" {w} ".encode() for w in marked_words(toxic, ordinary)]
    samples = [b"".join(marked[i:i + 8]) for i in range(0, len(marked), 8)]
    plain = []
    for text in ordinary:
        spaced = (" ".join(words(text)) + " ").encode()
        plain += [spaced[i:i + 256] for i in range(0, len(spaced), 256)]
    return _dictionary(TOXIC_BYTES, samples, 16), _dictionary(ORDINARY_BYTES, plain, 64)


class Windows(dict):
    """The distance of every window, that is of a word; recent ones are remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        super().__init__()
        self.plain = self._compressor(ordinary)
        self.both = self._compressor(toxic + ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=(
            zstandard.ZstdCompressionParameters.from_level(
                LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS)))

    def __missing__(self, word: str) -> int:
        window = HEAD + f" {word} ".encode("utf-8", "replace") + TAIL
        distance = len(self.plain.compress(window)) - len(self.both.compress(window))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = distance
        return distance

    def features(self, text: str) -> list[float]:
        """How many windows pass each threshold, in several measures."""
        found = np.fromiter(map(self.__getitem__, words(text) or [""]), np.int32)
        size = len(found)
        passing = [int((found >= t).sum()) for t in (2, 3, 4)]
        return [np.maximum(found, 0).mean(), *(p / size for p in passing), *(math.log1p(p) for p in passing),
                passing[0] / math.sqrt(size), float(found.max()), math.log(size)]


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple:
    """Centre, scale and weights of a ridge logistic regression, by Newton steps."""
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.hstack([(rows - centre) / scale, np.ones((len(rows), 1))])
    penalty = ridge * np.diag([*np.ones(rows.shape[1]), 1e-6])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty,
                               x.T @ (labels - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(tuple, (centre.tolist(), scale.tolist(), weights.tolist())))


def fit(rows: list[tuple[str, int]]) -> Model | float:
    """A model of (text, label) rows: even ones train dictionaries, odd ones calibrate."""
    parts = [rows[i::2] for i in (0, 1)]
    if any({label for _, label in part} != {0, 1} for part in parts):
        return sum(label for _, label in rows) / len(rows) if rows else 0.0
    toxic, ordinary = dictionaries(*([t for t, label in parts[0] if label == side] for side in (1, 0)))
    windows = Windows(toxic, ordinary)
    calibration = np.array([windows.features(text) for text, _ in parts[1]])
    return Model(toxic, ordinary, *_logistic(calibration, np.array([label for _, label in parts[1]], float)))


def _windows(toxic: bytes, ordinary: bytes) -> Windows:
    return resident(("windows", toxic, ordinary), lambda: Windows(toxic, ordinary))


def _batch_scores(model: Model | float, column: pa.Array) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(column), model)
    windows = _windows(model.toxic, model.ordinary)
    rows = np.array([windows.features(t or "") for t in column.to_pylist()])
    rows = (rows - np.array(model.centre)) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(rows @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30)))


def _scores(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_batch_scores(model, batch.column("text")))], ["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model | float:
    """The model of a bounded sample of the labelled rows that are not held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("labelled"), "labelled"]
    picked = known.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(ORDINARY_ROWS))
    texts = docs.select(F.col(id_column).cast("long").alias("labelled"), F.col(text_column).alias("text")).filter(
        F.octet_length("text") <= SAMPLE_BYTES)
    rows = texts.join(F.broadcast(picked), "labelled").dropDuplicates(["labelled"])  # bounded: the two limits
    return fit([(r.text, r.toxic) for r in sorted(rows.collect(), key=lambda r: r.labelled)])


def score(docs: DataFrame, model: Model | float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return in_small_batches(texts).mapInArrow(_scores(model), SCORED)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learnt from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model | float, text_column: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, text_column):
            yield batch.filter(pa.array(_batch_scores(model, batch.column(text_column)) < limit))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
