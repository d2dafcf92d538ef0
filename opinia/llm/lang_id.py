"""Language of pages by fusing text, declared language, address suffix and a prior of domain and host.

The text likelihood is multinomial over hashed byte trigrams, learnt from labelled
documents.  A page's text, markup (`<html lang>`, content-language) and address suffix are
taken as independent evidence given its language:

    log P(l | page) = log P(l | host) + log P(text | l) + log P(declared | l) + log P(suffix | l) + constant

P(declared | l) and P(suffix | l) come from grouped aggregations of the text posteriors,
smoothed towards the marginal.  P(l | host) is smoothed from level to level: all pages,
registered domain, host; each level adds the soft counts of its group to `PRIOR_WEIGHT`
times the prior of the level above.  The suffix is no level of it, or it would count twice.
A page's own text is taken out of its group's counts, so it is not used twice.

Trigrams of a text are far from independent, so the text likelihood is tempered to
that of `TEXT_WEIGHT` independent ones at most.  Groups are aggregated partially before
the shuffle; a host that owns a third of the pages is one row per task.  What the driver
collects is the trigram table, of `TABLE_ENTRIES` at most: there may be any number of
languages, and with many of them trigrams share wider bins.

Defined results: NULL html and urls give no evidence; unknown declared languages
become "other"; without labelled documents every page has lang NULL and
confidence 0; ties go to the first language in order; rows of equal page_id are all
returned (equal page_id and url rows share the sum of their evidence only through the
groups).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm.common import bounded_batches, cut, in_small_batches, table
from opinia.llm.html_text import main_text
from opinia.llm.url_filter import split_url

BINS = 1 << 15
TEXT_WEIGHT = 60.0
PRIOR_WEIGHT = 4.0
SMOOTHING = 0.5
#: Entries of the trigram table; with more languages than fit at `BINS`, neighbouring bins are added up.
TABLE_ENTRIES = 1 << 23
COUNTS = "lang string, bin int, n long"


def trigram_bins(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, white space runs as one space."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in bounded_batches(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in sums:
                sums[lang] = np.zeros(BINS, np.int64)
            sums[lang] += np.bincount(trigram_bins(text or ""), minlength=BINS)
    for lang, counts in sums.items():
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.astype(np.int32)),
                                          pa.array(counts[held])], ["lang", "bin", "n"])


def train(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log likelihood of every bin, from all labelled texts."""
    labelled = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).dropna()
    counted = in_small_batches(labelled).mapInArrow(_counted, COUNTS).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counted = cut(counted, "trigrams")
    size = counted.select("lang").distinct().count()
    bins = BINS
    while size * bins > TABLE_ENTRIES and bins > 1:
        bins //= 2
    folded = counted.groupBy("lang", F.floor(F.col("bin") / (BINS // bins)).cast("int").alias("bin")).agg(
        F.sum("n").alias("n"))
    rows = folded.toPandas()  # bounded: TABLE_ENTRIES
    langs = sorted(rows["lang"].unique())
    counts = np.full((len(langs), bins), SMOOTHING)
    counts[np.searchsorted(langs, rows["lang"]) if langs else [], rows["bin"]] += rows["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_scores(text: str, table_: np.ndarray) -> np.ndarray:
    """Tempered log likelihood of a text in every language, 0 for the best."""
    bins = trigram_bins(text)
    if len(table_) and table_.shape[1] < BINS:
        bins //= np.uint32(BINS // table_.shape[1])
    if not len(bins) or not len(table_):
        return np.zeros(len(table_))
    total = np.zeros(len(table_))
    for at in range(0, len(bins), 1 << 16):
        total += table_[:, bins[at:at + (1 << 16)]].sum(axis=1, dtype=np.float64)
    return (total - total.max()) * min(1.0, TEXT_WEIGHT / len(bins))


def _scored(table_: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "html"):
            found = [text_scores(main_text(h or ""), table_).tolist() for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("declared"),
                 pa.array(found, pa.list_(pa.float64()))], ["page_id", "host", "declared", "text"])

    return run


def declared_language(source: Column) -> Column:
    """The primary subtag that the markup declares, or an empty string."""
    root = F.regexp_extract(source, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    meta = F.regexp_extract(source, r"(?is)<meta\b[^>]*content-language[^>]*?content\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.coalesce(F.lower(F.when(root != "", root).otherwise(meta)), F.lit(""))


def _softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Soft counts per group, one array of the languages."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(size)]).alias(name))


def _zip(a: str | Column, b: str | Column, f) -> Column:
    return F.zip_with(a, b, f)


def _smoothed(counts: Column, prior: Column, weight: float = PRIOR_WEIGHT) -> Column:
    """(counts + weight * prior) / (total + weight)."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return _zip(counts, prior, lambda c, q: (c + weight * q) / (total + weight))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_column: str = "page_id",
             url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, host, declared, lang, confidence."""
    langs, likelihood = model
    size = len(langs)
    host = split_url(F.col(url_column))[0]
    declared = declared_language(F.col(html_column))
    read = pages.select(F.col(id_column).cast("long").alias("page_id"), host.alias("host"),
                        F.when(declared.isin("", *langs), declared).otherwise("other").alias("declared"),
                        F.col(html_column).alias("html"))
    scored = in_small_batches(read).mapInArrow(_scored(likelihood), "page_id long, host string, declared string, text array<double>")
    if not size:
        return scored.select("page_id", "host", "declared", F.lit(None).cast("string").alias("lang"),
                             F.lit(0.0).alias("confidence"))
    labels = F.split("host", r"\.")
    rows = cut(scored.select(
        "*", F.element_at(labels, -1).alias("suffix"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        _softmax(F.col("text")).alias("p")), "language-text")

    every = rows.agg(*[F.sum(F.col("p")[i]) for i in range(size)]).first()
    total = [float(v or 0.0) + SMOOTHING for v in every]
    base = F.array(*[F.lit(v / sum(total)) for v in total])
    by_suffix = _sums(rows, ["suffix"], size, "suffix_n")
    by_domain = _sums(rows, ["domain"], size, "domain_n")
    by_host = _sums(rows, ["host"], size, "host_n")
    by_declared = _sums(rows, ["declared"], size, "declared_n")

    less = lambda name: _zip(name, "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))
    level = _smoothed(less("domain_n"), base)
    prior = _smoothed(less("host_n"), level)

    def evidence(name: str) -> Column:
        """log P(value | l) up to a constant: share of the value among pages of l."""
        share = _smoothed(less(name), base)
        return _zip(share, base, lambda s, b: F.log(s / b))

    known = rows.join(by_suffix, "suffix").join(by_domain, "domain").join(by_host, "host").join(by_declared, "declared")
    parts = [F.col("text"), F.transform(prior, lambda x: F.log(x)), evidence("declared_n"), evidence("suffix_n")]
    fused = parts[0]
    for part in parts[1:]:
        fused = _zip(fused, part, lambda a, b: a + b)
    best = F.array_max("posterior")
    return known.select("page_id", "host", "declared", _softmax(fused).alias("posterior")).select(
        "page_id", "host", "declared",
        F.element_at(F.array(*map(F.lit, langs)), F.array_position("posterior", best).cast("int")).alias("lang"),
        best.alias("confidence"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with text likelihoods from all documents that have a language."""
    return identify(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
