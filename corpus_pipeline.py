"""From raw documents to encoded ones: toxicity, exact and near copies, mix, tokens.

Every stage reads all that the one before it kept and returns the columns of
`documents`; the last returns the digests of every document and its place in the mix.  The two dedup stages
give every row a key of its own and keep one row of each group, so rows that share a
doc_id, or have none, are judged by their texts.

Defined results: NULL and empty texts are equal to each other and one of them stays; texts
of any length pass whole; other columns of the input, whatever their names, come through all
stages but the last; without labels nothing counts as toxic; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm import bpe_codec, exact_dedup, simhash_dedup, source_mixing, toxicity
from opinia.llm.common import cut, table, unused


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a written key of their own, and its name, which no other column has."""
    key = unused(docs, "_row")
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _one_per_group(keyed: DataFrame, key: str, found: DataFrame, group: str) -> DataFrame:
    """Of the rows of each group, the one with the smallest doc_id; missing ones come last, ties go by the key."""
    narrow = keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    groups = found.select(F.col("doc_id").alias("row"), F.col(group).alias("group"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = narrow.join(groups, "row").groupBy("group").agg(F.min(order)["row"].alias(key))
    return keyed.join(first, key, "left_semi").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones here."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    keyed, key = _keyed(docs)
    found = exact_dedup.exact_dedup(keyed, exact_dedup.arrived_before(keyed), id_column=key)
    return _one_per_group(keyed, key, found, "keep_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    keyed, key = _keyed(docs)
    return _one_per_group(keyed, key, simhash_dedup.simhash_dedup(keyed, id_column=key), "component_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix; `encode` states the place of each."""
    return source_mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document, and its place in the mix.

    Columns: doc_id, source, n_tokens, ids_sha256, decoded_sha256, position, slot, block.
    Readers of the laid out rows do not keep their order.  The mix depends on doc_id and
    source alone, so it is the same here as in `mix_sources`.
    """
    coded = bpe_codec.digests(docs, public_tokenizers.path("word_bpe_49k.json"), source_column="source")
    at = source_mixing.mix(docs).select(
        F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), "position", "slot", "block")
    same = coded["doc_id"].eqNullSafe(at["_mix_id"]) & coded["source"].eqNullSafe(at["_mix_source"])
    return coded.join(at.hint("merge"), same).select(
        "doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "position", "slot", "block")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Compression lengths, Hamming distances and token ids have no SQL form; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
