"""The four duplicate rules of the review model.

* in-page, by id then by content: `dedup_page_id`, `dedup_page_content`
  (rows), `dedup_page_blocks` (a page's block array, no shuffle);
* across the pages of a run, greedy: `dedup_cross_page`;
* over a whole review set, id pass then content pass: `dedup_two_pass`;
* against the stored table: `insert_if_absent`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.functions.text import clean_pair, clean_review_id, clean_text, content_key, content_pair, let
from opinia.functions.urls import review_id_from_url
from opinia.operators.components import components
from opinia.operators.ranking import keep_first
from opinia.sources.scratch import reliable_checkpoint, written

# A run with more distinct (id, content) rows than this is cut into the components
# of its keys before the ordered pass; a smaller one is one component as it is.
# Runs with fewer rows of any kind go there as they are.
ORDERED_PASS_ROWS = 200_000
# Rounds that decide rows of such runs beforehand, which lets components fall apart.
ROUNDS = 3


def dedup_page_id(df: DataFrame, scope: list[str], page: str = "page",
                  pos: str = "pos") -> DataFrame:
    """First block per review id within a page; rows without id are dropped."""
    return keep_first(df.filter(F.col("review_id").isNotNull()),
                      [*scope, page, "review_id"], [pos])


def dedup_page_content(df: DataFrame, scope: list[str], page: str = "page",
                       pos: str = "pos") -> DataFrame:
    """First block per (title, body) within a page, after the id rule."""
    return keep_first(df.withColumn("_pair", _pair()), [*scope, page, "_pair"], [pos]).drop("_pair")


def dedup_page(df: DataFrame, scope: list[str], page: str = "page", pos: str = "pos") -> DataFrame:
    """Both in-page rules, the id first.

    Texts are hashed before either pass, so those that the caller does not ask for cross no
    shuffle; rows of a run or page that are together already are not moved.
    """
    by_id = dedup_page_id(df.withColumn("_pair", _pair()), scope, page, pos)
    return keep_first(by_id, [*scope, page, "_pair"], [pos]).drop("_pair")


def dedup_page_blocks(blocks: Column, title: Callable[[Column], Column]) -> Column:
    """Both in-page rules on an array of raw blocks, without a shuffle.

    Returns structs (pos, review_id, pair, review_title, review_body, block) of the
    surviving blocks.  `title` maps a raw title to the stored one, which is clean text
    and which the content rule compares; a body is cleaned once for all that asks for it.
    """
    texts = F.transform(blocks, lambda b: F.struct(
        title(b["title"]).alias("review_title"), clean_text(b["body"]).alias("review_body"), b.alias("block")))
    keyed = let(texts, lambda clean: F.transform(clean, lambda t, i: F.struct(
        i.alias("pos"),
        F.coalesce(review_id_from_url(t["block"]["id_href"]),
                   clean_review_id(clean_text(t["block"]["title"]), t["review_body"])).alias("review_id"),
        clean_pair(t["review_title"], t["review_body"]).alias("pair"),
        t["review_title"].alias("review_title"), t["review_body"].alias("review_body"),
        t["block"].alias("block"),
    )))
    # Bound step by step, or each reference would evaluate the hashes again.
    return let(keyed, lambda rows: let(
        _first_by(rows, "review_id"), lambda unique: _first_by(unique, "pair")))


def dedup_cross_page(df: DataFrame, scope: list[str], order: list[str],
                     group_rows: int = ORDERED_PASS_ROWS, pair: str | None = None) -> DataFrame:
    """Greedy rule over a run: drop a row whose id or content was seen on an
    earlier *kept* row; a dropped row leaves no trace.

    `order` must be unique within `scope`.  The input is evaluated once and written;
    everything is decided on narrow keys (place, id, hash of the content) read from there,
    and the rows are joined once, at the end, to the places that stay.

    Rows that share no key, not even by way of others, cannot decide each other.  So one
    ordered pass goes through groups of rows with common keys: a run of up to `group_rows`
    rows is such a group as a whole, and its keys are moved once.  In larger runs, rows equal
    in both id and content collapse to the first beforehand, which is what the rule does, and
    a run that still has more keys is cut into the components of the graph of their ids and
    contents (see `_large_groups`).

    `pair` names a column that holds the `_pair` of each row, which is then left out.
    """
    rows = written(df, "rows")
    places = rows.select(*scope, *order, "review_id", (F.col(pair) if pair else _pair()).alias("_pair"))
    rows = rows.drop(pair) if pair else rows
    group = F.xxhash64(*scope).alias("_group")
    long = reliable_checkpoint(_large_scopes(rows.select(*scope), scope, group_rows))
    if long.isEmpty():
        kept = _ordered_pass(places.select("*", group), scope, order)
    else:
        keys = reliable_checkpoint(keep_first(places, [*scope, "review_id", "_pair"], order))
        large = reliable_checkpoint(_large_scopes(keys, scope, group_rows))
        grouped = _semi(keys, large, scope, "left_anti").select("*", group)
        won, open_rows = _large_groups(_semi(keys, large, scope, "left_semi"), large, scope, order)
        kept = _ordered_pass(grouped.unionByName(open_rows), scope, order).drop("_group").unionByName(won)
    return _semi(rows, written(kept.select(*scope, *order), "kept"), [*scope, *order], "left_semi")


def dedup_two_pass(df: DataFrame, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """First row per review id, then first row per content key.

    The key is computed before either pass, so texts that the caller does not ask for end
    there and cross no shuffle.
    """
    scope = scope or []

    def column(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit("")

    key = content_key(*[column(c) for c in (
        "review_title", "review_body", "reviewer_name", "review_date", "rating", "variant")])
    keyed = df.withColumn("_key", F.unhex(key))
    by_id = keep_first(keyed, [*scope, "review_id"], order) if "review_id" in df.columns else keyed
    return keep_first(by_id, [*scope, "_key"], order).drop("_key")


def dedup_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, rows removed."""
    counted = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    return counted.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def insert_if_absent(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Rows of `new` to append: the first per review id that the table lacks."""
    fresh = keep_first(new, ["review_id"], order)
    return fresh.join(existing.select("review_id"), "review_id", "left_anti")


def _pair() -> Column:
    """`content_pair` of a review as bytes, half as long on its way as the digits."""
    return F.unhex(content_pair(F.col("review_title"), F.col("review_body")))


def _first_by(keyed: Column, field: str) -> Column:
    return let(F.transform(keyed, lambda k: k[field]), lambda seen: F.filter(
        keyed, lambda k, i: F.array_position(seen, k[field]) == i + 1))


def _large_scopes(keys: DataFrame, scope: list[str], group_rows: int) -> DataFrame:
    return keys.groupBy(*scope).agg(F.count("*").alias("_n")).filter(
        F.col("_n") > group_rows).drop("_n")


def _semi(df: DataFrame, keys: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Rows of `df` whose columns are (or are not) among those of `keys`.

    Both sides are plain exchanges, so a partition with a hot key is split at run time.
    """
    return df.join(_renamed(keys, columns), _matches(df, columns), how)


def _renamed(keys: DataFrame, columns: list[str]) -> DataFrame:
    return keys.select(*[F.col(c).alias(f"_j_{c}") for c in columns])


def _matches(df: DataFrame, columns: list[str]) -> Column:
    return reduce(and_, [df[c].eqNullSafe(F.col(f"_j_{c}")) for c in columns])


def _ordered_pass(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Greedy rule in one scan of each partition, sorted by group, scope and order.

    Rows stay Arrow columns; Python sees only the scope and the two keys.
    """

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, pairs = None, set(), set()
        for batch in batches:
            scopes = zip(*[batch.column(c).to_pylist() for c in ("_group", *scope)])
            keep = []
            for s, rid, pair in zip(scopes, batch.column("review_id").to_pylist(),
                                    batch.column("_pair").to_pylist()):
                if s != current:
                    current, ids, pairs = s, set(), set()
                fresh = rid not in ids and pair not in pairs
                if fresh:
                    if rid:
                        ids.add(rid)
                    pairs.add(pair)
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return (
        df.repartition("_group")
        .sortWithinPartitions("_group", *scope, *order)
        .mapInArrow(greedy, df.schema)
    )


def _large_groups(keys: DataFrame, large: DataFrame, scope: list[str],
                  order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys of large runs: those certainly kept, and the open ones with their `_group`.

    A row that is first for its id and first for its content among the open rows is
    certainly kept, and every open row sharing either key with it certainly dropped.  A few
    rounds of that leave components that are small as a rule; a chain in which every kept
    row decides the next stays one component and is one task's work, on narrow keys.  Rows
    without an id are bound by their content only.
    """
    won, open_rows = keys.filter("false"), keys
    if not large.isEmpty():
        for _ in range(ROUNDS):
            with_id = open_rows.filter(F.coalesce("review_id", F.lit("")) != "")
            no_id = open_rows.filter(F.coalesce("review_id", F.lit("")) == "")
            first_id = keep_first(with_id, [*scope, "review_id"], order).unionByName(no_id)
            first_pair = keep_first(open_rows, [*scope, "_pair"], order)
            kept = reliable_checkpoint(_semi(first_pair, first_id, [*scope, *order], "left_semi"))
            won = won.unionByName(kept)
            open_rows = drop_sharing(open_rows, kept, [*scope, "review_id"])
            open_rows = reliable_checkpoint(drop_sharing(open_rows, kept, [*scope, "_pair"]))
    text = F.xxhash64(F.lit("content"), *scope, "_pair")
    has_id = F.coalesce("review_id", F.lit("")) != ""
    # Hashes that meet by chance only join components, which decides nothing.
    links = open_rows.select(text.alias("a"), F.when(
        has_id, F.xxhash64(F.lit("id"), *scope, "review_id")).otherwise(text).alias("b"))
    if large.isEmpty():
        return won, open_rows.withColumn("_group", text)
    named = components(links).select(F.col("node").alias("_node"), F.col("component").alias("_group"))
    placed = open_rows.withColumn("_node", text).join(named, "_node").drop("_node")
    return won, placed


def drop_sharing(rows: DataFrame, won: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share no key with a winner; an empty last key shares with none."""
    real = won.filter(F.col(keys[-1]).isNotNull() & (F.length(keys[-1]) > 0))
    return _semi(rows, real, keys, "left_anti")
