"""Pages are triaged where they are read, and bodies are cleaned once."""

import random
from collections import Counter

from pyspark.sql import functions as F

from opinia.functions import pages as page_functions
from opinia.functions.text import canonical_review_id, content_pair, strip_rating_from_title
from opinia.operators import dedup, extract
from opinia.plans.ingest import paired_reviews, parse_pages
from opinia.schema import PAGES
from workload import derive

REVIEW = '<div data-hook="review"><b data-hook="review-title">5 sur 5 étoiles Bon\t{0}</b><p data-hook="review-body">a \n {0}</p></div>'


def captured(spark, htmls):
    rows = [("A", None, None, i + 1, f"u{i}", html, None, None, None) for i, html in enumerate(htmls)]
    return spark.createDataFrame(rows, PAGES)


def test_status_found_while_reading_is_that_of_triage(spark):
    markers = [m for group in page_functions.STATUS_MARKERS.values() for m in group]
    shown = [f"<p>{form}</p>" for m in markers for form in (m, m.upper(), m.title(), m[1:], m[:-1])]
    htmls = [None, "", "İ" + markers[0].upper(), markers[0] + markers[-1], *shown]
    table = captured(spark, [None if h is None else REVIEW.format(1) + h for h in htmls])
    expected = {r["page"]: r["page_status"] for r in page_functions.triage(table).collect()}
    read = extract.extract_pages(table, triaged=True).collect()
    assert {r["page"]: r["page_status"] for r in read} == expected
    assert {len(r["blocks"]) for r in read if r["page_status"] in ("challenge", "login")} == {0}
    assert set(expected.values()) == {"ok", "error", "challenge", "login"}
    usable = page_functions.usable(page_functions.triage(table)).drop("page_status")
    assert parse_pages(table).exceptAll(extract.extract_pages(usable)).isEmpty()
    assert parse_pages(table).count() == usable.count()


def test_pairs_and_ids_of_blocks_are_those_of_their_texts(spark):
    html = REVIEW.format("x") + REVIEW.format("é\x1f y") + '<div data-hook="review"></div>' + REVIEW.format("x")
    extracted = extract.extract_pages(captured(spark, [html]))
    rows = paired_reviews(extracted)
    assert rows.count() == 3
    pair = F.unhex(content_pair(F.col("review_title"), F.col("review_body")))
    assert rows.filter(pair != F.col("pair")).isEmpty()
    first = extracted.select(F.explode("blocks").alias("b")).select(
        canonical_review_id(F.col("b.title"), F.col("b.body")).alias("id"),
        strip_rating_from_title(F.col("b.title")).alias("title")).distinct()
    assert {(r["review_id"], r["review_title"]) for r in rows.collect()} == {(r["id"], r["title"]) for r in first.collect()}


def test_cross_page_rule_takes_given_pairs(spark):
    rows = spark.createDataFrame(
        [("A", 1, 0, "R1", "t", "b"), ("A", 2, 0, "R2", "t", " b"), ("A", 3, 0, "R2", "t", "c")],
        "asin string, page int, pos int, review_id string, review_title string, review_body string")
    plain = dedup.dedup_cross_page(rows, ["asin"], ["page", "pos"])
    given = dedup.dedup_cross_page(rows.withColumn("pair", dedup._pair()), ["asin"], ["page", "pos"], pair="pair")
    assert given.columns == rows.columns
    assert sorted(r["page"] for r in given.collect()) == sorted(r["page"] for r in plain.collect()) == [1, 3]


def test_rows_that_are_together_are_not_moved_by_the_page_rules(spark):
    rng = random.Random(4)
    rows = [(f"A{i % 7}" if i % 11 else None, i % 5 if i % 13 else None, i, rng.choice(["r1", "r2", "r3", "", None]),
             rng.choice(["t", "u", None]), rng.choice(["b", " b", "c"])) for i in range(600)]
    table = spark.createDataFrame(
        rows, "asin string, page int, pos int, review_id string, review_title string, review_body string")
    found = dedup.dedup_page(table.repartition(3), ["asin"])
    ids, pairs, expected = set(), set(), set()
    for asin, page, pos, rid, title, body in rows:
        if rid is None or (asin, page, rid) in ids:
            continue
        ids.add((asin, page, rid))
        if (asin, page, title or "", body.strip()) not in pairs:
            pairs.add((asin, page, title or "", body.strip()))
            expected.add(pos)
    assert sorted(r["pos"] for r in found.collect()) == sorted(expected)
    together = dedup.dedup_page(table.repartition(3, "asin"), ["asin"])
    assert str(together._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1


def test_placed_records_do_not_depend_on_how_products_are_split(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    whole = derive.paged(spark, sf_dir)
    # The placed lines of a product are together, and stay so through both rules.
    rules = str(dedup.dedup_page(whole, ["asin"])._jdf.queryExecution().executedPlan())
    assert "Exchange" not in rules[:rules.index("rn#")]
    whole = whole.collect()
    monkeypatch.setattr(derive, "PRODUCT_LINES", 30)
    split = derive.paged(spark, sf_dir)
    moved = str(dedup.dedup_page(split, ["asin"])._jdf.queryExecution().executedPlan()).partition("Union")[0]
    assert "Exchange" in moved
    assert not derive._by_size(spark, sf_dir, 30)[1].isEmpty()
    assert split.columns == derive.paged(spark, sf_dir).columns and Counter(split.collect()) == Counter(whole)
