"""Duplicate rules against plain-Python restatements, skew included."""

import random

import pytest
from pyspark.sql import functions as F

from opinia.operators import dedup
from opinia.operators.ranking import ordinal, running

SCHEMA = "asin string, page int, pos int, review_id string, review_title string, review_body string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def spots(df):
    return sorted((r["asin"], r["page"], r["pos"]) for r in df.collect())


def greedy(rows):
    seen, out = {}, []
    for asin, page, pos, rid, title, body in sorted(rows, key=lambda r: r[:3]):
        ids, texts = seen.setdefault(asin, (set(), set()))
        if (rid and rid in ids) or (title, body) in texts:
            continue
        if rid:
            ids.add(rid)
        texts.add((title, body))
        out.append((asin, page, pos))
    return sorted(out)


def random_rows(seed, n=1500, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        asin = "HOT" if rng.random() < hot else f"A{rng.randrange(40)}"
        text = ("", "") if rng.random() < 0.35 else (f"t{rng.randrange(30)}", f"b{rng.randrange(8)}")
        rid = None if rng.random() < 0.1 else f"R{rng.randrange(120)}"
        rows.append((asin, i // 10, i % 10, rid, *text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,group_rows", [(1, 10**6), (2, 20), (3, 1), (4, 60)])
def test_cross_page_equals_greedy(spark, seed, group_rows):
    rows = random_rows(seed)
    got = dedup.dedup_cross_page(frame(spark, rows), ["asin"], ["page", "pos"], group_rows)
    assert got.columns == frame(spark, []).columns
    assert spots(got) == greedy(rows)


def test_cross_page_long_chain(spark):
    """Each kept row decides the next one: the worst case for rounds."""
    rows = [("A", i, 0, f"R{(i + 1) // 2}", f"t{i // 2}", "b") for i in range(24)]
    got = dedup.dedup_cross_page(frame(spark, rows), ["asin"], ["page", "pos"], group_rows=6)
    assert spots(got) == greedy(rows)


def test_rules_differ(spark):
    rows = [("A", 1, 0, "1", "a", ""), ("A", 2, 0, "2", "a", ""), ("A", 3, 0, "2", "b", "")]
    df = frame(spark, rows)
    assert [p for _, p, _ in spots(dedup.dedup_cross_page(df, ["asin"], ["page", "pos"]))] == [1, 3]
    assert [p for _, p, _ in spots(dedup.dedup_two_pass(df, ["page"]))] == [1]


def test_two_levels_stay_separate(spark):
    rows = [("A", 1, 0, "1", "a", ""), ("A", 2, 0, "1", "b", ""), ("A", 2, 1, "2", "b", "")]
    df = frame(spark, rows)
    page = dedup.dedup_page_content(dedup.dedup_page_id(df, ["asin"]), ["asin"])
    assert spots(dedup.dedup_cross_page(page, ["asin"], ["page", "pos"])) == [("A", 1, 0)]


def test_two_pass_without_text_uses_facts(spark):
    rows = [("1", "", "", "u", "2024-01-01", 4.0, ""), ("2", "", None, "u", "2024-01-02", 4.0, None),
            ("3", None, "", "u", "2024-01-01", 4.0, ""), (None, "x", "", "", "", None, ""),
            (None, "y", "", "", "", None, "")]
    df = spark.createDataFrame(rows, "review_id string, review_title string, review_body string, "
                               "reviewer_name string, review_date string, rating double, variant string")
    df = df.coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    kept = {(r["review_id"], r["review_title"]) for r in dedup.dedup_two_pass(df, ["seq"]).collect()}
    assert kept == {("1", ""), ("2", ""), (None, "x")}


def test_insert_if_absent_and_metrics(spark):
    new = frame(spark, [("A", 1, 0, "R1", "", ""), ("A", 1, 1, "R2", "", ""), ("B", 1, 2, "R2", "", "")])
    old = frame(spark, [("Z", 1, 0, "R1", "", "")])
    got = dedup.insert_if_absent(new, old, ["asin", "page", "pos"])
    assert spots(got) == [("A", 1, 1)]
    assert tuple(dedup.dedup_metrics(new, got).first()) == (3, 1, 2)


def test_keep_first_limits_before_the_shuffle(spark):
    plan = dedup.dedup_page_id(frame(spark, []), ["asin"]) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_running_equals_a_plain_scan(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randrange(5), rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq int, n int, v int")
    got = running(df, ["k"], F.floor(F.col("seq") / 7), ["seq"], sums={"total": F.col("n")},
                  firsts={"first_v": F.col("v")}, lasts={"last_v": F.col("v")})
    state, want = {}, {}
    for k, seq, n, v in rows:
        total, first, last = state.get(k, (0, None, None))
        state[k] = want[k, seq] = (total + n, v if first is None else first, last if v is None else v)
    assert {(r["k"], r["seq"]): (r["total"], r["first_v"], r["last_v"]) for r in got.collect()} == want
    numbers = ordinal(df, [], F.floor(F.col("seq") / 9), ["seq"], "n_row").collect()
    assert all(r["n_row"] == r["seq"] + 1 for r in numbers)
