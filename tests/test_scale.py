"""Queries and derived inputs on small tables of their own: odd rows, what is moved, what is stored."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from opinia.functions import dates, ratings, text
from opinia.operators import dedup
from opinia.operators.ranking import running
from opinia.operators.records import conform
from opinia.schema import PAGES
from opinia.sources import csv_blocks, sinks
from opinia.streaming import pages as streams
from workload import derive
from workload.queries import QUERIES

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate date")


def line(order, part, number=1, tax=0.01):
    return (order, part, 3, number, 5.0, 10.0, 0.0, tax, "A", "O", datetime.date(2024, 1, 15))


@pytest.fixture
def tables(spark, tmp_path):
    """Writes lineitem, part and documents; returns their folder."""

    def build(lines, parts, docs):
        for name, rows, schema in (("lineitem", lines, LINE), ("part", parts, "p_partkey long, p_name string, p_type string"),
                                   ("documents", docs, "doc_id long, text string")):
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return build



def stored_files(spark):
    return sum(len(files) for _, _, files in os.walk(derive.scratch_path(spark, "x").rpartition("/")[0].removeprefix("file:")))


def test_running_moves_rows_once(spark):
    """The window and the join with the offsets share one exchange of the rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.lit(1).alias("wide"))
        plan = running(rows, ["k"], F.floor(F.col("seq") / 10), ["seq"], sums={"n": F.lit(1)})
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Rows by key and bucket; sums by key and bucket, by key, and back to their buckets.
    assert text.count("Exchange hashpartitioning") == 4, text


def test_running_nulls_and_totals(spark):
    rows = spark.createDataFrame([(None, None, 1), (None, None, 2), (None, 3, 3), ("a", None, 4), ("a", 12, 5)],
                                 "k string, seq int, n int")
    got = running(rows, ["k"], F.floor(F.col("seq") / 10), ["seq", "n"], sums={"so_far": F.col("n")},
                  totals={"of": F.col("n")})
    assert sorted((r["n"], r["so_far"], r["of"]) for r in got.collect()) == [
        (1, 1, 6), (2, 3, 6), (3, 6, 6), (4, 4, 9), (5, 9, 9)]


def test_derived_pages_are_not_stored(spark, tables):
    sf_dir = tables([line(1, 7), line(2, 7), line(3, 8)], [(7, "n", "t"), (8, "m", "t")], [(1, "first")])
    before = stored_files(spark)
    assert derive.captured_pages(spark, sf_dir).count() == 2
    assert derive.raw_reviews(spark, sf_dir).count() == 3
    assert stored_files(spark) == before


def test_texts_belong_to_the_first_orders(spark, tables):
    """Copies of a part multiply its lines; the null order takes a text that no line gets."""
    sf_dir = tables([line(None, 7), line(5, 7), line(6, 7), line(9, 8), line(9, 7, 2)],
                    [(7, "seven", "t"), (7, "seven", "t"), (8, "eight", "t")], [(None, "zero"), (4, "four"), (4, "four")])
    got = sorted((str(r["l_orderkey"]), r["body"].partition("\x1f")[0]) for r in derive.raw_reviews(spark, sf_dir).collect())
    seven, eight = "Avis:\tseven  t\nlot 2", "Avis:\teight  t\nlot 2"
    assert got == sorted([("None", seven)] * 2 + [("5", "Avis:\tfour")] * 2 + [("6", "Avis:\tfour")] * 2
                         + [("9", eight)] + [("9", seven)] * 2)


def test_pages_know_whether_another_follows(spark, tables):
    lines = [line(i, 7) for i in range(11)] + [line(i, 8) for i in range(10)] + [line(i, None) for i in range(12)]
    sf_dir = tables(lines, [(7, "n", "t"), (8, "m", "t")], [])
    got = {(r["asin"], r["page"]): "pageNumber=" in r["html"].partition("a-pagination")[2]
           for r in derive.captured_pages(spark, sf_dir).filter("html IS NOT NULL").collect()}
    assert got == {("B000000007", 1): True, ("B000000007", 2): False, ("B000000008", 1): False,
                   (None, 1): False}


def test_export_of_a_product_without_reviews(spark, tables):
    """Nothing is written, and nothing comes back."""
    sf_dir = tables([line(1, 8)], [(8, "m", "t")], [(1, "text")])
    got = QUERIES["export_product_limit"](spark, sf_dir)
    assert got.columns == ["asin", "review_id", "review_date", "rating", "columns"] and got.count() == 0


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


REVIEWED = "asin string, page int, pos int, review_id string, review_title string, review_body string"


def test_page_rules_move_no_texts(spark):
    """Both in-page rules compare hashes made before the first exchange."""
    rows = spark.createDataFrame([
        ("A", 1, 0, "R1", "t", "b"), ("A", 1, 1, "R1", "other", "b"), ("A", 1, 2, "R2", "t", " b\n"), ("A", 1, 3, None, "u", None),
        ("A", 2, 0, "R1", "t", "b"), (None, 1, 0, "", None, None), (None, 1, 1, "R4", "", "")], REVIEWED)
    got = dedup.dedup_page(rows, ["asin"])
    same = dedup.dedup_page_content(dedup.dedup_page_id(rows, ["asin"]), ["asin"])
    assert got.columns == same.columns and sorted(map(str, got.collect())) == sorted(map(str, same.collect()))
    moved = executed(got.select("asin", "page", "pos", "review_id")).rpartition("Exchange")[0]
    assert "Exchange" in moved and "review_body" not in moved


def test_short_runs_have_their_keys_moved_once(spark, monkeypatch):
    rows = spark.createDataFrame([
        ("A", 1, 0, "R1", "t", "b"), ("A", 1, 1, "R1", "t", "b"), ("A", 2, 0, "R2", "t", "b"), ("A", 2, 1, "R2", "u", ""),
        ("A", 3, 0, None, "u", ""), ("A", 3, 1, "", "v", None), ("A", 3, 2, None, "v", ""), (None, 1, 0, "R1", "t", "b"),
        (None, 1, 1, None, "t", "b"), ("B", 1, 0, "R1", None, None)], REVIEWED)
    wanted = [["A", 1, 0], ["A", 2, 1], ["A", 3, 1], ["B", 1, 0], ["None", 1, 0]]
    passes = []
    plain = dedup._ordered_pass
    monkeypatch.setattr(dedup, "_ordered_pass", lambda df, *how: passes.append(executed(df)) or plain(df, *how))
    for group_rows in (100, 7, 6, 1):
        got = dedup.dedup_cross_page(rows, ["asin"], ["page", "pos"], group_rows)
        assert sorted([str(r["asin"]), r["page"], r["pos"]] for r in got.collect()) == wanted
    assert "Exchange" not in passes[0] and "Exchange" not in passes[1] and "Exchange" in passes[2]


def test_keys_move_as_bytes(spark):
    rows = spark.createDataFrame([], REVIEWED)
    assert "unhex" in executed(dedup.dedup_two_pass(rows, ["pos"], ["asin"])).rpartition("Exchange")[2]
    assert dict(rows.withColumn("p", dedup._pair()).dtypes)["p"] == "binary"


def test_paged_rows_are_those_of_placed_typed_rows(spark, tables):
    lines = [line(i % 9, 7 + i % 2, 1 + i % 7, 0.01 * (i % 3)) for i in range(30)] + [line(None, None)]
    sf_dir = tables(lines, [(7, "seven", "t"), (7, "seven", "t"), (8, "eight", "t")], [(1, "one"), (2, "two"), (3, None)])
    got, plain = derive.paged(spark, sf_dir), derive.with_pages(derive.typed(spark, sf_dir))
    assert sorted(got.columns) == sorted(plain.columns)
    # Repeated parts make repeated lines, whose order is open: compare what does not depend on it.
    wanted = [c for c in plain.columns if c not in ("page", "pos")]
    assert sorted(map(str, got.select(wanted).collect())) == sorted(map(str, plain.select(wanted).collect()))
    assert sorted(map(str, got.select("asin", "page", "pos").collect())) == sorted(
        map(str, plain.select("asin", "page", "pos").collect()))
    shuffled = executed(got.filter("pos = 0").select("review_body"))
    depths = {name: [len(found) - len(found.lstrip(" :+-")) for found in shuffled.splitlines() if name in found] for name in ("review_body", "Window [")}
    assert max(depths["review_body"]) < min(depths["Window ["])


def test_lines_of_a_product_are_moved_to_their_pages_once(spark, tables):
    lines = [line(i % 9, 7 + i % 2, 1 + i % 7, 0.01 * (i % 3)) for i in range(48)] + [line(5, None), line(None, None)]
    sf_dir = tables(lines, [(7, "seven", "t"), (8, "eight", "t")], [(1, "one"), (2, "two"), (2, "two"), (3, None)])
    small = derive.captured_pages(spark, sf_dir)
    assert "Exchange" not in executed(small).partition("Window [")[0]
    some = ["asin", "domain", "star_filter", "page", "url", "started_at", "finished_at"]
    rows = [sorted(map(str, pages.select(*some, F.length("html")).collect()))
            for pages in (small, derive._captured_pages(spark, sf_dir, 10), derive._captured_pages(spark, sf_dir, 0))]
    assert len(rows[0]) == 7 and rows[0] == rows[1] == rows[2]


def test_csv_records_stay_where_they_are(spark, tmp_path):
    """Only tables of one row per split are joined to records."""
    (tmp_path / "a.csv").write_text('id,title\n1,"two\nlines"\n2,x\n', encoding="utf-8")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = csv_blocks.read_records(spark, str(tmp_path))
        assert "SortMergeJoin" not in executed(records) and records.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def counted(spark, rows):
    """The rows, and how many of them were evaluated so far."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def see(_):
        seen.add(1)
        return True

    return rows.filter(see("review_id")), seen


def test_exports_evaluate_their_rows_once(spark, tmp_path, monkeypatch):
    plain = spark.range(50).select(
        F.format_string("R%02d", "id").alias("review_id"), F.lit("B000000007").alias("asin"), F.lit("t").alias("review_title"),
        F.lit("b").alias("review_body"), F.lit(4.0).alias("rating"), F.lit("2024-01-01").alias("review_date"),
        F.timestamp_seconds("id").alias("created_at"), F.lit("r1").alias("run_id"))
    rows, seen = counted(spark, plain)
    path = sinks.export_reviews(rows, str(tmp_path / "all"), "parquet")
    assert seen.value == 50 and spark.read.parquet(path).count() == 50
    assert sinks.export_reviews(rows, str(tmp_path / "none"), "csv", "B000000008") is None

    sinks.write_run(plain, str(tmp_path / "runs"))
    views = []
    view = sinks.quality_view

    def counting(*args):
        shown, seen = counted(spark, view(*args).limit(50))
        views.append(seen)
        return shown

    monkeypatch.setattr(sinks, "quality_view", counting)
    out = sinks.export_last_run(spark, str(tmp_path / "runs"), str(tmp_path / "last"), "parquet", ["created_at"])
    assert spark.read.parquet(out).count() == 1 and [v.value for v in views] == [1]


def test_date_patterns_run_on_texts_that_can_match(spark):
    """Signs decide which patterns run; texts with and without them read as before."""
    shown = {"le 1er mai 2024": "2024-05-01", "1ER Mai 2024 x": "2024-05-01", "3 mai 2024, 1er juin 2024": "2024-05-03",
             "Reviewed on 5 March 2024": "2024-03-05", "March 5, 2024": "2024-03-05", "5 de marzo de 2024": "2024-03-05",
             "5. März 2024": "2024-03-05", "5/3/2024": "2024-03-05", "2024-3-5": "2024-03-05", "5.3.2024": "2024-03-05",
             "31 février 2024": "2024-02-31", "": None, "de, le / -": None, None: None}
    rows = spark.createDataFrame(list(shown.items()), "text string, want string")
    read = rows.select("text", "want", dates.normalize_date(F.col("text")).alias("got"))
    assert [(r["text"], r["got"]) for r in read.collect()] == list(shown.items())
    plan = executed(read)
    assert all(f", {sign})" in plan for sign in ("1er", "le", "/", "-", "de"))


def test_short_texts_are_read_once(spark):
    """A number, or the groups of a date, found once is not looked for again; signs decide which patterns run."""
    shown = {"4,5 sur 5 étoiles": 4.5, "4 sur 5": 4.0, "9,5 sur 5, 3 sur 5": None, "4.0 out of 5 stars": 4.0, "3": 3.0, "3,0": 3.0,
             "3.0\n": 3.0, "9.5": None, "12 sur 5": None, "sur 5": None, "": None, None: None}
    votes = {"12 personnes ont trouvé cela utile": 12, "3: 4 people found this helpful": 4, "a 7 utile": 7, "1,2": 1,
             "utile": 0, "99999999999": 0, "": 0, None: 0}
    for texts, read, most in ((shown, ratings.normalize_rating, 6), (votes, text.normalize_helpful_votes, 8),
                              (dict.fromkeys(shown), dates.normalize_date, 40)):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", read(F.col("text")).alias("got"))
        assert {r["text"]: r["got"] for r in rows.collect()} == texts
        assert executed(rows).count("regexp_extract(") <= most


def test_append_evaluates_records_once(spark, tmp_path):
    """The storage checks do not evaluate the texts again; of an id, the first row that fits is stored."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def see(title):
        seen.add(1)
        return title

    path = str(tmp_path / "reviews")
    sinks.ensure_reviews_table(spark, path)
    long = "t" * 600
    plain = conform(spark.createDataFrame(
        [("A", "R1", long, 1), ("A", "R1", "second", 2), ("A", "R1", "third", 3), ("A", "R2", long, 1), (None, "R3", "x", 1),
         ("A", None, "x", 1), ("A", "R4", None, 2), ("A", "R4", "later", 3)], "asin string, review_id string, review_title string, n int").withColumn(
        "created_at", F.timestamp_seconds("n")))
    assert sinks.append_reviews(plain.withColumn("review_title", see("review_title")), path, ["created_at"]) == 2
    assert seen.value == 8
    assert sinks.append_reviews(plain, path, ["created_at"]) == 0
    assert sinks.append_reviews(plain.withColumn("review_id", F.concat("review_id", F.lit("x"))).unionByName(plain), path, ["created_at"]) == 2
    assert sinks.append_reviews(plain.filter("false"), path, ["created_at"]) == 0
    stored = sorted((r["review_id"], r["review_title"]) for r in spark.read.parquet(path).collect())
    assert stored == [("R1", "second"), ("R1x", "second"), ("R4", None), ("R4x", None)]


def test_rows_in_between_are_compressed_columns(spark, tmp_path):
    """Batches that an append, an upsert or a micro-batch reads again lie in its scratch space as compressed columns."""
    def scratch(name):
        folder = derive.scratch_path(spark, "x").rpartition("/")[0].removeprefix("file:")
        return {f for f in os.listdir(folder) if f.startswith(f"{name}-")}

    before = {name: scratch(name) for name in ("ready", "decided")}
    table, source = str(tmp_path / "reviews"), str(tmp_path / "src")
    sinks.ensure_reviews_table(spark, table)
    page = '<div data-hook="review"><a data-hook="review-title" href="/reviews/R1">t</a></div>'
    spark.createDataFrame([("A", None, None, 1, "u", page, None, None, None)], PAGES).write.parquet(source)
    streams.stream_ingest(streams.read_page_stream(spark, source), table, str(tmp_path / "rejects"),
                          str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    assert {name: len(scratch(name) - before[name]) for name in before} == {"ready": 1, "decided": 1}
