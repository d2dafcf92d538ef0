"""Sources, sinks, metrics, views and maintenance on small frames."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opinia.operators import records
from opinia.operators.dedup import insert_if_absent
from opinia.plans import crawl, maintenance, metrics, views
from opinia.plans.ingest import first_writer
from opinia.schema import PAGE_RUNS, REVIEWS
from opinia.sources import readers, sinks


def review(asin="B123456789", rid="R1", **more):
    values = {"asin": asin, "review_id": rid, "verified_purchase": False, "helpful_votes": 0, **more}
    return tuple(values.get(f.name) for f in REVIEWS.fields)


def reviews(spark, *rows):
    return spark.createDataFrame(list(rows), REVIEWS)


def runs(spark, *rows):
    """Rows of (asin, star, page, parsed, saved, next, error, header)."""
    return spark.createDataFrame(
        [(a, None, s, p, n, sv, 0.1, nx, e, h, None) for a, s, p, n, sv, nx, e, h in rows], PAGE_RUNS)


def test_csv_round_trip_keeps_text(spark, tmp_path):
    body = ' "quoted", line\nbreak; é  '
    df = reviews(spark, review(review_body=body, rating=4.5, review_title="=1+1"))
    path = sinks.export_reviews(df, str(tmp_path / "out"), "csv")
    assert path.endswith(".csv")
    back = readers.read_review_csv(spark, path)
    (row,) = back.collect()
    assert back.columns == df.columns
    assert (row["review_body"], row["review_title"], row["rating"]) == (body, "=1+1", "4.5")


def test_export_rules(spark, tmp_path):
    df = reviews(spark, review(rid="R1", review_date="2024-01-01"), review(rid="R2"),
                 review(asin="C123456789", rid="R3"))
    path = sinks.export_reviews(df, str(tmp_path / "p.parquet"), "parquet", "B123456789", limit=1)
    assert path.endswith("p.parquet")
    assert [r["review_id"] for r in spark.read.parquet(path).collect()] == ["R1"]
    assert sinks.export_reviews(df, str(tmp_path / "none"), "csv", "Z123456789") is None
    assert not (tmp_path / "none.csv").exists()
    with pytest.raises(ValueError):
        sinks.export_reviews(df, "x", "json")
    with pytest.raises(ValueError):
        sinks.export_reviews(df, "x", "csv", asin="short")


def test_import_with_bom_index_and_aliases(spark, tmp_path):
    file = tmp_path / "in.csv"
    file.write_text('﻿,id,title,content,user,stars\n0,R1,"a ""b""","x\ny",u,5.0\n1,R1,t,z,u,4\n',
                    encoding="utf-8")
    df = readers.canonical_columns(readers.read_review_csv(spark, str(file)))
    assert set(df.columns) == {"_c0", "review_id", "review_title", "review_body", "reviewer_name",
                               "review_date", "rating", "variant"}
    first = df.filter("_c0 = 0").first()
    assert (first["review_title"], first["review_body"], first["variant"]) == ('a "b"', "x\ny", "")


def test_lists(spark, tmp_path):
    file = tmp_path / "codes.txt"
    file.write_text("# comment\n\nB08N5WRWNW\n  B07FZ8S74R \nbad\nB08N5WRWNW\n", encoding="utf-8")
    valid, bad = readers.read_product_list(spark, str(file))
    assert sorted((r["line_no"], r["asin"]) for r in valid.collect()) == [
        (3, "B08N5WRWNW"), (4, "B07FZ8S74R"), (6, "B08N5WRWNW")]
    assert [(r["line_no"], r["asin"]) for r in bad.collect()] == [(5, "bad")]
    empty = tmp_path / "empty.txt"
    empty.write_text("# nothing\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_product_list(spark, str(empty))
    links = tmp_path / "urls.txt"
    links.write_text("# x\nhttps://h/dp/B1\n\nhttps://h/none\nhttps://k/product-reviews/B2/?sortBy=s\n",
                     encoding="utf-8")
    got = readers.read_url_list(spark, str(links)).orderBy("line_no").collect()
    assert [(r["line_no"], r["asin"], r["domain"], r["sort"]) for r in got] == [
        (2, "B1", "h", None), (5, "B2", "k", "s")]


def test_line_numbers_over_many_splits(spark, tmp_path):
    file = tmp_path / "long.txt"
    file.write_text("".join(f"line {i}\n" for i in range(1, 3001)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = readers.numbered_lines(spark, str(file))
        assert lines.select("file").rdd.getNumPartitions() > 1
        assert lines.filter(F.concat(F.lit("line "), F.col("line_no")) != F.col("line")).count() == 0
        assert lines.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_html_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nx</p>", encoding="utf-8")
    (row,) = readers.read_html_folder(spark, str(tmp_path)).collect()
    assert row["html"] == "<p>\nx</p>" and row["url"].endswith("a.html")


def test_append_first_writer_wins(spark, tmp_path):
    path = str(tmp_path / "reviews")
    sinks.ensure_reviews_table(spark, path)
    order = ["asin", "review_date"]
    assert sinks.append_reviews(reviews(spark, review(rid="R1"), review(rid="R2")), path, order) == 2
    second = reviews(spark, review("C", "R2"), review("C", "R3"), review("C", None), review("C", "x" * 65))
    assert sinks.append_reviews(second, path, order) == 1
    sinks.ensure_reviews_table(spark, path)
    assert sorted((r["asin"], r["review_id"]) for r in readers.read_reviews(spark, path).collect()) == [
        ("B123456789", "R1"), ("B123456789", "R2"), ("C", "R3")]
    sinks.ensure_reviews_table(spark, path, reset=True)
    assert readers.read_reviews(spark, path).isEmpty()


def test_product_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "reviews")
    reviews(spark, review()).write.parquet(path)
    df = views.reviews_for_product(readers.read_reviews(spark, path), "B123456789", 5)
    plan = df.select("review_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(asin,B123456789)" in plan and "TakeOrderedAndProject" in plan
    assert "review_body" not in plan.split("ReadSchema")[1]


def test_storable_reasons(spark):
    df = reviews(spark, review(), review(rid=None), review(variant="v" * 256), review(review_title="t" * 500))
    good, bad = records.storable(df)
    assert good.count() == 2
    assert sorted(r["problem"] for r in bad.collect()) == ["review_id missing", "variant too long"]


def test_record_projection_and_defaults(spark):
    at = dt.datetime(2024, 1, 15, 10, 30)
    df = reviews(spark, review(rid="R1", created_at=at, updated_at=at.replace(microsecond=5)),
                 review(rid="R2"))
    rows = {r["review_id"]: r for r in records.project_record(df).collect()}
    assert rows["R1"]["created_at"] == "2024-01-15T10:30:00"
    assert rows["R1"]["updated_at"] == "2024-01-15T10:30:00.000005"
    assert rows["R2"]["created_at"] is None
    raw = spark.createDataFrame([(None, None, None, None), (True, "x", None, None), (False, "7", None, None)],
                                "verified_purchase boolean, helpful_votes string, created_at timestamp, "
                                "updated_at timestamp")
    got = records.coerce_defaults(raw).collect()
    assert [(r[0], r[1]) for r in got] == [(False, 0), (True, 0), (False, 7)]
    assert all(r["created_at"] for r in got)


def test_validity(spark):
    df = reviews(spark, review(review_title="t", rating=4.0), review(review_title="t", rating=6.0),
                 review(rating=4.0), review(review_body="b"))
    assert df.filter(records.is_valid_review()).count() == 2


def test_run_metrics(spark):
    df = runs(spark, ("A", "five_star", 1, 10, 8, True, None, None),
              ("A", "five_star", 2, 0, 0, True, None, 40), ("A", "five_star", 3, 4, 4, False, None, 50),
              ("A", None, 1, 2, 2, True, None, None), (None, None, 1, 1, 1, True, "boom", None))
    stats = {(r["asin"], r["star_filter"]): r for r in metrics.run_stats(df).collect()}
    five = stats["A", "five_star"]
    assert (five["total_reviews"], five["total_pages"], five["total_reviews_header"]) == (12, 3, 40)
    assert stats[None, None]["error_count"] == 1 and stats[None, None]["success"]
    (error,) = metrics.run_errors(df).collect()
    assert error["message"] == "Erreur sur la page 1: boom"
    recap = metrics.recap_sorted(metrics.labelled(df)).filter("asin = 'A'").collect()
    assert [(r["star_label"], r["pages"], r["saved"]) for r in recap] == [
        ("5 étoiles", 3, 12), ("Toutes", 1, 2)]
    done = {(r["star_filter"]): r for r in metrics.completeness(df, 5).filter("asin = 'A'").collect()}
    assert done["five_star"]["complete"] and not done[None]["complete"]
    progress = metrics.running_progress(df, 4).filter("star_filter is not null").orderBy("page").collect()
    # A quarter of the pages, then 8/40 and 12/50 of the reviews.
    assert [r["percent"] for r in progress] == [25, 20, 24]
    details = metrics.page_details(df)
    assert details.count() == 5 and details.filter("error is not null").first()["asin"] is None


def test_empty_run_counts_its_pages(spark):
    df = runs(spark, ("A", None, 1, 0, 0, True, None, None), ("A", None, 2, 0, 0, True, None, None))
    (row,) = metrics.completeness(df, 2).collect()
    assert row["total_pages"] == 2 and row["complete"]


def test_batches(spark):
    ok = metrics.run_stats(runs(spark, ("A", None, 1, 3, 3, False, None, 9)))
    broken = spark.createDataFrame([("B", "boom")], "asin string, message string").select(
        metrics.failed_run(F.col("asin"), F.col("message")).alias("s")).select("s.*")
    both = maintenance.union_runs(ok, broken)
    assert tuple(metrics.batch_totals(both).first()) == (3, 1, 2, "1/2 ok")
    assert tuple(metrics.merged_stats(both, []).first()) == (3, 1, 1, False, None, None)
    empty = metrics.batch_totals(both.filter("asin = 'none'")).first()
    assert tuple(empty) == (0, 0, 0, "0/0 ok")
    items = spark.range(1, 9).withColumnRenamed("id", "n")
    got = metrics.batch_progress(items, ["n"], F.floor(F.col("n") / 3)).orderBy("n").collect()
    assert [r["percent"] for r in got] == [12, 25, 38, 50, 62, 75, 88, 100]


def test_means_weigh_missing_ratings_as_zero(spark):
    df = reviews(spark, review(rating=4.0), review(rid="R2"))
    assert metrics.product_means(df).first()["mean_rating"] == 2.0


def test_sentiment_order_and_latest(spark):
    df = reviews(spark, review(rid="R1", rating=1.0, review_date="2024-01-03"),
                 review(rid="R2", rating=5.0), review(rid="R3", rating=5.0, review_date="2024-01-02"),
                 review(rid="R4", rating=3.0))
    ordered = views.sort_by_sentiment(views.with_sentiment(df))
    assert [r["review_id"] for r in ordered.collect()] == ["R3", "R2", "R4", "R1"]
    assert views.latest(df, "B123456789", 2).columns == ["review_id", "review_date", "rating"]
    assert [r["review_id"] for r in views.latest(df, "B123456789", 3).collect()] == ["R1", "R3", "R2"]
    assert [r["rank"] for r in views.latest_per_product(df, 2).collect()] == [1, 2]


def test_migration(spark):
    at, now = dt.datetime(2020, 1, 1), dt.datetime(2025, 1, 1)
    df = reviews(spark, review(rid="R1", review_title="5,0 sur 5 étoiles Bon", updated_at=at),
                 review(rid="R2", review_title="Bon", updated_at=at), review(rid="R3", updated_at=at))
    got = {r["review_id"]: (r["review_title"], r["updated_at"])
           for r in maintenance.migrate_titles(df, now=F.lit(now)).collect()}
    assert got == {"R1": ("Bon", now), "R2": ("Bon", at), "R3": (None, at)}
    assert tuple(maintenance.migration_metrics(df).first()) == (3, 1)
    older = df.withColumn("created_at", F.when(F.col("review_id") == "R1", F.lit(now)).otherwise(F.lit(at)))
    kept = {r["review_id"]: r["review_title"] for r in maintenance.migrate_titles(older, limit=2).collect()}
    assert kept == {"R1": "5,0 sur 5 étoiles Bon", "R2": "Bon", "R3": None}
    assert maintenance.migrate_titles(older, limit=3).filter("review_title = 'Bon'").count() == 2


def test_upsert_keeps_the_row_updated_last(spark):
    at = [dt.datetime(2020, 1, day) for day in (1, 2, 3)]
    stored = reviews(spark, review(rid="R1", review_title="a", updated_at=at[1]), review(rid="R2", updated_at=at[1]),
                     review(rid=None), review(rid="R3"))
    new = reviews(spark, review(rid="R1", review_title="b", updated_at=at[0]), review(rid=None),
                  review(rid="R2", review_title="c", updated_at=at[1]), review(rid="R4", review_title="d"),
                  review(rid="R3", review_title="e", updated_at=at[2]))
    rows = sorted(((r["review_id"], r["review_title"]) for r in maintenance.upsert(stored, new).collect()), key=str)
    assert rows == [("R1", "a"), ("R2", "c"), ("R3", "e"), ("R4", "d"), (None, None), (None, None)]


def test_tranches_are_written_from_five_to_one(spark):
    rows = spark.createDataFrame(
        [("A", None, star, 1, 0, "R1") for star in ("one_star", "three_star", None, "four_star")],
        "asin string, domain string, star_filter string, page int, pos int, review_id string")
    existing = reviews(spark, review(rid="other"))
    (row,) = insert_if_absent(rows, existing, first_writer(rows)).collect()
    assert row["star_filter"] == "four_star"


def test_appended_rows_get_defaults(spark, tmp_path):
    path, now = str(tmp_path / "reviews"), dt.datetime(2024, 5, 6)
    sinks.ensure_reviews_table(spark, path)
    assert sinks.append_reviews(reviews(spark, review(verified_purchase=None, helpful_votes=None)), path, ["asin"],
                                F.lit(now)) == 1
    (row,) = readers.read_reviews(spark, path).collect()
    assert (row["verified_purchase"], row["helpful_votes"], row["created_at"], row["updated_at"]) == (False, 0, now, now)


def test_distribution_and_timeline(spark):
    df = reviews(spark, review(rating=4.5, review_date="2024-01-05"), review(rating=4.0, review_date="2024-01-31"),
                 review(review_date="2024-02-01"), review(rating=1.0))
    stars = {r["stars"]: r["reviews"] for r in metrics.rating_distribution(df).collect()}
    assert stars == {4: 2, 1: 1, None: 1}
    months = {r["month"]: (r["reviews"], r["mean_rating"]) for r in metrics.review_timeline(df).collect()}
    assert months == {"2024-01": (2, 4.25), "2024-02": (1, None), None: (1, 1.0)}


def test_crawl_plan_and_gap(spark):
    urls = spark.createDataFrame([("A", "h", None)], "asin string, domain string, language string")
    plan = crawl.crawl_plan(urls, max_pages=3)
    assert plan.count() == 15
    assert [r["star_filter"] for r in crawl.star_tranches(urls).orderBy("star_rank").collect()][0] == "five_star"
    one = crawl.crawl_plan(urls, star="two_star", max_pages=2)
    assert {r["star_filter"] for r in one.collect()} == {"two_star"}
    gap = crawl.plan_gap(one, one.filter("page = 1"))
    assert [r["page"] for r in gap.collect()] == [2]


def files_by_bucket(path):
    return {p.parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in Path(path).glob("bucket=*/*.parquet")}


def test_batches_touch_their_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "reviews")
    sinks.ensure_reviews_table(spark, path)
    rows = [review(rid=f"R{i}", review_title=f"title {i}") for i in range(60)]
    sinks.append_reviews(reviews(spark, *rows), path, ["review_id"])
    before = files_by_bucket(path)
    assert len(before) == sinks.REVIEW_BUCKETS
    assert sinks.append_reviews(reviews(spark, *rows[:9]), path, ["review_id"]) == 0
    assert files_by_bucket(path) == before
    # Newer rows replace the stored ones; only their buckets are rewritten.
    newer = reviews(spark, review(rid="R1", review_title="new"), review(rid="R99", review_title="other")).withColumn(
        "updated_at", F.lit(dt.datetime(2999, 1, 1)))
    touched = {f"bucket={r.bucket}" for r in sinks.bucketed(newer).collect()}
    sinks.upsert_reviews(newer, path)
    after = files_by_bucket(path)
    assert {b for b in before if before[b] != after[b]} == touched
    titles = {r.review_id: r.review_title for r in readers.read_reviews(spark, path).collect()}
    assert titles == {f"R{i}": f"title {i}" for i in range(60)} | {"R1": "new", "R99": "other"}


def test_migration_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path, now = str(tmp_path / "reviews"), F.lit(dt.datetime(2024, 5, 6))
    sinks.ensure_reviews_table(spark, path)
    rows = [review(rid=f"R{i}", review_title="5 out of 5 stars good" if i % 3 == 0 else "good") for i in range(30)]
    sinks.append_reviews(reviews(spark, *rows), path, ["review_id"])
    before, replace, done = files_by_bucket(path), sinks._replace, []

    def stop_after_one(rows, path):
        if done:
            raise RuntimeError("stopped")
        done.append(replace(rows, path))

    monkeypatch.setattr(sinks, "_replace", stop_after_one)
    with pytest.raises(RuntimeError):
        sinks.migrate_table(spark, path, now, per_commit=2)
    half = files_by_bucket(path)
    assert sum(before[b] != half[b] for b in before) == 2
    monkeypatch.setattr(sinks, "_replace", replace)
    rest = sinks.migrate_table(spark, path, now, per_commit=2)
    after = files_by_bucket(path)
    assert {b for b in half if half[b] != after[b]} == {f"bucket={b}" for commit in rest for b in commit}
    assert {r.review_title for r in readers.read_reviews(spark, path).collect()} == {"good"}
    assert sinks.migrate_table(spark, path, now) == []


def test_newest_run_by_its_folder(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert_rows = [("2024-01", 1), ("2024-02", 2), ("2024-02", 3), ("10", 4), (None, 5), ("2024-03 a/x", 6)]
    df = spark.createDataFrame(assert_rows, "run_id string, n int")
    sinks.write_run(df.filter("n < 6"), path)
    assert sinks.newest_run(spark, path) == "2024-02"
    found = sinks.last_run(spark, path)
    assert sorted(r["n"] for r in found.collect()) == [2, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    # A run written again replaces itself; others stay.
    sinks.write_run(df.filter("n = 3"), path)
    assert [r["n"] for r in sinks.last_run(spark, path).collect()] == [3]
    sinks.write_run(df.filter("n = 6"), path)
    assert [tuple(r) for r in sinks.last_run(spark, path).select("n", "run_id").collect()] == [(6, "2024-03 a/x")]
    assert spark.read.parquet(path).count() == 5


def test_counts_of_the_write_itself(spark, tmp_path):
    rows = [review(rid="R1"), review(rid="R1", review_title="again"), review(rid="R2"), review("C", "R2"), review(rid=None)]
    path = str(tmp_path / "out")
    counts = sinks.write_unique(reviews(spark, *rows), path, "parquet", ["asin", "review_title"])
    assert counts["rows_before"] == 5 and counts["rows_after"] == spark.read.parquet(f"{path}.parquet").count()
    assert counts["removed"] == 5 - counts["rows_after"] > 0
    assert sinks.write_unique(reviews(spark).filter("false"), path, "csv", ["asin"]) == {
        "rows_before": 0, "rows_after": 0, "removed": 0}
