"""Streams on a handful of pages: status counts, order of arrival, one table, rejects, replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opinia.operators.records import conform
from opinia.schema import PAGES
from opinia.sources import readers, sinks
from opinia.streaming import pages as streams
from opinia.streaming import state


def block(rid, title):
    return (f'<div data-hook="review"><a data-hook="review-title" href="/reviews/{rid}">{title}</a>'
            "</div>")


def pages(spark, *rows, asin="A", run=None):
    return spark.createDataFrame(
        [(asin, None, None, page, "u", html, None, None, run) for page, html in rows], PAGES)


def test_page_loop_over_arrivals(spark, tmp_path):
    source, table, rejects, state, counts, state2 = (
        str(tmp_path / n) for n in ("src", "table", "rejects", "state", "counts", "state2"))
    now = dt.datetime(2024, 5, 6)
    sinks.ensure_reviews_table(spark, table)
    stored = [("A", "R0", "stored before"), ("A", None, "no id"), ("B", "R9", "other")]
    frame = spark.createDataFrame(stored, "asin string, review_id string, review_title string")
    sinks.append_reviews(conform(frame), table, ["asin"], F.lit(now))
    arrivals = [
        pages(spark, (1, block("R1", "a") + block("R1", "x") + block("R0", "z")), (2, block("R2", "a"))),
        # R2 was dropped, so it leaves no trace; R1 and content "a" were kept.
        pages(spark, (3, block("R2", "b") + block("R3", "a") + block("R1", "c")), (4, "captcha"), (None, block("R7", "lost"))),
        pages(spark, (5, block("R" + "8" * 70, "long id") + block("R5", "t" * 600))),
    ]
    for arrival in arrivals:
        arrival.write.mode("append").parquet(source)
        stream = streams.read_page_stream(spark, source)
        streams.stream_ingest(stream, table, rejects, state, F.lit(now)).awaitTermination()
        streams.stream_status_counts(stream, counts, state2).awaitTermination()
    rows = readers.read_reviews(spark, table).collect()
    assert sorted((r["asin"], r["review_id"], r["review_title"]) for r in rows) == [
        ("A", "R0", "stored before"), ("A", "R1", "a"), ("A", "R2", "b"), ("B", "R9", "other")]
    assert all(r["created_at"] == now and r["helpful_votes"] == 0 for r in rows)
    status = streams.latest_metrics(spark, counts, ["page_status"]).collect()
    assert {r["page_status"]: r["pages"] for r in status} == {"ok": 5, "challenge": 1}
    quarantined = spark.read.parquet(f"{rejects}/quarantined").collect()
    assert [(r["asin"], r["page"], r["status"]) for r in quarantined] == [("A", 4, "challenge")]
    problems = sorted(r["problem"] for r in spark.read.parquet(f"{rejects}/unstorable").collect())
    assert problems == ["review_id too long", "review_title too long"]
    # The rows of a batch that runs again are in their buckets already.
    assert sinks.append_reviews(readers.read_reviews(spark, table), table, ["review_id"]) == 0


def greedy(rows):
    seen, out = {}, []
    for run, asin, page, pos, rid, title in rows:
        keys = seen.setdefault((run, asin), set())
        if ("i", rid) not in keys and ("c", title) not in keys:
            keys |= {("i", rid), ("c", title)}
            out.append((run, asin, page, pos))
    return sorted(out, key=str)


@pytest.mark.parametrize("files_per_batch", [1, 64])
def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path, files_per_batch):
    draw = random.Random(8)
    places, files = [], []
    for run, asin in (("r1", "A"), ("r1", "B"), ("r2", "A"), (None, "A")):
        for page in range(1, 7):
            found = [(f"R{draw.randrange(12)}", f"t{draw.randrange(9)}") for _ in range(4)]
            ids, titles, pos = set(), set(), 0
            for pos, (rid, title) in enumerate(found):  # the in-page rules
                if rid in ids:
                    continue
                ids.add(rid)
                if title not in titles:
                    places.append((run, asin, page, pos, rid, title))
                titles.add(title)
            files.append((run, asin, page, "".join(block(*f) for f in found)))
    source, kept, state = (str(tmp_path / n) for n in ("src", "kept", "state"))
    draw.shuffle(files)
    for part in (files[:9], files[9:]):
        for run, asin, page, html in part if files_per_batch == 1 else []:
            pages(spark, (page, html), asin=asin, run=run).coalesce(1).write.mode("append").parquet(source)
        if files_per_batch > 1:
            rows = [(asin, None, None, page, "u", html, None, None, run) for run, asin, page, html in part]
            spark.createDataFrame(rows, PAGES).write.mode("append").parquet(source)
        streams.stream_dedup(streams.read_page_stream(spark, source, files_per_batch), kept, state).awaitTermination()
    got = sorted(((r.run_id, r.asin, r.page, r.pos) for r in spark.read.parquet(kept).collect()), key=str)
    assert got == greedy(places)


def test_progress_of_late_pages(spark, tmp_path):
    total = '<div data-hook="cr-filter-info-review-count">{}</div>'
    source, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    found = [(1, block("R1", "a") + block("R2", "b")), (2, total.format(8) + block("R3", "c") + block("R1", "d")),
             (3, "captcha"), (4, total.format(99) + block("R4", "e") + block("R5", "f"))]
    for some in ([found[3]], [found[1], found[2]], [found[0]]):
        pages(spark, *some).write.mode("append").parquet(source)
        streams.stream_progress(streams.read_page_stream(spark, source, 1), out, state, 5).awaitTermination()
    rows = sorted((r.page, r.saved_so_far, r.known_total, r.percent) for r in spark.read.parquet(out).collect())
    assert rows == [(1, 2, None, 20), (2, 3, 8, 38), (4, 5, 8, 62)]


def test_failed_pages_in_their_narrow_form(spark):
    rows = spark.createDataFrame([("ok", None, 1), ("ok", "ValueError: x", 2)], "status string, error string, page int")
    (row,) = streams.failed(rows.withColumn("duration_s", F.lit(1.5))).collect()
    assert tuple(row) == (2, 0, 0, 1.5, False, "ValueError: x")


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    assert streams.earlier(spark, path, 0) is None
    for _ in range(2):
        streams.write_batch(spark.range(3), path, 0)
        streams.write_batch(spark.range(3, 5), path, 1)
    assert spark.read.parquet(path).count() == 5
    assert streams.earlier(spark, path, 1).count() == 3
    assert streams.earlier(spark, path, 0).count() == 0


class FakeState:
    """List and map state of one run, with the number of single calls."""

    def __init__(self):
        self.rows, self.map, self.calls = [], {}, 0

    def get(self):
        return iter(self.rows)

    def appendList(self, rows):
        self.rows += rows

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value


def test_keys_of_a_run_are_read_and_written_at_once(monkeypatch):
    """A list up to its limit, one by one beyond it; a run without a list goes on in its map."""
    monkeypatch.setattr(state, "LISTED_KEYS", 5)
    fake = FakeState()
    for begun, keys, calls in ((False, "abcd", 0), (True, "abef", 1), (True, "fgag", 4)):
        held = state._Keys(fake, fake, begun)
        for key in keys:
            if not held.holds(key):
                held.add(key, 1)
        held.store()
        assert fake.calls == calls, begun
    assert [k for k, in fake.rows] == list("abcde") and sorted(fake.map) == [("f",), ("g",)]
    old = FakeState()
    old.map = {("a",): 1}
    held = state._Keys(old, old, True)
    assert held.holds("a") and not held.holds("b")
    held.add("b", 2)
    held.store()
    assert not old.rows and ("b",) in old.map
