"""Toxicity, mixing and the pipeline."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from opinia.llm import queries, source_mixing, toxicity
from opinia.llm.common import reliable_checkpoint
from opinia.llm.queries import ORACLE_SQL, QUERIES

from .conftest import EDGE, groups
from .test_dedup import exact_expected, print_expected

ROOT = "/root/testdata/sf0.001"


def corpus(count, seed=3):
    drawn = random.Random(seed)
    words = ["".join(drawn.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(drawn.randint(1, 4)))
             for _ in range(3000)]
    for i in range(count):
        text = [drawn.choice(words) for _ in range(drawn.randint(20, 120))]
        toxic = drawn.random() < 0.2
        if toxic:
            for _ in range(drawn.randint(2, 8)):
                text.insert(drawn.randrange(len(text)), drawn.choice(["grumbold", "skitterfang", "blorpish"]))
        yield i, " ".join(text), int(toxic)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = list(corpus(1200))
    return (spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"),
            spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"), {i: x for i, _, x in rows})


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels.unionByName(labels))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((found[i] >= 0.5) == truth[i] for i in held) / len(held)
    assert right > 0.95 and set(found) == set(truth)
    kept = {r.doc_id for r in toxicity.keep(docs, model).collect()}
    assert kept == {i for i, s in found.items() if s < 0.5}


def test_labels_of_held_out_rows_change_nothing(labelled):
    docs, labels, _ = labelled
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_toxicity_of_odd_rows(labelled, edge, nothing):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    scores = [r.score for r in toxicity.score(edge, model).collect()]
    assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(nothing, model).collect() == [] and toxicity.keep(nothing, model).collect() == []
    assert toxicity.train(docs, labels.filter("false")) == 0.0
    assert toxicity.train(docs, labels.filter("toxic = 1")) == 1.0
    assert {r.score for r in toxicity.score(edge, 0.25).collect()} == {0.25}


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 3, "c": 1}, {str(i): i + 1 for i in range(25)}])
def test_schedule_deviates_by_less_than_a_block(weights):
    placed, period = source_mixing.schedule(weights), sum(weights.values())
    assert [slot for _, _, slot, _, _ in placed] == list(range(period))
    done = dict.fromkeys(weights, 0)
    for source, turn, slot, release, deadline in placed:
        assert turn == done[source] and release <= slot < deadline
        done[source] += 1
        assert all(abs(done[s] - w * (slot + 1) / period) < 1 for s, w in weights.items())
    assert done == weights


def test_mix_places_every_row(spark, edge, nothing):
    drawn = random.Random(8)
    rows = [(i, drawn.choice(["hot"] * 6 + ["a", "b", None]), "t") for i in range(5000)] + [(None, "a", "t"), (7, "a", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, position string").repartition(6)
    weights = {"hot": 2.0, "a": 5.0, "b": 1.0}
    found = source_mixing.mix(docs, weights, block_rows=4).collect()
    assert {(r.doc_id, r.source) for r in found} == {(i, s) for i, s, _ in rows}
    assert len(found) == len(set(rows)) == len({r.position for r in found})
    assert all(r.release <= r.slot < r.deadline and r.position // 4 == r.slot for r in found)
    slots = {}
    for r in found:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    first = sorted(s for s, r in slots.items())[:80]
    share = sum(slots[s][0] == "a" for s in first) / 80
    assert abs(share - 5 / 8) < 0.03  # the missing source has one slot a period
    again = {(r.doc_id, r.source, r.position) for r in source_mixing.mix(docs.repartition(2), weights, block_rows=4).collect()}
    assert again == {(r.doc_id, r.source, r.position) for r in found}
    assert source_mixing.mix(nothing).collect() == []
    order = source_mixing.in_mixed_order(edge)
    assert order.columns == edge.columns and order.count() == len(EDGE)
    with pytest.raises(ValueError):
        source_mixing.mix(docs, {"a": 0.0})


def furthest(order, weights):
    """The largest deviation, over all prefixes, from shares by the weights of the sources that are left."""
    counts = {s: order.count(s) for s in set(order)}
    target, done, most = dict.fromkeys(counts, 0.0), dict.fromkeys(counts, 0), 0.0
    for source in order:
        unit = 1.0
        while unit > 1e-9:
            left = [s for s in counts if target[s] < counts[s] - 1e-9]
            total = sum(weights[s] for s in left)
            step = min(unit, *((counts[s] - target[s]) * total / weights[s] for s in left))
            for s in left:
                target[s] += step * weights[s] / total
            unit -= step
        done[source] += 1
        most = max(most, *(abs(done[s] - target[s]) for s in counts))
    return most


@pytest.mark.parametrize("counts, weights", [
    ({"hot": 1900} | {f"s{i}": 190 + i for i in range(19)}, None),  # the share of hot is not a whole part of 200
    ({f"s{i:03}": 4 for i in range(400)}, {f"s{i:03}": 3 if i % 2 else 1 for i in range(400)}),
    ({f"s{i:04}": 2 for i in range(1200)}, {f"s{i:04}": 1.5 if i % 3 else 0.5 for i in range(1200)}),
    ({"a": 900, "b": 900, "rare": 3}, {"a": 1.0, "b": 0.7, "rare": 0.0009}),
])
def test_mix_follows_the_weights_as_given(spark, counts, weights):
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    found = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1).collect()
    assert sorted((r.doc_id, r.source) for r in found) == rows
    assert sorted(r.slot for r in found) == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in found)
    order = [r.source for r in sorted(found, key=lambda r: r.position)]
    assert furthest(order, weights or {s: n**0.5 for s, n in counts.items()}) < 1 + 1e-6


def test_stages_against_brute_force(spark):
    """Every stage on what the one before it kept, over the smallest tables."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(reliable_checkpoint(stage(spark, kept[-1], ROOT)))
    assert all(k.columns == columns for k in kept[1:-1])
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    model = toxicity.train(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s < 0.5}
    exact = exact_expected(list(rows[1].items()))
    assert set(rows[2]) == {r[0] for r in exact if r[3]}
    prints = {i: print_expected(t) for i, t in rows[2].items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert set(rows[3]) == {i for i, root in groups(near, prints).items() if i == root}
    assert rows[4] == rows[3]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = {r.doc_id: r.n_tokens for r in kept[-1].collect()}
    assert counts == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows[4].items()}


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_dedup_stages_judge_rows_and_not_ids(spark, stage):
    first, second, third = ("the quick brown fox jumps over one lazy dog", "numbers and letters stand in long straight rows here",
                            "somewhere else entirely it rained for seven whole days")
    rows = [(1, first), (5, first), (5, second), (None, second), (None, third), (None, third), (7, "a b c d e f"), (7, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    kept = stage(spark, docs, ROOT)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(
        map(str, [(1, first), (5, second), (None, third), (7, "a b c d e f")]))


def test_rows_of_the_pipeline_follow_the_mix(spark):
    """What run() returns, in order of position, holds the target weights, and so does its beginning."""
    found = sorted(corpus_pipeline.run(spark, ROOT).collect(), key=lambda r: r.position)
    counts = {s: sum(r.source == s for r in found) for s in {r.source for r in found}}
    placed = [(r.slot, r.block, r.source) for r in found]
    assert all(r.position // source_mixing.BLOCK_ROWS == r.slot for r in found)
    blocks = [source for _, _, source in sorted(set(placed))]
    assert len(blocks) == len({r.slot for r in found}) == sum(-(-n // source_mixing.BLOCK_ROWS) for n in counts.values())
    assert furthest(blocks, {s: n**0.5 for s, n in counts.items()}) < 1 + 1e-6


def test_encoding_states_the_place_of_every_row(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 5}") for i in range(1500)] + [(None, "x", None), (None, "y", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = corpus_pipeline.encode(spark, docs, ROOT).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in found) == sorted((str(i), str(s)) for i, _, s in rows)
    weights = {s: sum(r.source == s for r in found) ** 0.5 for s in {r.source for r in found}}
    blocks = [s for _, s in sorted({(r.slot, r.source) for r in found}, key=lambda b: b[0])]
    assert furthest(blocks, weights) < 1 + 1e-6
    order = [r.position for r in found if r.doc_id is not None]
    assert len(set(order)) == len(order)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    found = QUERIES[name](spark, "/root/testdata/sf0.01")
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.select(columns).collect()))) == sorted(map(str, expected))


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_stages_with_clashing_columns_long_texts_and_nothing(spark, edge):
    rows = [(i, text, f"s{i % 3}" if i else None) for i, text in [
        (1, "same text here"), (2, "same  text here"), (2, "same  text here"), (None, "same text here"),
        (3, None), (4, ""), (5, "long words and lines.\n" * 20_000), (6, "x"), (7, "x"), (7, "another one")]]
    docs = spark.createDataFrame([(*r, "en", 1, 7, "g", 2.5, True) for r in rows],
                                 "doc_id long, text string, source string, lang string, n_chars long, "
                                 "_row long, _group string, _mix_at double, `_MIX_id` boolean")
    for frame in (docs.repartition(3), docs.filter("false")):
        expected = frame.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, ROOT)
            assert frame.columns == expected
            assert all((r._row, r._group, r._mix_at) == (7, "g", 2.5) for r in frame.collect())
        kept = sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
        left = corpus_pipeline.encode(spark, frame, ROOT).collect()
        assert len(left) == len(kept)
        if kept:
            assert {i for i, _ in kept} == {1, 3, 5, 6, 7} and len(kept) == 5
