"""Quality rules against a plain reading of the contract."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from opinia.functions.text import let
from opinia.llm import quality_rules

from .conftest import EDGE

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(repeated), n < 50 or 100 * len(repeated) > 50 * n)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    good, bad = ([f"{letter}{i}" for i in range(300)] for letter in "ab")
    rows = list(EDGE)
    for i in range(100, 400):
        words = draw.choices(bad if i % 5 == 0 else good, k=draw.randrange(60, 200))
        if i % 7 == 0:
            words[10:40] = words[40:70]
        rows.append((i, re.sub(" (?=[ab]1 )", "\n", " ".join(words)) + ("\nsame # line|\n" * (i % 3))))
    docs = spark.createDataFrame([(*r, 7, True) for r in rows], "doc_id long, text string, parts int, good boolean")
    labels = spark.createDataFrame(
        [(i, int(i % 5 > 0), 0) for i in range(100, 300)] + [(101, 0, 0), (None, 1, 0), (301, None, 0)],
        "doc_id long, quality int, toxic int")
    return rows, docs.repartition(5), labels


def test_base_counts(corpus):
    rows, docs, labels = corpus
    found = quality_rules.quality_rules(docs, labels).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(i, *base_expected(t)) for i, t in rows], key=str)


def test_bad_words_go_and_good_ones_stay(corpus):
    _, docs, labels = corpus
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).filter("doc_id >= 100 AND NOT base_failed").collect()}
    assert len(kept) > 250
    assert not any(kept[i] for i in kept if i % 5 == 0)
    good = [kept[i] for i in kept if i % 5]
    assert sum(good) >= 0.97 * len(good)


def test_score_is_the_mean_ratio_of_counts(spark, corpus):
    _, docs, labels = corpus
    trusted = quality_rules.fit_ids(labels)
    known = quality_rules.ratios(docs, trusted, buckets=64)
    grams = docs.select("doc_id", F.explode(let(quality_rules.words(F.col("text")), lambda p: quality_rules.ngram_buckets(p, 64))).alias("b")).collect()
    ids = {r.trusted for r in trusted.collect()}
    raw, good = [0] * 64, [0] * 64
    for r in grams:
        raw[r.b] += 1
        good[r.b] += r.doc_id in ids
    counts = list(zip(raw, good))
    expected = [round(1e6 * math.log((g + 1) / (sum(good) + 64) * (sum(raw) + 64) / (n + 1))) for n, g in counts]
    assert known == expected
    scored = {r.doc_id: r.score for r in quality_rules.judged(docs, known).filter("doc_id >= 100").collect()}
    for i in (100, 101, 250, 399):
        own = [known[r.b] for r in grams if r.doc_id == i]
        assert scored[i] == math.floor(sum(own) / len(own))


def test_same_verdicts_however_the_rows_are_dealt(corpus):
    _, docs, labels = corpus
    one = quality_rules.quality_rules(docs.coalesce(1), labels).collect()
    many = quality_rules.quality_rules(docs.repartition(9), labels).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_nothing_and_no_labels(corpus, nothing):
    rows, docs, labels = corpus
    assert quality_rules.quality_rules(nothing, labels).collect() == []
    alone = quality_rules.quality_rules(docs, labels.filter("false")).collect()
    assert len(alone) == len(rows) and all(r.kept == (not r.base_failed) for r in alone)


def test_no_python_in_the_plan(corpus):
    _, docs, labels = corpus
    plan = quality_rules.judged(docs, [1, 2, 3])._jdf.queryExecution().toString()
    assert not any(node in plan for node in ("EvalPython", "MapInArrow", "MapInPandas", "hashpartitioning"))
