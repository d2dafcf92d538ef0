"""Exact and near duplicates of texts and vectors, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opinia.llm import buckets, embedding_dedup, exact_dedup, fuse_filter, simhash_dedup
from opinia.llm.components import components

from .conftest import EDGE, groups


@pytest.mark.parametrize("count", [0, 1, 2, 5, 100, 5000])
def test_fuse_filter_holds_its_keys(count):
    keys = np.random.default_rng(count).integers(0, 1 << 63, count).astype(np.uint64)
    stored = fuse_filter.build(np.concatenate([keys, keys]))
    assert fuse_filter.contains(stored, keys).all()
    others = np.random.default_rng(99).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert fuse_filter.contains(stored, others).mean() < 0.02
    assert not fuse_filter.contains(None, keys).any()


def exact_expected(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seen", ["doc_id <= 7", "doc_id % 2 = 0", "true", "false", "doc_id > 9"])
def test_exact_dedup(edge, seen):
    found = exact_dedup.exact_dedup(edge, F.expr(seen)).collect()
    assert sorted(map(tuple, found), key=str) == exact_expected(EDGE)


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing, exact_dedup.arrived_before(nothing)).collect() == []


def print_expected(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest()
              for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(edge, nothing):
    found = sorted(map(tuple, simhash_dedup.simhash_dedup(edge).collect()), key=str)
    prints = [print_expected(t) for _, t in EDGE]
    near = [(i, j) for i in range(len(EDGE)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = groups(near, range(len(EDGE)))
    least = {r: min((EDGE[i][0] for i in root if root[i] == r and EDGE[i][0] is not None), default=None)
             for r in root.values()}
    assert found == sorted(((EDGE[i][0], f"{prints[i]:016x}", least[root[i]]) for i in root), key=str)
    assert simhash_dedup.simhash_dedup(nothing).collect() == []


@pytest.mark.parametrize("most", [simhash_dedup.GROUP_ROWS, 40])
def test_simhash_links_are_complete(spark, monkeypatch, most):
    """Crowds of near fingerprints, whole and cut into chunks."""
    monkeypatch.setattr(simhash_dedup, "GROUP_ROWS", most)
    drawn = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = drawn.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in drawn.sample(range(64), drawn.randint(0, 7))))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in prints], "print long")
    found = {r.node: r.root for r in components(simhash_dedup.links(table)).collect()}
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert {p: found.get(p, p) for p in prints} == groups(near, prints)


def test_components(spark):
    drawn = random.Random(5)
    links = [(drawn.randrange(400), drawn.randrange(400)) for _ in range(260)]
    links += [(500 + i, 501 + i) for i in range(60)] + [(600, 700 + i) for i in range(80)] + [(1, 1), (None, 4)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == groups(real, {x for pair in real for x in pair})


def test_cells_let_every_pair_meet_once(spark):
    rows = spark.range(0, 300).select((F.col("id") % 3).alias("bucket"), F.col("id").alias("member"))
    found = buckets.cells(rows.filter("bucket != 1 OR member < 30"), "member", 20).collect()
    met = {}
    for a in found:
        for b in found:
            same = (a.bucket, a.cell_a, a.cell_b) == (b.bucket, b.cell_a, b.cell_b)
            if same and a.member < b.member and (a.cell_a == a.cell_b or a.chunk != b.chunk):
                met[a.member, b.member] = met.get((a.member, b.member), 0) + 1
    members = {r.member: r.bucket for r in found}
    assert met == {(a, b): 1 for a in members for b in members if a < b and members[a] == members[b]}


def vectors(count, size, seed):
    drawn = np.random.default_rng(seed)
    base = drawn.standard_normal((count, size))
    near = base[:count // 4] + drawn.standard_normal((count // 4, size)) * drawn.uniform(0, 0.7, (count // 4, 1))
    crowd = base[0] + drawn.standard_normal((150, size)) * 0.2
    return np.concatenate([base, near, crowd, base[:5], base[:3] * 2]).astype(np.float32)


@pytest.mark.parametrize("most", [embedding_dedup.GROUP_ROWS, 60])
def test_embeddings(spark, monkeypatch, most):
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", most)
    monkeypatch.setattr(embedding_dedup, "GROUP", 100)
    rows = vectors(700, 24, 1)
    odd = [None, [], [0.0] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v.tolist(), 0, None) for i, v in enumerate(rows)]
    data += [(len(rows) + i, v, 1, None) for i, v in enumerate(odd)] + [(None, rows[1].tolist(), 0, None)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, node long").repartition(4)
    unit = np.concatenate([rows, rows[1:2]]).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    counts = np.array([found[i if i < len(rows) else None].n_links for i in range(len(unit))])
    assert (counts <= near.sum(axis=1)).all() and counts.sum() >= 0.98 * near.sum()
    for i in range(len(rows), len(rows) + 6):
        assert tuple(found[i]) == (i, 0, i, True)
    first = len(rows) + 6
    assert [tuple(found[i]) for i in (first, first + 1)] == [(first, 1, first, True), (first + 1, 1, first, False)]
    root = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b], range(len(unit)))
    agree = np.mean([found[i].component_id == root[i] for i in range(len(rows))])
    assert agree > 0.98
    assert embedding_dedup.near_duplicates(table.filter("false")).collect() == []


def test_calibration():
    least = embedding_dedup.least_collisions()
    drawn = np.random.default_rng(2).standard_normal((4000, embedding_dedup.PROJECTIONS)) * np.sqrt(0.2)
    hits = (np.abs(drawn) <= embedding_dedup.HALF_WINDOW).sum(axis=1)
    assert 0.99 < (hits >= least).mean() and embedding_dedup.layout(0) == (0, 1)
