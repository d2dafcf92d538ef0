"""The prefix trie against a plain one in one process."""

import hashlib
import random
import zlib

import pytest

from opinia.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, x1 long"


def expected(rows, rebuild=True):
    def identity(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    held = {}
    for r in rows:
        if r[0] is not None:
            held.setdefault(r[0], []).append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(
        rs, key=lambda r: (r[1] is not None, r[1] or 0, identity(r)))] for c, rs in held.items()}
    convs = {}
    for c, seq in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 9, abs(c) % 5
        first = c - rest if c >= 0 else c + rest
        convs[c] = own.get(first, [])[:h] + seq[h:] if rebuild else seq
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[:len(n)] == n]
        ends = sorted(c for c in members if len(convs[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children.get(n, [])),
                    sum(m not in children for m in below),
                    sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def sample(seed, convs, words, long=()):
    draw, rows = random.Random(seed), []
    for c in convs:
        n = 40 if c in long else draw.randrange(0, 12)
        rows += [(c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None]),
                  draw.choice(words)) for t in range(n)]
    return rows + rows[:7]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_rebuilt_conversations(spark, most):
    rows = sample(1, range(-12, 40), ["a", "é\n", "", None, "some words"], {5, 17})
    rows += [(None, 0, "user", "nobody"), (100, None, None, None), (103, 0, "user", "x" * 100_000)]
    conversations = table(spark, rows).repartition(3)
    assert found(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(conversations)), most)) == expected(rows)


@pytest.mark.parametrize("most", [2, 50])
def test_conversations_as_they_are(spark, most):
    rows = sample(2, range(30), ["a", "b"], {3}) + [(c, t, "user", "same") for c in range(1000, 1060) for t in range(3)]
    conversations = table(spark, rows).repartition(5)
    assert found(prefix_trie.prefix_trie(prefix_trie.whole(prefix_trie.turns(conversations)), most)) == expected(rows, False)


def test_ids_of_a_crowd_are_hashed_in_pieces(spark, monkeypatch):
    ends = spark.range(-20, 1000).selectExpr("2L AS depth", "3L AS x1", "4L AS x2", "id AS conv_id")
    (row,) = prefix_trie.end_digests(ends.repartition(7)).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(-20, 1000))).encode()).hexdigest()


def test_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(table(spark, [])))).collect() == []
