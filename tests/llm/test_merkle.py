"""The Merkle manifest against the whole tree built in one process."""

import hashlib
import random
import zlib

import pytest

from opinia.llm import merkle_manifest

from .conftest import EDGE


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def walk(tree, at, node):
    proof = ""
    for nodes in tree[:-1]:
        run = nodes[at - at % 3:at - at % 3 + 3]
        proof += "".join(run[:at % 3] + run[at % 3 + 1:])
        run[at % 3] = node
        node, at = digest(*run), at // 3
    return node, proof


def expected(rows):
    def leaf(fields):
        return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    sources = {}
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        bad = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(
            str(doc_id).encode()) % 2 == 0 else text
        sources.setdefault(source, []).append((doc_id, leaf(row), leaf((*row[:4], bad))))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = levels([r[1] for r in sources[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, good, bad) in enumerate(sources[s]):
            sub, proof = walk(trees[s], i, bad)
            root, above = walk(top, k, sub)
            out.append((doc_id, good, trees[s][-1][0], top[-1][0], digest(proof + above), root, root == top[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x", ["y"]) for r in rows], "doc_id long, source string, lang string, "
                                 "n_chars long, text string, at int, node binary, path array<string>")


def found(docs, height):
    return sorted(map(tuple, merkle_manifest.manifest(docs, height).collect()), key=str)


MANY = {"a": 40, "b": 3, None: 10, "": 1, "é": 9, "z": 28, **{f"s{i}": 1 + i % 4 for i in range(12)}}


@pytest.mark.parametrize("sizes,height", [({"a": 1}, 6), (MANY, 1), (MANY, 2), (MANY, 6)])
def test_manifest(spark, sizes, height):
    draw = random.Random(5)
    rows = [(draw.randrange(-50, 10**6), s, draw.choice(["en", None]), draw.choice([7, None]),
             draw.choice(["a\nb", "\n", "ü\n\nß", "", None, "plain"])) for s, n in sizes.items() for _ in range(n)]
    assert found(table(spark, rows).repartition(3), height) == expected(rows)


def test_edge_rows_and_ties(spark):
    rows = [(i, f"src{n % 2}" if n % 5 else None, None, None, t) for n, (i, t) in enumerate(EDGE)]
    rows += [(15, "src0", None, None, f"text\n{i}") for i in range(10)]
    assert found(table(spark, rows).repartition(4), 1) == expected(rows)


def test_nothing(spark):
    assert merkle_manifest.manifest(table(spark, []), 2).collect() == []


def test_versions_share_untouched_nodes():
    tree = merkle_manifest.Tree([bytes([i]) * 32 for i in range(20)], None)
    before = [list(nodes) for nodes in tree.levels]
    copied = tree.version(13, b"z" * 32)
    assert tree.levels == before and len(copied) == len(tree.levels)
    changed = before[0][:13] + [b"z" * 32] + before[0][14:]
    assert merkle_manifest.Tree(changed, None).top == copied[-1]
