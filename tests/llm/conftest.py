import pytest

LONG = "Longword thing, and so on.\n" * 8000

#: (doc_id, text): missing and empty values, ties, repeats, white space, specials, long texts.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog again and again."),
    (2, "The  quick brown\tfox jumps over the lazy dog again and again."),
    (3, None), (4, ""), (5, " \n\t "), (6, "ONE"), (7, "one"), (8, LONG), (9, LONG),
    (10, "a <|endoftext|> b <|startoftext|>c"), (11, "don't it's WE'LL 12345 ½ ²"),
    (12, "Éléphant\u00a0über ΣΑΣ İstanbul ﬁ e\u0301 中文字 한국어 😀👍🏽"), (13, "x" * 5000), (14, "\x1cfoo\x85bar\u2028"),
    (15, "One two three four five"), (15, "One two three four five"), (None, "one"), (None, "nobody else has this"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows, with other columns whose names the operators use inside."""
    extra = "sha string, print long, bucket int, seen boolean, node long, body string, piece string, block long"
    rows = [(i, t, "en", f"src{n % 3}" if n else None, None, None, None, None, None, None, None, None)
            for n, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")


def groups(pairs, items):
    """The smallest item reachable from every item by the pairs."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}
