"""Random texts through both engines: Spark expressions against the SQL ones."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinia.constants import (
    MONTHS_DE, MONTHS_EN, MONTHS_ES, MONTHS_FR, MONTHS_IT, MONTHS_NL,
)
from opinia.functions import dates, ratings, text, urls
from workload import oracle

SPACES = [" ", " ", " ", "  ", "\t", "\n", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "​"]
NUMBERS = ["0", "1", "4", "5", "9", "12", "15", "31", "32", "115", "2024", "0024", "20245"]
MARKS = [".", ",", "/", "-", "|", "–", "★", "☆", "!", ""]
RATING_WORDS = ["sur", "5", "étoiles", "ÉTOILE", "out", "of", "stars", "Star", "von"]
VOTE_WORDS = ["personne", "personnes", "ont", "trouvé", "cela", "utile", "people", "peopl",
              "found", "this", "helpful", "Vérifié", "verified", "pas", "not"]
DATE_WORDS = ["le", "Le", "de", "1er", "foo", "x_1", *MONTHS_FR, *MONTHS_EN, *MONTHS_ES,
              *MONTHS_IT, *MONTHS_DE, *MONTHS_NL]

CASES = {
    "clean_text": (text.clean_text, oracle.clean, VOTE_WORDS),
    "rating": (ratings.normalize_rating, oracle.rating, RATING_WORDS),
    "date_fr": (dates.normalize_date_fr, lambda x: oracle.date_fr(f"lower({x})"), DATE_WORDS),
    "date": (dates.normalize_date, lambda x: oracle.date_any(f"lower({x})"), DATE_WORDS),
    "votes": (text.normalize_helpful_votes, oracle.votes, VOTE_WORDS),
    "verified": (text.normalize_verified_purchase, oracle.verified, VOTE_WORDS),
    "strip_title": (text.strip_rating_from_title, oracle.strip_title, RATING_WORDS),
    "header_int": (text.localized_int, oracle.local_int, ["avis"]),
    "product_int": (lambda c: text.localized_int(c, False),
                    lambda x: oracle.local_int(x, False), ["avis"]),
    "review_id": (urls.review_id_from_url, oracle.href_id, ["/reviews/", "R1A", "reviews", "/"]),
}


def samples(seed, words, n=4000):
    rng = random.Random(seed)

    def piece():
        pool = rng.choices([NUMBERS, SPACES, MARKS, words], weights=[3, 4, 1, 3])[0]
        return rng.choice(pool)

    def date():
        day, sep, year = rng.choice(NUMBERS), rng.choice(SPACES), rng.choice(NUMBERS)
        word, mark = rng.choice(words), rng.choice(MARKS)
        return rng.choice([
            f"{day}{sep}{word}{sep}{year}", f"{word}{sep}{day},{sep}{year}", f"{day}{mark}{sep}{word} {year}",
            f"{day} de {word} de {year}", f"{day}{mark}{day}{mark}{year}", f"{year}-{day}-{day}"])

    out = ["".join(piece() for _ in range(rng.randint(1, 9))) for _ in range(n // 2)]
    out += [rng.choice(["", "le ", piece()]) + date() + rng.choice(["", " ", date()]) for _ in range(n // 2)]
    return out


@pytest.mark.parametrize("name", CASES)
def test_engines_agree(spark, name):
    build, sql, words = CASES[name]
    rows = samples(name, words)
    frame = pd.DataFrame({"i": range(len(rows)), "a": rows})
    got = {r["i"]: r["v"] for r in
           spark.createDataFrame(frame).select("i", build(F.col("a")).alias("v")).collect()}
    db = duckdb.connect()
    db.register("t", frame)
    want = dict(db.sql(f"SELECT i, {sql('a')} AS v FROM t").fetchall())
    differing = [(rows[i], got[i], want[i]) for i in range(len(rows)) if got[i] != want[i]]
    assert not differing, differing[:5]
    assert len(set(got.values())) > 1
