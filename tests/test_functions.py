"""Table-driven checks of every scalar function, quirks included."""

import hashlib

import pytest
from pyspark.sql import functions as F

from opinia.functions import dates, markets, pages, ratings, text, urls


def check(apply, build, cases):
    got = apply([c[0] for c in cases], lambda df: build(F.col("a")))
    assert got == [c[1] for c in cases], [
        (c[0], c[1], g) for c, g in zip(cases, got) if c[1] != g]


def test_clean_text(apply):
    check(apply, text.clean_text, [
        ("  hello world  ", "hello world"), ("hello\nworld", "hello world"),
        ("hello\tworld", "hello world"), ("hello\r\nworld", "hello world"),
        ("hello\x00world\x1f", "hello world"), ("", ""), (None, ""),
        ("a\xa0 b　", "a b"), ("a​b", "a​b"), ("x\x85y\x9fz", "x y z"),
    ])


def test_rating(apply):
    check(apply, ratings.normalize_rating, [
        ("4.0 sur 5 étoiles", 4.0), ("4,0 sur 5 étoiles", 4.0), ("4 sur 5", 4.0),
        ("4.5", 4.5), ("4,5", 4.5), ("5", 5.0), ("1.0", 1.0), ("", None), (None, None),
        ("invalid text", None), ("6.0", None), ("0.5", None), ("sur 5 étoiles", None),
        ("4 out of 5 stars", None), ("4.0 out of 5 stars", 4.0),
        ("4,0 von 5 Sternen", 4.0), ("2 avis, 4 sur 5", 2.0), ("10.0 ou 4 sur 5", None),
        ("4 sur 50", 4.0), (" 4 ", None), ("4\n", 4.0), ("4\x1csur\xa05", 4.0),
        ("9.5 puis 4,5 sur 5", 4.5), ("4 ", None),
    ])


def test_date_french(apply):
    check(apply, dates.normalize_date_fr, [
        ("le 15 janvier 2024", "2024-01-15"), ("15 janvier 2024", "2024-01-15"),
        ("15/01/2024", "2024-01-15"), ("2024-01-15", "2024-01-15"),
        ("le 1er février 2024", "2024-02-01"), ("1er février 2024", "2024-02-01"),
        ("1/12/2024", "2024-12-01"), ("", None), (None, None), ("invalid date", None),
        ("15 invalid 2024", None), ("32 janvier 2024", None), ("15 janvier 13", None),
        ("31 février 2024", "2024-02-31"), ("115 janvier 20245", "2024-01-15"),
        ("01/15/2024", None), ("01/02/0024", "24-02-01"), ("3 mars 0024", "0024-03-03"),
        ("le 3 foo 2020 et 4 mai 2021", None), ("LE 15 AOÛT 2024", "2024-08-15"),
        ("99/99/2024 2023-02-03", "2023-02-03"),
    ])


def test_date_all_languages(apply):
    check(apply, dates.normalize_date, [
        ("January 15, 2024", "2024-01-15"), ("15 January 2024", "2024-01-15"),
        ("15 de enero de 2024", "2024-01-15"), ("15 gennaio 2024", "2024-01-15"),
        ("15. Januar 2024", "2024-01-15"), ("15 januari 2024", "2024-01-15"),
        ("15.01.2024", "2024-01-15"), ("15-01-2024", "2024-01-15"),
        ("15. janvier 2024", None), ("15 enero 2024", None), ("Jan 15, 2024", None),
        ("15 März 2024", "2024-03-15"), ("Reviewed on 3 May 0024", "24-05-03"),
        ("15 gennaio 2024 e 3 de enero de 2023", "2023-01-03"),
        ("15 foo 2024 e 3. Mai 2023", None), ("foo 2024 e 3. Mai 2023", "2023-05-03"), ("  le 2 mai 2024\x1f", "2024-05-02"),
        (None, None), ("", None), ("15|August 2024", "2024-08-15"),
    ])


def test_votes(apply):
    check(apply, text.normalize_helpful_votes, [
        ("3 personnes ont trouvé cela utile", 3), ("3 people found this helpful", 3),
        ("3 utile", 3), ("3", 3), ("1 personne a trouvé cela utile", 1), ("0", 0), ("", 0),
        (None, 0), ("invalid text", 0), ("aucun vote", 0), ("no votes", 0),
        ("1,234 people found this helpful", 234), ("One person found this helpful", 0),
        ("8 ou 12 PERSONNES ONT TROUVÉ CELA UTILE", 12), ("99999999999999", 0),
    ])


def test_verified(apply):
    check(apply, text.normalize_verified_purchase, [
        ("Achat vérifié", True), ("Verified Purchase", True), ("vérifié", True),
        ("verified", True), ("ACHAT VÉRIFIÉ", True), ("", False), (None, False),
        ("pas vérifié", False), ("not verified", False), ("autre texte", False),
        ("unverified", True), ("non vérifié", True), ("Verifizierter Kauf", False),
    ])


def test_title_and_keys(apply):
    check(apply, text.strip_rating_from_title, [
        ("5,0 sur 5 étoiles Super", "Super"), ("4 out of 5 stars - Good", "Good"),
        ("★★★☆ Bien", "Bien"), ("4 SUR 5 ÉTOILES – Bof", "Bof"), ("Super", "Super"),
        ("", ""), (None, ""), ("5,0 sur 5 étoiles 4.0 out of 5 stars X", "X"),
        ("\x1f3 sur 5 étoile\xa0— A  B", "A B"), ("★\x1f★ B", "B"),
    ])
    got = apply([("a ", " b"), (None, None)],
                lambda df: text.canonical_review_id(df.t, df.b), "t string, b string")
    assert got[0] == "sha1_" + hashlib.sha1(b"a|b").hexdigest()
    assert got[1] == "sha1_3eb416223e9e69e6bb8ee19793911ad1ad2027d8"


def test_content_key(apply):
    rows = [("T", "B", "u", "d", 4.0, "v"), ("", None, "u ", "d", 4.0, None),
            (None, "", None, None, None, None), ("a|b", "c", "", "", 0.0, ""),
            ("a", "b|c", "", "", 0.0, "")]
    got = apply(rows, lambda df: text.content_key(df.t, df.b, df.u, df.d, df.r, df.v),
                "t string, b string, u string, d string, r double, v string")
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got[:3] == [sha("T|B"), sha("u|d|4.0|"), sha("|||")]
    assert got[3] == got[4]
    pair = apply(rows[3:], lambda df: text.content_pair(df.t, df.b),
                 "t string, b string, u string, d string, r double, v string")
    assert pair[0] != pair[1]


def test_localized_int(apply):
    check(apply, text.localized_int, [
        ("1 234 évaluations", 1234), ("1\xa0234", 1234), ("1 234 avis", 1234),
        ("1.234.567", 1234567), ("4.5 sur 5, 1 234", 45), ("aucun", None), (None, None),
        ("12\t34", None), ("12\n", 12),
    ])
    check(apply, lambda c: text.localized_int(c, nbsp=False), [
        ("1\xa0234", None), ("1234\xa0évaluations", 1234), ("1,234 ratings", 1234)])


def test_sentiment(spark):
    rows = [(5.0,), (4.0,), (3.9,), (2.0,), (1.0,), (None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "r double")
    got = [r[0] for r in df.select(ratings.sentiment(df.r)).collect()]
    assert got == ["Positif", "Positif", "Neutre", "Négatif", "Négatif", "Neutre", "Neutre"]


def test_asin(apply):
    check(apply, urls.validate_asin, [
        ("B123456789", True), ("1234567890", True), ("ABCDEFGHIJ", True),
        ("b0c123456é", True), ("", False), (None, False), ("B12345678", False),
        ("B1234567890", False), ("123456789-", False), ("123456789 ", False),
        ("123456789\n", False), ("B123456789\n", False),
    ])


def test_build_urls(apply):
    got = apply([("B123456789", 1, None, None), ("B123456789", 3, "www.amazon.de", "five_star")],
                lambda df: urls.generate_review_url(
                    df.a, df.p, domain=df.d, star_filter=df.s, language=F.lit("fr_FR")),
                "a string, p int, d string, s string")
    assert got == [
        "https://www.amazon.fr/product-reviews/B123456789/?reviewerType=all_reviews"
        "&sortBy=recent&filterByStar=all_stars&filterByLanguage=fr_FR",
        "https://www.amazon.de/product-reviews/B123456789/?reviewerType=all_reviews"
        "&sortBy=recent&filterByStar=five_star&filterByLanguage=fr_FR&pageNumber=3",
    ]
    check(apply, urls.generate_product_url, [("X", "https://www.amazon.fr/dp/X")])


def test_parse_urls(apply):
    flat = lambda r: None if r is None else tuple(r)
    dom = "www.amazon.fr"
    cases = [
        ("https://www.amazon.de/product-reviews/B1/?language=de_DE&sortBy=helpful",
         ("B1", "www.amazon.de", "de_DE", "helpful", "all_reviews")),
        ("https://h:8/x/product-reviews/B1?reviewerType=avp&language=&language=a%20b+c",
         ("B1", "h:8", "a b c", None, "avp")),
        ("https://u@h/product-reviews/", ("", "u@h", None, None, "all_reviews")),
        ("https://h/product-reviews", (None, "h", None, None, "all_reviews")),
        ("product-reviews/B2;v=1?languageLocale=it%zz", ("B2", dom, "it%zz", None, "all_reviews")),
        ("", None), (None, None), ("http://[h/product-reviews/B1", None),
        ("ht tp://x y/product-reviews/B1", ("B1", "x y", None, None, "all_reviews")),
    ]
    got = apply([c[0] for c in cases], lambda df: urls.parse_reviews_url(F.col("a")))
    assert [flat(g) for g in got] == [c[1] for c in cases]
    cases = [
        ("https://www.amazon.es/dp/B1?sortBy=x", ("B1", "www.amazon.es", None, None, "all_reviews")),
        ("https://h/a/gp//product/B2/", ("B2", "h", None, None, "all_reviews")),
        ("www.amazon.de/dp/X", ("X", dom, None, None, "all_reviews")),
        ("https://h/product-reviews//dp/B3", ("B3", "h", None, None, "all_reviews")),
        ("https://h/product-reviews/R1/dp/B3?sortBy=s", ("R1", "h", None, "s", "all_reviews")),
        ("https://h/dp/", None), ("https://h/gp/x/B1", None), ("", None), (None, None),
        ("https://h/adp/B1", None),
    ]
    got = apply([c[0] for c in cases], lambda df: urls.parse_product_url(F.col("a")))
    assert [flat(g) for g in got] == [c[1] for c in cases]


def test_review_id_and_next_page(apply):
    check(apply, urls.review_id_from_url, [
        ("https://www.amazon.fr/reviews/R123456789", "R123456789"),
        ("/reviews/R987654321", "R987654321"), ("", None), (None, None),
        ("https://www.amazon.fr/product/123", None), ("/gp/customer-reviews/R1", None),
    ])
    check(apply, urls.next_page_url, [
        ("https://h/p/?a=1&pageNumber=2&b=x%20y#f", "https://h/p/?a=1&pageNumber=3&b=x+y#f"),
        ("HTTP://h/p", "http://h/p?pageNumber=2"), ("http://h/p?a=&b=~*", "http://h/p?b=~%2A&pageNumber=2"),
        ("http://h/p?a=1&a=2", "http://h/p?a=1&pageNumber=2"),
        ("http://h/p?pageNumber=x", None), ("http://h/?q==", "http://h/?q=%3D&pageNumber=2"),
        (None, None),
    ])


def test_markets(apply):
    check(apply, markets.market_language, [
        ("www.amazon.co.uk", "en_GB"), ("WWW.AMAZON.DE", "de_DE"), (None, "fr_FR"), ("x.com", "fr_FR")])
    check(apply, markets.market_timezone, [
        ("www.amazon.co.uk", "Europe/London"), ("a.nl", "Europe/Amsterdam"), (None, "Europe/Paris")])
    got = apply([("www.amazon.co.uk", None), ("amazon.it", "fr_FR"), ("x", None), (None, "es_ES")],
                lambda df: markets.market_locale_currency(df.a, df.b), "a string, b string")
    assert [tuple(g) for g in got] == [
        ("en_GB", "GBP"), ("fr_FR", "EUR"), ("fr_FR", "EUR"), ("es_ES", "EUR")]
    got = apply([("d1", "d2", False), (None, "d2", False), (None, "d2", True), ("", None, False)],
                lambda df: markets.target_domain(df.a, df.b, df.c), "a string, b string, c boolean")
    assert got == ["d1", "d2", "www.amazon.fr", "www.amazon.fr"]
    check(apply, markets.star_code, [("five", "five_star"), ("all", None), ("x", None), (None, None)])
    check(apply, markets.star_label, [("one_star", "1 étoile"), (None, "Toutes"), ("x", "Toutes")])


@pytest.mark.parametrize("build,hits,misses", [
    (pages.is_challenge, ["x CAPTCHA y", "Vérification de sécurité", "unusual traffic"],
     ["", None, "<html>ok</html>"]),
    (pages.is_error, ["Error 404", "DÉSOLÉ! Quelque chose s'est mal passé"], ["", None, "error 40"]),
    (pages.is_login, ['<input ID="ap_email">', "ap_signin_form"], ["", None, "/ap/signin"]),
])
def test_page_predicates(apply, build, hits, misses):
    check(apply, build, [(h, True) for h in hits] + [(m, False) for m in misses])


def test_page_status_and_counts(apply):
    check(apply, pages.page_status, [
        ('captcha id="ap_email" error 404', "challenge"), ('id="ap_email" error 404', "login"),
        ("error 404", "error"), ("fine", "ok"), (None, "ok")])
    got = apply([('"reviewCount": 1,234', None), ('"reviewCount":"12"', "3 avis"), (None, "1\xa0234 avis")],
                lambda df: pages.product_review_count(df.a, df.b), "a string, b string")
    assert got == [1234, 3, None]
    got = apply([("x", "Bonjour, Identifiez-vous"), ("x", None), ("ap_signin_form", None)],
                lambda df: pages.is_signed_out(df.a, df.b), "a string, b string")
    assert got == [True, False, True]
