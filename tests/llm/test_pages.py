"""URL rules, HTML extraction and language ID."""

import time
import random

import pytest

from opinia.llm import html_text, lang_id, url_filter

ROOT = "/root/testdata/sf0.001"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    rest = rest[at:]
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def judged(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


def test_url_rules_against_brute_force(spark):
    drawn = random.Random(4)
    labels, bits = ["a", "b", "ab", "example", "com", "x-y", ""], ["/", "a", "en/", "x", "/b", ".", "%20"]
    host = lambda most: ".".join(drawn.choice(labels) for _ in range(drawn.randint(1, most)))
    path = lambda most: "/" + "".join(drawn.choice(bits) for _ in range(drawn.randint(0, most)))
    rules = list({(h, p): (h, p, drawn.choice(["allow", "block"])) for h, p in ((host(3), path(2)) for _ in range(120))}.values())
    urls = [None, "", "://", "no scheme", "http://", "http://COM", "http://com?x/y", "http://com#/", "x://a.b\n/c\nd",
            "http://a://b/c", "http://" + "a." * 300 + "com/" + "x" * 20000, "http://user@ÄB.com:80/en/"]
    urls += [f"http://{host(5)}{path(5)}{drawn.choice(['', '?q=/a', '#f'])}" for _ in range(600)]
    urls += urls[-50:] * 4
    pages = spark.createDataFrame([(i % 500, u, "k", "h") for i, u in enumerate(urls)],
                                  "page_id long, url string, key string, host string").repartition(5)
    found = url_filter.judge(pages, url_filter.rules_table(spark, rules)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i % 500, *judged(u, rules))) for i, u in enumerate(urls))


def test_url_rules_ties_and_emptiness(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    twice = [("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("a.com", "/", "block")]
    assert url_filter.judge(pages, url_filter.rules_table(spark, twice)).first().verdict == "block"
    none = url_filter.rules_table(spark, [("z", "/", "block")]).filter("false")
    assert tuple(url_filter.judge(pages, none, "block").first()) == (1, "a.com", "/x", None, "block")
    assert url_filter.judge(pages.filter("false"), url_filter.rules_table(spark, url_filter.RULES)).collect() == []


CASES = [
    (None, ""), ("", ""), ("plain text &amp; no  tags", "plain text & no tags"), ("<p>a<p>b<script>x<", "a b"),
    ("<div>hello <b>wor</b>ld</div>", "hello world"), ("<article>1 &lt; 2<br>3&#8212;4 &copy 5</article>", "1 < 2 3—4 © 5"),
    ("<body><nav><a>menu</a></nav><article><h1>T</h1><p>One.<p>Two<aside>side</aside><ul><li>x<li>y</ul>"
     "<form>f</form><section class='user-comments'><p>Nice, really. Good.</p></section></article><footer>end.</footer>",
     "T One. Two x y"),
    ("<header>Site. Name, here.</header><main><p>Only this, and that.</p></main><div class='cookie-notice'>We use, oh.</div>",
     "Only this, and that."),
    ("<div id=c><h2>Head</h2><p>Long enough text, with marks. And more of it, so on and on.</p><p>Short.</p><p>Another long"
     " one, with marks. And more of it, really.</p></div><div><a href=/>Home</a> <a href=/x>About us</a></div>",
     "Head Long enough text, with marks. And more of it, so on and on. Short. Another long one, with marks. And more of it, really."),
    ("<article><!-- <p>no</p> --><style>p{}</style><p hidden>no</p><div style='display: none'>no</div><![CDATA[raw & x]]></article>",
     "raw & x"),
    ("<article>" + "<p>word, word.</p>" * 30000 + "</article>", " ".join(["word, word."] * 30000)),
    ("<div>" * 2000 + "deep, text." + "</div>" * 1000, "deep, text."),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_main_text(case):
    source, expected = CASES[case]
    assert html_text.main_text(source or "") == expected


PROSE = "Long enough text, with marks. And more of it, so on and on; it does not end here."
KEPT = [
    (f"<div class='overflow-hidden md:hidden'><p>{PROSE}</p></div>", PROSE),
    (f"<div class='page no-sidebar'><h1>T</h1><p>{PROSE}</p></div><div class='sidebar'><p>Buy, now.</p></div>", "T " + PROSE),
    (f"<div class='elementor-widget'><p>{PROSE}</p></div><div class='elementor-widget'><p>{PROSE}</p></div>", f"{PROSE} {PROSE}"),
    (f"<article><div class='article-header'><h1>Title</h1></div><p>{PROSE}</p><h2 id='related-work'>Related work</h2><p>{PROSE}</p>"
     f"<h2 id='search'>Search</h2><p>{PROSE}</p></article>", f"Title {PROSE} Related work {PROSE} Search {PROSE}"),
    (f"<body><div><a href='/'>Site</a></div><form id=f action=/><div><p>{PROSE}</p><p>{PROSE}</p></div></form></body>", f"{PROSE} {PROSE}"),
    (f"<div class=widget><p>{PROSE}</p></div>", PROSE),
    (f"<aside><p>{PROSE}</p></aside>", PROSE),
    (f"<div><p>{PROSE}</p><p>{PROSE}</p></div><div class='x ad'><p>{PROSE}</p></div><div id=user_comments><p>{PROSE}</p></div>"
     f"<form><p>Write to us, please.</p></form>", f"{PROSE} {PROSE}"),
    (f"<article><p>{PROSE}</p><div class=ad><p>{PROSE}</p></div><p>{PROSE}</p></article>", f"{PROSE} {PROSE}"),
]


@pytest.mark.parametrize("case", range(len(KEPT)))
def test_names_lower_but_do_not_delete(case):
    source, expected = KEPT[case]
    assert html_text.main_text(source) == expected


def test_extract(spark):
    rows = [(i % 7, f"u{i}", source, "t", 1) for i, (source, _) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int").repartition(3)
    expected = [(i % 7, f"u{i}", text, len(text)) for i, (_, text) in enumerate(CASES)]
    assert sorted(map(tuple, html_text.extract(pages).collect())) == sorted(expected)
    assert html_text.extract(pages.filter("false")).collect() == []


def test_language(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    pages = spark.read.parquet(f"{ROOT}/pages.parquet")
    model = lang_id.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = lang_id.identify(pages.selectExpr("*", "1 AS host", "2 AS p", "3 AS suffix"), model).collect()
    assert len(found) == pages.count()
    known = {r.page_id: r.url.split("/")[3] for r in pages.collect() if r.url and r.url.count("/") > 3}
    agree = [r.lang == known[r.page_id] for r in found if known.get(r.page_id) in set(truth.values())]
    assert sum(agree) / len(agree) > 0.97
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (2, "no scheme", ""), (None, "http://x.fr/", "<html lang=xx>")],
                                "page_id long, url string, html string")
    rows = lang_id.identify(odd, model).collect()
    assert len(rows) == 4 and all(0 < r.confidence <= 1 and r.lang for r in rows)
    assert {r.declared for r in rows} == {"", "other"}
    blank = lang_id.train(docs.filter("false"))
    assert [tuple(r)[3:] for r in lang_id.identify(odd, blank).collect()] == [(None, 0.0)] * 4
    assert lang_id.identify(odd.filter("false"), model).collect() == []


def test_host_settles_a_short_text(spark):
    """A page without text of its own follows the others of its host."""
    docs = spark.createDataFrame([("en", "the cat and the dog with the other thing " * 30), ("de", "der hund und die katze mit dem anderen ding " * 30)],
                                 "lang string, text string")
    rows = [(i, "http://a.x.org/", "<p>der hund und die katze mit dem ding</p>") for i in range(8)]
    rows += [(100 + i, "http://b.y.org/", "<p>the cat and the dog with the thing</p>") for i in range(8)]
    rows += [(50, "http://a.x.org/empty", ""), (51, "http://b.y.org/empty", None)]
    found = {r.page_id: r.lang for r in lang_id.identify(
        spark.createDataFrame(rows, "page_id long, url string, html string"), lang_id.train(docs)).collect()}
    assert (found[50], found[51], found[0], found[100]) == ("de", "en", "de", "en")


PROSE = "This paragraph, long enough to be read, says something; it goes on, as prose does, for a while. " * 3


@pytest.mark.parametrize("block", ['<section class="discussion-thread">{}</section>', '<div class="post-comments">{}</div>'])
def test_reader_comments_inside_the_article(block):
    comments = block.format("<p>I disagree, as one does, with all of it.</p>" * 4)
    page = f"<html><body><article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>{comments}</article></body></html>"
    assert "disagree" not in html_text.main_text(page) and "Title" in html_text.main_text(page)


def test_sidebar_beside_the_post():
    page = (f'<body><div class="wrap has-sidebar"><div class="post"><p>{PROSE}</p><p>{PROSE}</p></div>'
            f'<div class="site-sidebar"><p>Aside, {PROSE}</p></div></div></body>')
    assert "Aside" not in html_text.main_text(page) and "says something" in html_text.main_text(page)


@pytest.mark.parametrize("piece", ["<div>x", "<a ", '<a "', "<p><td>y", "<li>z", "<b>w", "<!--", "<script ", "</div>", "<p class='"])
def test_time_grows_with_the_page_only(piece):
    def seconds(times):
        source = f"<ul><p>{piece * times}"
        start = time.perf_counter()
        html_text.main_text(source)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)  # ten times the page; a square would take a hundred times as long


def test_paths_are_those_of_the_open_elements():
    nodes, paths = html_text.text_nodes("<body><div>a<p>b<i>c</i></p></div><div><p>d</p></div><section><p>e</p></section></body>")
    found = {n.text: (n.path, n.parent) for n in nodes}
    assert found["bc"][0] == found["d"][0] != found["e"][0]
    assert paths.parent[found["d"][0][1]] == found["d"][1][1] == found["a"][0][1]


def test_many_languages(spark, monkeypatch):
    """Any number of languages; beyond the size of the table, trigrams share bins."""
    monkeypatch.setattr(lang_id, "TABLE_ENTRIES", 300 << 9)
    draw = random.Random(2)
    words = {f"l{i}": ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(300)}
    docs = spark.createDataFrame([(" ".join(draw.choices(w, k=60)), lang) for lang, w in words.items() for _ in range(2)],
                                 "text string, lang string")
    langs, likelihood = lang_id.train(docs)
    assert len(langs) == 300 and likelihood.shape == (300, 512)
    assert sum(langs[int(lang_id.text_scores(" ".join(draw.choices(w, k=60)), likelihood).argmax())] == lang
               for lang, w in words.items()) > 290


def test_fusion_against_plain_arithmetic(spark):
    """Posteriors of a few pages recomputed by hand from text likelihood, declared language, suffix and the chain of priors."""
    import numpy as np

    draw = random.Random(3)
    words = {"de": "und der die nicht ist".split(), "en": "the and of not is".split(), "fr": "le et des pas est".split()}
    docs = spark.createDataFrame([(" ".join(draw.choices(w, k=80)), lang) for lang, w in words.items() for _ in range(5)],
                                 "text string, lang string")
    rows = []
    for i in range(60):
        lang = draw.choice(list(words))
        host = draw.choice(["a.x.de", "b.x.de", "y.com", "z.fr", ""])
        text = " ".join(draw.choices(words[lang], k=draw.choice([0, 2, 40])))
        declared = draw.choice(["", f' lang="{lang}"', ' lang="en-GB"', " lang=xx"])
        rows.append((i, f"http://{host}/p" if host else None, f"<html{declared}><body><p>{text}.</p></body></html>"))
    model = lang_id.train(docs)
    langs, likelihood = model
    found = {r.page_id: r for r in lang_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    pages = []
    for i, url, source in rows:
        host = (url or "http://").split("//")[1].split("/")[0]
        said = source[5:source.index(">")].replace(' lang=', "").strip('"')[:2]
        text = lang_id.text_scores(html_text.main_text(source), likelihood)
        pages.append({"host": host, "suffix": host.split(".")[-1], "domain": ".".join(host.split(".")[-2:]),
                      "declared": said if said in ("", *langs) else "other", "text": text, "p": softmax(text)})
    base = sum(p["p"] for p in pages) + lang_id.SMOOTHING
    base = base / base.sum()
    for i, page in enumerate(pages):
        def level(key, prior):
            counts = np.maximum(sum(q["p"] for q in pages if q[key] == page[key]) - page["p"], 0)
            return (counts + lang_id.PRIOR_WEIGHT * prior) / (counts.sum() + lang_id.PRIOR_WEIGHT)

        prior = level("host", level("domain", base))
        evidence = np.log(level("declared", base) / base) + np.log(level("suffix", base) / base)
        fused = softmax(page["text"] + np.log(prior) + evidence)
        assert found[i].declared == page["declared"] and found[i].host == page["host"]
        assert abs(found[i].confidence - fused.max()) < 1e-6
        assert found[i].lang == langs[int(fused.argmax())] or abs(np.sort(fused)[-1] - np.sort(fused)[-2]) < 1e-9
