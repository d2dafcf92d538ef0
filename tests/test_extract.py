"""Reading pages: selectors, fallbacks, pagination and broken markup."""

from pyspark.sql import functions as F

from opinia.operators import extract, records
from opinia.operators.extract import Outline, _read_page
from opinia.plans.ingest import page_reviews
from opinia.schema import PAGES

BLOCK = """
<div id="cm_cr-review_list"><div data-hook="review" id="customer_review-1">
 <a data-hook="review-title" href="/x/reviews/R12?a=1&amp;b"><i data-hook="review-star-rating">
 <span class="a-icon-alt">4,0 sur 5 étoiles</span></i> <span>Titre &amp; <b>gras</b></span></a>
 <span class='x a-profile-name'>Bob<br>by</span><span data-hook=review-date>le 1er mai 2024</span>
 <span data-hook="verified-purchase-badge">Achat vérifié</span>
 <span data-hook="review-body"><script>var a = "<p>";</script><span>Bon &lt;produit&gt;</span></span>
 <span data-hook="helpful-vote-statement">3 utile</span></div></div>
"""


def test_block_fields():
    page = _read_page(BLOCK)
    assert page["matched_selector"] == '[data-hook="review"]'
    assert page["matched_blocks"] is None
    (block,) = page["blocks"]
    assert block["id_href"] == "/x/reviews/R12?a=1&b"
    assert block["title"].split() == ["4,0", "sur", "5", "étoiles", "Titre", "&", "gras"]
    assert block["rating"] == block["star_rating"] == "4,0 sur 5 étoiles"
    assert block["reviewer"] == "Bobby"
    assert block["date"] == "le 1er mai 2024"
    assert block["verified"] == "Achat vérifié" and "avp_badge" not in block
    assert block["body"] == 'var a = "<p>";Bon <produit>'
    assert "variant" not in block


def test_icon_before_star_rating_wins():
    (block,) = _read_page(
        '<div data-hook="review"><i class="a-icon-alt">2</i>'
        '<i data-hook="review-star-rating">3</i></div>')["blocks"]
    assert (block["rating"], block["star_rating"]) == ("2", "3")


def test_selector_chain():
    for html, selector in [
        ('<p id="customer_review-9"><b data-hook="review-title">T</b></p>',
         '[id^="customer_review-"]'),
        ('<div data-hook="top-review-x">T</div>', 'div[data-hook*="review"]'),
        ('<div class="review aok-relative a-section">T</div>', "div.a-section.review.aok-relative"),
        ("<p>nothing</p>", None),
    ]:
        page = _read_page(html)
        assert page["matched_selector"] == selector
        assert page["blocks"] == []
        assert len(page["matched_blocks"] or []) == (0 if selector is None else 1)


def test_pagination():
    def flags(inner):
        page = _read_page(f'<ul class="a-pagination">{inner}</ul>')
        return page["next_disabled"], page["next_link"], page["next_href"]

    assert flags('<li class="a-last"><a href="?p=2">x</a></li>') == (False, True, "?p=2")
    assert flags('<li class="a-disabled a-last"><a href="?p=2">x</a>') == (True, True, "?p=2")
    assert flags('<li class="a-last" aria-disabled="true"><a>x</a>') == (True, True, None)
    assert flags('<li class="a-last">x<li><a>1</a>') == (True, False, None)
    assert flags('<li><a href="/l?pageNumber=3">3</a></li>') == (False, True, "/l?pageNumber=3")
    assert flags("<li>1</li>") == (False, False, None)
    assert _read_page('<a aria-label="Page Weiter" href="w">')["next_href"] == "w"
    assert _read_page('<a data-hook="pagination-bar-next" href="n">')["next_href"] == "n"
    assert not _read_page('<a href="/l?pageNumber=3">3</a>')["next_link"]


def test_header_places():
    hook = "<div data-hook='cr-filter-info-review-count'> {} </div>"
    assert _read_page(hook.format("12 avis"))["header_text"] == "12 avis"
    section = '<div id="filter-info-section">all <span class="a-size-base">{}</span></div>'
    assert _read_page(hook.format("") + section.format("7"))["header_text"] == "7"
    assert _read_page(section.format(""))["header_text"] == "all"
    assert _read_page('<div class="a-size-base a-row a-spacing-base">9</div>')["header_text"] == "9"
    assert _read_page("<p>")["header_text"] is None


def test_other_texts():
    page = _read_page(
        '<script type="application/ld+json">{"reviewCount": 12, "t": "<b>"}</script>'
        '<span id=acrCustomerReviewText>34 notes</span><a id="nav-link-accountList">Sign in</a>')
    assert '"reviewCount": 12, "t": "<b>"' in page["jsonld_text"]
    assert (page["rating_count_text"], page["account_text"]) == ("34 notes", "Sign in")


def test_broken_markup():
    assert _read_page(None)["error"] is None
    outline = Outline('a < b <!-- <p> --> &eacute; <p>x<p>y</i><img src="a>b">z<!-- end')
    assert outline.tags == ["p", "p", "img"]
    assert outline.parent == [-1, -1, 1]
    assert [outline.text(n) for n in (0, 1)] == ["x", "yz"]
    assert "".join(outline.texts).startswith("a < b  é ")
    assert Outline('<a href="unclosed>text').tags == []
    assert Outline("<SCRIPT>if (a<b) '</p>'").texts == ["if (a<b) '</p>'"]


def test_frame_and_strict_mode(spark):
    bare = '<div data-hook="review"><i class="a-icon-alt">2</i></div>'
    odd = '<div data-hook="review"><a href="/reviews/abc">x</a><b data-hook="review-title">T</b></div>'
    rows = [("A", None, None, i + 1, "u", html, None, None, None)
            for i, html in enumerate([BLOCK, bare, odd, None])]
    extracted = extract.extract_pages(spark.createDataFrame(rows, PAGES))
    assert "html" not in extracted.columns
    assert extracted.filter(F.col("error").isNotNull()).count() == 0
    lenient = {r["page"]: r for r in page_reviews(extracted).collect()}
    assert lenient[1]["review_id"] == "R12" and lenient[1]["verified_purchase"]
    assert lenient[1]["review_title"] == "Titre & gras" and lenient[1]["review_date"] == "2024-05-01"
    assert lenient[2]["review_title"] == "" and lenient[2]["rating"] == 2.0
    assert lenient[2]["review_id"] == "sha1_3eb416223e9e69e6bb8ee19793911ad1ad2027d8"
    assert lenient[3]["review_id"].startswith("sha1_")
    strict = records.typed_reviews(extract.explode_blocks(extracted, strict=True), strict=True)
    (only,) = strict.collect()
    # The strict badge knows one hook; the text-free and the odd-link blocks have no id.
    assert (only["page"], only["verified_purchase"], only["variant"]) == (1, False, None)
