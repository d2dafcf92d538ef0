"""Review-shaped tables derived from the sample tables.

The sample tables hold no reviews.  Every lineitem row becomes one review block
of the product `l_partkey`; orders that have a document carry its whole text as
the body.  `workload/oracle.py` states the same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.constants import (
    CHALLENGE_MARKERS, ERROR_MARKERS, LOGIN_MARKERS, MARKETS, NEXT_LINK_LABELS,
    SIGN_IN_INVITATIONS,
    STAR_LABEL_BY_CODE,
)
from opinia.functions.urls import generate_review_url
from opinia.operators.ranking import ordinal, running
from opinia.operators.records import typed_reviews
from opinia.sources.scratch import scratch_path

DOMAINS = [f"www.{d}" for d in MARKETS]
STARS = list(STAR_LABEL_BY_CODE)
MARKERS = [*CHALLENGE_MARKERS, *ERROR_MARKERS, *LOGIN_MARKERS]
MONTHS_SHOWN = {
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "en": "January February March April May June July August September October November December",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
}
# A total order of lineitem rows (they are fully distinct).
ORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
       "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
PAGE_SIZE = 10
# Lines of a product that one task puts on its pages; those of larger products are spread.
PRODUCT_LINES = 20_000
BLOCK_FORMS = ['<div data-hook="review">', '<section id="customer_review-x">',
               '<div data-hook="cmps-review-item">', '<div class="aok-relative review x a-section">', "<p>"]
BLOCK_ENDS = ["</div>", "</section>", "</div>", "</div>", "</p>"]
# Pagination as pages write it: forms with a next page, then forms without one.
NEXT_SHOWN = ['<ul class="a-pagination"><li class="a-last"><a href="/n?pageNumber=2">x</a></li></ul>',
              *[f'<a aria-label="{label}" href="/n">x</a>' for label in NEXT_LINK_LABELS],
              '<a data-hook="pagination-bar-next" href="/n">x</a>',
              '<ul class="a-pagination"><li><a href="/n?pageNumber=3">3</a></li></ul>']
NEXT_FORMS = [*NEXT_SHOWN,
              '<ul class="a-pagination"><li class="a-disabled a-last"><a href="/n?pageNumber=2">x</a></li></ul>',
              '<ul class="a-pagination"><li class="a-last" aria-disabled="true"><a href="/n">x</a></li></ul>',
              '<ul class="a-pagination"><li class="a-last">x</li></ul>', '<a href="/n?pageNumber=2">elsewhere</a>']


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The sample tables are single files: give each core a part of one.

    A file of many splits is dealt out as it is; rows are moved only where most cores would wait.
    """
    if 2 * df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(*keys)


def pick(values: list[str], index: Column) -> Column:
    """Entry of a short list; NULL past its end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def product_code(key: Column) -> Column:
    return F.concat(F.lit("B"), F.lpad(key.cast("string"), 9, "0"))


def domain_of(key: Column) -> Column:
    return pick(DOMAINS, key % 7)


def star_of(key: Column) -> Column:
    return pick(STARS, F.floor(key / 7) % 6)


_stored: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written when an application first asks for it and read from there on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        rows, path = make(), scratch_path(spark, name)
        rows.write.option("compression", "zstd").parquet(path)
        _stored[key] = path, rows.schema
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def with_texts(spark: SparkSession, sf_dir: str, line: DataFrame) -> DataFrame:
    """Lines with the `text` of their order: the documents, by doc_id, belong to the first orders by key, one each.

    Lines of later orders are not moved.  Documents are numbered and meet orders as places in
    their files, so a text is moved once to the lines of its order.
    """
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("text_order")).distinct()
    orders = ordinal(orders, [], F.floor(F.col("text_order") / 65536), ["text_order"], "n")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    places = ordinal(docs.drop("text"), [], F.floor(F.col("doc_id") / 65536), ["doc_id"], "n").drop("doc_id")
    orders = orders.filter(F.col("n") <= docs.count())
    last = orders.agg(F.max("text_order")).first()[0]
    first = orders.join(places, "n", "left").drop("n")
    early = F.coalesce(F.col("l_orderkey") <= last, F.lit(False))
    matched = line.filter(early).join(first, F.col("l_orderkey") == F.col("text_order"), "left").drop(
        "text_order").join(docs.drop("doc_id"), "place", "left").drop("place")
    return matched.unionByName(line.filter(~early).withColumn("text", F.lit(None).cast("string")))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey")


def _named_lines(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    line = _lines(spark, sf_dir) if line is None else line
    return line.join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")


def _placed_lines(spark: SparkSession, sf_dir: str, line: DataFrame | None = None,
                  totals: dict[str, Column] | None = None) -> DataFrame:
    line = _named_lines(spark, sf_dir, line).withColumn("asin", product_code(F.col("l_partkey")))
    return with_pages(line, totals).drop("asin")


def raw_reviews(spark: SparkSession, sf_dir: str, body: bool = True) -> DataFrame:
    """Blocks as a page would show them, all strings; `body` joins the texts."""
    if not body:
        return _shown(spread(table(spark, sf_dir, "lineitem"), "l_orderkey"))
    return _shown(with_texts(spark, sf_dir, _named_lines(spark, sf_dir)))


def _shown(line: DataFrame) -> DataFrame:
    body = "text" in line.columns
    number, supplier = F.col("l_linenumber"), F.col("l_suppkey")
    quantity = F.col("l_quantity").cast("int")
    x = (1 + quantity % 5).cast("string")
    n = quantity.cast("string")
    rating = pick(
        ["{},0 sur 5 étoiles", "{}.0 out of 5 stars", "{} sur 5", "{}", "9.5", "",
         "{},0 von 5 Sternen"], number - 1)
    helpful = pick(
        ["{} personnes ont trouvé cela utile", "{} people found this helpful", "{} utile",
         "1,{} people found this helpful", "", "{}", "aucun vote"], number - 1)
    placed = [c for c in ("product", "page", "pos", "products") if c in line.columns]
    df = line.select(
        *ORD, *placed,
        # The same column where it is there, so that Spark knows that lines of a product are together.
        (F.col("product") if "product" in placed else product_code(F.col("l_partkey"))).alias("asin"),
        domain_of(F.col("l_partkey")).alias("domain"),
        star_of(F.col("l_partkey")).alias("star_filter"),
        F.when(number != 7, F.concat(
            F.lit("/reviews/R"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 4, "0"),
            F.lpad((F.col("l_orderkey") % 50).cast("string"), 2, "0"))).alias("id_href"),
        F.replace(rating, F.lit("{}"), x).alias("rating"),
        F.concat(F.lit("Titre "), (supplier % 5).cast("string")).alias("title_core"),
        *([_body(number, quantity).alias("body")] if body else []),
        _shown_date().alias("date"),
        F.when(F.col("l_returnflag") == "A", "Achat vérifié")
        .when(F.col("l_returnflag") == "N", "not verified").otherwise("").alias("verified"),
        F.replace(helpful, F.lit("{}"), n).alias("helpful"),
        F.concat(F.lit("User "), supplier.cast("string")).alias("reviewer"),
        F.when(F.col("l_discount") > 0, F.concat(
            F.lit("Taille: "), F.round(F.col("l_discount") * 100).cast("int").cast("string")))
        .alias("variant"),
    )
    title = F.when(F.col("l_tax") == 0, F.lit("")).otherwise(
        F.trim(F.concat_ws(" ", "rating", "title_core")))
    return df.withColumns({
        "title": title, "star_rating": F.col("rating"), "avp_badge": F.col("verified")})


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of `raw_reviews`."""
    return typed_reviews(raw_reviews(spark, sf_dir).drop("title_core"))


def with_pages(df: DataFrame, totals: dict[str, Column] | None = None) -> DataFrame:
    """Place each review on a page of ten, in order within its product."""
    numbered = running(df, ["asin"], F.floor(F.col("l_orderkey") / 65536), ORD,
                       sums={"rn": F.lit(1).cast("long")}, totals=totals)
    return _on_pages(numbered)


def _on_pages(numbered: DataFrame) -> DataFrame:
    return numbered.withColumns({
        "page": (F.floor((F.col("rn") - 1) / PAGE_SIZE) + 1).cast("int"),
        "pos": ((F.col("rn") - 1) % PAGE_SIZE).cast("int")}).drop("rn")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records with their page and position; all lines of a product meet in one task, but for large products."""
    few, many = _by_size(spark, sf_dir, PRODUCT_LINES)
    shown = _shown(_product_lines(spark, sf_dir, few)).drop("product", "products")
    if many is not None:
        shown = shown.unionByName(_shown(with_texts(spark, sf_dir, _placed_lines(spark, sf_dir, many))))
    return typed_reviews(shown.drop("title_core"))


def captured_pages(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """The review pages a browser would have captured, as HTML; `stored` for those who read them several times."""
    if not stored:
        return _captured_pages(spark, sf_dir)
    return _once(spark, sf_dir, "captured", lambda: _captured_pages(spark, sf_dir))


def _captured_pages(spark: SparkSession, sf_dir: str, product_lines: int = PRODUCT_LINES) -> DataFrame:
    """Pages of products of up to `product_lines` lines, made where their lines meet, and of larger ones."""
    few, many = _by_size(spark, sf_dir, product_lines)
    pages = _pages_of(_product_lines(spark, sf_dir, few), "product")
    return pages if many is None else pages.unionByName(_pages_of(_spread_lines(spark, sf_dir, many)))


def _by_size(spark: SparkSession, sf_dir: str, product_lines: int) -> tuple[DataFrame, DataFrame | None]:
    """Lines with their `product`, for products of up to `product_lines` lines, and those of larger ones, if any."""
    line = table(spark, sf_dir, "lineitem").withColumn("product", product_code(F.col("l_partkey")))
    large = line.groupBy("product").agg(F.count("*").alias("n")).filter(
        F.col("n") > product_lines).select(F.col("product").alias("_large"))
    if large.isEmpty():
        return line, None
    same = line["product"].eqNullSafe(large["_large"])
    return line.join(large, same, "left_anti"), line.join(large, same, "left_semi").drop("product")


def _product_lines(spark: SparkSession, sf_dir: str, line: DataFrame) -> DataFrame:
    """Placed lines with their texts: all lines of a product are moved to one task, once, and named there.

    The codes of products meet, as the pages are numbered by code; keys past nine digits may share one.
    """
    part = _parts(spark, sf_dir).withColumn("_code", product_code(F.col("p_partkey")))
    # Not an equality, which would have the lines moved by both.
    same_key = (F.col("l_partkey") >= F.col("p_partkey")) & (F.col("l_partkey") <= F.col("p_partkey"))
    named = with_texts(spark, sf_dir, line).join(
        part, (F.col("product") == F.col("_code")) & same_key, "left").drop("p_partkey", "_code")
    product = Window.partitionBy("product")
    return _on_pages(named.select("*", F.row_number().over(product.orderBy(*ORD)).cast("long").alias("rn"),
                                  F.count("*").over(product).alias("products")))


def _spread_lines(spark: SparkSession, sf_dir: str, line: DataFrame) -> DataFrame:
    """Placed lines with their texts, a page together: lines are placed before they get their texts."""
    placed = _placed_lines(spark, sf_dir, line, totals={"products": F.lit(1)})
    return with_texts(spark, sf_dir, placed).repartition("l_partkey", "page")


def _pages_of(placed: DataFrame, *keys: str) -> DataFrame:
    """The pages of placed lines, which meet on their page as numbers, not as HTML."""
    pages = _shown(placed).groupBy(*keys, "l_partkey", "page").agg(
        F.array_sort(F.collect_list(F.struct("pos", _block_html().alias("html")))).alias("blocks"),
        F.min("l_shipdate").alias("first_ship"), F.count("*").alias("n"), F.max("products").alias("products"))
    key, page = F.col("l_partkey"), F.col("page")
    pages = pages.withColumns({
        "asin": product_code(key), "domain": domain_of(key), "star_filter": star_of(key),
        "more": key.isNotNull() & (F.col("products") > page * PAGE_SIZE)})
    marker = pick(MARKERS, (key + page) % 100)
    invitation = pick([*SIGN_IN_INVITATIONS, "Bonjour, Ann"], key % 8)
    shown = F.col("first_ship").cast("timestamp")
    return pages.select(
        "asin", "domain", "star_filter", "page",
        generate_review_url(F.col("asin"), page, domain=F.col("domain"),
                            star_filter=F.col("star_filter")).alias("url"),
        F.concat(
            F.lit("<!DOCTYPE html><html><body>"),
            F.coalesce(F.concat(F.lit('<a id="nav-link-accountList">'), invitation,
                                F.lit("</a>")), F.lit("")),
            F.when(page % 2 == 0, F.concat(
                F.lit('<div data-hook="cr-filter-info-review-count">'), shown_total(key),
                F.lit(" évaluations</div>"))).otherwise(""),
            F.when(page == 3, F.concat(
                F.lit('<script type="application/ld+json">{"reviewCount": '),
                shown_count(key), F.lit("}</script>"))).otherwise(""),
            F.when(page == 2, F.concat(
                F.lit('<span id="acrCustomerReviewText">'), (key % 900).cast("string"),
                F.lit(" notes</span>"))).otherwise(""),
            F.lit('<div id="cm_cr-review_list">'),
            F.array_join(F.transform("blocks", lambda b: b["html"]), ""),
            F.lit('</div><ul class="a-pagination">'),
            F.when(F.col("more"), F.concat(
                F.lit('<li class="a-last"><a href="/next?pageNumber='),
                (page + 1).cast("string"), F.lit('">Suivant</a></li>')))
            .otherwise('<li class="a-disabled a-last">Suivant</li>'),
            F.lit("</ul>"),
            F.coalesce(F.concat(F.lit("<p>"), marker, F.lit("</p>")), F.lit("")),
            F.lit("</body></html>"),
        ).alias("html"),
        shown.alias("started_at"),
        F.timestamp_millis(F.unix_millis(shown) + F.col("n") * 137).alias("finished_at"),
    )


def shown_total(key: Column) -> Column:
    """A grouped number as pages print it, with a no-break or narrow space."""
    gap = F.when(key % 2 == 0, F.lit("\N{NO-BREAK SPACE}")).otherwise(
        F.lit("\N{NARROW NO-BREAK SPACE}"))
    return F.concat((1 + key % 9).cast("string"), gap, F.lpad((key % 1000).cast("string"), 3, "0"))


def shown_count(key: Column) -> Column:
    return F.concat((1 + key % 5).cast("string"), F.lit(","),
                    F.lpad((key % 1000).cast("string"), 3, "0"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample web pages, most with a marker added, some in upper case."""
    marker = pick(MARKERS, F.col("page_id") % 30)
    cased = F.when(F.floor(F.col("page_id") / 30) % 2 == 1, F.upper(marker)).otherwise(marker)
    return spread(table(spark, sf_dir, "pages"), "page_id").withColumn(
        "html", F.concat("html", F.coalesce(cased, F.lit(""))))


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small page per part, in turn with each block container and pagination form."""
    key, name = F.col("p_partkey"), F.col("p_name")
    opening = pick(BLOCK_FORMS, key % 5)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        key, F.concat(F.lit("<html><body>"), opening, F.lit('<span data-hook="review-body">'), name,
                      F.lit("</span>"), pick(BLOCK_ENDS, key % 5), pick(NEXT_FORMS, key % len(NEXT_FORMS)),
                      F.lit("</body></html>")).alias("html"))


HEADER_FORMS = ['<div data-hook="cr-filter-info-review-count">{}</div>',
                '<div id="filter-info-section"><span class="a-size-base">{}</span> x</div>',
                '<div class="a-size-base a-row a-spacing-base">{}</div>',
                '<div id="filter-info-section"><b>{}</b></div>', "<div>{}</div>",
                '<div data-hook="cr-filter-info-review-count"> </div><div class="a-row a-spacing-base a-size-base">{}</div>']


def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small page per part, in turn with each place that shows the announced total, and one that does not."""
    key = F.col("p_partkey")
    shown = F.replace(pick(HEADER_FORMS, key % len(HEADER_FORMS)), F.lit("{}"), F.concat(shown_total(key), F.lit(" avis")))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        key, F.concat(F.lit("<html><body>"), shown, F.lit("</body></html>")).alias("html"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as a log of page runs: a user is a product."""
    user, eid = F.col("user_id"), F.col("event_id")
    failed = F.col("event_type") == "error"
    star = pick(STARS, eid % 6)
    return table(spark, sf_dir, "events").select(
        "event_id",
        product_code(user).alias("asin"),
        domain_of(user).alias("domain"),
        star.alias("star_filter"),
        # Pages of a run are its events in order of arrival, so they have gaps.
        (eid + 1).cast("int").alias("page"),
        F.when(failed, 0).otherwise(F.floor(F.col("value")) + 2).cast("long")
        .alias("reviews_parsed"),
        F.when(failed, 0).otherwise(F.floor(F.col("value"))).cast("long").alias("saved"),
        F.col("value").alias("duration_s"),
        (~failed & (eid % 5 != 0)).alias("next"),
        F.when(failed, F.concat(F.lit("timeout "), (eid % 7).cast("string"))).alias("error"),
        F.when(~failed & (eid % 4 == 0), (eid % 5000).cast("long")).alias("total_reviews_header"),
        F.when(~failed & (eid % 9 == 0), (eid % 7000).cast("long"))
        .alias("product_global_review_count"),
    )


def product_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a URL list, one per part: pages, comments, blanks and noise."""
    key, code = F.col("p_partkey"), product_code(F.col("p_partkey"))
    host = F.coalesce(domain_of(key), F.lit("www.example.com"))
    form = key % 9
    line = (
        F.when(form == 0, F.concat(F.lit("https://"), host, F.lit("/dp/"), code))
        .when(form == 1, F.concat(F.lit("  https://"), host, F.lit("/gp/product/"), code,
                                  F.lit("?language=it_IT ")))
        .when(form == 2, F.concat(F.lit("https://"), host, F.lit("/product-reviews/"), code,
                                  F.lit("/?sortBy=helpful&languageLocale=de%5FDE&x=1#top")))
        .when(form == 3, F.concat(F.lit("https://u@"), host, F.lit(":8443/x/product-reviews/"),
                                  code, F.lit("?reviewerType=avp_only+reviews&language=")))
        .when(form == 4, F.concat(host, F.lit("/dp/"), code, F.lit(";p=1?language=fr%zz")))
        .when(form == 5, F.concat(F.lit("# https://"), host, F.lit("/dp/"), code))
        .when(form == 6, F.lit(" \t "))
        .when(form == 7, F.concat(F.lit("https://"), host, F.lit("/s?k="), F.col("p_name")))
        .otherwise(F.concat(F.lit("https://"), host, F.lit("/product-reviews//dp/"), code))
    )
    return table(spark, sf_dir, "part").select(
        key.alias("line_no"), line.alias("line"), code.alias("code"))


def _body(number: Column, quantity: Column) -> Column:
    from_doc = F.concat(F.col("text"), F.lit("\x1f  fin "), (number % 2).cast("string"))
    from_part = F.concat(F.col("p_name"), F.lit("  "), F.col("p_type"), F.lit("\nlot "),
                         (quantity % 3).cast("string"))
    return F.when(F.col("l_tax") == 0, F.lit("")).otherwise(
        F.concat(F.lit("Avis:\t"), F.coalesce(from_doc, from_part, F.lit(""))))


def _shown_date() -> Column:
    """The ship date in one of eight written forms."""
    ship, form = F.col("l_shipdate"), F.col("l_suppkey") % 8
    day = F.day(ship).cast("string")
    year = F.year(ship).cast("string")
    name = {lang: pick(names.split(), F.month(ship) - 1) for lang, names in MONTHS_SHOWN.items()}
    return (
        F.when(form == 0, F.concat_ws(" ", F.lit("le"), day, name["fr"], year))
        .when(form == 1, F.concat_ws(" ", day, name["fr"], year))
        .when(form == 2, F.concat(name["en"], F.lit(" "), day, F.lit(", "), year))
        .when(form == 3, F.concat_ws(" ", F.lit("Reviewed on"), day, name["en"], year))
        .when(form == 4, F.concat_ws(" de ", day, name["es"], year))
        .when(form == 5, F.concat(day, F.lit(". "), name["de"], F.lit(" "), year))
        .when(form == 6, F.date_format(ship, "yyyy-MM-dd"))
        .otherwise(F.lit("31 février 2024"))
    )


def _block_html() -> Column:
    def escaped(c: Column) -> Column:
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    def element(opening: str, c: Column, closing: str) -> Column:
        return F.coalesce(F.concat(F.lit(opening), escaped(c), F.lit(closing)), F.lit(""))

    href = F.coalesce(F.concat(F.lit(' href="'), F.col("id_href"), F.lit('"')), F.lit(""))
    star = element('<i data-hook="review-star-rating"><span class="a-icon-alt">',
                   F.col("rating"), "</span></i>")
    with_text = F.concat(
        F.lit('<a data-hook="review-title"'), href, F.lit(">"), star, F.lit(" <span>"),
        F.col("title_core"), F.lit("</span></a>"))
    without_text = F.concat(F.lit("<a"), href, F.lit("></a>"), star)
    has_text = F.col("l_tax") != 0
    return F.concat(
        F.lit('<div data-hook="review" id="customer_review-x">'),
        F.when(has_text, with_text).otherwise(without_text),
        element('<span class="a-profile-name">', F.col("reviewer"), "</span>"),
        element('<span data-hook="review-date">', F.col("date"), "</span>"),
        element('<a data-hook="format-strip">', F.col("variant"), "</a>"),
        element('<span data-hook="avp-badge">', F.col("verified"), "</span>"),
        F.when(has_text, element('<span data-hook="review-body"><span>', F.col("body"),
                                 "</span></span>")).otherwise(""),
        element('<span data-hook="helpful-vote-statement">', F.col("helpful"), "</span>"),
        F.lit("</div>"),
    )
