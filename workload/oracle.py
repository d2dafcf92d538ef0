"""The registered queries in DuckDB SQL, stated independently of the Spark code.

Fixed values come from `opinia.constants`; every rule is written again here.
"""

from __future__ import annotations

from opinia import constants as k
from workload.derive import DOMAINS, MARKERS, MONTHS_SHOWN, NEXT_FORMS, NEXT_SHOWN, STARS

SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WD = r"[\p{L}\p{N}_]"
ORD = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, "
       "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(x: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(a) if isinstance(a, str) else a} THEN "
                    f"{q(b) if isinstance(b, str) else b}" for a, b in table.items())
    return f"CASE {x} {arms} ELSE {default} END"


def pick(values: list[str], index: str) -> str:
    return case(index, dict(enumerate(values)))


def code(x: str) -> str:
    return f"'B' || lpad(CAST({x} AS VARCHAR), 9, '0')"


def clean(x: str) -> str:
    pattern = r"[\x00-\x20\x{7f}-\x{9f}\p{Z}]+"
    return f"coalesce(trim(regexp_replace({x}, '{pattern}', ' ', 'g')), '')"


def grp(x: str, pattern: str, n: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {n})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def rating(x: str) -> str:
    def valid(text: str) -> str:
        number = f"TRY_CAST(replace({text}, ',', '.') AS DOUBLE)"
        return f"CASE WHEN {number} BETWEEN 1 AND 5 THEN {number} END"

    first = grp(x, r"(\d+(?:[.,]\d+)?)")
    whole = r"^[1-5](?:[.,]0)?[\n]?$"
    return (
        f"coalesce({valid(grp(x, rf'(\d+[.,]\d+){SP}*sur{SP}*5'))}, "
        f"{valid(grp(x, r'(\d+[.,]\d+)'))}, "
        f"CASE WHEN {has(x, rf'\d{SP}*sur{SP}*5')} THEN {valid(first)} END, "
        f"CASE WHEN {has(x, whole)} THEN {valid(first)} END)"
    )


def _named(x, pattern, day, month, year, months, as_written=False):
    d = f"TRY_CAST(replace({grp(x, pattern, day)}, 'er', '') AS INT)"
    y = grp(x, pattern, year)
    if not as_written:
        y = f"CAST(TRY_CAST({y} AS INT) AS VARCHAR)"
    return (f"CASE WHEN {d} BETWEEN 1 AND 31 THEN {y} || '-' || "
            f"{case(grp(x, pattern, month), months)} || '-' || "
            f"lpad(CAST({d} AS VARCHAR), 2, '0') END")


def _numbered(x, pattern, day, month, year):
    d, m, y = (f"TRY_CAST({grp(x, pattern, i)} AS INT)" for i in (day, month, year))
    return (f"CASE WHEN {d} BETWEEN 1 AND 31 AND {m} BETWEEN 1 AND 12 THEN CAST({y} AS VARCHAR) "
            f"|| '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || "
            f"lpad(CAST({d} AS VARCHAR), 2, '0') END")


def date_fr(x: str) -> str:
    day = rf"(\d{{1,2}}|1er){SP}+({WD}+){SP}+(\d{{4}})"
    return ("coalesce("
            + _named(x, rf"le{SP}+{day}", 1, 2, 3, k.MONTHS_FR, True) + ", "
            + _named(x, day, 1, 2, 3, k.MONTHS_FR, True) + ", "
            + _numbered(x, r"(\d{1,2})/(\d{1,2})/(\d{4})", 1, 2, 3) + ", "
            + _numbered(x, r"(\d{4})-(\d{1,2})-(\d{1,2})", 3, 2, 1) + ")")


def date_any(x: str) -> str:
    plain = rf"(\d{{1,2}}){SP}+({WD}+){SP}+(\d{{4}})"
    comma = rf"({WD}+){SP}+(\d{{1,2}}),{SP}*(\d{{4}})"
    spanish = rf"(\d{{1,2}}){SP}+de{SP}+({WD}+){SP}+de{SP}+(\d{{4}})"
    dotted = rf"(\d{{1,2}})(?:[.|]|{SP})+({WD}+){SP}+(\d{{4}})"
    return ("coalesce(" + ", ".join([
        date_fr(x),
        _named(x, comma, 2, 1, 3, k.MONTHS_EN),
        _named(x, plain, 1, 2, 3, k.MONTHS_EN),
        _named(x, spanish, 1, 2, 3, k.MONTHS_ES),
        _named(x, plain, 1, 2, 3, k.MONTHS_IT),
        _named(x, dotted, 1, 2, 3, k.MONTHS_DE),
        _named(x, plain, 1, 2, 3, k.MONTHS_NL),
        _numbered(x, r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", 1, 2, 3),
    ]) + ")")


def votes(x: str) -> str:
    low = f"lower({x})"
    found = [
        rf"(\d+){SP}+personnes?{SP}+ont{SP}+trouvé{SP}+cela{SP}+utile",
        rf"(\d+){SP}+people?{SP}+found{SP}+this{SP}+helpful",
        rf"(\d+){SP}+utile",
        r"(\d+)",
    ]
    texts = ", ".join(f"nullif({grp(low, p)}, '')" for p in found)
    return f"coalesce(TRY_CAST(coalesce({texts}) AS INT), 0)"


def verified(x: str) -> str:
    low = f"lower({x})"
    return (f"coalesce(NOT (contains({low}, 'pas vérifié') OR contains({low}, 'not verified')) "
            f"AND (contains({low}, 'vérifié') OR contains({low}, 'verified')), false)")


def strip_title(x: str) -> str:
    for words in (rf"sur{SP}*5{SP}*étoiles?", rf"out{SP}*of{SP}*5{SP}*stars?"):
        x = (f"regexp_replace({x}, "
             f"'^{SP}*\\d+[.,]?\\d*{SP}*{words}{SP}*[-–—]*{SP}*', '', 'i')")
    return clean(f"regexp_replace({x}, '^(?:[★☆]|{SP})+', '')")


def review_hash(title: str, body: str) -> str:
    return f"'sha1_' || sha1({clean(title)} || '|' || {clean(body)})"


def href_id(x: str) -> str:
    return f"nullif({grp(x, '/reviews/([A-Z0-9]+)')}, '')"


def content_key(r: str = "") -> str:
    t, b = clean(f"{r}review_title"), clean(f"{r}review_body")
    facts = (f"{clean(f'{r}reviewer_name')} || '|' || coalesce({r}review_date, '') || '|' || "
             f"coalesce(CASE WHEN {r}rating <> 0 THEN CAST({r}rating AS VARCHAR) END, '') "
             f"|| '|' || {clean(f'{r}variant')}")
    return f"sha1(CASE WHEN {t} <> '' OR {b} <> '' THEN {t} || '|' || {b} ELSE {facts} END)"


def sentiment(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'Neutre' WHEN {x} >= 4 THEN 'Positif' "
            f"WHEN {x} <= 2 THEN 'Négatif' ELSE 'Neutre' END")


def sentiment_rank(x: str) -> str:
    return case(x, {"Positif": 0, "Neutre": 1, "Négatif": 2})


def local_int(x: str, nbsp: bool = True) -> str:
    if nbsp:
        x = f"translate({x}, chr(160) || chr(8239), '  ')"
    number = f"translate({grp(x, rf'(\d(?:[\d.,]|{SP})*)')}, ' .,', '')"
    return f"TRY_CAST(regexp_replace({number}, '^{SP}+|{SP}+$', '', 'g') AS BIGINT)"


def domain_of(x: str) -> str:
    return pick(DOMAINS, f"({x}) % 7")


def star_of(x: str) -> str:
    return pick(STARS, f"(({x}) // 7) % 6")


def label(x: str) -> str:
    return case(x, k.STAR_LABEL_BY_CODE, "'Toutes'")


def label_rank(x: str) -> str:
    return case(x, {v: i for i, v in enumerate([*k.STAR_LABEL_BY_CODE.values(), "Toutes"])})


def product_url(asin: str, domain: str) -> str:
    return f"'https://' || coalesce(nullif({domain}, ''), 'www.amazon.fr') || '/dp/' || {asin}"


def review_url(asin, page, domain, star, sort="NULL", kind="'all_reviews'", language="NULL"):
    return (f"'https://' || coalesce(nullif({domain}, ''), 'www.amazon.fr') || "
            f"'/product-reviews/' || {asin} || '/?reviewerType=' || {kind} || '&sortBy=' || "
            f"coalesce(nullif({sort}, ''), 'recent') || '&filterByStar=' || "
            f"coalesce(nullif({star}, ''), 'all_stars') || "
            f"coalesce('&filterByLanguage=' || nullif({language}, ''), '') || "
            f"CASE WHEN {page} > 1 THEN '&pageNumber=' || CAST({page} AS VARCHAR) ELSE '' END")


def _raw() -> str:
    x = "CAST(1 + CAST(l_quantity AS INT) % 5 AS VARCHAR)"
    n = "CAST(CAST(l_quantity AS INT) AS VARCHAR)"
    form = "l_suppkey % 8"
    day, year = "CAST(day(l_shipdate) AS VARCHAR)", "CAST(year(l_shipdate) AS VARCHAR)"
    name = {g: pick(m.split(), "month(l_shipdate) - 1") for g, m in MONTHS_SHOWN.items()}
    return f"""raw0 AS (
  SELECT l.*, {code('l_partkey')} AS asin, {domain_of('l_partkey')} AS domain,
    {star_of('l_partkey')} AS star_filter,
    CASE WHEN l_linenumber <> 7 THEN '/reviews/R' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 4, '0')
      || lpad(CAST(l_orderkey % 50 AS VARCHAR), 2, '0') END AS id_href,
    CASE l_linenumber WHEN 1 THEN {x} || ',0 sur 5 étoiles' WHEN 2 THEN {x} || '.0 out of 5 stars'
      WHEN 3 THEN {x} || ' sur 5' WHEN 4 THEN {x} WHEN 5 THEN '9.5' WHEN 6 THEN ''
      WHEN 7 THEN {x} || ',0 von 5 Sternen' END AS rating_text,
    'Titre ' || CAST(l_suppkey % 5 AS VARCHAR) AS title_core,
    CASE WHEN l_tax = 0 THEN '' ELSE 'Avis:' || chr(9) || coalesce(
      d.text || chr(31) || '  fin ' || CAST(l_linenumber % 2 AS VARCHAR),
      p.p_name || '  ' || p.p_type || chr(10) || 'lot ' || CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR),
      '') END AS body,
    CASE {form} WHEN 0 THEN 'le ' || {day} || ' ' || {name['fr']} || ' ' || {year}
      WHEN 1 THEN {day} || ' ' || {name['fr']} || ' ' || {year}
      WHEN 2 THEN {name['en']} || ' ' || {day} || ', ' || {year}
      WHEN 3 THEN 'Reviewed on ' || {day} || ' ' || {name['en']} || ' ' || {year}
      WHEN 4 THEN {day} || ' de ' || {name['es']} || ' de ' || {year}
      WHEN 5 THEN {day} || '. ' || {name['de']} || ' ' || {year}
      WHEN 6 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '31 février 2024' END AS date_text,
    CASE l_returnflag WHEN 'A' THEN 'Achat vérifié' WHEN 'N' THEN 'not verified' ELSE '' END
      AS verified_text,
    CASE l_linenumber WHEN 1 THEN {n} || ' personnes ont trouvé cela utile'
      WHEN 2 THEN {n} || ' people found this helpful' WHEN 3 THEN {n} || ' utile'
      WHEN 4 THEN '1,' || {n} || ' people found this helpful' WHEN 5 THEN '' WHEN 6 THEN {n}
      WHEN 7 THEN 'aucun vote' END AS helpful_text,
    'User ' || CAST(l_suppkey AS VARCHAR) AS reviewer_text,
    CASE WHEN l_discount > 0 THEN 'Taille: ' || CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR)
      END AS variant_text
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
    LEFT JOIN (SELECT k, text FROM (SELECT k, row_number() OVER (ORDER BY k) AS i
        FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem))
      JOIN (SELECT text, row_number() OVER (ORDER BY doc_id) AS i FROM documents) USING (i)) d
    ON l.l_orderkey = d.k),
raw AS (
  SELECT *, CASE WHEN l_tax = 0 THEN '' ELSE trim(rating_text || ' ' || title_core) END AS title
  FROM raw0)"""


RAW = _raw()
TYPED = f"""{RAW},
typed AS (
  SELECT {ORD}, asin, domain, star_filter,
    coalesce({href_id('id_href')}, {review_hash('title', 'body')}) AS review_id,
    {strip_title('title')} AS review_title, {clean('body')} AS review_body,
    {rating('rating_text')} AS rating, {date_any('lower(date_text)')} AS review_date,
    {verified('verified_text')} AS verified_purchase, {votes('helpful_text')} AS helpful_votes,
    {clean('reviewer_text')} AS reviewer_name, {clean('variant_text')} AS variant
  FROM raw)"""


def paged(of: str) -> str:
    return f"""paged AS (
  SELECT *, CAST((rn - 1) // 10 + 1 AS INT) AS page, CAST((rn - 1) % 10 AS INT) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY {ORD}) AS rn FROM {of}))"""


def first(name: str, source: str, keys: str, order: str) -> str:
    return (f"{name} AS (SELECT * FROM {source} QUALIFY "
            f"row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)")


PAIR = f"{clean('review_title')} || chr(31) || {clean('review_body')}"


def greedy(source: str, rounds: int = 8) -> str:
    """The cross-page rule as unrolled rounds on narrow keys; `survivors` is the result."""
    at = "asin, page, pos"
    parts = [f"g0 AS MATERIALIZED (SELECT {at}, review_id, sha256({PAIR}) AS pair FROM {source})"]
    for i in range(rounds):
        parts.append(
            f"w{i} AS MATERIALIZED (SELECT {at}, review_id, pair FROM (SELECT *, "
            f"row_number() OVER (PARTITION BY asin, review_id ORDER BY page, pos) AS a, "
            f"row_number() OVER (PARTITION BY asin, pair ORDER BY page, pos) AS b FROM g{i}) "
            f"WHERE a = 1 AND b = 1)")
        parts.append(
            f"g{i + 1} AS MATERIALIZED (SELECT * FROM g{i} g WHERE NOT EXISTS (SELECT 1 FROM w{i} w "
            f"WHERE w.asin = g.asin AND w.review_id = g.review_id) AND NOT EXISTS (SELECT 1 FROM "
            f"w{i} w WHERE w.asin = g.asin AND w.pair = g.pair))")
    union = " UNION ALL ".join(f"SELECT {at} FROM w{i}" for i in range(rounds))
    # Rows still open after the last round would show up as a mismatch.
    rest = f"SELECT {at} FROM g{rounds}"
    return ",\n".join([*parts, f"survivors AS (SELECT s.* FROM {source} s SEMI JOIN "
                       f"({union} UNION ALL {rest}) USING (asin, page, pos))"])


IN_PAGE = ",\n".join([
    first("by_id", "paged", "asin, page, review_id", "pos"),
    first("by_content", "by_id", f"asin, page, {PAIR}", "pos"),
])
REVIEW = ("review_id, review_title, review_body, rating, review_date, verified_purchase, "
          "helpful_votes, reviewer_name, variant")
KEY = "l_orderkey, l_linenumber, asin"

MARKED = f"""marked AS (
  SELECT page_id, url, html || coalesce(CASE WHEN (page_id // 30) % 2 = 1 THEN upper(m) ELSE m END, '')
    AS html FROM (SELECT *, {pick(MARKERS, 'page_id % 30')} AS m FROM pages))"""


def mentions(x: str, markers) -> str:
    return "coalesce(" + " OR ".join(f"contains({x}, {q(m)})" for m in markers) + ", false)"


STATUS = (f"CASE WHEN {mentions('lower(html)', k.CHALLENGE_MARKERS)} THEN 'challenge' "
          f"WHEN {mentions('lower(html)', k.LOGIN_MARKERS)} THEN 'login' "
          f"WHEN {mentions('lower(html)', k.ERROR_MARKERS)} THEN 'error' ELSE 'ok' END")

# Captured pages: one row per product page, with what each should yield.
PAGE_FACTS = """page_facts AS (
  SELECT asin, domain, star_filter, l_partkey, page, count(*) AS n,
    max(page) OVER (PARTITION BY asin) > page AS more,
    (l_partkey + page) % 100 AS marker
  FROM paged GROUP BY asin, domain, star_filter, l_partkey, page)"""
# Markers 0-8 are challenges and 20-25 login forms; the error ones stay usable.
USABLE = "(marker BETWEEN 9 AND 19 OR marker > 25)"
HEADER = ("CASE WHEN page % 2 = 0 THEN (1 + l_partkey % 9) * 1000 + l_partkey % 1000 END")
PRODUCT_COUNT = ("CASE WHEN page = 3 THEN (1 + l_partkey % 5) * 1000 + l_partkey % 1000 "
                 "WHEN page = 2 THEN l_partkey % 900 END")
SIGNED_OUT = "(l_partkey % 8 < 6 OR marker BETWEEN 20 AND 25)"

EVENTS = f"""runs AS (
  SELECT event_id, {code('user_id')} AS asin, {domain_of('user_id')} AS domain,
    {pick(STARS, 'event_id % 6')} AS star_filter, CAST(event_id + 1 AS INT) AS page,
    CAST(CASE WHEN failed THEN 0 ELSE floor(value) + 2 END AS BIGINT) AS reviews_parsed,
    CAST(CASE WHEN failed THEN 0 ELSE floor(value) END AS BIGINT) AS saved,
    value AS duration_s, NOT failed AND event_id % 5 <> 0 AS next,
    CASE WHEN failed THEN 'timeout ' || CAST(event_id % 7 AS VARCHAR) END AS error,
    CASE WHEN NOT failed AND event_id % 4 = 0 THEN event_id % 5000 END AS total_reviews_header,
    CASE WHEN NOT failed AND event_id % 9 = 0 THEN event_id % 7000 END
      AS product_global_review_count
  FROM (SELECT *, event_type = 'error' AS failed FROM events))"""
STATS = f"""{EVENTS},
stats AS (
  SELECT asin, domain, star_filter, CAST(sum(saved) AS BIGINT) AS total_reviews,
    coalesce(max(CASE WHEN reviews_parsed > 0 THEN page END), 0) AS total_pages,
    count(error) AS error_count,
    arg_min(total_reviews_header, page) FILTER (total_reviews_header IS NOT NULL)
      AS total_reviews_header,
    arg_min(product_global_review_count, page) FILTER (product_global_review_count IS NOT NULL)
      AS product_global_review_count,
    true AS success
  FROM runs GROUP BY asin, domain, star_filter)"""

URLS = f"""lines AS (
  SELECT p_partkey AS line_no, {code('p_partkey')} AS code,
    CASE p_partkey % 9
      WHEN 0 THEN 'https://' || host || '/dp/' || {code('p_partkey')}
      WHEN 1 THEN '  https://' || host || '/gp/product/' || {code('p_partkey')} || '?language=it_IT '
      WHEN 2 THEN 'https://' || host || '/product-reviews/' || {code('p_partkey')}
        || '/?sortBy=helpful&languageLocale=de%5FDE&x=1#top'
      WHEN 3 THEN 'https://u@' || host || ':8443/x/product-reviews/' || {code('p_partkey')}
        || '?reviewerType=avp_only+reviews&language='
      WHEN 4 THEN host || '/dp/' || {code('p_partkey')} || ';p=1?language=fr%zz'
      WHEN 5 THEN '# https://' || host || '/dp/' || {code('p_partkey')}
      WHEN 6 THEN ' ' || chr(9) || ' '
      WHEN 7 THEN 'https://' || host || '/s?k=' || p_name
      ELSE 'https://' || host || '/product-reviews//dp/' || {code('p_partkey')} END AS line
  FROM (SELECT *, coalesce({domain_of('p_partkey')}, 'www.example.com') AS host FROM part))"""
_SPLIT = r"^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def url_parts(source: str, column: str) -> str:
    """Authority, path and query of a URL column."""
    return f"""parts AS (
  SELECT *, coalesce(nullif(substr({grp(column, _SPLIT, 2)}, 3), ''), 'www.amazon.fr') AS host_of,
    regexp_replace({grp(column, _SPLIT, 3)}, ';[^/]*$', '') AS path_of,
    {grp(column, _SPLIT, 4)} AS query_of FROM {source})"""


def param(name: str) -> str:
    raw = f"nullif({grp('query_of', f'[?&]{name}=([^&]+)')}, '')"
    return f"url_decode(replace({raw}, '+', ' '))"


LANGUAGE = f"coalesce({param('language')}, {param('languageLocale')})"
REVIEWS_CODE = (f"CASE WHEN {has('path_of', '(?:^|/)product-reviews/')} THEN "
                f"{grp('path_of', '(?:^|/)product-reviews/([^/]*)')} END")
DP_CODE = f"nullif({grp('path_of', '(?:^|/)(?:dp|gp/+product)/+([^/]+)')}, '')"
KIND = f"coalesce({param('reviewerType')}, 'all_reviews')"
PARSED_URL = f"""parsed AS (
  SELECT *, coalesce(nullif({REVIEWS_CODE}, ''), {DP_CODE}) AS asin_of,
    CASE WHEN {REVIEWS_CODE} <> '' THEN {param('sortBy')} END AS sort_of,
    CASE WHEN {REVIEWS_CODE} <> '' THEN {KIND} ELSE 'all_reviews' END AS kind_of,
    {LANGUAGE} AS language_of FROM parts)"""
LISTED = f"""{URLS}, bare AS (
  SELECT *, regexp_replace(line, '^{SP}+|{SP}+$', '', 'g') AS url FROM lines
  WHERE NOT regexp_matches(line, '^{SP}*(#|$)')),
{url_parts('bare', 'url')}, {PARSED_URL},
listed AS (SELECT line_no, url, asin_of AS asin, host_of AS domain, language_of AS language,
  sort_of AS sort, kind_of AS reviewer_type FROM parsed WHERE asin_of IS NOT NULL)"""

STORED = f"""{TYPED}, stored AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, asin, {REVIEW}, domain,
    CASE WHEN domain IS NOT NULL THEN {product_url('asin', 'domain')} END AS canonical_product_url,
    l_shipdate + to_hours(l_linenumber) AS created_at,
    l_shipdate + to_microseconds(l_suppkey) AS updated_at, {ORD} FROM typed)"""
# Stored twice over is impossible: a table holds each id once.
TABLE = STORED.replace("stored AS (", "stored0 AS (") + ",\n" + first(
    "stored", "stored0", "review_id", ORD)


def iso(ts: str) -> str:
    return (f"CASE WHEN strftime({ts}, '%f') = '000000' THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


TWO_PASS = ",\n".join([
    first("pass1", "typed", "asin, review_id", ORD),
    first("pass2", "pass1", f"asin, {content_key()}", ORD),
])
LATEST_ORDER = "review_date DESC NULLS LAST, review_id"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    def scalar(name: str, expr: str, source: str = RAW, table: str = "raw", keys: str = KEY):
        o[name] = f"WITH {source} SELECT {keys}, {expr} AS value FROM {table}"

    o["clean_text_docs"] = f"SELECT doc_id, {clean('text')} AS value FROM documents"
    scalar("rating_normalize", rating("rating_text"))
    scalar("date_normalize_fr", date_fr("lower(date_text)"))
    scalar("date_normalize", date_any("lower(date_text)"))
    scalar("votes_normalize", votes("helpful_text"))
    scalar("verified_flag", verified("verified_text"))
    scalar("canonical_review_id", review_hash("title", "body"))
    scalar("content_key", content_key(), TYPED, "typed")
    scalar("strip_title", strip_title("title"))
    scalar("sentiment_label", sentiment(f"({rating('rating_text')})"))
    grouped = ("CAST(1 + l_partkey % 9 AS VARCHAR) || CASE l_linenumber % 4 WHEN 0 THEN chr(160) "
               "WHEN 1 THEN chr(8239) WHEN 2 THEN '.' ELSE ' ' END || "
               "lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ' avis'")
    o["localized_int"] = (
        f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {grouped} AS shown FROM lineitem) "
        f"SELECT *, {local_int('shown')} AS header_form, {local_int('shown', False)} "
        f"AS product_form FROM t")
    o["coerce_defaults"] = f"""WITH {RAW} SELECT {KEY},
      coalesce(CASE WHEN l_returnflag <> 'R' THEN l_returnflag = 'A' END, false) AS verified_purchase,
      coalesce(TRY_CAST(nullif(helpful_text, '') AS INT), 0) AS helpful_votes,
      l_shipdate IS NULL AS created_missing FROM raw"""
    o["record_projection"] = f"""WITH {STORED} SELECT id, asin, {REVIEW}, domain,
      canonical_product_url, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at
      FROM stored"""

    # Codes and URLs.
    o["asin_valid"] = f"""WITH {URLS} SELECT line_no,
      coalesce(regexp_full_match(CASE line_no % 4 WHEN 0 THEN code WHEN 1 THEN code || chr(10)
        WHEN 2 THEN substr(code, 2) || 'é' ELSE substr(code, 2) END, '[\\p{{L}}\\p{{N}}]{{10}}'), false)
      AS value FROM lines"""
    o["review_url"] = f"""WITH {RAW} SELECT {KEY}, {review_url(
        'asin', 'l_linenumber', 'domain', 'star_filter',
        sort="CASE WHEN l_linenumber > 3 THEN 'helpful' END",
        language="CASE WHEN l_linenumber < 3 THEN 'fr_FR' END")} AS value FROM raw"""
    o["product_url"] = f"WITH {RAW} SELECT {KEY}, {product_url('asin', 'domain')} AS value FROM raw"
    o["parse_review_url"] = f"""WITH {URLS}, {url_parts('lines', 'line')}
      SELECT line_no, {REVIEWS_CODE} AS asin, host_of AS domain, {LANGUAGE} AS language,
      {param('sortBy')} AS sort, {KIND} AS reviewer_type FROM parts"""
    o["parse_product_url"] = f"""WITH {URLS}, {url_parts('lines', 'line')}, {PARSED_URL}
      SELECT line_no, asin_of AS asin, CASE WHEN asin_of IS NOT NULL THEN host_of END AS domain,
      CASE WHEN asin_of IS NOT NULL THEN language_of END AS language,
      sort_of AS sort, CASE WHEN asin_of IS NOT NULL THEN kind_of END AS reviewer_type FROM parsed"""
    scalar("review_id_from_url", href_id("id_href"))
    suffixes = " ".join(f"WHEN ends_with(lower(domain), {q(s)}) THEN {q(v)}"
                        for s, v in k.LANGUAGE_BY_SUFFIX.items())
    scalar("market_language", f"CASE {suffixes} ELSE 'fr_FR' END")
    zones = " ".join(f"WHEN ends_with(domain, {q(s)}) THEN {q(v)}"
                     for s, v in k.TIMEZONE_BY_SUFFIX.items())
    scalar("market_timezone", f"CASE {zones} ELSE 'Europe/Paris' END")
    bare = "regexp_replace(domain, '^www\\.', '')"
    o["market_locale_currency"] = f"""WITH {RAW} SELECT {KEY},
      coalesce(CASE WHEN l_linenumber = 1 THEN 'nl_NL' END,
        {case(bare, {d: v[0] for d, v in k.MARKETS.items()})}, 'fr_FR') AS locale,
      coalesce({case(bare, {d: v[1] for d, v in k.MARKETS.items()})}, 'EUR') AS currency FROM raw"""
    scalar("target_domain", """CASE WHEN l_linenumber = 1 THEN 'www.amazon.de'
      WHEN l_linenumber % 2 = 0 AND domain IS NOT NULL THEN domain ELSE 'www.amazon.fr' END""")
    option = pick(["all", "five", "four", "three", "two", "one", "six"], "l_linenumber - 1")
    scalar("star_code", case(f"({option})", k.STAR_CODE_BY_OPTION))
    scalar("star_label", label("star_filter"))
    o["enrich_product"] = f"""WITH {RAW} SELECT {KEY}, domain, CASE WHEN domain IS NOT NULL THEN
      {product_url('asin', 'domain')} END AS canonical_product_url FROM raw"""

    # Lists and crawl planning.
    o["product_list"] = f"""WITH t AS (SELECT p_partkey AS line_no, CASE p_partkey % 5
        WHEN 0 THEN {code('p_partkey')} WHEN 1 THEN '  ' || {code('p_partkey')} || chr(9)
        WHEN 2 THEN '# ' || {code('p_partkey')} WHEN 3 THEN {code('p_partkey')} || '-'
        ELSE '' END AS line FROM part),
      u AS (SELECT line_no, trim(line, ' ' || chr(9)) AS asin FROM t)
      SELECT line_no, asin, regexp_full_match(asin, '[\\p{{L}}\\p{{N}}]{{10}}') AS valid FROM u
      WHERE asin <> '' AND NOT starts_with(asin, '#')"""
    o["url_list"] = f"WITH {LISTED} SELECT * FROM listed"
    o["url_counts"] = f"""WITH {LISTED} SELECT (SELECT count(*) FROM bare) AS listed,
      (SELECT count(*) FROM listed) AS parsable"""
    plan = f"""{LISTED}, plan AS (
      SELECT line_no, asin, domain, star_filter, CAST(star_rank AS INT) AS star_rank,
        CAST(page AS INT) AS page,
        {review_url('asin', 'page', 'domain', 'star_filter', language='language')} AS page_url
      FROM listed, (VALUES ('five_star', 0), ('four_star', 1), ('three_star', 2), ('two_star', 3),
        ('one_star', 4)) AS s(star_filter, star_rank), range(1, 6) AS r(page))"""
    o["crawl_plan"] = f"WITH {plan} SELECT * FROM plan"
    o["plan_gap"] = f"""WITH {plan}, {RAW}, {paged('raw')}
      SELECT line_no, asin, star_filter, page FROM plan p WHERE NOT EXISTS (SELECT 1 FROM paged c
        WHERE c.asin = p.asin AND c.star_filter = p.star_filter AND c.page = p.page)"""

    # Page predicates.
    for name, markers in (("page_challenge", k.CHALLENGE_MARKERS), ("page_error", k.ERROR_MARKERS),
                          ("page_login", k.LOGIN_MARKERS)):
        scalar(name, mentions("lower(html)", markers), MARKED, "marked", "page_id")
    o["page_triage"] = f"""WITH {MARKED}, s AS (SELECT page_id, {STATUS} AS page_status FROM marked)
      SELECT *, page_status IN ('ok', 'error') AS usable FROM s"""
    o["page_status_counts"] = f"""WITH {MARKED} SELECT {STATUS} AS page_status, count(*) AS pages
      FROM marked GROUP BY 1"""
    facts = f"{RAW}, {paged('raw')}, {PAGE_FACTS}"
    o["page_signed_out"] = f"""WITH {facts} SELECT asin, page, {SIGNED_OUT} AS signed_out
      FROM page_facts"""
    o["signed_out_domains"] = f"""WITH {facts} SELECT domain, bool_and({SIGNED_OUT})
      AS all_signed_out, count(*) AS pages FROM page_facts GROUP BY domain"""

    o["crawl_frontier"] = f"""WITH RECURSIVE {facts}, l AS MATERIALIZED (SELECT asin, domain, star_filter, page,
        CASE WHEN l_partkey % 7 = 0 AND page = 2 THEN 1 WHEN more THEN page + 1 END AS "to"
        FROM page_facts WHERE {USABLE}),
      walk AS (SELECT asin, page FROM l WHERE page = 1 UNION
        SELECT n.asin, n.page FROM walk w JOIN l ON l.asin = w.asin AND l.page = w.page
        JOIN l AS n ON n.asin = l.asin AND n.page = l."to"),
      v AS (SELECT l.asin, l.page, l."to", n.page IS NULL AS stop FROM walk JOIN l USING (asin, page)
        LEFT JOIN l AS n ON n.asin = l.asin AND n.page = l."to"),
      s AS (SELECT asin, count(*) AS reached, max(page) AS largest, max(page) FILTER (stop) AS stopped,
        arg_max("to", page) FILTER (stop) AS lead, bool_or(stop AND "to" IS NULL) AS last FROM v GROUP BY asin)
      SELECT r.asin, r.domain, r.star_filter, coalesce(reached, 0) AS reached,
        coalesce(stopped, largest) AS last_page, CASE WHEN reached IS NULL THEN 'missing page'
        WHEN stopped IS NULL THEN 'loop' WHEN last THEN 'last page' ELSE 'missing page' END AS outcome,
        CASE WHEN reached IS NULL THEN 1 WHEN NOT last THEN lead END AS wanted
      FROM (SELECT DISTINCT asin, domain, star_filter FROM l) r LEFT JOIN s USING (asin)"""

    # Extraction: the strings that went into each page must come back.
    o["extract_reviews"] = f"""WITH {RAW}, {paged('raw')} SELECT asin, page, pos, id_href, title,
      body, rating_text AS rating, date_text AS date, verified_text AS verified,
      helpful_text AS helpful, reviewer_text AS reviewer, coalesce(variant_text, '') AS variant,
      '[data-hook="review"]' AS matched_selector FROM paged"""
    o["extract_strict"] = f"""WITH {TYPED}, {paged('typed')} SELECT asin, page, pos,
      {REVIEW.replace('variant', "nullif(variant, '') AS variant")} FROM paged
      WHERE review_title <> '' OR review_body <> ''"""
    scalar("review_id_resolve", f"coalesce({href_id('id_href')}, {review_hash('title', 'body')})")
    o["header_total"] = f"WITH {facts} SELECT asin, page, {HEADER} AS value FROM page_facts"
    o["product_count"] = f"WITH {facts} SELECT asin, page, {PRODUCT_COUNT} AS value FROM page_facts"
    o["has_next"] = f"""WITH {facts} SELECT asin, page, more AS has_next, CASE WHEN more THEN
      '/next?pageNumber=' || CAST(page + 1 AS VARCHAR) END AS next_url FROM page_facts"""
    o["next_page_url"] = r"""WITH t AS (SELECT page_id, replace(url, 'page=', 'pageNumber=') AS url
        FROM pages),
      u AS (SELECT *, regexp_extract(url, '^([^?#]*)', 1) AS base,
        regexp_extract(url, '\?([^#]*)', 1) AS qs, regexp_extract(url, '(#.*)$', 1) AS frag,
        TRY_CAST(regexp_extract(url, '[?&]pageNumber=(\d+)', 1) AS INT) AS n FROM t)
      SELECT page_id, url, base || '?' || CASE WHEN n IS NOT NULL THEN
        regexp_replace(qs, 'pageNumber=\d+', 'pageNumber=' || CAST(n + 1 AS VARCHAR))
        WHEN qs = '' THEN 'pageNumber=2' ELSE qs || '&pageNumber=2' END || frag AS next_url FROM u"""

    # Record checks and duplicates.
    o["valid_reviews"] = f"""WITH {TYPED} SELECT {KEY}, review_id FROM typed
      WHERE (review_title <> '' OR review_body <> '') AND (rating IS NULL OR rating BETWEEN 1 AND 5)"""
    o["storable_reviews"] = f"""WITH {TYPED}, t AS (SELECT * REPLACE (
        CASE WHEN l_linenumber = 3 THEN review_body ELSE review_title END AS review_title,
        CASE WHEN l_linenumber = 4 THEN NULL ELSE asin END AS asin) FROM typed)
      SELECT l_orderkey, l_linenumber, review_id, CASE WHEN asin IS NULL THEN 'asin missing'
        WHEN length(review_title) > 500 THEN 'review_title too long' END AS problem FROM t"""
    o["dedup_page_id"] = f"""WITH {TYPED}, {paged('typed')}, {IN_PAGE}
      SELECT asin, page, pos, review_id FROM by_id"""
    o["dedup_page_content"] = f"""WITH {TYPED}, {paged('typed')}, {IN_PAGE}
      SELECT asin, page, pos, review_id, review_title FROM by_content"""
    o["dedup_cross_page"] = f"""WITH {TYPED}, {paged('typed')}, {IN_PAGE}, {greedy('by_content')}
      SELECT asin, page, pos, {REVIEW} FROM survivors"""
    hot = f"""hot AS (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 'B000000000' ELSE asin END
      AS asin) FROM typed)"""
    o["dedup_cross_page_hot"] = f"""WITH {TYPED}, {hot}, {paged('hot')}, {greedy('paged', 12)}
      SELECT asin, page, pos, review_id FROM survivors"""
    o["dedup_two_pass"] = f"WITH {TYPED}, {TWO_PASS} SELECT {KEY}, {REVIEW} FROM pass2"
    o["dedup_metrics"] = f"""WITH {TYPED}, {TWO_PASS} SELECT a AS rows_before, b AS rows_after,
      a - b AS removed FROM (SELECT count(*) AS a FROM typed), (SELECT count(*) AS b FROM pass2)"""
    o["failed_products"] = f"""WITH {EVENTS} SELECT asin, CAST(0 AS BIGINT) AS total_reviews, 0 AS total_pages,
      CAST(1 AS BIGINT) AS error_count, false AS success, arg_min(coalesce(error, ''), page) AS message
      FROM runs GROUP BY asin, domain, star_filter HAVING arg_min(coalesce(error, ''), page) <> ''"""
    o["dedup_metrics_written"] = o["dedup_metrics"]
    o["insert_if_absent"] = f"""WITH {TYPED}, {first('fresh', 'typed', 'review_id', ORD)}
      SELECT {KEY}, review_id FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM typed t
        WHERE t.l_linestatus = 'O' AND t.review_id = f.review_id)"""

    # Metrics.
    kept = (f"{TYPED}, {paged('typed')}, {PAGE_FACTS}, arrived AS (SELECT p.* FROM paged p JOIN "
            f"page_facts f ON p.asin = f.asin AND p.page = f.page WHERE {USABLE}), "
            f"{IN_PAGE.replace('FROM paged', 'FROM arrived')}, {greedy('by_content')}")
    o["ingest"] = f"""WITH {kept} SELECT asin, domain, star_filter, page, pos, {REVIEW},
      CASE WHEN domain IS NOT NULL THEN {product_url('asin', 'domain')} END AS canonical_product_url
      FROM survivors"""
    counted = f"""{kept}, per_page AS (SELECT asin, page, count(*) AS n FROM survivors
      GROUP BY asin, page)"""
    o["page_runs"] = f"""WITH {counted} SELECT f.asin, domain, star_filter, f.page,
      coalesce(c.n, 0) AS reviews_parsed, coalesce(c.n, 0) AS saved,
      round(f.n * 137 / 1000.0, 2) AS duration_s, more AS next, CAST(NULL AS VARCHAR) AS error,
      first_value({HEADER.replace('page ', 'f.page ')} IGNORE NULLS) OVER w AS total_reviews_header,
      first_value({PRODUCT_COUNT.replace('page ', 'f.page ')} IGNORE NULLS) OVER w
        AS product_global_review_count
      FROM (SELECT * FROM page_facts WHERE {USABLE}) f
      LEFT JOIN per_page c ON c.asin = f.asin AND c.page = f.page
      WINDOW w AS (PARTITION BY f.asin ORDER BY f.page ROWS UNBOUNDED PRECEDING)"""
    # Pages decide one after another, so the first two of a run stand alone.
    o["ingest_runs"] = f"""WITH p AS ({o['page_runs']})
      SELECT * REPLACE (duration_s + CASE WHEN page = 1 THEN 1 ELSE 0 END AS duration_s),
        '2024-01' AS run_id FROM p
      UNION ALL SELECT *, '2024-02' AS run_id FROM p WHERE page <= 2"""
    o["ingest_recap"] = f"""WITH {counted} SELECT f.asin, domain, {label('star_filter')} AS star_label,
      max(f.page) AS pages, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS reviews_parsed,
      CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS saved
      FROM (SELECT * FROM page_facts WHERE {USABLE}) f
      LEFT JOIN per_page c ON c.asin = f.asin AND c.page = f.page GROUP BY ALL"""
    recap = f"""SELECT asin, domain, {label('star_filter')} AS star_label, max(page) AS pages,
      CAST(sum(reviews_parsed) AS BIGINT) AS reviews_parsed, CAST(sum(saved) AS BIGINT) AS saved
      FROM runs GROUP BY ALL"""
    o["recap"] = f"WITH {EVENTS} {recap}"
    o["recap_sorted"] = f"""WITH {EVENTS}, r AS ({recap})
      SELECT *, {label_rank('star_label')} AS star_rank FROM r"""
    o["run_stats"] = f"WITH {STATS} SELECT * FROM stats"
    o["run_errors"] = f"""WITH {EVENTS} SELECT asin, domain, star_filter, page,
      'Erreur sur la page ' || CAST(page AS VARCHAR) || ': ' || error AS message
      FROM runs WHERE error IS NOT NULL"""
    o["batch_totals"] = f"""WITH {STATS} SELECT CAST(sum(total_reviews) AS BIGINT) AS total_reviews,
      count(*) FILTER (error_count = 0) AS succeeded, count(*) AS runs,
      CAST(count(*) FILTER (error_count = 0) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) || ' ok'
      AS summary FROM stats"""
    rank = f"{label_rank(label('star_filter'))}"
    o["merged_stats"] = f"""WITH {STATS}, r AS (SELECT *, {rank} AS star_rank FROM stats)
      SELECT asin, domain, CAST(sum(total_reviews) AS BIGINT) AS total_reviews,
      CAST(sum(total_pages) AS BIGINT) AS total_pages, CAST(sum(error_count) AS BIGINT) AS error_count,
      bool_and(error_count = 0) AS success,
      max(total_reviews_header) FILTER (star_rank = lowest) AS total_reviews_header,
      max(product_global_review_count) FILTER (star_rank = lowest) AS product_global_review_count
      FROM (SELECT *, min(star_rank) OVER (PARTITION BY asin, domain) AS lowest FROM r)
      GROUP BY asin, domain"""
    o["merged_batch"] = f"""WITH {STATS} SELECT CAST(sum(total_reviews) AS BIGINT) AS total_reviews,
      CAST(sum(total_pages) AS BIGINT) AS total_pages, CAST(sum(error_count) AS BIGINT) AS error_count,
      bool_and(error_count = 0) AS success, CAST(NULL AS BIGINT) AS total_reviews_header,
      CAST(NULL AS BIGINT) AS product_global_review_count FROM stats"""
    o["product_mean_rating"] = f"""WITH {TYPED} SELECT asin, count(*) AS reviews,
      sum(coalesce(rating, 0.0)) / count(*) AS mean_rating FROM typed GROUP BY asin"""
    o["completeness"] = f"""WITH {EVENTS}, c AS (SELECT asin, domain, star_filter,
        coalesce(max(CASE WHEN reviews_parsed > 0 THEN page END), count(*)) AS total_pages,
        arg_max(next, page) AS last_next FROM runs GROUP BY ALL)
      SELECT *, total_pages = 5 OR last_next = false AS complete FROM c"""
    o["page_details"] = f"""WITH {EVENTS} SELECT
      CASE WHEN error IS NULL THEN asin END AS asin, CASE WHEN error IS NULL THEN domain END AS domain,
      CASE WHEN error IS NULL THEN star_filter END AS star_filter, page, reviews_parsed, saved,
      duration_s, next, error,
      CASE WHEN error IS NULL THEN total_reviews_header END AS total_reviews_header,
      CASE WHEN error IS NULL THEN product_global_review_count END AS product_global_review_count
      FROM runs"""
    o["failures"] = f"""WITH {EVENTS} SELECT page, CAST(0 AS BIGINT) AS reviews_parsed,
      CAST(0 AS BIGINT) AS saved, duration_s, false AS next, error FROM runs WHERE error IS NOT NULL"""
    o["progress_running"] = f"""WITH {EVENTS}, s AS (SELECT asin, domain, star_filter, page,
        sum(saved) OVER w AS saved_so_far,
        last_value(CASE WHEN total_reviews_header > 0 THEN total_reviews_header END IGNORE NULLS)
          OVER w AS known_total FROM runs
        WINDOW w AS (PARTITION BY asin, domain, star_filter ORDER BY page ROWS UNBOUNDED PRECEDING))
      SELECT asin, domain, star_filter, page, CAST(saved_so_far AS BIGINT) AS saved_so_far,
        known_total, CAST(least(100, round_even(CASE WHEN known_total IS NOT NULL
          THEN saved_so_far / known_total ELSE page / 5 END * 100, 0)) AS INT) AS percent FROM s"""
    o["batch_progress"] = f"""WITH {LISTED}, n AS (SELECT line_no, asin,
        row_number() OVER (ORDER BY line_no) AS batch_done, count(*) OVER () AS batch_total FROM listed)
      SELECT *, CAST(round_even(batch_done / batch_total * 100, 0) AS INT) AS percent FROM n"""

    # Ordered reads.
    o["reviews_for_product"] = f"""WITH {TABLE} SELECT asin, review_id, review_date, rating
      FROM stored WHERE asin = 'B000000007' ORDER BY {LATEST_ORDER} LIMIT 20"""
    o["all_reviews_recent"] = f"""WITH {TABLE} SELECT review_id, asin, review_title, created_at
      FROM stored"""
    o["recent_hundred"] = f"""WITH {TABLE} SELECT review_id, asin, review_title FROM stored
      ORDER BY created_at DESC, review_id LIMIT 100"""
    o["sentiment_sorted"] = f"""WITH {TYPED}, {TWO_PASS}, s AS (SELECT {KEY}, {REVIEW},
        {sentiment('rating')} AS sentiment FROM pass2)
      SELECT *, {sentiment_rank('sentiment')} AS sentiment_rank FROM s"""
    o["latest_ten"] = f"""WITH {TABLE} SELECT asin, review_id, review_date, rating,
      CAST(row_number() OVER (PARTITION BY asin ORDER BY {LATEST_ORDER}) AS INT) AS rank FROM stored
      QUALIFY rank <= 10"""
    o["preview_head"] = f"""WITH {TYPED}, {TWO_PASS} SELECT {KEY}, review_id, review_title FROM pass2
      ORDER BY {ORD} LIMIT 200"""

    # Unions, migration, import and export.
    o["union_tranches"] = f"""WITH {TYPED} SELECT {KEY}, review_id, rating FROM typed"""
    o["union_missing_cols"] = o["page_details"]
    o["migrate_titles"] = f"""WITH raw_t AS (WITH {RAW} SELECT {KEY}, id_href,
        CASE WHEN l_linenumber = 6 THEN NULL ELSE title END AS review_title, l_shipdate AS updated_at
        FROM raw)
      SELECT l_orderkey, l_linenumber, asin, CASE WHEN review_title IS NOT NULL THEN
        {strip_title('review_title')} END AS review_title,
        coalesce({strip_title('review_title')} <> review_title, false) AS touched FROM raw_t"""
    o["migrate_metrics"] = f"""WITH {RAW} SELECT count(*) AS scanned,
      count(*) FILTER ({strip_title('title')} <> title) AS updated FROM raw"""
    o["import_alias_dedup"] = f"""WITH {TYPED},
      {first('pass1', 'typed', 'review_id', ORD)},
      {first('pass2', 'pass1', content_key(), ORD)}
      SELECT {KEY}, {REVIEW.replace('verified_purchase, helpful_votes, ', '').replace(
          'rating,', "coalesce(CAST(rating AS VARCHAR), '') AS rating,")} FROM pass2"""
    exported = f"""WITH {TABLE} SELECT id, asin, {REVIEW}, domain, canonical_product_url FROM stored"""
    o["export_roundtrip_csv"] = exported
    o["export_roundtrip_parquet"] = exported
    o["ephemeral_run"] = f"WITH {kept} SELECT asin, page, pos, review_id, rating FROM survivors"
    o["import_csv_split"] = o["import_alias_dedup"]
    o["header_total_forms"] = """SELECT p_partkey, CASE WHEN p_partkey % 6 <> 4
      THEN (1 + p_partkey % 9) * 1000 + p_partkey % 1000 END AS value FROM part"""
    o["latest_of_product"] = f"""WITH {TABLE} SELECT review_id, review_date, review_title AS title
      FROM stored WHERE asin = 'B000000007' ORDER BY {LATEST_ORDER} LIMIT 10"""
    o["union_missing_cols"] = f"""WITH {TYPED} SELECT {KEY}, review_id, CASE WHEN l_returnflag <> 'N' THEN rating END
      AS rating, CASE WHEN l_returnflag <> 'A' THEN variant END AS variant FROM typed"""
    o["ingest_tranches"] = f"""WITH {kept}, both_runs AS (SELECT asin, domain, star_filter, page, pos, review_id
        FROM survivors UNION ALL SELECT asin, domain, 'three_star', page, pos, review_id FROM survivors
        WHERE page <= 2 AND star_filter IS DISTINCT FROM 'three_star')
      SELECT asin, star_filter, page, pos, review_id FROM both_runs QUALIFY row_number() OVER (PARTITION BY review_id
        ORDER BY asin, domain NULLS FIRST, {label_rank(label('star_filter'))}, page, pos) = 1"""
    last = f"""last AS (SELECT *, {sentiment('rating')} AS sentiment FROM typed
      WHERE year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM typed))"""
    o["last_run_export"] = f"""WITH {TYPED}, {last}, {first('pass1', 'last', 'review_id', ORD)},
      {first('pass2', 'pass1', content_key(), ORD)} SELECT {KEY}, review_id, rating, sentiment FROM pass2"""
    o["append_to_table"] = f"""WITH {TYPED}, {first('fresh', 'typed', 'review_id',
        f"CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, {ORD}")}
      SELECT asin, review_id, review_title, rating, review_date,
        '2024-05-06 07:08:09' AS created_at, '2024-05-06 07:08:09' AS updated_at FROM fresh"""

    o["export_ndjson"] = exported
    o["export_product_limit"] = f"""WITH {TABLE} SELECT asin, review_id, review_date, rating,
      'asin,review_id,rating,review_date,created_at' AS columns
      FROM stored WHERE asin = 'B000000007' ORDER BY {LATEST_ORDER} LIMIT 5"""
    o["export_page_details"] = o["page_details"]
    o["migrate_titles_limited"] = f"""WITH {TABLE}, shown AS (SELECT review_id, created_at,
        CASE WHEN id % 2 = 0 THEN '5 out of 5 stars ' || review_title ELSE review_title END AS title
        FROM stored),
      ranked AS (SELECT *, row_number() OVER (ORDER BY created_at, review_id) <= 500
        AND {strip_title('title')} <> title AS touched FROM shown)
      SELECT review_id, CASE WHEN touched THEN {strip_title('title')} ELSE title END AS review_title,
        touched FROM ranked"""
    o["upsert_reviews"] = f"""WITH {TABLE}, both_sides AS (
        SELECT review_id, asin, review_title, updated_at, 0 AS fresh FROM stored UNION ALL
        SELECT CASE WHEN id % 4 = 2 THEN review_id || 'N' ELSE review_id END, asin,
          review_title || ' v2', updated_at + to_days(CASE WHEN id % 4 = 1 THEN -1 ELSE 1 END), 1
        FROM stored WHERE id % 4 <> 3)
      SELECT review_id, asin, review_title FROM both_sides QUALIFY
        row_number() OVER (PARTITION BY review_id ORDER BY updated_at DESC, fresh DESC) = 1"""
    o["rating_distribution"] = f"""WITH {TABLE} SELECT asin, CAST(floor(rating) AS INT) AS stars,
      count(*) AS reviews FROM stored GROUP BY ALL"""
    o["review_timeline"] = f"""WITH {TABLE} SELECT asin, left(review_date, 7) AS month,
      count(*) AS reviews, CAST(sum(CAST(rating AS DECIMAL(10,4))) AS DOUBLE)
        / nullif(count(rating), 0) AS mean_rating FROM stored GROUP BY ALL"""
    o["url_distinct"] = f"""WITH {LISTED} SELECT line_no, asin, domain FROM listed QUALIFY
      row_number() OVER (PARTITION BY asin, domain ORDER BY line_no) = 1"""
    selectors = {0: '[data-hook="review"]', 1: '[id^="customer_review-"]',
                 2: 'div[data-hook*="review"]', 3: 'div.a-section.review.aok-relative'}
    o["extract_fallback"] = f"""SELECT p_partkey, {case('p_partkey % 5', selectors)} AS matched_selector,
      p_name AS body FROM part WHERE p_partkey % 5 < 4"""
    o["has_next_forms"] = f"""SELECT p_partkey, p_partkey % {len(NEXT_FORMS)} < {len(NEXT_SHOWN)}
      AS has_next FROM part"""
    o["ingest_existing"] = f"""WITH {counted}, fresh AS (SELECT * FROM survivors s WHERE NOT EXISTS (
          SELECT 1 FROM typed t WHERE t.l_linestatus = 'O' AND t.review_id = s.review_id)
        QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY asin, domain NULLS FIRST,
          {label_rank(label('star_filter'))}, page, pos) = 1),
      stored_pages AS (SELECT asin, page, count(*) AS n FROM fresh GROUP BY asin, page)
      SELECT f.asin, domain, star_filter, f.page, coalesce(c.n, 0) AS reviews_parsed,
        coalesce(w.n, 0) AS saved FROM (SELECT * FROM page_facts WHERE {USABLE}) f
      LEFT JOIN per_page c ON c.asin = f.asin AND c.page = f.page
      LEFT JOIN stored_pages w ON w.asin = f.asin AND w.page = f.page"""

    # Product recap (flagship).
    o["product_quality"] = f"""WITH {TYPED}, {TWO_PASS} SELECT asin, count(*) AS reviews,
      sum(coalesce(rating, 0.0)) / count(*) AS mean_rating,
      count(*) FILTER ({sentiment('rating')} = 'Positif') AS positive,
      count(*) FILTER ({sentiment('rating')} = 'Neutre') AS neutral,
      count(*) FILTER ({sentiment('rating')} = 'Négatif') AS negative,
      count(*) FILTER (verified_purchase) AS verified, CAST(sum(helpful_votes) AS BIGINT) AS votes,
      max(review_date) AS last_date FROM pass2 GROUP BY asin"""

    # Streams equal the batch over the same pages.
    o["upsert_table"] = o["upsert_reviews"]
    o["migrate_table"] = f"""WITH {TABLE}, shown AS (SELECT review_id,
        CASE WHEN id % 2 = 0 THEN '5 out of 5 stars ' || review_title ELSE review_title END AS title FROM stored)
      SELECT review_id, CASE WHEN {strip_title('title')} <> title THEN {strip_title('title')} ELSE title END
        AS review_title, {strip_title('title')} <> title AS touched FROM shown"""
    o["stream_parse"] = f"""WITH {kept} SELECT asin, page, pos, {REVIEW} FROM by_content"""
    o["stream_dedup"] = f"""WITH {kept} SELECT asin, page, pos, review_id, review_title
      FROM survivors"""
    # The table takes the first writer of an id: pages 1 and 2 arrive first.
    first_writer = first(
        "written", "survivors", "review_id",
        f"page > 2, asin, domain NULLS FIRST, {label_rank(label('star_filter'))}, page, pos")
    o["stream_ingest"] = f"""WITH {kept}, {first_writer}
      SELECT asin, review_id, review_title, rating, review_date, '2024-05-06 07:08:09' AS created_at,
        '2024-05-06 07:08:09' AS updated_at FROM written"""
    o["stream_dedup_shuffled"] = o["stream_dedup"]
    o["stream_progress"] = f"""WITH p AS ({o['page_runs']}), s AS (SELECT asin, page,
        sum(saved) OVER (PARTITION BY asin ORDER BY page ROWS UNBOUNDED PRECEDING) AS saved_so_far,
        total_reviews_header AS known_total FROM p)
      SELECT asin, page, CAST(saved_so_far AS BIGINT) AS saved_so_far, known_total, CAST(least(100, round_even(
        CASE WHEN known_total IS NOT NULL THEN saved_so_far / known_total ELSE page / 5 END * 100, 0)) AS INT)
        AS percent FROM s"""
    o["stream_quarantine"] = f"""WITH {RAW}, {paged('raw')}, {PAGE_FACTS} SELECT asin, page,
      CASE WHEN marker BETWEEN 20 AND 25 THEN 'login' ELSE 'challenge' END AS status
      FROM page_facts WHERE NOT {USABLE}"""
    o["stream_metrics"] = o["ingest_recap"]
    return o
