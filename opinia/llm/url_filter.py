"""URL rules by a sort-merge range join with a stack of nested rules.

A rule (host, path) fits a host and its subdomains where the path starts with the
rule's.  Written as the labels of the host in reverse, then the path, a rule is a
prefix, that is an interval of keys; a URL has a key for its host and for each
parent domain, and a rule fits the URL if one of those keys lies in its interval.

Keys and rules are sorted together (range partitions, rules before keys).  One
sweep per partition keeps the rules that contain the present position on a stack;
intervals are nested or apart, so the top is the longest.  The stack at the start
of a partition comes from a first sweep over what the partitions before it leave
open: one entry per partition and nesting level, no more, reaches the driver.

Equal (host, path) pairs are swept once, so a URL or host that owns a third of the
rows is one key; a host with many paths is cut like any other range.

Defined results: NULL urls and urls without `://` have an empty host and path and
take the default; among rules of equal length the longer host wins, then block;
repeated rules do no harm, a rule with a NULL part is left out, and a rule's host
is lower-cased.  Rows of equal page_id are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm.common import cut, reliable_checkpoint, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends the labels of a key; sorts before every character that a label may have.
END = "\x01"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Reversed host labels, each ended by END, then END and the path."""
    return F.concat(F.array_join(labels, END), F.lit(END + END), path)


def _sweep(carried: dict[int, list], answer: bool):
    """Sweep sorted partitions; give answers, or only the stack each one leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stack, last = list(carried.get(part, [])), None
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for key, kind, host, path, rule, verdict in zip(
                    rows["key"], rows["kind"], rows["host"], rows["path"], rows["rule"], rows["verdict"], strict=True):
                last = key
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, rule, verdict))
                elif answer and stack:
                    out.append((host, path, stack[-1][1], stack[-1][2]))
            if answer:
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string()) for c in columns], ["host", "path", "rule", "verdict"])
        if not answer and last is not None:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "last": [last], "keys": pa.array([[k for k, _, _ in stack]], pa.list_(pa.string())),
                "rules": pa.array([[r for _, r, _ in stack]], pa.list_(pa.string())),
                "verdicts": pa.array([[v for _, _, v in stack]], pa.list_(pa.string()))})

    return run


def _carried(swept: DataFrame, longest: int) -> dict[int, list]:
    """For every partition the rules that are open where it starts."""
    ends = sorted(swept.withColumn("last", F.substring("last", 1, longest)).collect())
    carried, open_rules = {}, []
    for row in ends:
        carried[row.part] = open_rules
        own = list(zip(row["keys"], row["rules"], row["verdicts"], strict=True))
        open_rules = [r for r in open_rules if row["last"].startswith(r[0])] + own
    return carried


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """One row per rule with its key; of equal rules, block."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    host = F.translate("host", UPPER, LOWER)
    return rules.dropna(subset=["host", "path", "verdict"]).select(
        _key(_labels(host), F.col("path")).alias("key"), F.concat(host, "path").alias("rule"), "verdict",
    ).groupBy("key", "rule").agg(F.max("verdict").alias("verdict"))  # "block" > "allow"


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id",
          url_column: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (or NULL) and verdict."""
    host, path = split_url(F.col(url_column))
    split = cut(pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path")), "split-urls")
    labels = _labels(F.col("host"))
    probes = split.select("host", "path").distinct().select(
        "host", "path", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda n: _key(F.slice(labels, F.lit(1), n), F.col("path")))).alias("key"))
    none = F.lit(None).cast("string")
    keyed = cut(rules.select("key", F.lit(0).alias("kind"), none.alias("host"), none.alias("path"),
                             "rule", "verdict").unionByName(
        probes.select("key", F.lit(1).alias("kind"), "host", "path", none.alias("rule"),
                      none.alias("verdict"))), "url-keys")
    order = ["key", "kind", "host", "path"]
    events = reliable_checkpoint(keyed.repartitionByRange(*order).sortWithinPartitions(*order))
    longest = rules.agg(F.max(F.length("key"))).first()[0] or 0
    swept = events.mapInArrow(_sweep({}, False), "part int, last string, keys array<string>, "
                                                 "rules array<string>, verdicts array<string>")
    answers = events.mapInArrow(_sweep(_carried(swept, longest), True),
                                "host string, path string, rule string, verdict string")
    # The key of the host itself and those of its parents may each have an answer.
    length = F.length("rule") * F.lit(1 << 20) + F.length(F.regexp_extract("rule", r"^[^/]*", 0))
    best = answers.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), length).alias("best"))
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the five rules; a url that no rule fits is allowed."""
    return judge(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


SQL = r"""
WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES
    ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
    ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
    ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS nr, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT nr, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                       AND starts_with(path, rule_path)
  GROUP BY nr)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (nr)
"""
