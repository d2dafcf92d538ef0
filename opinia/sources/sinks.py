"""Writers: the reviews table and exports.

The table lies in `REVIEW_BUCKETS` folders by the hash of the review id.  A batch reads,
extends or replaces only the buckets that it touches, so batch writes, micro-batches and
rewrites share one table: a replayed batch finds its own rows and adds none, and a rewrite
replaces whole buckets, each run of them in one commit.  One writer at a time.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.operators.dedup import dedup_two_pass
from opinia.operators.ranking import keep_first
from opinia.operators.records import coerce_defaults, conform, storage_problem
from opinia.plans.maintenance import migrate_titles, title_changes, upsert
from opinia.plans.views import all_reviews, quality_view, reviews_for_product
from opinia.schema import REVIEWS
from opinia.sources.scratch import reliable_checkpoint, written

FORMATS = ("csv", "parquet", "ndjson")
REVIEW_BUCKETS = 16
STORED = T.StructType([*REVIEWS.fields, T.StructField("bucket", T.IntegerType())])


def ensure_reviews_table(spark: SparkSession, path: str, reset: bool = False) -> None:
    """Create the empty table when missing; `reset` empties an existing one."""
    if not reset:
        try:
            spark.read.schema(REVIEWS).parquet(path)
            return
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    spark.createDataFrame([], REVIEWS).write.mode("overwrite").parquet(path)


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("review_id"), F.lit(REVIEW_BUCKETS)).cast("int"))


def stored_in(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """Reviews of some buckets of the table, with their `bucket`; no other folder is read."""
    return spark.read.schema(STORED).parquet(path).filter(F.col("bucket").isin(buckets))


def laid_out(df: DataFrame) -> DataFrame:
    """Cluster by bucket, product and date, so product reads skip row groups."""
    keys = ["bucket", "asin", "review_date"]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def append_reviews(new: DataFrame, path: str, order: list[str | Column],
                   now: Column | None = None) -> int:
    """Append the storable rows whose review id the table lacks.

    Absent badges, votes and times get their defaults (`now`).  Returns how many were
    written, counted by the write itself.
    """
    # A filter on the problem would evaluate the record's texts once for itself and once for the rows.
    checked = new.withColumn("_unfit", storage_problem().isNotNull())
    first = conform(keep_first(checked, ["review_id"], ["_unfit", *order]).filter(~F.col("_unfit")))
    # Run the input once: buckets, comparison and the sample of the range layout read it.
    ready = written(bucketed(conform(coerce_defaults(first, now))), "ready")
    known = stored_in(new.sparkSession, path, _touched(ready)).select("bucket", "review_id")
    # Whole rows are compared, which moves them, only where the table has an id of theirs.
    taken = reliable_checkpoint(ready.select("bucket", "review_id").join(known, ["bucket", "review_id"], "left_semi"))
    fresh = ready if taken.isEmpty() else ready.join(taken, ["bucket", "review_id"], "left_anti")
    saved = Observation("saved")
    counted = laid_out(fresh).observe(saved, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").partitionBy("bucket").parquet(path)
    return saved.get["rows"]


def upsert_reviews(new: DataFrame, path: str) -> None:
    """Make the table hold, per review id, the row updated last; untouched buckets stay as they are."""
    ready = written(bucketed(conform(new.filter(F.col("review_id").isNotNull()))), "ready")
    buckets = _touched(ready)
    _replace(upsert(stored_in(new.sparkSession, path, buckets), ready), path)


def migrate_table(spark: SparkSession, path: str, now: Column | None = None, per_commit: int = 4) -> list[list[int]]:
    """Remove star mentions from the titles of the stored table; returns the buckets of each commit.

    Only buckets with a title that changes are rewritten, a few per commit.  A run that was
    stopped is continued by the next one, for which the buckets already done have no change.
    """
    table = spark.read.schema(STORED).parquet(path)
    open_ = sorted(_touched(table.filter(title_changes())))
    commits = [open_[i:i + per_commit] for i in range(0, len(open_), per_commit)]
    for buckets in commits:
        _replace(migrate_titles(stored_in(spark, path, buckets), now=now), path)
    return commits


def _touched(df: DataFrame) -> list[int]:
    """The buckets of the rows, `REVIEW_BUCKETS` numbers at most."""
    return [r["bucket"] for r in df.select("bucket").distinct().collect()]


def _replace(rows: DataFrame, path: str) -> None:
    """Put the rows in place of the buckets they belong to, in one commit."""
    ready = written(rows, "buckets")
    (laid_out(ready).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def export_reviews(reviews: DataFrame, path: str, fmt: str, asin: str | None = None,
                   limit: int | None = None) -> str | None:
    """Write all reviews, or one product's, and return the path; None when empty.

    The path gets the suffix of its format.  Columns come in the order of the
    stored table, whatever that of the frame; others follow.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    if asin is not None and not (len(asin) == 10 and asin.isalnum()):
        raise ValueError(f"invalid product code {asin!r}")
    first = [c for c in REVIEWS.fieldNames() if c in reviews.columns]
    reviews = reviews.select(*first, *[c for c in reviews.columns if c not in first])
    # Run the input once: the emptiness test, the sample of the sort and the sort read it.
    chosen = written(reviews.filter(F.col("asin") == asin) if asin else reviews, "export")
    rows = reviews_for_product(chosen, asin, limit) if asin else all_reviews(chosen, limit)
    return None if chosen.isEmpty() else _write(rows, path, fmt)


def write_rows(rows: DataFrame, path: str, fmt: str) -> str | None:
    """Any frame to a folder of CSV, Parquet or NDJSON files; nothing when it is empty."""
    return None if rows.isEmpty() else _write(rows, path, fmt)


def write_unique(rows: DataFrame, path: str, fmt: str, order: list[str | Column],
                 scope: list[str] | None = None) -> dict[str, int]:
    """Write the rows that the two-pass rule keeps; how many came in, stayed and went, counted on the way.

    Rows are evaluated once: both counts are observed by the job that writes.
    """
    if rows.isEmpty():  # the optimizer may drop all of an empty plan, its counts included
        _write(rows, path, fmt)
        return {"rows_before": 0, "rows_after": 0, "removed": 0}
    before, after = Observation("before"), Observation("after")
    unique = dedup_two_pass(rows.observe(before, F.count(F.lit(1)).alias("rows")), order, scope)
    _write(unique.observe(after, F.count(F.lit(1)).alias("rows")), path, fmt)
    came, stayed = before.get["rows"], after.get["rows"]
    return {"rows_before": came, "rows_after": stayed, "removed": came - stayed}


def _write(rows: DataFrame, path: str, fmt: str) -> str:
    if not path.endswith(f".{fmt}"):
        path = f"{path}.{fmt}"
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        # Quotes are doubled, and text keeps its own leading and trailing space.
        (writer.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "ndjson":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return path


def write_run(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Keep the results of runs, one folder per run; a run that is written again replaces itself."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(run).parquet(path))


def newest_run(spark: SparkSession, path: str, run: str = "run_id") -> str | None:
    """The last run id by the names of the run folders; no file is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    statuses = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(folder)
    names = [s.getPath().getName() for s in statuses if s.isDirectory()]
    runs = [unquote(n.removeprefix(f"{run}=")) for n in names if n.startswith(f"{run}=")]
    return max((r for r in runs if r != "__HIVE_DEFAULT_PARTITION__"), default=None)


def last_run(spark: SparkSession, path: str, run: str = "run_id") -> DataFrame | None:
    """Rows of the newest run kept by `write_run`; only its folder is read."""
    newest = newest_run(spark, path, run)
    if newest is None:
        return None
    # Ids stay text: `007` and `7` are different runs.
    schema = spark.read.parquet(f"{path.rstrip('/')}/{run}={quote(newest, safe=' ')}").schema
    stored = T.StructType([*schema.fields, T.StructField(run, T.StringType())])
    return spark.read.schema(stored).parquet(path).filter(F.col(run) == newest)


def export_last_run(spark: SparkSession, path: str, out: str, fmt: str, order: list[str | Column],
                    run: str = "run_id") -> str | None:
    """Export the newest run, deduplicated and in sentiment order; None when there is no run or no row."""
    rows = last_run(spark, path, run)
    # The view keeps a row of any rows there are, so the files of the run tell whether it is empty.
    return None if rows is None or rows.isEmpty() else _write(quality_view(rows, order), out, fmt)
