"""Storing reviews, files and findings; report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
FEW_BUCKETS = 16  # of a shuffled part of 64 MB each then holds a few MB


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("review_id"), F.lit(buckets))


def stored_findings(findings: DataFrame, files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Findings with their review and bucket, dealt as they are to be written.

    Findings that lack their review get it by a join, which deals them by file in even parts and splits hot files. With few
    buckets each part holds enough rows of each bucket for a file of its own, so the rows are not moved again; the join is
    then a shuffled one at any size, as a broadcast one would leave them in the parts of their source.
    """
    keyed, few = findings, False
    if "review_id" not in findings.columns:
        few = buckets <= FEW_BUCKETS
        owners = files.select("file_id", "review_id")
        keyed = findings.join(owners.hint("merge") if few else owners, "file_id")
    keyed = keyed.withColumn("bucket", _bucket(buckets))
    return keyed if few else keyed.hint("rebalance", "bucket")


def write_review_tables(
    findings: DataFrame, files: DataFrame, reviews: DataFrame, path: str,
    buckets: int = BUCKETS, append: bool = False,
) -> None:
    """Write the three levels.

    Tables are partitioned by a bucket of the review, and a run replaces the buckets it touches,
    so a re-run does not leave earlier rows behind (``append`` would). Before writing, rows are
    rebalanced by bucket: adaptive execution joins small buckets into one task, and splits the
    bucket of a huge review over many. Findings are moved only once if the buckets are few (``stored_findings``).
    """
    mode = "append" if append else "overwrite"
    tables = {
        "findings": stored_findings(findings, files, buckets),
        "file_reviews": files.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket"),
        "reviews": reviews.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket"),
    }
    for name, df in tables.items():
        (
            df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket").parquet(f"{path}/{name}")
        )


def read_review_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("bucket")


def report_name(owner: Column, repo: Column, number: Column, at: Column) -> Column:
    """Deterministic file name of a report."""
    return F.concat(
        F.lit("review_"), owner, F.lit("_"), repo, F.lit("_pr"), number.cast("string"), F.lit("_"),
        F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".md"),
    )


def write_reports(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Reports as rows (``name``, ``volume``, ``text``) in buckets of names; a run replaces the buckets it touches."""
    bucket = F.pmod(F.hash("name"), F.lit(buckets))
    (
        documents.select("name", "volume", "text").withColumn("bucket", bucket).hint("rebalance", "bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports; the volumes of a name in order make its text."""
    return spark.read.parquet(path).drop("bucket")
