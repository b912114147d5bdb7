"""Scores and counts per file and per review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.scores import clamp_score, severity_weight
from reviewlake.rules import catalog as C


def severity_counts() -> list[Column]:
    return [
        F.count_if(F.col("severity") == name).alias(f"{name}_count") for name in C.SEVERITY_WEIGHTS
    ]


def penalty() -> Column:
    return F.sum(severity_weight(F.col("severity")))


def file_scores(files: DataFrame, findings: DataFrame, key: str = "file_id") -> DataFrame:
    """Files with findings count, severity counts and score; a file without findings has 100.

    Findings are counted per file first, on the map side and in hash tables, so what meets the
    files is one narrow row per file.
    """
    counted = findings.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("findings_count"), *severity_counts(), penalty().alias("penalty")
    )
    counts = [c for c in counted.columns if c != "_key"]
    return files.join(counted, F.col(key) == F.col("_key"), "left").select(
        *files.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        clamp_score(F.coalesce("penalty", F.lit(0))).alias("score"),
    )


def review_scores(
    file_rows: DataFrame, key: str = "review_id", normalise: bool = True
) -> DataFrame:
    """Roll scored files up to reviews: 100 - penalty / (2 × files), clamped.

    ``normalise=False`` is the alternative that takes the whole penalty off.
    """
    total = F.sum("penalty")
    files = F.count("*")
    taken = total / F.greatest(files * 2, F.lit(1)) if normalise else total
    return file_rows.groupBy(key).agg(
        files.alias("files_analyzed"),
        F.sum("findings_count").alias("total_findings"),
        *[F.sum(f"{n}_count").alias(f"{n}_count") for n in C.SEVERITY_WEIGHTS],
        clamp_score(taken).alias("score"),
    )


def score_all_reviews(reviews: DataFrame, scored: DataFrame, key: str = "review_id") -> DataFrame:
    """Also reviews of which no file was analysed: score 100, nothing found."""
    return reviews.select(key).join(scored, key, "left").select(
        key,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in scored.columns if c not in (key, "score")],
        F.coalesce("score", F.lit(100.0)).alias("score"),
    )


def analysed_counts(files: DataFrame, key: str = "review_id") -> DataFrame:
    """Per review: analysed files, and skipped ones (``error`` set); left-out files count in
    neither."""
    return files.groupBy(key).agg(
        F.count_if(F.col("error").isNull()).alias("files_analyzed"),
        F.count_if(F.col("error").isNotNull()).alias("files_skipped"),
    )


def severity_pivot(findings: DataFrame, key: str = "file_id") -> DataFrame:
    """Critical and warning counts per file."""
    return findings.groupBy(key).agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
    )


def rule_hit_rate(findings: DataFrame, file_key: str = "file_id") -> DataFrame:
    """Per rule: findings, and the distinct files it hits (exact, in two combining steps)."""
    per_file = findings.groupBy("rule_id", file_key).agg(F.count("*").alias("_n"))
    return per_file.groupBy("rule_id").agg(
        F.sum("_n").alias("findings"), F.count("*").alias("files")
    )


def category_cube(findings: DataFrame) -> DataFrame:
    """Findings by category × severity × language with all subtotals (null = all)."""
    return findings.cube("category", "severity", "language").agg(
        F.grouping_id().alias("level"), F.count("*").alias("findings")
    )
