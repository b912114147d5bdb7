"""Queries over stored reviews, files and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.scores import round_tenth
from reviewlake.operators.skew import with_part

COUNTERS = ("total_findings", "critical_count", "warning_count", "suggestion_count")
ROWS_PER_GROUP = 500


def filter_reviews(
    reviews: DataFrame, status: str | None = None, repo: str | None = None,
    min_score: float | None = None, max_score: float | None = None,
) -> DataFrame:
    """Equality on status, case-insensitive substring of the repository name, score bounds; a
    review without a score drops out once a bound is set."""
    out = reviews
    if status:
        out = out.where(F.col("status") == status)
    if repo:
        out = out.where(F.col("repo_name").ilike(f"%{repo}%"))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if max_score is not None:
        out = out.where(F.col("score") <= max_score)
    return out


def newest_first(reviews: DataFrame) -> DataFrame:
    return reviews.orderBy(F.desc("created_at"), F.desc("review_id"))


def page(reviews: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page, newest first. Offset and limit run as one bounded top-k."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page numbers start at 1; a page holds 1 to 100 rows")
    return newest_first(reviews).offset((number - 1) * size).limit(size)


def page_after(reviews: DataFrame, created_at, review_id, size: int = 20) -> DataFrame:
    """The page behind a given row: its cost does not grow with the page number."""
    at, key = F.lit(created_at).cast("timestamp"), F.lit(review_id)
    behind = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("review_id") < key))
    return newest_first(reviews.where(behind)).limit(size)


def page_counts(reviews: DataFrame, size: int = 20) -> DataFrame:
    total = F.count("*")
    return reviews.agg(
        total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint").alias("pages")
    )


def newest_projects(projects: DataFrame, n: int | None = None) -> DataFrame:
    """Projects by time of registration, the newest first; all of them, or the first ``n``."""
    ordered = projects.orderBy(F.desc("created_at"), F.desc("project_id"))
    return ordered if n is None else ordered.limit(n)


def recent(reviews: DataFrame, n: int = 10) -> DataFrame:
    return newest_first(reviews).limit(n)


def review_stats(reviews: DataFrame) -> DataFrame:
    """All totals in one pass; an empty sum is 0."""
    return reviews.agg(
        F.count("*").alias("total_reviews"),
        round_tenth(F.coalesce(F.avg("score"), F.lit(0.0))).alias("avg_score"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}_sum") for c in COUNTERS],
    )


def reviews_by_status(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("status").agg(F.count("*").alias("reviews"))


def status_map(reviews: DataFrame) -> DataFrame:
    """The same as one map value; the group is the handful of statuses."""
    return reviews_by_status(reviews).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "reviews")))).alias("by_status")
    )


def top_languages(file_reviews: DataFrame, n: int = 5) -> DataFrame:
    return (
        file_reviews.groupBy("language").agg(F.count("*").alias("files"))
        .orderBy(F.desc("files"), "language").limit(n)
    )


def score_trend(reviews: DataFrame, n: int = 10) -> DataFrame:
    """The newest scores, oldest first."""
    newest = newest_first(reviews.where(F.col("score").isNotNull())).limit(n)
    return newest.orderBy("created_at", "review_id").select(
        "review_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "score"
    )


def newest_per_project(reviews: DataFrame, n: int = 20) -> DataFrame:
    """Newest reviews of every project. The bound on the rank lets each task drop all but ``n``
    rows per project before the shuffle, so a hot project is cheap."""
    order = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("review_id"))
    return reviews.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def project_reviews(reviews: DataFrame, projects: DataFrame, n: int = 20) -> DataFrame:
    named = projects.select(F.col("project_id").alias("_project"), "owner", "repo")
    return newest_per_project(reviews, n).join(named, F.col("project_id") == F.col("_project")).drop("_project")


def project_patterns(projects: DataFrame, patterns: DataFrame) -> DataFrame:
    return projects.select("project_id", "owner", "repo").join(patterns, "project_id")


def new_projects(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested projects of which the address is not known yet."""
    return requested.join(existing.select("repo_url"), "repo_url", "left_anti")


def nested_reviews(
    reviews: DataFrame, file_reviews: DataFrame, findings: DataFrame, limit: int = ROWS_PER_GROUP
) -> DataFrame:
    """Reviews with their files, and files with their findings, nested.

    One row per review and part: a review or file with more children than ``limit`` is spread over
    several parts, so no array grows without bound. All columns of the review repeat per part.
    """
    detail = [c for c in findings.columns if c not in ("file_id", "ordinal")]
    pieces = (
        with_part(findings, ["file_id"], F.col("ordinal"), limit, "piece")
        .groupBy("file_id", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", *detail))).alias("findings"))
    )
    files = file_reviews.join(pieces, "file_id", "left").withColumn(
        "piece", F.coalesce("piece", F.lit(0).cast("bigint"))
    )
    columns = [c for c in file_reviews.columns if c not in ("review_id", "file_id")]
    nested = F.transform(
        F.coalesce("findings", F.array().cast(pieces.schema["findings"].dataType)),
        lambda f: F.struct(*[f[c].alias(c) for c in detail]),
    )
    parts = (
        with_part(files, ["review_id"], F.col("file_id") + F.col("piece"), limit)
        .groupBy("review_id", "part")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("file_id", "piece", *columns, nested.alias("findings")))
            ).alias("files")
        )
    )
    return reviews.join(parts, "review_id", "left").withColumn(
        "part", F.coalesce("part", F.lit(0).cast("bigint"))
    )


def score_moves(reviews: DataFrame, span: int = 5, bucket: str = "hour") -> DataFrame:
    """Per repository and scored review: change against the review before, and the mean of the
    last ``span`` scores.

    A window over a repository would sort a hot repository in one task. Instead every review gets
    its position from bucket counts (one row per repository and bucket, then a small running
    sum), and then contributes to the ``span`` positions it counts for.
    """
    scored = reviews.where(F.col("score").isNotNull()).select(
        "review_id", "repo_name", "created_at", "score", F.date_trunc(bucket, "created_at").alias("_bucket")
    )
    per_bucket = scored.groupBy("repo_name", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("repo_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "repo_name", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("repo_name", "_bucket").orderBy("created_at", "review_id")
    placed = scored.join(offsets, ["repo_name", "_bucket"]).select(
        "review_id", "repo_name", "created_at", "score",
        (F.col("_offset") + F.row_number().over(inside)).alias("position"),
    )
    shares = placed.withColumn("target", F.explode(F.sequence("position", F.col("position") + (span - 1))))
    own = F.col("position") == F.col("target")
    previous = F.col("position") == F.col("target") - 1
    return (
        shares.groupBy("repo_name", "target")
        .agg(
            F.max(F.when(own, F.struct("review_id", "created_at", "score"))).alias("_own"),
            F.max(F.when(previous, F.col("score"))).alias("_previous"),
            F.avg("score").alias("moving_average"),
        )
        .where(F.col("_own").isNotNull())
        .select(
            "repo_name", F.col("target").alias("position"), "_own.*",
            (F.col("_own.score") - F.col("_previous")).alias("change"), "moving_average",
        )
    )


def latest_settings(log: DataFrame, *ties: str) -> DataFrame:
    """Last value per key of a change log."""
    return log.groupBy("key").agg(
        F.max_by("value", F.struct("updated_at", *ties)).alias("value"),
        F.max("updated_at").alias("updated_at"),
    )


def purge(
    reviews: DataFrame, file_reviews: DataFrame, findings: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the reviews in ``doomed(review_id)`` and without their files and findings."""
    gone_files = file_reviews.join(doomed, "review_id", "left_semi").select("file_id")
    return (
        reviews.join(doomed, "review_id", "left_anti"),
        file_reviews.join(doomed, "review_id", "left_anti"),
        findings.join(gone_files, "file_id", "left_anti"),
    )


def purge_projects(
    projects: DataFrame, patterns: DataFrame, reviews: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the projects in ``doomed(project_id)``: patterns go with them, reviews stay without
    a project."""
    gone = doomed.select(F.col("project_id").alias("_gone"))
    kept_reviews = reviews.join(gone, F.col("project_id") == F.col("_gone"), "left").withColumn(
        "project_id", F.when(F.col("_gone").isNull(), F.col("project_id"))
    ).drop("_gone")
    return (
        projects.join(doomed, "project_id", "left_anti"),
        patterns.join(doomed, "project_id", "left_anti"),
        kept_reviews,
    )


def files_with_patch(file_reviews: DataFrame, pr_files: DataFrame) -> DataFrame:
    """Reviewed files with the patch of the first changed file of the same review and name."""
    first = pr_files.groupBy("review_id", "filename").agg(F.min_by("patch", "position").alias("patch"))
    return file_reviews.join(first, ["review_id", "filename"], "left")
