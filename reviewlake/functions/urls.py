"""Pull-request and repository addresses, branch names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: accepted address forms
PR_URL = r"(?i)(?:https?://)?github\.com/([^/]+)/([^/]+)/pull/(\d+)"
REPO_URL = r"(?i)(?:https?://)?github\.com/([^/]+)/([^/\s]+?)(?:\.git)?/?\z"


def _part(url: Column, pattern: str, group: int) -> Column:
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, group))


def parse_pr_url(url: Column) -> Column:
    """struct<owner, repo, number>; null when the address is not one of a pull request."""
    repo = F.regexp_replace(_part(url, PR_URL, 2), r"\.git\z", "")
    return F.when(
        url.rlike(PR_URL),
        F.struct(
            _part(url, PR_URL, 1).alias("owner"), repo.alias("repo"),
            _part(url, PR_URL, 3).try_cast("bigint").alias("number"),
        ),
    )


def parse_repo_url(url: Column) -> Column:
    """struct<owner, repo>; null when the address is not one of a repository."""
    return F.when(
        url.rlike(REPO_URL),
        F.struct(_part(url, REPO_URL, 1).alias("owner"), _part(url, REPO_URL, 2).alias("repo")),
    )


def split_by_pr_url(df: DataFrame, column: str = "pr_url") -> tuple[DataFrame, DataFrame]:
    """(rows with a parsed address, rejected rows with a reason)."""
    parsed = df.withColumn("_parsed", parse_pr_url(F.trim(F.col(column))))
    good = parsed.where("_parsed is not null").select(*df.columns, "_parsed.*")
    bad = parsed.where("_parsed is null").select(
        *df.columns, F.concat(F.lit("Cannot parse pull request URL: "), F.col(column)).alias("reason")
    )
    return good, bad


def split_by_repo_url(df: DataFrame, column: str = "repo_url") -> tuple[DataFrame, DataFrame]:
    cleaned = F.rtrim(F.trim(F.col(column)), F.lit("/"))
    parsed = df.withColumn("_parsed", parse_repo_url(cleaned))
    good = parsed.where("_parsed is not null").select(*df.columns, "_parsed.*")
    bad = parsed.where("_parsed is null").select(
        *df.columns, F.concat(F.lit("Cannot parse repository URL: "), F.col(column)).alias("reason")
    )
    return good, bad


def branch_of(ref: Column) -> Column:
    return F.when(
        ref.startswith("refs/heads/"), F.replace(ref, F.lit("refs/heads/"), F.lit(""))
    ).otherwise(ref)
