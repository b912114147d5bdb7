"""Findings as sets: first of each key, order, and differences between two reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.scores import severity_rank


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def finding_key() -> Column:
    """The rule id, or the beginning of the message where there is none."""
    return F.coalesce(F.nullif("rule_id", F.lit("")), F.substring("message", 1, 50))


def dedupe_findings(findings: DataFrame, file_key: str = "file_id") -> DataFrame:
    """The first finding, by ordinal, of each (file, category, line, key); no line is a key too.

    An aggregate instead of a ranking window: it combines before the shuffle, so a key that is
    repeated without end costs one row per task.
    """
    others = [c for c in findings.columns if c not in (file_key, "category", "line_number")]
    first = F.min_by(F.struct(*others), F.col("ordinal"))
    return (
        findings.groupBy(file_key, "category", "line_number", finding_key().alias("_key"))
        .agg(first.alias("_first"))
        .select(file_key, "category", "line_number", "_first.*")
        .select(*findings.columns)
    )


def sort_findings(findings: DataFrame, *ties: str) -> DataFrame:
    """Critical first, then by line (none counts as 0), then by the given columns."""
    return findings.orderBy(severity_rank(F.col("severity")), F.coalesce("line_number", F.lit(0)), *ties)


_IDENTITY = ("filename", "rule_id", "code_snippet")


def new_findings(before: DataFrame, after: DataFrame, on: tuple[str, ...] = _IDENTITY) -> DataFrame:
    """Findings of ``after`` that ``before`` does not have, by name, rule and snippet."""
    old = before.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return after.join(old, same, "left_anti")


def fixed_findings(before: DataFrame, after: DataFrame, on: tuple[str, ...] = _IDENTITY) -> DataFrame:
    return new_findings(after, before, on)
