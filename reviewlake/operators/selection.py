"""Which files are analysed, and which are only kept."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reviewlake.functions.patterns import jvm_pattern
from reviewlake.functions.text import is_blank
from reviewlake.rules.catalog import CATEGORIES, MAX_FILE_KB

TOO_LARGE = "File too large for analysis"


def drop_removed(files: DataFrame) -> DataFrame:
    return files.where(F.coalesce("status", F.lit("modified")) != "removed")


@F.pandas_udf(StringType())
def _for_the_jvm(patterns: pd.Series) -> pd.Series:
    return patterns.map(jvm_pattern).astype(object)


def valid_patterns(patterns: DataFrame) -> DataFrame:
    """Ignore patterns that compile, as ``jvm`` also in the JVM's spelling; the pattern table is configuration, so it is small."""
    return patterns.withColumn("jvm", _for_the_jvm("pattern")).where(F.col("jvm").isNotNull())


def rejected_patterns(patterns: DataFrame) -> DataFrame:
    """The ignore patterns that do not compile, with the reason; files are selected without them."""
    bad = patterns.withColumn("jvm", _for_the_jvm("pattern")).where(F.col("jvm").isNull()).drop("jvm")
    return bad.withColumn("reason", F.when(F.col("pattern").isNull(), "no pattern").otherwise("not a regular expression"))


def drop_ignored(files: DataFrame, patterns: DataFrame, key: str = "project_id") -> DataFrame:
    """Drop files of which the name holds a match of any pattern of their project.

    Every pattern is taken as a regular expression. The join is an equi-join on the project with
    the match as residual, so it stays a hash or sort-merge join whatever the table sizes, and
    neither side needs a forced broadcast.
    """
    usable = valid_patterns(patterns).select(
        F.col(key).alias("_key"), F.col("jvm").alias("pattern")
    )
    return files.join(
        usable,
        (F.col(key) == F.col("_key")) & F.rlike("filename", F.col("pattern")),
        "left_anti",
    )


def is_oversize(bytes_: Column, max_kb: int = MAX_FILE_KB) -> Column:
    return bytes_ > max_kb * 1024


def flag_oversize(files: DataFrame, max_kb: int = MAX_FILE_KB) -> DataFrame:
    size = F.octet_length("content")
    if "content_bytes" in files.columns:
        size = F.coalesce(F.col("content_bytes"), size)
    return files.withColumn("is_oversize", F.coalesce(is_oversize(size, max_kb), F.lit(False)))


def flag_blank(files: DataFrame) -> DataFrame:
    blank = is_blank(F.col("content"))
    if "content_bytes" in files.columns:  # a text that was too long to be put together
        blank = blank & ~(F.col("content").isNull() & (F.coalesce("content_bytes", F.lit(0)) > 0))
    return files.withColumn("is_blank", blank)


def split_csv(csv: Column) -> Column:
    """Comma list → array of trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(csv, ","), lambda c: F.trim(c)), lambda c: c != "")


def enabled_categories(findings: DataFrame, csv_col: str) -> DataFrame:
    """Findings of the categories their project has switched on; an empty list means all."""
    chosen = split_csv(F.col(csv_col))
    return findings.where(
        F.col(csv_col).isNull() | (F.size(chosen) == 0) | F.array_contains(chosen, F.col("category"))
    )


def category_list(categories) -> tuple[str, ...]:
    chosen = tuple(c for c in CATEGORIES if not categories or c in categories)
    return chosen
