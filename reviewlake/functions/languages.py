"""File name → language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.rules.catalog import EXTENSIONS, SUPPORTED_LANGUAGES


def language_of(filename: Column) -> Column:
    """Language by the last suffix of the base name, ``unknown`` otherwise.

    A dot that opens the base name starts no suffix, and a suffix is never empty.
    """
    suffix = F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)/*$", 1))
    table = F.create_map(*[F.lit(v) for pair in EXTENSIONS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("unknown"))


def with_language(df: DataFrame, path_col: str = "filename") -> DataFrame:
    return df.withColumn("language", language_of(F.col(path_col)))


def supported_only(df: DataFrame, language_col: str = "language") -> DataFrame:
    return df.where(F.col(language_col).isin(*SUPPORTED_LANGUAGES))
