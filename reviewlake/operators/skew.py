"""Bounded groups: parts of keys that hold too many rows for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_part(
    df: DataFrame, keys: Sequence[str], salt: Column, limit: int, name: str = "part"
) -> DataFrame:
    """Add a part number: 0 for keys of at most ``limit`` rows, else ``salt`` modulo the number
    of parts needed. Only the keys above the limit are joined back, which are few: at most
    rows / limit. Every row stays."""
    keys = list(keys)
    big = (
        df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_rows") / limit).alias("_parts"))
    )
    on = None
    for k in keys:
        test = F.col(k) == F.col(f"_{k}")
        on = test if on is None else on & test
    return df.join(big, on, "left").select(
        *df.columns,
        F.when(F.col("_parts").isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.pmod(salt.cast("bigint"), F.col("_parts"))).cast("bigint").alias(name),
    )
