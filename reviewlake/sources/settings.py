"""Stored settings over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: keys that are masked, and keys read as whole numbers
SENSITIVE = ("github_token", "github_webhook_secret", "openai_api_key", "claude_api_key")
NUMERIC = ("max_file_size_kb", "poll_interval_seconds", "api_port")
MASK = "***"


def read_settings(stored: DataFrame, defaults: DataFrame, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """(key, value, number): a stored value wins over the default, also an empty one; without a
    stored value the default counts, and null is empty. Set secrets show as a mask."""
    kept = stored.select("key", F.coalesce("value", F.lit("")).alias("_stored"))
    merged = defaults.join(kept, "key", "left").select(
        "key", F.coalesce("_stored", F.col("value"), F.lit("")).alias("value")
    )
    shown = F.when(
        F.col("key").isin(*sensitive), F.when(F.col("value") != "", MASK).otherwise("")
    ).otherwise(F.col("value"))
    return merged.select(
        "key", shown.alias("value"),
        F.when(F.col("key").isin(*NUMERIC), F.col("value").try_cast("int")).alias("number"),
    )
