"""Replies of a text model, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.text import strip
from reviewlake.schemas import MODEL_REPLY

_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
NO_REPLY = "AI review unavailable"
DEFAULT_ASSESSMENT = "needs_work"


def fenced_json(reply: Column) -> Column:
    """Content of the first fenced block, or the whole reply."""
    return strip(F.when(reply.rlike(_FENCE), F.regexp_extract(reply, _FENCE, 1)).otherwise(reply))


def parse_reply(reply: Column, unwrap: bool = True) -> Column:
    """struct<summary, suggestions, overall_assessment, parsed>.

    A reply that is no JSON object becomes its own summary, cut to 500 characters.
    """
    raw = fenced_json(reply) if unwrap else reply
    is_object = F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{")
    is_object = F.coalesce(is_object, F.lit(False))
    data = F.from_json(raw, MODEL_REPLY, {"mode": "PERMISSIVE"})
    broken = F.when(F.length(raw) > 0, F.substring(raw, 1, 500)).otherwise(F.lit(NO_REPLY))
    return F.struct(
        F.when(is_object, F.coalesce(data["summary"], F.lit(""))).otherwise(broken).alias("summary"),
        F.when(is_object, F.coalesce(data["suggestions"], F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("suggestions"),
        F.when(is_object, F.coalesce(data["overall_assessment"], F.lit(DEFAULT_ASSESSMENT)))
        .otherwise(F.lit(DEFAULT_ASSESSMENT)).alias("overall_assessment"),
        is_object.alias("parsed"),
    )
