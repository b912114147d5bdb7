"""Scores, bands and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.rules import catalog as C


def severity_weight(severity: Column) -> Column:
    out = None
    for name, weight in C.SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, weight) if out is None else out.when(severity == name, weight)
    return out.otherwise(1)


def clamp_score(penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - penalty))


def severity_rank(severity: Column) -> Column:
    lowered = F.lower(severity)
    return (
        F.when(lowered == "critical", 0).when(lowered == "warning", 1).when(lowered == "suggestion", 2).otherwise(3)
    )


def severity_colour(severity: Column) -> Column:
    lowered, out = F.lower(severity), None
    for name, colour in C.SEVERITY_COLOURS.items():
        out = F.when(lowered == name, colour) if out is None else out.when(lowered == name, colour)
    return out.otherwise(C.UNKNOWN_SEVERITY_COLOUR)


def _band(score: Column, field: int, continuous: bool) -> Column:
    out = None
    for band in C.SCORE_BANDS:
        test = (score >= band[0]) if continuous else score.between(band[0], band[1])
        out = F.when(test, band[field]) if out is None else out.when(test, band[field])
    return out.otherwise(C.SCORE_BANDS[-1][field])


def score_label(score: Column, continuous: bool = False) -> Column:
    """Band of a score. Bounds are integers, so a fraction between two bands falls to the last
    one; ``continuous`` closes these gaps."""
    return _band(score, 2, continuous)


def score_colour(score: Column, continuous: bool = False) -> Column:
    return _band(score, 3, continuous)


def round_tenth(x: Column) -> Column:
    """Nearest multiple of 0.1 of the exact binary value; true ties go to the even digit.

    ``bround`` rounds the shortest decimal form, which looks like a tie for values such as 99.85
    that in fact lie below or above it. 20x = 16x + 4x is formed with its rounding error, which
    tells the side.
    """
    a, b = x * 16.0, x * 4.0
    s = a + b
    t = s - a
    error = (a - (s - t)) + (b - t)
    looks_tied = (s == F.floor(s)) & (F.pmod(F.floor(s), F.lit(2)) == 1)
    below = (F.floor(s) - 1) / 2
    odd = F.pmod(below, F.lit(2)) == 1
    tenths = below + F.when((error > 0) | ((error == 0) & odd), 1).otherwise(0)
    return F.when(looks_tied, tenths / 10.0).otherwise(F.bround(x, 1))


def score_summary(score: Column, continuous: bool = False) -> Column:
    return F.struct(
        round_tenth(score).alias("score"),
        score_label(score, continuous).alias("label"),
        score_colour(score, continuous).alias("colour"),
        F.bround(score, 0).cast("int").alias("percentage"),
    )


def score_bar(score: Column) -> Column:
    filled = F.floor(score / 5).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(20) - filled))


def one_decimal(score: Column) -> Column:
    """Text with one decimal digit."""
    return F.format_string("%.1f", round_tenth(score.cast("double")))
