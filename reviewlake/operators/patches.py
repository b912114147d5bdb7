"""Unified diffs: analysed text of a patch, and its lines with new-file numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.text import OTHER_LINE_BREAKS, holds_any, split_lines


def patch_content(patch: Column) -> Column:
    """Added and context lines of a diff, glued together.

    An added line loses its sign only; any other kept line loses all leading spaces. Headers
    (``@@``, ``+++``) and removed lines are dropped.
    """
    # where only line feeds end lines, one pass over the text; each line is seen with the line feed before it
    lines = F.concat(F.lit("\n"), F.when(patch.endswith("\n"), F.left(patch, F.length(patch) - 1)).otherwise(patch))
    glued = F.substring(F.regexp_replace(lines, _SIGNS, "$1"), 2, _ALL)
    return F.when(holds_any(patch, OTHER_LINE_BREAKS), _content_by_lines(patch)).otherwise(glued)


# lines to be dropped, or what a kept line loses behind its line feed (group 1)
_SIGNS = r"(?:\n(?:-|\+\+\+|@@)[^\n]*+)++|(\n)(?:\+| ++)"
_ALL = 2**31 - 1


def _content_by_lines(patch: Column) -> Column:
    kept = F.filter(
        split_lines(patch),
        lambda l: ~(l.startswith("-") | l.startswith("+++") | l.startswith("@@")),
    )
    return F.array_join(
        F.transform(
            kept,
            lambda l: F.when(l.startswith("+"), l.substr(F.lit(2), F.length(l))).otherwise(F.ltrim(l, F.lit(" "))),
        ),
        "\n",
    )


def patch_lines(patches: DataFrame, key: str = "file_id") -> DataFrame:
    """Lines of each diff: (key, position, line_number, content, is_added, is_removed, extract_line).

    ``line_number`` counts in the new file; a removed line carries the number current before it.
    ``extract_line`` is the position of the line in ``patch_content`` (null for lines not in it).
    One shuffle by file; the windows share it.
    """
    raw = patches.select(key, F.posexplode(split_lines(F.col("patch"))).alias("position", "raw"))
    header = F.col("raw").startswith("@@")
    base = F.regexp_extract("raw", r"\+(\d+)", 1)
    added = F.col("raw").startswith("+") & ~F.col("raw").startswith("+++") & ~header
    removed = F.col("raw").startswith("-") & ~F.col("raw").startswith("---") & ~header
    tagged = raw.select(
        key, "position", "raw",
        header.alias("is_header"), added.alias("is_added"), removed.alias("is_removed"),
        F.when(header & (base != ""), base.cast("long") - 1).alias("base"),
        F.when(header | removed, 0).otherwise(1).alias("advance"),
        (~(header | F.col("raw").startswith("-") | F.col("raw").startswith("+++"))).cast("int").alias("in_extract"),
    )
    upto = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = tagged.select(
        "*",
        F.sum("advance").over(upto).alias("advanced"),
        F.sum("in_extract").over(upto).alias("extracted"),
    ).select(
        "*",
        F.last(
            F.when(F.col("base").isNotNull(), F.col("base") - F.col("advanced")), ignorenulls=True
        ).over(upto).alias("offset"),
    )
    content = F.when(
        F.col("is_added") | F.col("is_removed"), F.col("raw").substr(F.lit(2), F.length("raw"))
    ).otherwise(F.ltrim("raw", F.lit(" ")))
    return running.where(~F.col("is_header")).select(
        key, "position",
        (F.coalesce("offset", F.lit(0)) + F.col("advanced")).cast("int").alias("line_number"),
        content.alias("content"), "is_added", "is_removed",
        F.when(F.col("in_extract") == 1, F.col("extracted")).cast("int").alias("extract_line"),
    )


def new_line_numbers(findings: DataFrame, patches: DataFrame, key: str = "file_id") -> DataFrame:
    """Findings on patch extracts, placed in the new file (``new_line`` and ``is_added``)."""
    numbered = patch_lines(patches, key).where(F.col("extract_line").isNotNull()).select(
        F.col(key).alias("_key"), "extract_line", F.col("line_number").alias("new_line"), "is_added"
    )
    return findings.join(
        numbered,
        (F.col(key) == F.col("_key")) & (F.col("line_number") == F.col("extract_line")),
        "left",
    ).drop("_key", "extract_line")
