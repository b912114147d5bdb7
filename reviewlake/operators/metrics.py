"""Size, complexity and nesting of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import indent_width, strip
from reviewlake.operators.blocks import GENERIC_LANGUAGES, code_blocks
from reviewlake.rules import catalog as C


BRACE_LANGUAGES = ("javascript", "typescript", "java", "go")


def cyclomatic(body: Column, language: Column) -> Column:
    """1 + number of branch tokens, ignoring case; ``else if`` counts twice by design."""

    def total(tokens) -> Column:
        out = F.lit(1)
        for token in tokens:
            out = out + F.regexp_count(body, F.lit("(?iU)" + token))
        return out

    by_tokens: dict[tuple, list[str]] = {}
    for name, tokens in C.BRANCH_TOKENS.items():
        by_tokens.setdefault(tokens, []).append(name)
    default = C.BRANCH_TOKENS["javascript"]
    out = None
    for tokens, names in by_tokens.items():
        if tokens == default:
            continue
        test = language.isin(*names)
        out = F.when(test, total(tokens)) if out is None else out.when(test, total(tokens))
    return out.otherwise(total(default))


def max_nesting(body: Column) -> Column:
    """Deepest indentation of a non-blank line, in units of four characters."""
    depths = F.transform(
        F.filter(F.split(body, "\n", -1), lambda l: strip(l) != ""),
        lambda l: F.floor(indent_width(l) / 4).cast("int"),
    )
    return F.coalesce(F.array_max(depths), F.lit(0))


def function_length(start: Column, end: Column) -> Column:
    return end - start + 1


def functions_with_metrics(
    files: DataFrame, keep: list[str] | None = None, brace_extents: bool = False
) -> DataFrame:
    """(*keep, language, name, start_line, end_line, length, complexity, nesting, text).

    Languages read by their surface shape have no extents, so their functions are not listed;
    ``brace_extents`` gives them extents by running brace depth.
    """
    keep = keep or ["file_id"]
    braces = GENERIC_LANGUAGES
    if brace_extents:
        braces += BRACE_LANGUAGES
    blocks = code_blocks(files, ("function",), braces, keep)
    return with_metrics(blocks).select(
        *keep, "language", "name", "start_line", "end_line", "length", "complexity", "nesting", "text"
    )


def with_metrics(blocks: DataFrame) -> DataFrame:
    """Add length, complexity and nesting to blocks that are functions."""
    is_function = F.col("kind").isin("function", "generic")
    return blocks.withColumns(
        {
            "length": function_length(F.col("start_line"), F.col("end_line")),
            "complexity": F.when(is_function, cyclomatic(F.col("text"), F.col("language"))),
            "nesting": F.when(is_function, max_nesting(F.col("text"))),
        }
    )


def function_length_quantiles(functions: DataFrame) -> DataFrame:
    """Per language: number of functions, and median and 90th percentile of their length."""
    return functions.groupBy("language").agg(
        F.count("*").alias("functions"),
        F.percentile_approx("length", [0.5, 0.9], 10_000).alias("q"),
        F.max("length").alias("longest"),
    ).select(
        "language", "functions", F.col("q")[0].alias("median_length"), F.col("q")[1].alias("p90_length"),
        "longest",
    )
