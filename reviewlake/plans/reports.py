"""Reports and prompt texts for many reviews at once.

A report is built as a table of short pieces with an order, never as one collected group, so a
review with any number of findings is just more rows. ``assemble`` joins them, a very long report into several volumes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.scores import one_decimal, score_bar, score_label, severity_rank
from reviewlake.functions.text import capitalise
from reviewlake.operators.aggregates import severity_pivot

ORDER = ["section", "k1", "k2", "k3", "k4"]
MAX_REPORT_CHARS = 4_000_000
REPORT_CATEGORIES = ("bugs", "security", "performance", "architecture", "style")
CRITICALS_PER_FILE = 3
CRITICALS_PER_COMMENT = 10
PROMPT_FINDINGS = 10
PROMPT_FILES = 20
PATCH_CHARS = 6000
FOOTER = "*Generated by reviewlake*"


def _say(*parts) -> Column:
    """Text of strings and columns; a null column reads as nothing."""
    return F.concat(
        *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    )


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("string")


def _piece(section: int, text: Column, k1=0, k2=0, k3=0, k4=0, when: Column | None = None) -> Column:
    keys = [
        (k if isinstance(k, Column) else F.lit(k)).cast("bigint").alias(n)
        for n, k in zip(ORDER[1:], (k1, k2, k3, k4))
    ]
    piece = F.struct(F.lit(section).alias("section"), *keys, text.alias("text"))
    return piece if when is None else F.when(when, piece)


def _pieces(df: DataFrame, *pieces: Column) -> DataFrame:
    """All pieces of a row from one pass over the table."""
    made = df.select("review_id", F.explode(F.array(*pieces)).alias("p")).where(F.col("p").isNotNull())
    return made.select("review_id", "p.*")


def _review_score() -> Column:
    return F.coalesce(F.col("score"), F.lit(0.0))


def _file_score(zero_is_full: bool) -> Column:
    """A file score of 0 reads as 100 in reports (``zero_is_full``), as an absent one does."""
    score = F.coalesce(F.col("score"), F.lit(100.0))
    return F.when(score == 0, 100.0).otherwise(score) if zero_is_full else score


def _located(findings: DataFrame, files: DataFrame) -> DataFrame:
    named = files.select("file_id", "review_id", "filename")
    kept = [c for c in findings.columns if c not in ("review_id", "filename")]
    return findings.select(*kept).join(named, "file_id")


def _or_none(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def report_parts(
    reviews: DataFrame, files: DataFrame, findings: DataFrame, zero_is_full: bool = True
) -> DataFrame:
    """Pieces of the full markdown report: (review_id, section, k1..k4, text).

    ``reviews`` may hold an ``ai_summary``.
    """
    score, label = _review_score(), score_label(_review_score())
    summary = (
        F.when(
            F.coalesce(F.col("ai_summary"), F.lit("")) != "",
            _say("## AI Analysis\n\n", F.col("ai_summary"), "\n\n"),
        ).otherwise("")
        if "ai_summary" in reviews.columns else F.lit("")
    )
    head = _piece(
        0,
        _say(
            "# Code Review Report\n\n**PR:** [", F.col("pr_title"), "](", F.col("pr_url"), ")\n**Date:** ",
            F.date_format("created_at", "yyyy-MM-dd HH:mm"), " UTC\n**Score:** ", one_decimal(score),
            "/100 — ", label, "\n\n## Summary\n\n| Metric | Value |\n|--------|-------|\n| Files Changed | ",
            _count("files_changed"), " |\n| Lines Added | +", _count("lines_added"), " |\n| Lines Removed | -",
            _count("lines_removed"), " |\n| Critical Issues | ", _count("critical_count"), " |\n| Warnings | ",
            _count("warning_count"), " |\n| Suggestions | ", _count("suggestion_count"),
            " |\n| Total Findings | ", _count("total_findings"), " |\n\n", summary, "## Score\n\n```\n[",
            score_bar(score), "] ", one_decimal(score), "/100 (", label, ")\n```\n",
        ),
    )
    with_files = files.select("review_id").distinct()
    files_head = _piece(1, F.lit("## File Analysis\n"))

    per_file = findings.groupBy("file_id").agg(F.count("*").alias("_listed"))
    counted = files.join(per_file, "file_id", "left").withColumn("_listed", F.coalesce("_listed", F.lit(0)))
    shown = F.coalesce(F.col("findings_count"), F.col("_listed")) if "findings_count" in files.columns else F.col("_listed")
    file_score = _file_score(zero_is_full)
    file_head = _piece(
        2,
        _say(
            "### `", F.col("filename"), "`\n\n**Language:** ", capitalise(F.col("language")), " | **Score:** ",
            one_decimal(file_score), "/100 (", score_label(file_score), ") | **Findings:** ", shown, "\n\n",
            F.when(
                F.col("_listed") > 0,
                "| Severity | Line | Category | Issue |\n|----------|------|----------|-------|",
            ).otherwise("No issues found in this file.\n"),
        ),
        k1=F.col("file_id"), k2=0,
    )
    table_end = _piece(2, F.lit(""), k1=F.col("file_id"), k2=2, when=F.col("_listed") > 0)

    located = _located(findings, files)
    line = F.col("line_number")
    row = _piece(
        2,
        _say(
            "| ", F.upper("severity"), " | ",
            F.when(line.isNull() | (line == 0), "-").otherwise(line.cast("string")), " | ",
            capitalise(F.col("category")), " | ", F.substring("message", 1, 80), " |",
        ),
        k1=F.col("file_id"), k2=1, k3=F.col("ordinal"),
    )
    # the bound on the rank prunes rows before the shuffle
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("ordinal"))
    criticals = located.where(F.col("severity") == "critical").withColumn("_nth", nth).where(
        F.col("_nth") <= CRITICALS_PER_FILE
    )
    snippet = _piece(
        2,
        _say(
            "**Critical at line ", _or_none("line_number"), ":**\n```\n", F.col("code_snippet"), "\n```\n",
            F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("> "), "suggestion", F.lit("\n"))).otherwise(""),
        ),
        k1=F.col("file_id"), k2=3, k3=F.col("_nth"),
    )

    rank = F.array_position(F.array(*[F.lit(c) for c in REPORT_CATEGORIES]), F.col("category"))
    categories_head = _piece(3, F.lit("## Findings by Category\n"))
    per_category = located.groupBy("review_id", "category").agg(F.count("*").alias("_n"))
    category_head = _piece(
        4, _say("### ", capitalise(F.col("category")), " (", F.col("_n"), ")\n"), k1=rank, k2=-1, when=rank > 0
    )
    category_end = _piece(4, F.lit(""), k1=rank, k2=9, when=rank > 0)
    bullet = _piece(
        4,
        _say(
            "- `", F.col("severity"), "` **", F.col("filename"), ":", _or_none("line_number"), "** — ",
            F.col("message"),
            F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("\n  - Fix: "), "suggestion")).otherwise(""),
        ),
        k1=rank, k2=severity_rank(F.col("severity")), k3=F.col("file_id"), k4=F.col("ordinal"), when=rank > 0,
    )
    foot = _piece(9, F.lit(f"---\n{FOOTER}"))
    return reduce(
        DataFrame.unionByName,
        [
            _pieces(reviews, head, foot),
            _pieces(with_files, files_head),
            _pieces(counted, file_head, table_end),
            _pieces(located, row, bullet),
            _pieces(criticals.where(F.coalesce("code_snippet", F.lit("")) != ""), snippet),
            _pieces(per_category.select("review_id").distinct(), categories_head),
            _pieces(per_category, category_head, category_end),
        ],
    )


def comment_parts(
    reviews: DataFrame, files: DataFrame, findings: DataFrame, zero_is_full: bool = True
) -> DataFrame:
    """Pieces of the short comment: totals, at most ten criticals, file score table."""
    score = _review_score()
    summary = (
        F.when(F.coalesce(F.col("ai_summary"), F.lit("")) != "", _say("> ", F.col("ai_summary"), "\n\n")).otherwise("")
        if "ai_summary" in reviews.columns else F.lit("")
    )
    head = _piece(
        0,
        _say(
            "## Code Review — ", one_decimal(score), "/100 (", score_label(score), ")\n\n"
            "| Files | +Added | -Removed | Critical | Warning | Suggestion |\n"
            "|-------|--------|----------|-------------|------------|---------------|\n| ",
            _count("files_changed"), " | +", _count("lines_added"), " | -", _count("lines_removed"), " | ",
            _count("critical_count"), " | ", _count("warning_count"), " | ", _count("suggestion_count"),
            " |\n", F.when(summary != "", F.concat(F.lit("\n"), F.regexp_replace(summary, "\n\\z", ""))).otherwise(""),
        ),
    )
    critical = _located(findings, files).where(F.col("severity") == "critical")
    counts = critical.groupBy("review_id").agg(F.count("*").alias("_n"))
    opening = _piece(1, _say("<details>\n<summary>Critical Issues (", F.col("_n"), ")</summary>\n"), k1=0)
    closing = _piece(1, F.lit("</details>\n"), k1=2)
    nth = F.row_number().over(Window.partitionBy("review_id").orderBy("file_id", "ordinal"))
    top = critical.withColumn("_nth", nth).where(F.col("_nth") <= CRITICALS_PER_COMMENT)
    issue = _piece(
        1,
        _say(
            "**`", F.col("filename"), "`:", _or_none("line_number"), "** — ", F.col("message"), "\n",
            F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("> "), "suggestion", F.lit("\n"))).otherwise(""),
            F.when(F.coalesce("code_snippet", F.lit("")) != "", F.concat(F.lit("```\n"), "code_snippet", F.lit("\n```\n"))).otherwise(""),
        ),
        k1=1, k2=F.col("_nth"),
    )
    with_files = files.select("review_id").distinct()
    table_head = _piece(
        2,
        F.lit("<details>\n<summary>File Scores</summary>\n\n| File | Language | Score | Critical | Warnings |\n"
              "|------|----------|-------|----------|----------|"),
    )
    table_end = _piece(4, F.lit("\n</details>\n"))
    file_score = _file_score(zero_is_full)
    counted = files.join(severity_pivot(findings), "file_id", "left")
    row = _piece(
        3,
        _say("| `", F.col("filename"), "` | ", F.col("language"), " | ", one_decimal(file_score), " (",
             score_label(file_score), ") | ", _count("critical"), " | ", _count("warning"), " |"),
        k1=F.col("file_id"),
    )
    foot = _piece(9, F.lit(f"---\n{FOOTER}"))
    return reduce(
        DataFrame.unionByName,
        [
            _pieces(reviews, head, foot), _pieces(counts, opening, closing), _pieces(top, issue),
            _pieces(with_files, table_head, table_end), _pieces(counted, row),
        ],
    )


def assemble(parts: DataFrame, max_chars: int = MAX_REPORT_CHARS) -> DataFrame:
    """(review_id, volume, text): every report in full.

    A report is cut between pieces into volumes of about ``max_chars``, numbered from 0, so that a row stays bounded
    whatever the report; nearly all have one. Places come from a running sum over the pieces in order, and the volumes
    from the same partitioning.
    """
    ordered = Window.partitionBy("review_id").orderBy(*ORDER, "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(ordered), F.lit(0))
    placed = parts.withColumn("volume", F.floor(before / max_chars).cast("int"))
    pieces = F.sort_array(F.collect_list(F.struct(*ORDER, "text")))
    return placed.groupBy("review_id", "volume").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text")
    )


def default_summaries(reviews: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """One sentence-style summary per review."""
    per_review = (
        files.join(severity_pivot(findings), "file_id", "left").groupBy("review_id").agg(
            F.sum(F.coalesce("critical", F.lit(0))).alias("critical"),
            F.sum(F.coalesce("warning", F.lit(0))).alias("warning"),
            F.count("*").alias("files"),
        )
    )
    joined = reviews.select("review_id", "pr_title", "score").join(per_review, "review_id", "left")
    critical, score = F.coalesce("critical", F.lit(0)), _review_score()
    text = _say(
        "Code review completed for '", F.col("pr_title"), "'. Overall score: ", one_decimal(score), "/100 (",
        score_label(score), "). Found ", critical, " critical issue(s) and ", _count("warning"),
        " warning(s) across ", _count("files"), " file(s). ",
        F.when(critical > 0, "Address critical issues before merging.").otherwise("No critical issues found."),
    )
    return joined.select("review_id", text.alias("summary"))


def review_prompts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Prompt text per file with a patch: patch cut to a bound, at most ten findings."""
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("ordinal"))
    first = findings.select("file_id", "ordinal", "severity", "line_number", "message").withColumn(
        "_nth", nth
    ).where(F.col("_nth") <= PROMPT_FINDINGS)
    item = _say("- [", F.upper("severity"), "] Line ", _or_none("line_number"), ": ", F.col("message"))
    listed = first.groupBy("file_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_nth", item.alias("item")))), lambda x: x["item"]), "\n"
        ).alias("_items")
    )
    joined = files.where(F.coalesce("patch", F.lit("")) != "").join(listed, "file_id", "left")
    cut = _say(
        F.substring("patch", 1, PATCH_CHARS),
        F.when(F.length("patch") > PATCH_CHARS, "\n... (truncated)").otherwise(""),
    )
    found = F.when(
        F.col("_items").isNotNull(), F.concat(F.lit("\n\nStatic analysis already found:\n"), "_items")
    ).otherwise("")
    text = _say(
        "Review this ", F.col("language"), " file: `", F.col("filename"), "`\n\n```diff\n", cut, "\n```", found,
        "\n\nProvide additional semantic insights not already covered by static analysis.",
    )
    return joined.select("file_id", text.alias("prompt"))


def summary_prompts(reviews: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """Prompt text per review over its first twenty files."""
    nth = F.row_number().over(Window.partitionBy("review_id").orderBy("file_id"))
    first = files.select("review_id", "file_id", "filename", "score").withColumn("_nth", nth).where(
        F.col("_nth") <= PROMPT_FILES
    )
    counted = first.join(severity_pivot(findings), "file_id", "left")
    item = _say(
        "- ", F.col("filename"), ": score=", F.bround(F.coalesce("score", F.lit(0.0)), 0).cast("bigint"),
        ", critical=", _count("critical"), ", warning=", _count("warning"),
    )
    listed = counted.groupBy("review_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_nth", item.alias("item")))), lambda x: x["item"]), "\n"
        ).alias("_items")
    )
    text = _say(
        "PR: ", F.col("pr_title"), "\nOverall score: ", one_decimal(_review_score()), "/100\n\nFiles analyzed:\n",
        F.coalesce("_items", F.lit("")),
        "\n\nWrite a 3-4 sentence executive summary of this code review. "
        "Be specific about the main concerns and overall code quality.",
    )
    return reviews.select("review_id", "pr_title", "score").join(listed, "review_id", "left").select(
        "review_id", text.alias("prompt")
    )
