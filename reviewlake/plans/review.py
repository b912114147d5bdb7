"""The whole review of changed files as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.languages import supported_only, with_language
from reviewlake.operators.aggregates import file_scores, review_scores
from reviewlake.operators.findings import dedupe_findings, union_findings
from reviewlake.operators.patches import patch_content
from reviewlake.operators.scan import scan_rules
from reviewlake.operators.selection import (
    TOO_LARGE,
    category_list,
    drop_ignored,
    drop_removed,
    flag_blank,
    flag_oversize,
)
from reviewlake.operators.structure_rules import structure_findings
from reviewlake.rules import catalog as C
from reviewlake.rules.model import Rule, pattern_rules, strict_case as with_strict_case

Pack = Callable[[DataFrame], DataFrame]
_PACKS: dict[str, Pack] = {}


def register_pack(name: str, pack: Pack) -> None:
    """Add a checker: files(file_id, language, content) → findings."""
    _PACKS[name] = pack


def unregister_pack(name: str) -> None:
    _PACKS.pop(name, None)


@dataclass(frozen=True)
class ReviewOptions:
    categories: Sequence[str] | None = None
    max_file_kb: int = C.MAX_FILE_KB
    rules: Sequence[Rule] | None = None
    extra_rules: Sequence[Rule] = field(default=())
    strict_case: bool = False
    solid: bool = False
    brace_extents: bool = False


@dataclass(frozen=True)
class ReviewResult:
    files: DataFrame
    findings: DataFrame
    reviews: DataFrame
    headers: DataFrame  # the files before they are scored


def with_text(files: DataFrame) -> DataFrame:
    """Text to analyse: of the patch where there is one, else the content, else empty."""
    columns = set(files.columns)
    content = F.col("content") if "content" in columns else F.lit(None).cast("string")
    if "patch" in columns:
        has_patch = F.coalesce(F.col("patch") != "", F.lit(False))
        content = F.when(has_patch, patch_content(F.col("patch"))).otherwise(content)
        if "content_bytes" in columns:  # the size that counts is that of the text to analyse
            files = files.withColumn("content_bytes", F.when(has_patch, F.octet_length(content)).otherwise(F.col("content_bytes")))
    if "content_bytes" not in columns:
        content = F.coalesce(content, F.lit(""))
    return files.withColumn("content", content)


def select_files(files: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """Files that take part: not removed, not ignored, of a supported language."""
    chosen = drop_removed(files)
    if ignore is not None:
        chosen = drop_ignored(chosen, ignore)
    return supported_only(with_language(chosen))


def files_with_text(files: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """The files that take part, with the text to analyse in place of the patch: what ``review_files`` reads from them stays the
    same. Written once, each reader of the review has its text without extracting it anew."""
    return with_text(select_files(files, ignore)).drop("patch")


def review_files(
    files: DataFrame, options: ReviewOptions | None = None, ignore: DataFrame | None = None
) -> ReviewResult:
    """files(file_id, review_id, filename, status, additions, deletions, patch?, content?) →
    findings, scored files, scored reviews.

    Scanning is one pass without a shuffle. What is shuffled is one pre-aggregated row per file,
    then one per review.
    """
    options = options or ReviewOptions()
    categories = category_list(options.categories)
    chosen = flag_blank(flag_oversize(with_text(select_files(files, ignore)), options.max_file_kb))
    text = chosen.where(~F.col("is_oversize") & ~F.col("is_blank")).select("file_id", "language", "content")

    rules = list(pattern_rules(options.solid) if options.rules is None else options.rules)
    rules += list(options.extra_rules)
    if options.strict_case:
        rules = with_strict_case(rules)
    rules = [r for r in rules if r.category in categories]

    parts = [scan_rules(text, rules)] if rules else []
    if options.rules is None:
        structure = structure_findings(
            text, solid=options.solid, brace_extents=options.brace_extents, categories=categories
        )
        parts += [structure] if structure is not None else []
    findings = union_findings(*(parts or [scan_rules(text, pattern_rules()).where("false")]))
    if _PACKS or options.extra_rules:
        # built-in packs report a (rule, line) once; added ones may not
        extra = [pack(text) for pack in _PACKS.values()]
        findings = dedupe_findings(union_findings(findings, *extra))

    headers = chosen.select(
        "file_id", "review_id", "filename", "language",
        F.coalesce("additions", F.lit(0)).alias("lines_added"),
        F.coalesce("deletions", F.lit(0)).alias("lines_removed"),
        F.when(F.col("is_oversize") & ~F.col("is_blank"), TOO_LARGE).alias("parse_error"),
    )
    scored = file_scores(headers, findings)
    return ReviewResult(scored, findings, review_scores(scored), headers)
