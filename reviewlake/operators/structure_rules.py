"""Findings that rest on the extents of functions, classes and loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import strip, to_snake_case
from reviewlake.operators.blocks import GENERIC_LANGUAGES, PYTHON_KINDS, code_blocks
from reviewlake.operators.lines import duplicate_blocks
from reviewlake.operators.metrics import BRACE_LANGUAGES, with_metrics
from reviewlake.operators.scan import ORDINAL_STEP, code_view
from reviewlake.rules import catalog as C

# emission order of structural rules, placed between the pattern rules by category
ORDER = {
    "PY-BUG-AST002": 45, "STY-LEN002": 115, "STY-CC001": 116, "STY-DUP001": 117,
    "PY-NAM001": 118, "PY-NAM002": 119, "ARCH-GOD001": 175, "ARCH-NEST001": 176,
    "PY-ARCH-AST001": 185, "PY-ARCH-AST002": 186, "PY-ARCH-AST003": 187,
    "ARCH-SRP001": 198, "ARCH-SRP002": 199,
}
COLUMNS = (
    "language", "category", "severity", "rule_id", "line_number", "end_line", "message",
    "code_snippet", "suggestion", "ordinal",
)


def _finding(rule_id, category, severity, line, end, message, snippet, suggestion, language):
    return F.struct(
        language.alias("language"),
        F.lit(category).alias("category"), F.lit(severity).alias("severity"),
        F.lit(rule_id).alias("rule_id"), line.cast("int").alias("line_number"),
        end.cast("int").alias("end_line"), message.alias("message"), snippet.alias("code_snippet"),
        suggestion.alias("suggestion"),
        (F.lit(ORDER[rule_id]).cast("long") * ORDINAL_STEP + line).alias("ordinal"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


SUM_SUBSCRIPT = r"[\w\])]\[[^\[\]():,\n+\-]*\+[^\[\]():,\n+\-=]*\]"
_GATES = {
    "chain": lambda text: text.rlike(r"(?md)^[ \t]*elif[ \t]+isinstance"),
    "for": lambda text: text.rlike(SUM_SUBSCRIPT),
}


def _snippet() -> Column:
    return strip(F.substring_index("text", "\n", 1))


def _make(rule_id, category, severity, message, suggestion, end=None):
    start = F.col("start_line")
    return _finding(
        rule_id, category, severity, start, start if end is None else end, message, _snippet(),
        F.lit(suggestion) if isinstance(suggestion, str) else suggestion, F.col("language"),
    )


def _function_checks(solid: bool) -> list[tuple[Column, Column]]:
    name, length, end = F.col("name"), F.col("length"), F.col("end_line")
    is_function = F.col("kind").isin("function", "generic")
    python_name = (
        (F.col("kind") == "function") & ~name.rlike("^[a-z_][a-z0-9_]*$") & ~name.startswith("_")
    )
    checks = [
        (is_function & (length > C.MAX_FUNCTION_LINES),
         _make("STY-LEN002", "style", "warning",
               _text("Function `", name, "` is ", length, f" lines long (max recommended {C.MAX_FUNCTION_LINES})"),
               "Extract logic into smaller, focused helper functions.", end)),
        (is_function & (F.col("complexity") >= C.HIGH_COMPLEXITY),
         _make("STY-CC001", "style", "warning",
               _text("High cyclomatic complexity (", F.col("complexity"), ") in `", name, "` — hard to test"),
               "Refactor into smaller functions with single responsibilities.", end)),
        (python_name,
         _make("PY-NAM001", "style", "suggestion", _text("Function `", name, "` should be snake_case"),
               _text("Rename to `", to_snake_case(name), "`."))),
        (is_function & (length > C.GOD_FUNCTION_LINES),
         _make("ARCH-GOD001", "architecture", "warning",
               _text("God function: `", name, "` is ", length, " lines — violates Single Responsibility"),
               "Break this function into smaller, focused helper functions.", end)),
        (is_function & (F.col("nesting") > C.DEEP_NESTING),
         _make("ARCH-NEST001", "architecture", "suggestion",
               _text("Deep nesting (", F.col("nesting"), " levels) in `", name, "` — hard to read and test"),
               "Use early returns, guard clauses, or extract nested logic into helper functions.", end)),
    ]
    if solid:
        rule_id, message, suggestion = C.SOLID[2]
        checks.append(
            ((F.col("kind") == "function") & (length > C.SOLID_FUNCTION_LINES),
             _make(rule_id, "architecture", "warning", F.lit(message), suggestion, end))
        )
    return checks


def _class_checks(solid: bool) -> list[tuple[Column, Column]]:
    text, name, end = F.col("text"), F.col("name"), F.col("end_line")
    is_class = F.col("kind") == "class"
    methods = F.regexp_count(text, F.lit(r"(?md)^[ \t]+(?:async[ \t]+)?def[ \t]+\w+[ \t]*\("))
    member_indent = F.regexp_extract(text, r"(?md)\n([ \t]+)[^ \t\n#]", 1)
    has_init = F.regexp_like(text, F.concat(F.lit("(?md)^"), member_indent, F.lit(r"def[ \t]+__init__\b")))
    checks = [
        (is_class & ~name.rlike("^[A-Z][a-zA-Z0-9]*$"),
         _make("PY-NAM002", "style", "suggestion", _text("Class `", name, "` should be PascalCase"),
               "Rename class to PascalCase.")),
        (is_class & (methods > C.GOD_CLASS_METHODS),
         _make("PY-ARCH-AST001", "architecture", "warning",
               _text("God class `", name, "` has ", methods, " methods — violates SRP"),
               "Split into multiple focused classes.", end)),
        (is_class & (end - F.col("start_line") > C.LARGE_CLASS_LINES) & ~has_init,
         _make("PY-ARCH-AST002", "architecture", "suggestion",
               _text("Large class `", name, "` has no `__init__` — consider using dataclass"),
               "Use @dataclass decorator for data-holding classes.", end)),
    ]
    if solid:
        rule_id, message, suggestion = C.SOLID[0]
        checks.append(
            (is_class & (F.length("text") > C.SOLID_CLASS_CHARS),
             _make(rule_id, "architecture", "warning", F.lit(message), suggestion, end))
        )
    return checks


def _chain_checks() -> list[tuple[Column, Column]]:
    """An if/elif branch with three or more isinstance tests from it to the end of its chain. The
    tests counted are those of the branch lines, at the indentation of the branch."""
    pattern = F.concat(
        F.lit("(?md)^"), F.col("indent"), F.lit(r"(?:el)?if[ \t]+isinstance[ \t]*\([^\n]*\)[ \t]*:")
    )
    tests = F.regexp_count("text", pattern)
    return [
        ((F.col("kind") == "chain") & (tests >= C.ISINSTANCE_CHAIN),
         _make("PY-ARCH-AST003", "architecture", "suggestion",
               _text("Chain of ", tests, " isinstance() checks — consider polymorphism"),
               "Use inheritance, ABCs, or @singledispatch instead of isinstance chains."))
    ]


def _loop_lines() -> Column:
    """Findings of an outermost loop: one per line with a subscript that holds a sum."""
    lines = F.arrays_zip(
        F.split(code_view(F.col("text")), "\n", -1).alias("seen"), F.split("text", "\n", -1).alias("source")
    )
    numbered = F.transform(
        lines,
        lambda l, i: F.struct(
            l["seen"].alias("seen"), l["source"].alias("source"), (F.col("start_line") + i).alias("no")
        ),
    )
    return F.transform(
        F.filter(numbered, lambda l: l["seen"].rlike(SUM_SUBSCRIPT)),
        lambda l: _finding(
            "PY-BUG-AST002", "bugs", "suggestion", l["no"], l["no"],
            F.lit("Potential off-by-one: index with +offset inside loop"), strip(l["source"]),
            F.lit("Verify loop bounds to prevent IndexError."), F.col("language"),
        ),
    )


def block_findings(
    files: DataFrame, keep: list[str] | None = None, kinds: tuple[str, ...] = PYTHON_KINDS,
    generic_languages: tuple[str, ...] = GENERIC_LANGUAGES, solid: bool = False,
) -> DataFrame:
    """All findings that rest on blocks, from one pass over the texts and without a shuffle."""
    keep = keep or ["file_id"]
    blocks = code_blocks(files, kinds, generic_languages, keep, _GATES)
    checks = []
    if "function" in kinds or generic_languages:
        blocks = with_metrics(blocks)
        checks += _function_checks(solid)
    if "class" in kinds:
        checks += _class_checks(solid)
    if "chain" in kinds:
        checks += _chain_checks()
    made = F.array(*[F.when(test, finding) for test, finding in checks]) if checks else None
    if "for" in kinds:
        loops = F.when(F.col("kind") == "for", _loop_lines())
        made = loops if made is None else F.coalesce(loops, made)
    return (
        blocks.select(*keep, F.explode(made).alias("f")).where(F.col("f").isNotNull()).select(*keep, "f.*")
    )


def function_findings(
    files: DataFrame, keep: list[str] | None = None, solid: bool = False, brace_extents: bool = False
) -> DataFrame:
    """Length, complexity, god function, nesting, and python function names."""
    languages = GENERIC_LANGUAGES + (BRACE_LANGUAGES if brace_extents else ())
    return block_findings(files, keep, ("function",), languages, solid)


def class_findings(files: DataFrame, keep: list[str] | None = None, solid: bool = False) -> DataFrame:
    """Python class names, classes with many methods, large classes without initialiser."""
    return block_findings(files, keep, ("class",), (), solid)


def loop_subscript_findings(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Subscripts with a sum inside the body of a python ``for`` loop, one finding per line."""
    return block_findings(files, keep, ("for",), ())


def isinstance_chain_findings(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """if/elif chains of isinstance tests."""
    return block_findings(files, keep, ("chain",), ())


def duplicate_findings(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Repeated six-line windows. Positions count non-blank lines, and the end is one too far:
    both as in the model these results are compared with."""
    line = F.col("position")
    made = _finding(
        "STY-DUP001", "style", "suggestion", line, F.col("end_position"),
        F.lit(f"Duplicate code block detected ({C.DUPLICATE_BLOCK_LINES}+ lines)"), F.col("code_snippet"),
        F.lit("Extract the repeated block into a shared function."), F.lit(None).cast("string"),
    )
    return duplicate_blocks(files, key).select(key, made.alias("f")).select(key, "f.*")


def structure_findings(
    files: DataFrame, key: str = "file_id", solid: bool = False, brace_extents: bool = False,
    categories: tuple[str, ...] = C.CATEGORIES,
) -> DataFrame:
    """All structural findings; kinds that only serve unwanted categories are not looked for."""
    wanted = set(categories)
    functions = bool({"style", "architecture"} & wanted)
    kinds = ("function", "class") if functions else ()
    kinds += ("chain",) if "architecture" in wanted else ()
    kinds += ("for",) if "bugs" in wanted else ()
    languages = GENERIC_LANGUAGES + (BRACE_LANGUAGES if brace_extents else ()) if functions else ()
    parts = [block_findings(files, [key], kinds, languages, solid)] if kinds else []
    if "style" in wanted:
        parts.append(duplicate_findings(files, key))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).where(F.col("category").isin(*categories))
