"""Rule scan: every match of every applicable rule, with its line, in one narrow pass.

A scan needs no shuffle. Per file, cheap substring tests on the case-folded text pick the
candidate rules; each (file, candidate) row then runs its pattern exactly once: the matches are
marked in the text, the marked text is split into lines, and the lines that hold a mark are the
findings. The pattern is a column, but neighbouring rows of one file differ, so it is compiled
once per candidate, which is small next to the pass over the text. In ASCII texts a search looks
for the characters that a match can begin with before it tries the pattern itself.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import text as X
from reviewlake.rules import catalog as C
from reviewlake.rules.model import (
    CAPTURE_END,
    CAPTURE_SEP,
    MARK,
    Rule,
    beginning,
    pattern_rules,
    required_literals,
    required_size,
)

MOST_DIGITS = 3  # longer runs of digits are not told apart
MOST_SPELLED = 256  # rules whose tests are expressions of the plan
SHORT = 20  # nearly any text has as many characters
RARE_FIRST = "zqjx@$%`~^\\&|?!#<>{}[]+*;:kvw'\"=()y-/,b_gm.pdfhculnorsaitte \t"  # characters of code, roughly by how few texts hold them
ORDINAL_STEP = 2**32  # a line number is an int, so ordinals of different rules never meet

_RULE_TYPE = (
    "array<struct<id string, category string, severity string, message string,"
    " suggestion string, guard string, view string, ascii string, unicode string,"
    " replacement string, precheck string, needs array<array<string>>>>"
)

_SEARCH_FIELDS = ("view", "ascii", "unicode", "replacement", "precheck", "needs")  # not copied beside the marked text

CODE_VIEW = r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|#[^\n]*"""


def code_view(content: Column) -> Column:
    """Python text with one-line string literals and comments emptied; lines stay in place."""
    return F.regexp_replace(content, CODE_VIEW, '""')


def without_marks(content: Column) -> Column:
    marks = MARK + CAPTURE_END + CAPTURE_SEP
    return F.when(
        X.holds_any(content, marks), F.translate(content, marks, "�" * len(marks))
    ).otherwise(content)


def _flags(rule: Rule, unicode: bool) -> str:
    """Only a line feed ends lines; Unicode classes are switched on for non-ASCII text only."""
    return f"(?{rule.flags}d{'U' if unicode else ''})"


def cheapest_first(needs: Sequence[Sequence[str]]) -> list[list[str]]:
    """The same sets with fewer tests: no alternative that holds another one, few alternatives first, single characters (often there) last."""
    least = [[x for x in one_of if not any(y != x and y in x for y in one_of)] for one_of in needs]
    return sorted(least, key=lambda one_of: (min(map(len, one_of)) < 2, len(one_of)))


def digit_run(content: Column, ascii_: Column) -> Column:
    """The longest run of digits, up to ``MOST_DIGITS``; texts with other characters may hold other digits, so they count as having it."""
    run = F.when(~ascii_, MOST_DIGITS)
    for n in range(MOST_DIGITS):  # most texts have few digits
        run = run.when(~content.rlike(f"[0-9]{{{n + 1}}}"), n)
    return run.otherwise(MOST_DIGITS)


def rules_literal(rules: Sequence[Rule]) -> Column:
    """The rules as one constant array, folded by the optimizer."""
    rows = [
        {
            "id": r.id, "category": r.category, "severity": r.severity, "message": r.message,
            "suggestion": r.suggestion, "guard": r.guard, "view": r.view,
            "ascii": _flags(r, False) + beginning(r.pattern, "i" in r.flags) + r.pattern, "unicode": _flags(r, True) + r.pattern,
            "replacement": r.replacement, "precheck": r.precheck or None,
            "needs": cheapest_first(required_literals(r.pattern)),
        }
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULE_TYPE)


_NONE = "cast(array() as array<int>)"


def _quoted(text: str) -> str:
    """A text as SQL that no setting of the parser changes; folded by the optimizer."""
    return f"cast(X'{text.encode().hex()}' as string)"


def _holds(literal: str) -> str:
    return f"contains(folded, {_quoted(literal)})"


def _try(number: int, rule: Rule) -> str:
    """The number of a rule if a text is worth trying, as SQL, the cheapest tests first."""
    width, digits = (0, 0) if rule.view == "code" else required_size(rule.pattern)  # the code view is another text than the one tested
    tests = [f"digits >= {min(digits, MOST_DIGITS)}"] if digits else []
    tests += [f"chars >= {min(width, 2**31 - 1)}"] if width > SHORT else []
    tests += ["(" + " or ".join(map(_holds, one_of)) + ")" for one_of in cheapest_first(required_literals(rule.pattern))]
    tests += [f"rlike(content, {_quoted(rule.precheck)})"] if rule.precheck else []
    return f"if({' and '.join(tests)}, {number}, null)" if tests else str(number)


def _gate(rule: Rule) -> str:
    """The rarest character that every match holds in any case, empty if none is known."""
    needs = required_literals(rule.pattern)
    held = set().union(*[set.intersection(*map(set, one_of)) for one_of in needs])
    return min(held, key=lambda c: (RARE_FIRST.find(c), c), default="") if held else ""


def _tried(rules: Sequence[tuple[int, Rule]]) -> str:
    """Numbers of the rules worth trying and nulls as SQL; rules that need the same rare character are passed over by one test."""
    by_gate: dict[str, list[tuple[int, Rule]]] = {}
    for n, rule in rules:
        by_gate.setdefault(_gate(rule), []).append((n, rule))
    groups = []
    for gate, group in by_gate.items():
        tries = f"array({', '.join(_try(n, rule) for n, rule in group)})"
        groups.append(f"if({_holds(gate)}, {tries}, {_NONE})" if gate and len(group) > 1 else tries)
    return f"flatten(array({', '.join(groups)}))" if groups else _NONE


def _spelled(rules: Sequence[tuple[int, Rule]]) -> Column:
    languages = sorted({x for _, r in rules for x in r.languages if x != "*"})
    own = "".join(
        f" when {_quoted(name)} then {_tried([(n, r) for n, r in rules if '*' not in r.languages and name in r.languages])}"
        for name in languages
    )
    common = _tried([(n, r) for n, r in rules if "*" in r.languages])
    return F.expr(f"concat({common}, case language{own} else {_NONE} end)" if own else common)


def with_candidates(prepared: DataFrame, rules: Sequence[Rule], table: Column) -> DataFrame:
    """A row for each file and rule worth trying on it, with the number of the rule (from 1).

    A rule is one if it applies to the language, the text is as long and holds as many digits in a row
    as a match, and the case-folded text holds a literal of each set its pattern needs. The first rules
    are spelled out, as a test costs several times more where it is looked up than in generated code; further ones
    are data in the plan and not expressions, so the plan stays small however many there are.
    """
    numbered = list(enumerate(rules, 1))
    spelled, further = numbered[:MOST_SPELLED], numbered[MOST_SPELLED:]
    columns = [c for c in prepared.columns if c != "code"]
    tried = prepared.select(
        *columns, _spelled(spelled).alias("tried"),
        # a lambda keeps this projection out of the one method of its stage, which would be too long to be compiled to machine code
        F.get(F.transform(F.array("code"), lambda code: code), 0).alias("code"),
    )
    numbers = F.filter("tried", lambda n: n.isNotNull())
    if further:
        numbers = F.concat(numbers, _looked_up(further, table))
    return tried.select("*", F.explode(numbers).alias("rule_no")).drop("folded", "chars", "digits", "tried")


def _looked_up(numbered: Sequence[tuple[int, Rule]], table: Column) -> Column:
    languages = sorted({x for _, r in numbered for x in r.languages if x != "*"})
    by_language = {name: [n for n, r in numbered if r.applies_to(name)] for name in languages}
    common = [n for n, r in numbered if "*" in r.languages]
    numbers = F.coalesce(
        F.try_element_at(F.from_json(F.lit(json.dumps(by_language)), "map<string,array<int>>"), F.col("language")),
        F.from_json(F.lit(json.dumps(common)), "array<int>"),
    )

    def worth_trying(n: Column) -> Column:
        rule = F.element_at(table, n)
        holds = F.forall(
            rule["needs"], lambda one_of: F.exists(one_of, lambda l: F.contains(F.col("folded"), l))
        )
        return holds & F.when(rule["precheck"].isNull(), True).otherwise(
            F.rlike(F.col("content"), rule["precheck"])
        )

    return F.filter(numbers, worth_trying)


def scan_rules(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    keep: Sequence[str] = ("file_id",),
) -> DataFrame:
    """Findings of pattern rules on ``files(language, content, *keep)``.

    One row per (file, rule, line): a rule that matches a line more than once reports its first
    match there, which is what keyed de-duplication would leave.
    """
    rules = list(pattern_rules() if rules is None else rules)
    keep = list(keep)
    table = rules_literal(rules)

    texts = files.where(F.col("content").isNotNull()).select(
        *keep, "language", without_marks(F.col("content")).alias("content")
    )
    needs_code = any(r.view == "code" for r in rules)
    prepared = texts.select(
        *keep, "language", "content",
        X.fold(F.col("content")).alias("folded"),
        X.is_ascii(F.col("content")).alias("ascii"),
        F.length("content").alias("chars"),
        digit_run(F.col("content"), X.is_ascii(F.col("content"))).alias("digits"),
        (
            F.when(F.col("language") == "python", code_view(F.col("content")))
            if needs_code else F.lit(None).cast("string")
        ).alias("code"),
    )
    candidates = with_candidates(prepared, rules, table)

    ruled = candidates.withColumn("rule", F.element_at(table, F.col("rule_no")))
    code_rule = F.col("rule.view") == "code"
    marked = ruled.select(
        *keep, "language", "rule_no", F.col("rule").dropFields(*_SEARCH_FIELDS).alias("rule"),
        F.regexp_replace(
            F.when(code_rule, F.coalesce("code", "content")).otherwise(F.col("content")),
            F.when(F.col("ascii"), F.col("rule.ascii")).otherwise(F.col("rule.unicode")),
            F.col("rule.replacement"),
        ).alias("marked"),
        F.when(code_rule, F.split("content", "\n", -1)).alias("source_lines"),
    )
    # lines with a mark are picked inside the row: a filter on exploded lines would walk over
    # every line of every candidate, and one on the text would be pushed down and run the
    # pattern twice
    picked = F.array_compact(
        F.transform(
            F.split("marked", "\n", -1),
            lambda line, i: F.when(
                F.contains(line, F.lit(MARK)),
                F.struct(
                    (i + 1).alias("line_number"), line.alias("marked_line"),
                    F.element_at("source_lines", i + 1).alias("source_line"),
                ),
            ),
        )
    )
    has_mark = F.contains("marked", F.lit(MARK))
    lines = marked.select(
        *keep, "language", "rule_no", "rule", F.inline(F.when(has_mark, picked))
    )

    first = F.substring_index(F.substring_index("marked_line", MARK, 2), MARK, -1)
    captured = F.split(F.substring_index(first, CAPTURE_END, 1), CAPTURE_SEP, -1)
    unmarked = F.regexp_replace("marked_line", f"{MARK}[^{CAPTURE_END}]*{CAPTURE_END}", "")
    located = lines.select(
        *keep, "language", "rule_no", "rule",
        "line_number",
        F.element_at(captured, 1).alias("first_capture"),
        F.coalesce(F.try_element_at(captured, F.lit(2)), F.lit("")).alias("second_capture"),
        F.coalesce("source_line", unmarked).alias("line"),
    )
    kept = located.withColumn("stripped", X.strip(F.col("line"))).where(_passes_guard())
    return kept.select(*keep, *_finding_columns())


def comment_line(stripped: Column, language: Column) -> Column:
    return F.when(language.isin("python", "ruby"), stripped.startswith("#")).otherwise(
        stripped.startswith("//") | stripped.startswith("*") | stripped.startswith("/*")
    )


def placeholder_line(line: Column) -> Column:
    return F.lower(line).rlike("|".join(C.PLACEHOLDER_WORDS))


def redact_literals(text: Column) -> Column:
    return F.regexp_replace(text, C.REDACTED_LITERAL, C.REDACTION)


def number_line(line: Column, stripped: Column) -> Column:
    """Lines on which numbers are not magic: constant definitions, comments and imports."""
    return (
        line.rlike(r"^\s*[A-Z_]+\s*=")
        | stripped.startswith("#") | stripped.startswith("//") | stripped.startswith("*")
        | line.rlike(r"^\s*(import|from|require|#include)")
    )


def _passes_guard() -> Column:
    guard, line, stripped = F.col("rule.guard"), F.col("line"), F.col("stripped")
    return (
        F.when(guard == "comment", ~comment_line(stripped, F.col("language")))
        .when(guard == "secret", ~placeholder_line(line))
        .when(guard == "number", ~number_line(line, stripped))
        .otherwise(F.lit(True))
    )


def _finding_columns() -> list[Column]:
    guard, first = F.col("rule.guard"), F.col("first_capture")
    shown = F.when(guard == "tag", F.upper(first)).when(
        F.col("rule.id") == "PY-BUG-AST001", F.lower(first)
    ).otherwise(first)
    width = F.length(F.rtrim(F.col("line"), F.lit("\r")))

    def filled(template: str) -> Column:
        out = F.replace(F.col(template), F.lit("{1}"), shown)
        out = F.replace(out, F.lit("{2}"), F.col("second_capture"))
        out = F.when(guard == "long", F.replace(out, F.lit("{n}"), width.cast("string"))).otherwise(out)
        return F.when(
            F.contains(out, F.lit("{camel}")), F.replace(out, F.lit("{camel}"), X.to_camel_case(first))
        ).otherwise(out)

    snippet = (
        F.when(guard == "secret", redact_literals(F.col("stripped")))
        .when(guard == "long", F.concat(X.cut(F.col("line"), 100), F.lit("...")))
        .otherwise(F.col("stripped"))
    )
    return [
        F.col("language"),
        F.col("rule.category").alias("category"),
        F.when((guard == "tag") & shown.isin(*C.WARNING_TAGS), "warning")
        .otherwise(F.col("rule.severity")).alias("severity"),
        F.when(guard == "tag", F.replace(F.col("rule.id"), F.lit("{1}"), shown))
        .otherwise(F.col("rule.id")).alias("rule_id"),
        F.col("line_number"),
        F.col("line_number").alias("end_line"),
        filled("rule.message").alias("message"),
        snippet.alias("code_snippet"),
        filled("rule.suggestion").alias("suggestion"),
        (F.col("rule_no").cast("long") * ORDINAL_STEP + F.col("line_number")).alias("ordinal"),
    ]
