"""Rules as rows, and the text patterns of the rules that are evaluated on blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

from reviewlake.rules import catalog as C

# A marker opens every match in a marked text, a second one closes its captures. Both are
# control characters; texts that hold them have them replaced before matching.
MARK = "\x01"
CAPTURE_END = "\x02"
CAPTURE_SEP = "\x03"


@dataclass(frozen=True)
class Rule:
    """One pattern rule.

    ``flags`` are the letters m, i and s. ``captures`` numbers the groups whose text goes into
    ``{1}``, ``{2}`` of message, suggestion and rule id. ``lead`` numbers a group to be kept
    in front of the marker, for rules that report a place inside the match. ``view`` is
    ``content`` or ``code`` (string literals and comments of one line emptied).
    """

    id: str
    category: str
    severity: str
    pattern: str
    message: str
    suggestion: str = ""
    languages: tuple[str, ...] = ("*",)
    flags: str = "mi"
    guard: str = ""
    captures: tuple[int, ...] = ()
    lead: int = 0
    rest: int = 0
    view: str = "content"
    step: int = 0
    precheck: str = ""  # a pattern every matching text holds, tried before the costly one

    def applies_to(self, language: str) -> bool:
        return "*" in self.languages or language in self.languages

    @property
    def replacement(self) -> str:
        captured = CAPTURE_SEP.join(f"${n}" for n in self.captures)
        if self.lead:
            return f"${self.lead}{MARK}{captured}{CAPTURE_END}${self.rest}"
        return f"{MARK}{captured}{CAPTURE_END}$0"


# ---- blocks by indentation -------------------------------------------------------------
# Group 1 is the indentation of the header line. A block holds the lines indented deeper, blank
# and comment lines, and lines that begin with a closing bracket. All repeats are possessive,
# so matching is linear in the text and uses no stack.
_SKIP = r"[ \t]*(?:#[^\n]*)?(?=\n|\z)"
_CLOSER = r"[ \t]*[)\]}][^\n]*"
_HEADER_END = r":[ \t]*(?:#[^\n]*)?(?=\n)"


def block_with(header: str, call: str, at_line_start: bool = False) -> str:
    """Header line, then the first line of its block that matches ``call``."""
    lead = r"\1[ \t]+" if at_line_start else r"\1[ \t]+[^\n]*?"
    target = lead + call
    return (
        rf"^([ \t]*){header}{_HEADER_END}"
        rf"(?:\n(?:{_SKIP}|{_CLOSER}|(?!{target})\1[ \t]+[^\n]*))*+\n{target}"
    )


_FOR_ANY = r"(?:async[ \t]+)?for\s[^\n]+"
_FOR_NAMES = r"(?:async[ \t]+)?for\s+\w+\s+in\s+\w+[^:\n]*"
_WHILE_TRUE = r"while\s+True[^:\n]*"

LOOP_QUERY = block_with(_FOR_ANY, r"(?:\.filter\(|\.find\(|\.query\(|SELECT)")
LOOP_GLOBAL = block_with(_FOR_ANY, r"global\s", at_line_start=True)
LOOP_CALL = block_with(_FOR_NAMES, C.N_PLUS_ONE_PYTHON_CALLS)
WHILE_GROWS = block_with(_WHILE_TRUE, r"\w+\.(?:append|add|update|push)\s*\(", at_line_start=True)

_GROWS = r"for\s+\w+[^\n]*:\s*\n\s+\1\.(?:append|extend)\s*\("
GROWING_LOOP = r"(?md)^for\s+\w+[^\n]*:\s*\n\s+\w+\.(?:append|extend)\s*\("
LIST_GROWS = rf"(\w+)\s*=\s*\[\]\s*\n(?:(?!{_GROWS})[^\n]*\n)*+{_GROWS}"

_WRITE = r"\s*\w+\s*[+-]?="
CALL_THEN_WRITE = (
    r"\.call\{[^}]*\}\s*\([^)]*\)[^;]*;\s*\n" rf"(?:(?!{_WRITE})[^;]+;\s*\n)*+{_WRITE}"
)

_LOOSE_AWAIT = r"await\s+[^;]+;(?![^{}]*catch)"
AWAIT_UNGUARDED = (
    r"async\s+function\s+\w+[^{]*\{"
    rf"(?:(?!{_LOOSE_AWAIT})(?:[^{{}}]|\{{[^{{}}]*\}}))*+{_LOOSE_AWAIT}"
)

# calls chained to a fetch up to the one that a catch follows; the repeat gives nothing back, so it needs no stack
FETCH_UNGUARDED = r"fetch\s*\([^)]+\)(?:\s*\.then\s*\([^)]+\)(?!\s*\.catch))*+(?!\s*\.catch)"

EXCEPT_PASS = (
    r"^([ \t]*)except\b[^\n]*?:(?:"
    r"[ \t]*(?:#[^\n]*)?"
    rf"(?:\n{_SKIP})*+\n\1[ \t]+pass[ \t]*(?:#[^\n]*)?(?=\n|\z)"
    rf"(?!(?:\n{_SKIP})*+\n\1[ \t]+[^ \t\n#])"
    r"|[ \t]*pass[ \t]*(?:#[^\n]*)?(?=\n|\z))"
)


def infinite_loop(head: str) -> str:
    """Loop head with no exit word in the characters that follow it.

    A word counts when it lies inside the window; at the very end of the window no word
    boundary is asked for.
    """
    checks = []
    for word in C.INFINITE_LOOP_EXITS:
        room = C.INFINITE_LOOP_WINDOW - len(word)
        checks.append(rf"(?!(?-i:(?s:.{{0,{room - 1}}})\b{word}\b))(?!(?-i:(?s:.{{{room}}})\b{word}))")
    return f"(?={head})" + "".join(checks) + f"(?:{head})"


def magic_number() -> str:
    accepted = "|".join(str(n) for n in C.ACCEPTABLE_NUMBERS if n >= 0)
    return (
        r"(?<!['\"\w.])\b(?=\d{%d,}\b)(?!0*(?:%s)\b)0*(\d+)\b(?!['\"])"
        % (C.MAGIC_NUMBER_MIN_DIGITS, accepted)
    )


_JAVA_SPELLING = {
    # a bracket inside a character class must be escaped
    "JS-SEC005": r"\[['\"__proto__\['\"]|\.constructor\s*\[",
}
_BLOCK_SPELLING = {
    "PERF001": LOOP_QUERY,
    "PY-PERF004": LOOP_GLOBAL,
    "SOL-BUG001": CALL_THEN_WRITE,
}
BLOCK_RULES = frozenset(
    {"PERF001", "PY-PERF004", "SOL-BUG001", "PERF-N1001", "PERF-UNB001", "PERF-UNB002", "ARCH-ERR001"}
)


def catalogue_rules() -> list[Rule]:
    rules = []
    for language, entries in C.CATALOGUE.items():
        for rule_id, category, severity, pattern, message, suggestion in entries:
            pattern = _BLOCK_SPELLING.get(rule_id, _JAVA_SPELLING.get(rule_id, pattern))
            rules.append(
                Rule(
                    rule_id, category, severity, pattern, message, suggestion, (language,),
                    guard="comment" if category == "security" else "", step=0,
                )
            )
    return rules


def bug_rules() -> list[Rule]:
    nullable_call = (
        r"\.(\w*(?:get|find|first|fetch|load)\w*)\([^()\n]*+(?:\([^()\n]*+\)[^()\n]*+)*+\)\.(\w+)"
        r"[ \t]*(?:[^=\s\w]|==|$)"
    )
    mutable_default = (
        # stretches between brackets without such a default, then the last one of the first stretch that has one
        r"(\bdef[ \t]+(\w+)[ \t]*\((?:(?:(?!=[ \t]*[\[{])[^()])*+\([^()]*+\))*+[^()]*=[ \t]*)([\[{])"
    )
    rules = [
        Rule("PY-BUG-AST001", "bugs", "warning", nullable_call,
             "Method `{1}()` may return None — accessing `.{2}` without None check",
             "Add a None check before accessing attributes.", ("python",), captures=(1, 2),
             guard="comment", view="code", step=1),
        Rule("PY-BUG-AST003", "bugs", "critical", EXCEPT_PASS,
             "Exception silently swallowed with `pass` — bugs will be hidden",
             "Log the exception or re-raise it.", ("python",), flags="m", step=1),
        Rule("PY-BUG-AST004", "bugs", "critical", mutable_default,
             "Mutable default argument in `{1}()` — shared across all calls",
             "Use `None` as default and initialize in the function body.", ("python",),
             flags="m", captures=(2,), lead=1, rest=3, view="code", step=1),
    ]
    for language, head in C.INFINITE_LOOP_HEADS.items():
        rules.append(
            Rule("BUG-INF001", "bugs", "warning", infinite_loop(head), C.INFINITE_LOOP_MESSAGE,
                 C.INFINITE_LOOP_SUGGESTION, (language,), flags="i", step=2)
        )
    rules.append(
        Rule("BUG-OBO001", "bugs", "critical", C.OFF_BY_ONE, C.OFF_BY_ONE_MESSAGE,
             C.OFF_BY_ONE_SUGGESTION, flags="m", step=3)
    )
    return rules


def security_rules() -> list[Rule]:
    def pack(entries, message, suggestion, step, languages=("*",), guard=""):
        return [
            Rule(entry[0], "security", "critical", entry[1],
                 entry[2] if message is None else message, suggestion, languages,
                 flags="m", guard=guard, step=step)
            for entry in entries
        ]

    return [
        *pack(C.SECRETS, None, C.SECRETS_SUGGESTION, 1, guard="secret"),
        *pack(C.SQL_INJECTION, C.SQL_INJECTION_MESSAGE, C.SQL_INJECTION_SUGGESTION, 2),
        *pack(C.XSS, C.XSS_MESSAGE, C.XSS_SUGGESTION, 3, ("javascript", "typescript")),
        *pack(C.COMMAND_INJECTION, C.COMMAND_INJECTION_MESSAGE,
              C.COMMAND_INJECTION_SUGGESTION, 4, guard="comment"),
        Rule("PY-SEC-AST001", "security", "critical",
             r"(?=[ec])(?<!\bdef )\b(eval|exec|compile)[ \t]*\(", "`{1}()` executes arbitrary code",
             "Remove `{1}()`. Use safe alternatives.", ("python",), flags="m", captures=(1,),
             guard="comment", view="code", step=5),
        Rule("PY-SEC-AST002", "security", "critical",
             r"\b(?:execute|raw|query)[ \t]*\(\s*(?:[fF][rR]?|[rR][fF])[\"']",
             "SQL injection: f-string used in database query", "Use parameterized queries.",
             ("python",), flags="m", guard="comment", step=5),
    ]


def style_rules() -> list[Rule]:
    limit = C.MAX_LINE_LENGTH
    return [
        Rule("STY-LEN001", "style", "suggestion", rf"^[^\r\n]{{{limit + 1},}}",
             f"Line too long: {{n}} characters (max {limit})",
             f"Break line to keep under {limit} characters.", flags="m", guard="long", step=1),
        Rule("JS-NAM001", "style", "suggestion", C.JS_SNAKE_NAME,
             "Function `{1}` uses snake_case — JavaScript convention is camelCase",
             "Rename to `{camel}`.", ("javascript", "typescript"), flags="", captures=(1,),
             step=6),
    ]


def performance_rules() -> list[Rule]:
    n1 = dict(message=C.N_PLUS_ONE_MESSAGE, suggestion=C.N_PLUS_ONE_SUGGESTION, step=1)
    rules = [
        Rule("PERF-N1001", "performance", "warning", LOOP_CALL, languages=("python",), flags="m", **n1)
    ]
    for language, pattern in C.N_PLUS_ONE.items():
        rules.append(
            Rule("PERF-N1001", "performance", "warning", pattern, languages=(language,), flags="ms", **n1)
        )
    for step, flags, pack in ((2, "m", C.MEMORY_LEAKS), (3, "ms", C.REDUNDANT_LOOPS)):
        rules += [
            Rule(rule_id, "performance", "warning", pattern, message, suggestion, flags=flags, step=step)
            for rule_id, pattern, message, suggestion in pack
        ]
    spelled = {"PERF-UNB001": WHILE_GROWS, "PERF-UNB002": LIST_GROWS}
    rules += [
        Rule(rule_id, "performance", "warning", spelled[rule_id], message, suggestion, flags="m", step=4,
             precheck=GROWING_LOOP if rule_id == "PERF-UNB002" else "")
        for rule_id, message, suggestion in C.UNBOUNDED_COLLECTIONS
    ]
    rules.append(
        Rule("PY-PERF-AST003", "performance", "suggestion",
             r"(?=[aslmt])(?<![.\w])(sum|any|all|min|max|sorted|list|set|tuple)[ \t]*\("
             r"(?:[^()\[\]\n]*,)?[ \t]*\[[^\[\]\n]*\bfor\b",
             "List comprehension inside `{1}()` — use generator expression",
             "Remove `[]` to use a generator expression.", ("python",), flags="m",
             captures=(1,), view="code", step=5)
    )
    return rules


def architecture_rules() -> list[Rule]:
    rules = [
        Rule("ARCH-MAG001", "architecture", "suggestion", magic_number(),
             "Magic number `{1}` — define as a named constant",
             "Define `CONSTANT_NAME = {1}` at the module/class level.", flags="m",
             captures=(1,), guard="number", step=3),
    ]
    spelled = {"ARCH-ERR001": AWAIT_UNGUARDED, "ARCH-ERR002": FETCH_UNGUARDED}
    for rule_id, languages, pattern, message in C.MISSING_ERROR_HANDLING:
        rules.append(
            Rule(rule_id, "architecture", "warning", spelled.get(rule_id, pattern), message,
                 C.MISSING_ERROR_SUGGESTION, languages, flags="ms", step=4)
        )
    tags = "|".join(C.COMMENT_TAGS)
    hash_languages = ("python", "ruby")
    slash_languages = tuple(x for x in C.SUPPORTED_LANGUAGES if x not in hash_languages)
    for opener, languages in (("#", hash_languages), ("//", slash_languages)):
        rules.append(
            Rule("ARCH-{1}001", "architecture", "suggestion", rf"{opener}\s*({tags})\b[^\n]*",
                 "{1} comment: incomplete or workaround code", C.TAG_SUGGESTION, languages,
                 flags="i", captures=(1,), guard="tag", step=6)
        )
    return rules


def solid_rules() -> list[Rule]:
    """The switched-off pack: the parts that are patterns (the rest is evaluated on blocks)."""
    rule_id, message, suggestion = C.SOLID[1]
    return [
        Rule(rule_id, "architecture", "warning", C.SOLID_ISINSTANCE, message, suggestion,
             flags="m", step=7)
    ]


def pattern_rules(solid: bool = False) -> list[Rule]:
    """All pattern rules in emission order: category, then step, then position."""
    everything = [
        *catalogue_rules(), *bug_rules(), *security_rules(), *style_rules(),
        *performance_rules(), *architecture_rules(), *(solid_rules() if solid else []),
    ]
    return sorted(everything, key=lambda r: (C.CATEGORIES.index(r.category), r.step))


_STRICT_CASE = ("PY-STY001", "PY-STY002", "PY-STY003", "GO-STY001", "RS-STY001", "RB-STY001",
                "TS-STY002", "TS-STY003", "JV-STY001", "JV-STY002", "JS-STY001")


def strict_case(rules: list[Rule]) -> list[Rule]:
    """Naming rules matched with case, as their messages intend; the default ignores case."""
    return [replace(r, flags=r.flags.replace("i", "")) if r.id in _STRICT_CASE else r for r in rules]


# ---- literals a text must hold for a pattern to match ----------------------------------
try:
    from re import _parser as _regex_parser
except ImportError:  # older Python
    import sre_parse as _regex_parser


def _needed(tree) -> list[list[str]]:
    """Sets of alternatives; a match holds at least one literal of every set."""
    sets: list[list[str]] = []
    run = ""

    def flush():
        nonlocal run
        if run:
            sets.append([run])
        run = ""

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        flush()
        if name == "SUBPATTERN":
            sets += _needed(arg[3])
        elif name == "ATOMIC_GROUP":
            sets += _needed(arg)
        elif name == "BRANCH":
            parts = [_best(_needed(b), 1) for b in arg[1]]
            if all(parts):
                sets.append([x for part in parts for x in part[0]])
        elif name == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg):
                sets.append([chr(a) for _, a in arg])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            sets += _needed(arg[2])
    flush()
    return sets


def _best(sets: list[list[str]], n: int) -> list[list[str]]:
    """The most telling sets: longest shortest literal, then fewest alternatives."""
    return sorted(sets, key=lambda s: (-min(map(len, s)), len(s)))[:n]


@lru_cache(maxsize=None)
def required_literals(pattern: str, sets: int = 3) -> tuple[tuple[str, ...], ...]:
    """Lower-case literals every matching text contains: one of each set (empty: unknown)."""
    try:
        found = _needed(_regex_parser.parse(pattern.replace(r"\z", r"\Z"), re.MULTILINE))
    except re.error:
        return ()
    lowered = [tuple(dict.fromkeys(x.lower() for x in s)) for s in found]
    return tuple(dict.fromkeys(tuple(s) for s in _best([list(s) for s in lowered], sets)))


def _digit_run(tree) -> int:
    """Digits in a row that a text must hold for ``tree`` to match."""
    most = 0
    for op, arg in tree:
        name = str(op)
        run = 0
        if name == "IN":
            run = int(all((str(kind), str(value)) == ("CATEGORY", "CATEGORY_DIGIT") for kind, value in arg))
        elif name == "SUBPATTERN":
            run = _digit_run(arg[3])
        elif name == "ATOMIC_GROUP":
            run = _digit_run(arg)
        elif name == "ASSERT":
            run = _digit_run(arg[1])
        elif name == "BRANCH":
            run = min(map(_digit_run, arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            run = _digit_run(arg[2])
            if run and len(arg[2]) == 1 and str(arg[2][0][0]) == "IN":
                run = arg[0]
        most = max(most, run)
    return most


@lru_cache(maxsize=None)
def required_size(pattern: str) -> tuple[int, int]:
    """Characters that every match has at least, and digits in a row that every matching text holds (0: unknown)."""
    try:
        tree = _regex_parser.parse(pattern.replace(r"\z", r"\Z"), re.MULTILINE)
    except re.error:
        return 0, 0
    return tree.getwidth()[0], _digit_run(tree)


# ---- characters a match can begin with ------------------------------------------------------
_CLASSES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w"}


def _beginnings(tree) -> tuple[set[str] | None, bool]:
    """Characters and classes that a match of ``tree`` can begin with (None: any), and whether it can be empty."""
    found: set[str] = set()
    for op, arg in tree:
        name = str(op)
        empty = False
        if name == "LITERAL":
            own: set[str] | None = {chr(arg)}
        elif name == "IN":
            own = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    own.add(chr(value))
                elif str(kind) == "RANGE" and value[1] < 128:
                    own |= {chr(c) for c in range(value[0], value[1] + 1)}
                elif str(kind) == "CATEGORY" and str(value) in _CLASSES:
                    own.add(_CLASSES[str(value)])
                else:
                    own = None
                    break
        elif name == "SUBPATTERN":
            own, empty = _beginnings(arg[3])
        elif name == "ATOMIC_GROUP":
            own, empty = _beginnings(arg)
        elif name == "BRANCH":
            parts = [_beginnings(b) for b in arg[1]]
            own = None if any(c is None for c, _ in parts) else set().union(*[c for c, _ in parts])
            empty = any(e for _, e in parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            own, empty = _beginnings(arg[2])
            empty = empty or arg[0] == 0
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            own, empty = set(), True  # takes no character
        else:
            return None, False
        if own is None:
            return None, False
        found |= own
        if not empty:
            return found, False
    return found, True


@lru_cache(maxsize=None)
def beginning(pattern: str, any_case: bool) -> str:
    """A look-ahead for the characters with which an ASCII match begins, to go in front of ``pattern``; empty if it is of no use.

    A search then passes over most places by one look into a table, where the pattern's own first steps (word boundaries,
    look-arounds, alternatives) cost several times as much. Patterns that begin at a line start or with a plain literal
    need none.
    """
    if pattern.startswith("^"):
        return ""
    try:
        tree = _regex_parser.parse(pattern.replace(r"\z", r"\Z"), re.MULTILINE)
        chars, empty = _beginnings(tree)
    except (re.error, RecursionError):
        return ""
    if empty or not chars or r"\w" in chars or str(tree[0][0]) == "LITERAL" or not all(ord(c[-1]) < 128 for c in chars):
        return ""
    if any_case or "(?i" in pattern:
        chars = {x for c in chars for x in ((c,) if len(c) > 1 else (c.lower(), c.upper()))}
    spelled = "".join(c if len(c) > 1 or c.isalnum() else f"\\x{ord(c):02x}" for c in sorted(chars))
    return f"(?=[{spelled}])"
