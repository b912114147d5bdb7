"""Python regular expressions in the spelling of the JVM.

The parse tree of the standard library is written out again: literals escaped, groups under plain names, classes without
loose brackets. A condition on a group, which the JVM lacks, becomes a reference to an empty group that is set along
with it.
"""

from __future__ import annotations

import re

try:
    from re import _parser
except ImportError:  # older Python
    import sre_parse as _parser

_CLASSES = {
    "CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S",
    "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W",
}
_PLACES = {"AT_BEGINNING_STRING": r"\A", "AT_BOUNDARY": r"\b", "AT_NON_BOUNDARY": r"\B", "AT_END_STRING": r"\z"}
_REPEATS = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}


def _literal(code: int) -> str:
    return chr(code) if chr(code).isalnum() and code < 128 else rf"\x{{{code:x}}}"


class _Writer:
    def __init__(self, flags: int):
        self.flags, self.tested = flags, set()

    def all(self, tree) -> str:
        return "".join(self.one(str(op), arg) for op, arg in tree)

    def one(self, op: str, arg) -> str:
        if op == "LITERAL":
            return _literal(arg)
        if op == "NOT_LITERAL":
            return f"[^{_literal(arg)}]"
        if op == "ANY":
            return r"[\s\S]" if self.flags & re.DOTALL else r"[^\n]"
        if op == "IN":
            return self._class(arg)
        if op == "BRANCH":
            return f"(?:{'|'.join(map(self.all, arg[1]))})"
        if op == "SUBPATTERN":
            return self._group(*arg)
        if op == "ATOMIC_GROUP":
            return f"(?>{self.all(arg)})"
        if op in _REPEATS:
            low, high, what = arg
            most = "" if high == _parser.MAXREPEAT else str(high)
            return f"(?:{self.all(what)}){{{low},{most}}}{_REPEATS[op]}"
        if op in ("ASSERT", "ASSERT_NOT"):
            side = "<" if arg[0] < 0 else ""
            return f"(?{side}{'=' if op == 'ASSERT' else '!'}{self.all(arg[1])})"
        if op == "AT":
            many = self.flags & re.MULTILINE
            ends = {"AT_BEGINNING": r"(?<![^\n])" if many else r"\A", "AT_END": r"(?=\n|\z)" if many else r"(?=\n?\z)"}
            return ends.get(str(arg)) or _PLACES[str(arg)]
        if op == "GROUPREF":
            return rf"\k<g{arg}>"
        if op == "GROUPREF_EXISTS":
            number, yes, no = arg
            mark = rf"\k<s{number}>"
            return f"(?:{mark}{self.all(yes)}|(?!{mark}){self.all(no) if no else ''})"
        raise ValueError(op)

    def _class(self, parts) -> str:
        out, negated = [], False
        for op, arg in ((str(o), a) for o, a in parts):
            if op == "NEGATE":
                negated = True
            elif op == "LITERAL":
                out.append(_literal(arg))
            elif op == "RANGE":
                out.append(f"{_literal(arg[0])}-{_literal(arg[1])}")
            else:
                out.append(_CLASSES[str(arg)])
        return f"[{'^' if negated else ''}{''.join(out)}]"

    def _group(self, number, add, drop, what) -> str:
        before, self.flags = self.flags, (self.flags | add) & ~drop
        inner = self.all(what)
        switched = "".join(c for c, f in (("i", re.IGNORECASE),) if (add | drop) & f)
        on, off = (switched, "") if self.flags & re.IGNORECASE else ("", switched)
        self.flags = before
        if switched:
            inner = f"(?{on}{'-' + off if off else ''}:{inner})"
        return f"(?<g{number}>{inner}(?<s{number}>))" if number is not None else f"(?:{inner})"


def jvm_pattern(pattern: str) -> str | None:
    """The same expression for the JVM, or None where Python does not compile it."""
    try:
        re.compile(pattern)
        tree = _parser.parse(pattern)
    except (re.error, TypeError, OverflowError, RecursionError):
        return None
    flags = tree.state.flags
    classes = "" if flags & re.ASCII else "U"
    case = "iu" if flags & re.IGNORECASE else ""
    return (f"(?{case}{classes})" if case or classes else "") + _Writer(flags).all(tree)
