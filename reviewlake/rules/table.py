"""Rules as a table: rows become rules of the scan, and rows that are no safe pattern are put aside with the reason.

A table of rules is configuration: it is read when a plan is made, as the patterns stand in the plan. Each pattern is
looked at before it is used. Java's matcher takes a stack frame for each turn of a repeated group, and a pattern whose repeats
can share the same text in many ways takes exponential time; either can end an executor, whatever its memory. So a
repeat without bound is accepted only over single characters or classes, or over a group that takes its turns possessively or
whose turns cannot be divided in two ways.
"""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import DataFrame

from reviewlake.rules.model import Rule

COLUMNS = ("id", "category", "severity", "pattern", "message", "suggestion", "languages", "flags")
_REPEATS = ("MAX_REPEAT", "MIN_REPEAT")
_UNBOUNDED = 1000


def _single(tree) -> bool:
    """Whether a repeat over ``tree`` runs in a loop: one character or class."""
    return len(tree) == 1 and str(tree[0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY")


def _walk(tree):
    for op, arg in tree:
        name = str(op)
        yield name, arg
        if name == "SUBPATTERN":
            yield from _walk(arg[3])
        elif name in ("ATOMIC_GROUP", "POSSESSIVE_REPEAT", *_REPEATS):
            yield from _walk(arg if name == "ATOMIC_GROUP" else arg[2])
        elif name in ("ASSERT", "ASSERT_NOT"):
            yield from _walk(arg[1])
        elif name == "BRANCH":
            for branch in arg[1]:
                yield from _walk(branch)
        elif name == "GROUPREF_EXISTS":
            yield from _walk(arg[1])
            yield from _walk(arg[2] or [])


def objection(pattern: str | None, flags: str = "mi") -> str | None:
    """Why a pattern cannot be used, or None."""
    if not pattern:
        return "empty"
    if set(flags) - set("mis"):
        return f"flags: {flags}"
    try:
        tree = _parser.parse(pattern.replace(r"\z", r"\Z"), sum({"m": re.M, "i": re.I, "s": re.S}[f] for f in set(flags)))
    except (re.error, OverflowError, RecursionError) as error:
        return f"no pattern: {error}"
    if tree.getwidth()[0] == 0:
        return "matches the empty text"
    if "(?P" in pattern or any(name == "GROUPREF_EXISTS" for name, _ in _walk(tree)):
        return "a form that the matcher does not have"
    for name, arg in _walk(tree):
        if name not in _REPEATS or arg[1] < _UNBOUNDED or _single(arg[2]):
            continue
        inside = list(_walk(arg[2]))
        if any(n in _REPEATS and a[1] > 1 for n, a in inside):
            return "grows: a repeat inside a repeat without bound"
        return "recursion: a group repeated without bound; write it possessively"
    return None


def rules_of(table: DataFrame) -> tuple[list[Rule], list[tuple[str, str]]]:
    """The rules of ``table`` (``id, category, severity, pattern, message, suggestion, languages, flags``), and (id, reason) of the rows put aside.

    ``languages`` is an array of names, null or empty for all; null flags are ``mi``; null suggestions are empty. Rows come in
    the order of their ids. A row without id, category, severity or message, and each further row of an id, is put aside.
    """
    rows = sorted(table.select(*COLUMNS).collect(), key=lambda r: tuple(str(r[c] or "") for c in COLUMNS))
    good: dict[str, Rule] = {}
    aside: list[tuple[str, str]] = []
    for r in rows:
        flags = "mi" if r["flags"] is None else r["flags"]
        lacking = [c for c in ("id", "category", "severity", "message") if not r[c]]
        reason = f"lacks {', '.join(lacking)}" if lacking else "repeated id" if r["id"] in good else objection(r["pattern"], flags)
        if reason:
            aside.append((r["id"], reason))
        else:
            good[r["id"]] = Rule(
                r["id"], r["category"], r["severity"], r["pattern"], r["message"], r["suggestion"] or "", tuple(r["languages"] or ("*",)), flags
            )
    return list(good.values()), aside
