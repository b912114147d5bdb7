"""Text expressions shared by the operators. Everything here is a built-in Spark expression."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# line breaks of the source text model (wider than "\n")
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\u0085\\u2028\\u2029]"
PLAIN_LINE_BREAK = "\n"
OTHER_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"


WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def is_blank(text: Column) -> Column:
    """No character other than white space (null counts as blank)."""
    return ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def strip(text: Column) -> Column:
    """Trim white space of any kind on both sides."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def indent_width(line: Column) -> Column:
    """Number of leading white-space characters."""
    return F.length(line) - F.length(F.ltrim(line, F.lit(WHITE_SPACE)))


def holds_any(text: Column, characters: str) -> Column:
    """Whether a text holds one of a few characters; looks at its bytes, where an expression would decode it first."""
    return reduce(or_, [F.contains(text, F.lit(c)) for c in characters])


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Lower case such that letters equal under ignore-case matching become equal.

    Four non-ASCII letters match ASCII letters when case is ignored; they are mapped first, and
    only on text that is not pure ASCII.
    """
    mapped = F.translate(text, "ſıİK", "siik")
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.lower(mapped))


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a final break does not open another line."""
    body = F.regexp_replace(text, f"(?:{LINE_BREAKS})\\z", "")
    simple = ~holds_any(text, OTHER_LINE_BREAKS)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.when(simple, F.split(F.regexp_replace(text, "\\n\\z", ""), "\n", -1)).otherwise(
            F.split(body, LINE_BREAKS, -1)
        )
    )


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def cut(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def to_snake_case(name: Column) -> Column:
    first = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(first, "([a-z0-9])([A-Z])", "$1_$2"))


def to_camel_case(name: Column) -> Column:
    head = F.substring_index(name, "_", 1)
    tail = F.substring(name, F.length(head) + 2, F.length(name))
    return F.concat(head, F.replace(F.initcap(F.replace(tail, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")))


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))
