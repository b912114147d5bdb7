"""Code structure: functions, classes, imports and their extents.

Extents are found inside the row of a file, so nothing is shuffled. Python blocks come from one
pattern whose look-ahead captures the indented block behind a header; brace languages fold over
the lines with a running depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import newline_count, split_lines, strip
from reviewlake.rules import catalog as C
from reviewlake.rules.model import MARK

# one physical line, continued over triple-quoted strings; possessive, so linear
_TRIPLE = r"""(?<!['"])\"\"\"(?s:.*?)\"\"\"|(?<!['"])'''(?s:.*?)'''"""
_REST = (
    r"(?:[^\n\"'#]++|" + _TRIPLE
    + r"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|#[^\n]*+|[\"'])*+"
)
# a line of the block: behind any blank and comment lines, indented deeper than the header
# (group 3) or beginning with a closing bracket
_BODY_LINE = (
    r"\n(?:[ \t]*(?:#[^\n]*)?\n)*+(?:\3[ \t]+(?=[^ \t\n#])|[ \t]*(?=[)\]}]))" + _REST
)
_DECORATORS = r"((?:^[ \t]*+@[^\n]*+\n)*+)"
HEADERS = {
    "function": r"(?:async[ \t]+)?def[ \t]+%s[ \t]*\(",
    "class": r"class[ \t]+%s[ \t]*[:(]",
    "for": r"(?:async[ \t]+)?(for)\b[^\n]*:[ \t]*(?:#[^\n]*)?(?=\n)",
    "chain": r"(?:el)?(if)\b",
}
# an if/elif branch runs on over the elif branches behind it
_CHAIN_LINE = _BODY_LINE.replace(r"(?:\3[ \t]+", r"(?:\3elif\b|\3[ \t]+", 1)


def _block_pattern(kind: str, with_block: bool) -> str:
    """Groups: 1 string passed over, 2 decorators, 3 indentation, 4 name, [5 block].

    Triple-quoted strings are matched on their own, so that header look-alikes in them are not.
    The block of a loop is consumed, so only outermost loops match; other blocks are looked at
    only, so inner ones match too.
    """
    header = HEADERS[kind]
    named = header % r"(\w+)" if "%s" in header else header
    plain = header % r"\w+" if "%s" in header else header.replace("(for)", "for").replace("(if)", "if")
    line = _CHAIN_LINE if kind == "chain" else _BODY_LINE
    block = rf"({_REST}(?:{line})*+)"
    if not with_block:
        tail = named
    elif kind == "for":
        tail = rf"(?={named}){block}"
    else:
        tail = rf"(?={named})(?={block}){plain}"
    return rf"(?md)({_TRIPLE})|{_DECORATORS}^([ \t]*+){tail}"


PYTHON_KINDS = ("function", "class", "chain", "for")
GENERIC_LANGUAGES = ("rust", "ruby", "solidity")
# what a text must hold for a kind of block to be looked for
_GATES = {
    "function": lambda text: F.contains(text, F.lit("def")),
    "class": lambda text: F.contains(text, F.lit("class")),
    "chain": lambda text: text.rlike(r"(?md)^[ \t]*(?:el)?if\b"),
    "for": lambda text: text.rlike(r"(?md)^[ \t]*(?:async[ \t]+)?for\b"),
}


def _by_kind(values: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(pairs, F.col("kind"))


def _match_lines(content: Column, pattern: Column, replacement: Column) -> Column:
    """Line number of every match, in order."""
    marked = F.split(F.regexp_replace(content, pattern, replacement), "\n", -1)
    return F.flatten(
        F.transform(
            marked,
            lambda line, i: F.array_repeat(
                i + 1, F.length(line) - F.length(F.replace(line, F.lit(MARK), F.lit("")))
            ),
        )
    )


def _python_block_array(content: Column, kinds: tuple[str, ...]) -> Column:
    block = _by_kind({k: _block_pattern(k, True) for k in kinds})
    mark = _by_kind({k: _block_pattern(k, k == "for") for k in kinds})
    # strings and decorators stay in front of the mark, a consumed block stays behind it
    replacement = _by_kind({k: f"$1$2{MARK}" + ("$5" if k == "for" else "") for k in kinds})
    part = {
        name: F.regexp_extract_all(content, block, n)
        for name, n in (("above", 2), ("indent", 3), ("name", 4), ("block", 5))
    }
    return F.arrays_zip(
        _match_lines(content, mark, replacement).alias("start_line"),
        *[array.alias(name) for name, array in part.items()],
    )


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once and not at each of its uses."""
    return F.get(F.transform(F.array(value), body), 0)


def _generic_block_array(content: Column) -> Column:
    def blocks(lines: Column) -> Column:
        return F.transform(
            generic_extents(lines),
            lambda f: F.struct(
                f["start_line"].alias("start_line"), F.lit("").alias("above"), F.lit("").alias("indent"),
                f["name"].alias("name"),
                F.array_join(F.slice(lines, f["start_line"], f["end_line"] - f["start_line"] + 1), "\n").alias("block"),
            ),
        )

    return _let(split_lines(content), blocks)


def code_blocks(
    files: DataFrame, kinds: tuple[str, ...] = PYTHON_KINDS,
    generic_languages: tuple[str, ...] = (), keep: list[str] | None = None,
    gates: dict | None = None,
) -> DataFrame:
    """Blocks of source files in one pass over the texts, without a shuffle.

    (*keep, language, kind, name, start_line, end_line, indent, decorators, text). Python kinds
    are function, class, for (outermost loops) and chain (if/elif branches with the branches
    behind them); the kind of a function by brace depth is generic. ``text`` runs from the header
    line to the last code line of the block.
    """
    keep = keep or ["file_id"]
    gates = {**_GATES, **(gates or {})}
    content = F.col("content")
    languages = (("python",) if kinds else ()) + tuple(generic_languages)
    tried = F.when(
        F.col("language") == "python", F.array(*[F.when(gates[k](content), F.lit(k)) for k in kinds])
    ) if kinds else F.when(F.lit(False), F.array(F.lit("")))
    if generic_languages:
        tried = tried.when(
            F.col("language").isin(*generic_languages) & content.rlike(_GENERIC_GATE), F.array(F.lit("generic"))
        )
    rows = (
        files.where(F.col("language").isin(*languages) & content.isNotNull())
        .select(*keep, "language", F.translate("content", MARK, " ").alias("content"), F.explode(tried).alias("kind"))
        .where(F.col("kind").isNotNull())
    )
    blocks = F.when(F.col("kind") == "generic", _generic_block_array(content)) if generic_languages else None
    if kinds:
        python = _python_block_array(content, kinds)
        blocks = python if blocks is None else blocks.otherwise(python)
    decorators = F.transform(
        F.filter(F.split("above", "\n"), lambda l: F.trim(l) != ""),
        lambda l: strip(F.regexp_replace(l, r"^\s*@", "")),
    )
    return (
        rows.select(*keep, "language", "kind", F.inline(blocks))
        .where(F.col("name") != "")
        .select(
            *keep, "language", "kind", "name", "start_line",
            (F.col("start_line") + newline_count(F.col("block"))).alias("end_line"),
            "indent", decorators.alias("decorators"), F.concat("indent", "block").alias("text"),
        )
    )


def python_blocks(files: DataFrame, kind: str, keep: list[str] | None = None) -> DataFrame:
    """Blocks of one kind: (*keep, name, start_line, end_line, indent, decorators, text)."""
    return code_blocks(files, (kind,), keep=keep).drop("language", "kind")


def python_params(text: Column) -> Column:
    """Positional parameter names of a function header (up to the closing bracket)."""
    inside = F.regexp_extract(text, r"def\s+\w+\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+)\)", 1)
    flat = F.regexp_replace(inside, r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|#[^\n]*", "")
    before_star = F.regexp_replace(flat, r"(?s)(?:^|,)\s*\*.*$", "")
    return F.filter(
        F.transform(F.split(before_star, ","), lambda p: F.regexp_extract(p, r"^\s*(\w+)", 1)),
        lambda p: p != "",
    )


def python_imports(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``import a.b as c, d`` → a.b, d; ``from m import x, y`` → m.x, m.y (brackets allowed)."""
    keep = keep or ["file_id"]
    python = files.where((F.col("language") == "python") & F.contains("content", F.lit("import")))
    statement = (
        rf"(?md)(?:{_TRIPLE})|^[ \t]*(?:from[ \t]+(\.*[\w.]*)[ \t]+)?import[ \t]+(\([^)]*\)|(?:\\\n|[^\n#;(])++)"
    )
    rows = python.select(
        *keep,
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("content", F.lit(statement), 1).alias("module"),
                F.regexp_extract_all("content", F.lit(statement), 2).alias("names"),
            )
        ).alias("s"),
    )
    cleaned = F.regexp_replace(F.regexp_replace("s.names", r"#[^\n]*", ""), r"[()\\]", "")
    names = rows.select(
        *keep, F.ltrim(F.col("s.module"), F.lit(".")).alias("module"), F.col("s.module").alias("_full"),
        F.explode(F.split(cleaned, ",")).alias("part"),
    ).withColumn("part", F.regexp_extract("part", r"^\s*([\w.*]+)", 1)).where(F.col("part") != "")
    return names.select(
        *keep,
        F.when(F.col("_full") == "", F.col("part"))
        .otherwise(F.concat("module", F.lit("."), "part")).alias("module"),
    )


_GENERIC_START = rf"^(?:{'|'.join(C.GENERIC_FUNCTION_WORDS)}) "
_GENERIC_GATE = rf"(?md)^\s*(?:{'|'.join(C.GENERIC_FUNCTION_WORDS)}) "


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def generic_extents(lines: Column) -> Column:
    """Functions of brace languages: array of (name, start_line, end_line).

    A keyword line that names a function opens it, and replaces one still open; the first later
    line where the running brace depth is zero or less closes it. Lines between two openers are folded
    on their own, with a depth and an end as the only state, so that time grows with the lines.
    """
    def facts(line: Column, i: Column) -> Column:
        stripped = strip(line)
        keyword = stripped.rlike(_GENERIC_START)
        return F.struct(
            (i + 1).alias("no"), keyword.alias("keyword"),
            F.when(keyword, F.regexp_extract(stripped, r"(?U)[\s(](\w+)\s*\(", 1)).otherwise("").alias("name"),
            (_count(line, "{") - _count(line, "}")).alias("delta"),
        )

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + x["delta"]
        return F.when((acc["end"] > 0) | x["keyword"], acc).otherwise(
            F.struct(depth.alias("depth"), F.when(depth <= 0, x["no"]).otherwise(0).alias("end"))
        )

    def extents(every: Column) -> Column:
        def closed(openers: Column) -> Column:
            def extent(opener: Column, k: Column) -> Column:
                following = F.coalesce(F.get(openers, k + 1)["no"], F.size(every) + 1)
                inside = F.slice(every, opener["no"] + 1, following - opener["no"] - 1)
                begin = F.struct(opener["delta"].alias("depth"), F.lit(0).alias("end"))
                end = F.aggregate(inside, begin, step, lambda acc: acc["end"])
                return F.struct(opener["name"].alias("name"), opener["no"].alias("start_line"), end.alias("end_line"))

            return F.filter(F.transform(openers, extent), lambda f: f["end_line"] > 0)

        return _let(F.filter(every, lambda x: x["name"] != ""), closed)

    return _let(F.transform(lines, facts), extents)


def generic_functions(
    files: DataFrame, languages: tuple[str, ...] = GENERIC_LANGUAGES, keep: list[str] | None = None
) -> DataFrame:
    """(*keep, language, name, start_line, end_line, body) by running brace depth."""
    keep = keep or ["file_id"]
    return code_blocks(files, (), languages, keep).select(
        *keep, "language", "name", "start_line", "end_line", F.col("text").alias("body")
    )
