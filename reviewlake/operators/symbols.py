"""Functions, classes and imports of languages read by their surface shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.blocks import GENERIC_LANGUAGES, code_blocks, python_imports
from reviewlake.operators.scan import without_marks
from reviewlake.rules import catalog as C
from reviewlake.rules.model import CAPTURE_END, MARK

_FLAGS = "(?md)"
# The modifiers in front of a method are taken as one run, possessively: no stack is used, and time is linear. A modifier stays
# out of the run where it must serve as the type of the method (``public Name(``), and a run begins only where no
# other ends: from a place inside a run nothing matches that did not match from its beginning.
_MODIFIER = "public|private|protected|static"
_JAVA_METHOD = C.JAVA_METHOD_SHAPE.replace(
    rf"(?:{_MODIFIER}|\s)+", rf"(?<!\s|{_MODIFIER})(?:\s++|(?:{_MODIFIER})(?!\s+\w+\s*\())++"
)
assert _JAVA_METHOD != C.JAVA_METHOD_SHAPE


# language → (kind, shape, number of groups of which one holds the name)
SHAPES = {
    "javascript": (("function", C.JS_FUNCTION_SHAPES, 3), ("import", C.JS_IMPORT_SHAPE, 1), ("class", C.JS_CLASS_SHAPE, 1)),
    "java": (("function", _JAVA_METHOD, 1), ("class", C.JAVA_CLASS_SHAPE, 1), ("import", C.JAVA_IMPORT_SHAPE, 1)),
    "go": (("function", C.GO_FUNCTION_SHAPE, 1), ("class", C.GO_STRUCT_SHAPE, 1), ("import", C.GO_IMPORT_SHAPE, 1)),
}
SHAPES["typescript"] = SHAPES["javascript"]


def shape_symbols(
    files: DataFrame, keep: list[str] | None = None, languages: tuple[str, ...] = tuple(SHAPES)
) -> DataFrame:
    """(*keep, kind, name, line_number) of languages read by surface shape, in one pass.

    In javascript and typescript a block head such as ``if (x) {`` has the shape of a function and
    is counted as one; function names that begin with a capital are not.
    """
    keep = keep or ["file_id"]
    table = None
    for language in languages:
        shapes = F.array(
            *[
                F.struct(
                    F.lit(kind).alias("kind"), F.lit(_FLAGS + shape).alias("pattern"),
                    F.lit(MARK + "".join(f"${n}" for n in range(1, groups + 1)) + CAPTURE_END + "$0").alias("replacement"),
                )
                for kind, shape, groups in SHAPES[language]
            ]
        )
        test = F.col("language") == language
        table = F.when(test, shapes) if table is None else table.when(test, shapes)
    chosen = files.where(F.col("language").isin(*languages) & F.col("content").isNotNull()).select(
        *keep, "language", without_marks(F.col("content")).alias("content"), F.explode(table).alias("shape")
    )
    marked = chosen.select(
        *keep, "language", F.col("shape.kind").alias("kind"),
        F.regexp_replace("content", F.col("shape.pattern"), F.col("shape.replacement")).alias("marked"),
    )
    picked = F.array_compact(
        F.transform(
            F.split("marked", "\n", -1),
            lambda line, i: F.when(F.contains(line, F.lit(MARK)), F.struct(i.alias("index"), line.alias("line"))),
        )
    )
    lines = marked.select(*keep, "language", "kind", F.inline(F.when(F.contains("marked", F.lit(MARK)), picked)))
    parts = lines.select(
        *keep, "language", "kind", "index", F.posexplode(F.split("line", MARK, -1)).alias("part_no", "part")
    ).where(F.col("part_no") > 0)
    found = parts.select(
        *keep, "language", "kind", F.substring_index("part", CAPTURE_END, 1).alias("name"),
        (F.col("index") + 1).alias("line_number"),
    )
    capital = F.col("language").isin("javascript", "typescript") & (F.col("kind") == "function") & F.col(
        "name"
    ).rlike(r"^\p{Lu}")
    return found.where((F.col("name") != "") & ~capital).drop("language")


def js_symbols(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return shape_symbols(files, keep, ("javascript", "typescript"))


def java_symbols(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return shape_symbols(files, keep, ("java",))


def go_symbols(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Functions (with receivers), structs as classes, quoted path-like strings as imports."""
    return shape_symbols(files, keep, ("go",))


def block_symbols(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Functions and classes of the languages that have extents."""
    keep = keep or ["file_id"]
    blocks = code_blocks(files, ("function", "class"), GENERIC_LANGUAGES, keep)
    kind = F.when(F.col("kind") == "generic", "function").otherwise(F.col("kind"))
    return blocks.select(*keep, kind.alias("kind"), "name", F.col("start_line").alias("line_number"))


def import_symbols(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    keep = keep or ["file_id"]
    return python_imports(files, keep).select(
        *keep, F.lit("import").alias("kind"), F.col("module").alias("name"), F.lit(None).cast("int").alias("line_number")
    )


def symbols(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All symbols of all languages, one row each."""
    keep = keep or ["file_id"]
    return (
        block_symbols(files, keep).unionByName(import_symbols(files, keep)).unionByName(shape_symbols(files, keep))
    )


def symbol_inventory(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: number of functions, classes and imports."""
    return symbols(files, [key]).groupBy(key).agg(
        *[
            F.count_if(F.col("kind") == kind).alias(f"{kind}_count")
            for kind in ("function", "class", "import")
        ]
    )


def most_imported(files: DataFrame) -> DataFrame:
    """Modules with the number of import statements that name them."""
    imports = import_symbols(files).unionByName(shape_symbols(files).where(F.col("kind") == "import"))
    return imports.groupBy(F.col("name").alias("module")).agg(
        F.count("*").alias("imports")
    )
