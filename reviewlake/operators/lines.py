"""Line tables, context and snippets, line-based rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import split_lines, strip
from reviewlake.rules import catalog as C


def explode_lines(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, line_number, content), numbered from 1."""
    return files.select(
        key, F.posexplode(split_lines(F.col(text))).alias("_index", "line")
    ).select(key, (F.col("_index") + 1).alias("line_number"), F.col("line").alias("content"))


def line_at(lines: Column, number: Column) -> Column:
    """Trimmed text of a line of an array of lines, empty outside of it."""
    return F.coalesce(
        F.when(number > 0, strip(F.try_element_at(lines, number.cast("int")))), F.lit("")
    )


def with_snippet(findings: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Look up the line text of findings.

    The wanted lines of a file are put together first, so that a text meets one row, is split once, and only the lines
    picked from it go on.
    """
    wanted = findings.where(F.col("line_number") > 0).groupBy(F.col(key).alias("_key")).agg(F.collect_set("line_number").alias("_numbers"))
    texts = files.select(F.col(key).alias("_file"), split_lines(F.col("content")).alias("_lines"))
    picked = wanted.join(texts, F.col("_key") == F.col("_file")).select(
        "_key",
        F.inline(F.transform("_numbers", lambda n: F.struct(n.alias("_number"), line_at(F.col("_lines"), n).alias("code_snippet")))),
    )
    found = findings.drop("code_snippet").join(
        picked, (F.col(key) == F.col("_key")) & (F.col("line_number") == F.col("_number")), "left"
    )
    return found.withColumn("code_snippet", F.coalesce("code_snippet", F.lit(""))).drop("_key", "_number")


def line_context(files: DataFrame, key: str = "file_id", around: int = 2) -> DataFrame:
    """Every line with its neighbours, rendered ``%4d: text``; no shuffle, and a line carries its own context only."""
    lines = F.col("_lines")

    def context(_, i):
        first = F.greatest(F.lit(1), i + 1 - around)
        shown = F.transform(
            F.slice(lines, first, i + 1 + around - first + 1),
            lambda text, j: F.concat(
                F.lpad((first + j).cast("string"), F.greatest(F.lit(4), F.length((first + j).cast("string"))), F.lit(" ")), F.lit(": "), text
            ),
        )
        return F.array_join(shown, "\n")

    split = files.select(key, split_lines(F.col("content")).alias("_lines"))
    return split.select(key, F.posexplode(F.transform(lines, context)).alias("_index", "context")).select(
        key, (F.col("_index") + 1).alias("line_number"), "context"
    )


def long_lines(files: DataFrame, key: str = "file_id", limit: int = C.MAX_LINE_LENGTH) -> DataFrame:
    """Lines above the length limit, with their length and shortened text."""
    return (
        files.where(F.col("content").rlike(f"[^\\r\\n]{{{limit + 1}}}"))
        .transform(lambda d: explode_lines(d, key))
        .where(F.length("content") > limit)
        .select(
            key, "line_number", F.length("content").alias("length"),
            F.concat(F.substring("content", 1, 100), F.lit("...")).alias("code_snippet"),
        )
    )


def _starts(size: int) -> Column:
    """Positions at which a window of ``size`` lines fits (a sequence would count down to 0)."""
    last = F.size("filled") - (size - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last))


def _blocks(files: DataFrame, key: str, size: int) -> DataFrame:
    """Per file the trimmed non-blank lines, and one 64-bit key per window of ``size`` lines."""
    filled = F.filter(F.transform(split_lines(F.col("content")), strip), lambda l: l != "")
    texts = files.select(key, filled.alias("filled"))
    windows = F.transform(
        _starts(size), lambda i: F.xxhash64(*[F.try_element_at("filled", i + n) for n in range(size)])
    )
    return texts.select(key, "filled", windows.alias("windows"))


def duplicate_blocks(
    files: DataFrame, key: str = "file_id", size: int = C.DUPLICATE_BLOCK_LINES
) -> DataFrame:
    """Windows of non-blank lines that repeat an earlier window of the same file.

    Columns: position among non-blank lines (from 1), end position, first line of the window.
    Files without any repeat are recognised inside their row and never shuffled. For the rest,
    narrow rows (file, position, keys) are ranked per window; a second hash over the same lines
    makes the key 96 bits wide.
    """
    # inside the generator, since a filter would be pushed down and repeat the whole folding
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = F.transform(
        F.when(repeated, F.col("windows")),
        lambda window, i: F.struct(
            (i + 1).alias("position"), window.alias("_window"), F.hash(F.slice("filled", i + 1, size)).alias("_check"),
            F.element_at("filled", i + 1).alias("code_snippet"),
        ),
    )
    narrow = _blocks(files, key, size).select(key, F.inline(rows))
    from pyspark.sql import Window

    order = Window.partitionBy(key, "_window", "_check").orderBy("position")
    return (
        narrow.withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") > 1)
        .select(key, "position", (F.col("position") + size).alias("end_position"), "code_snippet")
    )


_PLACES = 10_000_000  # more than the lines of any file


def corpus_duplicate_blocks(
    files: DataFrame, key: str = "file_id", size: int = C.DUPLICATE_BLOCK_LINES
) -> DataFrame:
    """Windows found more than once in the whole corpus: occurrences, first place, text digest.

    Counting is a plain aggregate with map-side combine, so a licence header that sits in a third
    of all files collapses to one row per task before the shuffle.
    """
    filled = F.filter(F.transform(split_lines(F.col("content")), strip), lambda l: l != "")
    texts = files.select(key, filled.alias("filled"))
    windows = F.transform(
        _starts(size),
        lambda i: F.md5(F.array_join(F.slice("filled", i, size), "\n")),
    )
    rows = texts.select(key, F.posexplode(windows).alias("_index", "block"))
    # the first place as one number, which keeps the aggregate in hash tables
    place = F.col(key).cast("decimal(19,0)") * _PLACES + (F.col("_index") + 1)
    return (
        rows.groupBy("block")
        .agg(F.count("*").alias("occurrences"), F.min(place.cast("decimal(38,0)")).alias("_first"))
        .where(F.col("occurrences") > 1)
        .select(
            "block", "occurrences",
            F.floor(F.col("_first") / _PLACES).cast("bigint").alias("first_file"),
            (F.col("_first") % _PLACES).cast("int").alias("first_position"),
        )
    )
