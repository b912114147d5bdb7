"""Changed files, pull-request headers and file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.sources import trees


def _with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "status": F.coalesce("status", F.lit("modified")),
            "additions": F.coalesce("additions", F.lit(0)),
            "deletions": F.coalesce("deletions", F.lit(0)),
        }
    )


def read_pr_files(spark: SparkSession, path: str) -> DataFrame:
    """Changed files from JSON lines; absent counts are 0, the patch may be null."""
    return _with_defaults(spark.read.schema(schemas.PR_FILES).json(path))


def flatten_headers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "number", "title", "body", "state", "html_url",
        F.col("head.ref").alias("head_ref"), F.col("base.ref").alias("base_ref"),
        F.col("head.sha").alias("head_sha"),
        F.col("base.repo.owner.login").alias("repo_owner"), F.col("base.repo.name").alias("repo_name"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("additions", "deletions", "changed_files")],
        F.coalesce(
            F.transform("labels", lambda l: l["name"]), F.array().cast("array<string>")
        ).alias("labels"),
        F.coalesce("draft", F.lit(False)).alias("draft"),
    )


def read_pr_headers(spark: SparkSession, path: str) -> DataFrame:
    """Pull-request headers from nested JSON, one flat row each."""
    return flatten_headers(spark.read.schema(schemas.PR_HEADERS).json(path))


def header_files(raw: DataFrame) -> DataFrame:
    """Files nested in headers, one row each, with their position."""
    rows = raw.select(
        F.col("base.repo.owner.login").alias("repo_owner"), F.col("base.repo.name").alias("repo_name"),
        "number", F.posexplode("files").alias("position", "file"),
    )
    return _with_defaults(rows.select("repo_owner", "repo_name", "number", "position", "file.*"))


def read_code_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files below a folder: (filename, content).

    Spark's reader keeps several records of each file in the driver and deals few files to a task. So a ``file:`` folder is listed
    and read by tasks; only other file systems, single files and globs go through Spark's reader.
    """
    folder = trees.local_folder(spark, path)
    if folder:
        raw = trees.read_files(spark, *folder, pattern)
    else:
        raw = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(path)
        )
    return raw.select(F.col("path").alias("filename"), decode_utf8(F.col("content")).alias("content"))


def decode_utf8(binary):
    """UTF-8 with the replacement character for bytes that are none."""
    return F.coalesce(F.try_validate_utf8(binary.cast("string")), F.make_valid_utf8(binary.cast("string")))


def decode_contents(df: DataFrame, column: str = "content") -> DataFrame:
    """Base64 contents, as a code host delivers them (line breaks allowed)."""
    packed = F.regexp_replace(column, r"\s", "")
    return df.withColumn(column, decode_utf8(F.unbase64(packed)))
