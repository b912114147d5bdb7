"""Contract tables derived from the given parquet tables, as DataFrames.

The given tables hold no code, pull requests or webhooks, so each contract table is a plain
derivation of them. ``bindings_sql`` states the same derivations for the SQL check.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.snippets import SNIPPETS
from reviewlake.session import materialize

EXTENSIONS = (".py", ".js", ".ts", ".go", ".rs", ".java", ".rb", ".sol", ".css", "")
FOLDERS = 256
IGNORED = (r"mod1\d/", r"f\d*7\.", r"\.sol$")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant_array(values) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def snippet_lines(lineitem: DataFrame, levels: int) -> DataFrame:
    """Every lineitem becomes a snippet of code, indented by its line number."""
    indent = F.repeat(F.lit("    "), F.col("l_linenumber") % levels)
    raw = F.element_at(
        constant_array(SNIPPETS), (F.col("l_partkey") % len(SNIPPETS) + 1).cast("int")
    )
    code = F.concat(indent, F.replace(raw, F.lit("\n"), F.concat(F.lit("\n"), indent)))
    return lineitem.select("*", code.alias("code"))


def _size_columns(text: str) -> list[Column]:
    return [
        (F.sum(F.octet_length(text) + 1) - 1).alias("content_bytes"),
        F.count_if(F.col("l_returnflag") == "A").alias("additions"),
        F.count_if(F.col("l_returnflag") == "R").alias("deletions"),
    ]


def _sizes(lines: DataFrame, key: str, text: str) -> DataFrame:
    return lines.groupBy(key).agg(*_size_columns(text))


def _joined_column(order: list[str], text: str) -> Column:
    return F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text")))),
            lambda s: s["_text"],
        ),
        "\n",
    )


def _joined(lines: DataFrame, key: str, order: list[str], text: str, alias: str) -> DataFrame:
    """Lines of one key joined in order: a file is one row, whatever its size."""
    return lines.groupBy(key).agg(_joined_column(order, text).alias(alias))


def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as changed files."""
    key = F.col("o_orderkey")
    extension = F.element_at(constant_array(EXTENSIONS), (key % 10 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("file_id"),
        F.col("o_custkey").alias("review_id"),
        F.concat(
            F.lit("src/mod"), (key % 97).cast("string"), F.lit("/f"), key.cast("string"), extension
        ).alias("filename"),
        F.when((F.col("o_orderstatus") == "P") & (key % 4 == 0), "removed")
        .when(F.col("o_orderstatus") == "O", "added")
        .otherwise("modified").alias("status"),
    )


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files with content: short files, a few snippets each."""
    lines = snippet_lines(table(spark, sf_dir, "lineitem"), 3)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = lines.select("l_orderkey", *order, "l_returnflag", "code")
    both = lines.groupBy("l_orderkey").agg(*_size_columns("code"), _joined_column(order, "code").alias("content"))
    return file_headers(spark, sf_dir).join(both, F.col("file_id") == F.col("l_orderkey"), "left").select(
        "file_id", "review_id", "filename", "status",
        F.coalesce("additions", F.lit(0)).alias("additions"),
        F.coalesce("deletions", F.lit(0)).alias("deletions"),
        F.when(F.col("content_bytes").isNull(), F.lit("")).otherwise(F.col("content")).alias("content"),
        F.coalesce("content_bytes", F.lit(0)).alias("content_bytes"),
    )


def put_together(files: DataFrame) -> DataFrame:
    """The same files, with their texts put together once: a review reads them for lines, blocks, repeats and headers,
    and each of these would join them anew. Dealt by file, as a text costs much more than its bytes to read; into a set number
    of parts, as parts put together by their bytes would be too few to keep all cores at work."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(files, "files").repartition(parts, "file_id")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long files: all snippets of one supplier."""
    lines = snippet_lines(table(spark, sf_dir, "lineitem"), 5)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
    lines = lines.select("l_suppkey", *order, "l_returnflag", "code")
    joined = _sizes(lines, "l_suppkey", "code").join(
        _joined(lines, "l_suppkey", order, "code", "content"), "l_suppkey", "left"
    )
    languages = constant_array(
        ("python", "rust", "ruby", "solidity", "javascript", "go", "java", "typescript")
    )
    return joined.select(
        F.col("l_suppkey").alias("file_id"),
        F.element_at(languages, (F.col("l_suppkey") % 8 + 1).cast("int")).alias("language"),
        "content",
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as files that carry a unified diff; every snippet line gets a sign."""
    lines = snippet_lines(table(spark, sf_dir, "lineitem"), 3)
    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    signed = F.concat(sign, F.replace("code", F.lit("\n"), F.concat(F.lit("\n"), sign)))
    hunk = F.concat(
        F.lit("@@ -"), (F.col("l_orderkey") % 50 + F.col("l_linenumber") * 100).cast("string"), F.lit(",3 +"),
        (F.col("l_orderkey") % 70 + F.col("l_linenumber") * 100).cast("string"), F.lit(",3 @@"),
    )
    text = F.when(F.col("l_linenumber").isin(1, 4), F.concat_ws("\n", hunk, signed)).otherwise(signed)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return _joined(
        lines.select("l_orderkey", *order, "l_returnflag", text.alias("diff")), "l_orderkey", order, "diff", "patch"
    ).select(F.col("l_orderkey").alias("file_id"), "patch")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    owner = F.replace(F.lower("r_name"), F.lit(" "), F.lit("-"))
    repo = F.lower("n_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        key.cast("bigint").alias("project_id"),
        owner.alias("owner"),
        repo.alias("repo"),
        F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo).alias("repo_url"),
        (key % 2 == 0).alias("auto_watch"),
        F.when(key % 3 == 0, "bugs, security")
        .when(key % 3 == 1, "style,performance ,architecture").otherwise("").alias("enabled_categories"),
    )


def ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0")
    return chosen.select(
        F.col("n_nationkey").cast("bigint").alias("project_id"),
        F.explode(constant_array((*IGNORED, "(broken"))).alias("pattern"),
        F.lit(True).alias("is_regex"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reviews: one per customer that ordered."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    per_customer = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("last"),
        F.count("*").alias("files_changed"),
    )
    status = (
        F.when(F.col("c_mktsegment") == "BUILDING", "pending")
        .when(F.col("c_mktsegment") == "MACHINERY", "running")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "failed")
        .otherwise("completed")
    )
    base = customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey")).withColumn("status", status)
    whole = F.floor(F.abs("c_acctbal"))
    done = F.col("status") == "completed"
    return base.select(
        F.col("c_custkey").alias("review_id"),
        F.col("c_nationkey").cast("bigint").alias("project_id"),
        F.concat(
            F.lit("https://github.com/org"), F.col("c_nationkey").cast("string"), F.lit("/nation_"),
            F.col("c_nationkey").cast("string"), F.lit("/pull/"), F.col("c_custkey").cast("string"),
        ).alias("pr_url"),
        F.col("c_custkey").alias("pr_number"),
        F.concat(F.lit("Change "), F.col("c_name")).alias("pr_title"),
        F.concat(F.lit("org"), F.col("c_nationkey").cast("string")).alias("repo_owner"),
        F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string")).alias("repo_name"),
        F.when(done, (whole % 1001).cast("double") / 10.0).alias("score"),
        "status",
        "files_changed",
        (whole % 500).cast("bigint").alias("lines_added"),
        (whole % 300).cast("bigint").alias("lines_removed"),
        F.when(done, whole % 40).cast("bigint").alias("total_findings"),
        F.when(done, whole % 7).cast("bigint").alias("critical_count"),
        F.when(done, whole % 13).cast("bigint").alias("warning_count"),
        F.when(done, whole % 20).cast("bigint").alias("suggestion_count"),
        "created_at",
        F.when(done, F.col("last")).alias("completed_at"),
    )


def file_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored file rows: one per order."""
    languages = constant_array(
        ("python", "javascript", "typescript", "go", "rust", "java", "ruby", "solidity", "python", "go")
    )
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("file_id"),
        F.col("o_custkey").alias("review_id"),
        F.concat(F.lit("src/f"), key.cast("string")).alias("filename"),
        F.element_at(languages, (key % 10 + 1).cast("int")).alias("language"),
        (F.floor("o_totalprice") % 101).cast("double").alias("score"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings: one per lineitem."""
    part, number = F.col("l_partkey"), F.col("l_linenumber")
    categories = constant_array(("bugs", "security", "style", "performance", "architecture"))
    ordinal = (
        F.col("l_linenumber").cast("bigint") * 10_000_000_000 + part * 1_000 + F.col("l_suppkey") % 1_000
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.element_at(categories, (number % 5 + 1).cast("int")).alias("category"),
        F.when(F.col("l_returnflag") == "A", "critical")
        .when(F.col("l_returnflag") == "R", "warning").otherwise("suggestion").alias("severity"),
        F.when(number != 7, F.col("l_quantity").cast("int")).alias("line_number"),
        F.concat(F.lit("Issue kind "), (part % 20).cast("string"), F.lit(" seen")).alias("message"),
        F.concat(F.lit("code_"), (part % 50).cast("string"), F.lit("()")).alias("code_snippet"),
        F.when(part % 3 != 0, F.concat(F.lit("Fix "), (part % 20).cast("string"))).alias("suggestion"),
        F.when(part % 20 == 0, F.lit(None).cast("string"))
        .when(part % 20 == 1, "")
        .otherwise(F.concat(F.lit("R"), (part % 20).cast("string"))).alias("rule_id"),
        ordinal.alias("ordinal"),
    )


def _payload(event: Column) -> Column:
    repo = F.concat(F.lit("repo-"), (F.col("user_id") % 25).cast("string"))
    full_name = F.concat(F.upper(F.col("owner")), F.lit("/"), F.col("repo"))
    pull = F.concat(
        F.lit('{"action":"'),
        F.element_at(constant_array(("opened", "synchronize", "reopened", "closed")),
                     (F.col("event_id") % 4 + 1).cast("int")),
        F.lit('","pull_request":{"html_url":"'),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(
            F.concat(F.lit("https://github.com/"), full_name, F.lit("/pull/"), F.col("event_id").cast("string"))
        ),
        F.lit('","number":'), F.col("event_id").cast("string"),
        F.lit('},"repository":{"full_name":"'), full_name, F.lit('"}}'),
    )
    push = F.concat(
        F.lit('{"ref":"refs/heads/b'), (F.col("user_id") % 7).cast("string"),
        F.lit('","repository":{"full_name":"'), full_name, F.lit('"}}'),
    )
    body = F.when(event == "pull_request", pull).when(event == "push", push).otherwise(F.lit("{}"))
    return F.when(F.col("event_id") % 97 == 0, F.lit("{broken")).otherwise(body)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as webhook deliveries; every tenth delivery comes twice."""
    events = table(spark, sf_dir, "events")
    known = projects(spark, sf_dir).select("project_id", "owner", "repo")
    event = (
        F.when(F.col("event_type") == "click", "push")
        .when(F.col("event_type").isin("purchase", "signup"), "pull_request")
        .otherwise(F.col("event_type"))
    )
    joined = events.join(known, F.col("user_id") % 30 == F.col("project_id"), "left").select(
        "event_id", "ts", "user_id", event.alias("event_type"),
        F.coalesce("owner", F.lit("nobody")).alias("owner"), F.coalesce("repo", F.lit("none")).alias("repo"),
    )
    rows = joined.select(
        F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("delivery_id"),
        "event_type",
        _payload(F.col("event_type")).alias("body"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.when(F.col("event_id") % 10 == 0, 2).otherwise(1).alias("copies"),
    )
    return rows.select(
        "delivery_id", "event_type", "body", "received_at",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
        F.col("ts").alias("updated_at"),
        "event_id",
    )


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("text").alias("content")
    )


def write_text_tree(docs: DataFrame, folder: str) -> None:
    """documents as a code tree: a text file for each id, its texts as lines, in ``FOLDERS`` folders whatever their number.

    A folder for each file costs several file system calls in a row at the end of the job, and a task for its listing. A task
    that runs again writes the same files again.
    """

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        made, name, out = set(), None, None
        for batch in batches:
            for below, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    if out:
                        out.close()
                    if below not in made:
                        system.create_dir(f"{root}/{below}", recursive=True)
                        made.add(below)
                    name, out = own, system.open_output_stream(f"{root}/{below}/{own}.txt")
                out.write((text or b"") + b"\n")
        if out:
            out.close()
        yield from ()

    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("without-id"))
    rows = docs.select(F.pmod(F.hash("doc_id"), F.lit(FOLDERS)).alias("below"), own.alias("name"), F.col("text").cast("binary").alias("text"))
    rows.repartition(64, "below", "name").sortWithinPartitions("below", "name").mapInArrow(write, "none int").count()
