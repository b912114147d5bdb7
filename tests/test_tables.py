"""Stored tables: rows kept, and how often they are moved."""

import re
from collections import Counter

from pyspark.sql import functions as F

from checks import bindings as B
from checks.q_history import QUERIES
from reviewlake.plans.review import files_with_text, review_files
from reviewlake.sources import tables as T


def _frames(spark):
    files = spark.createDataFrame([(n, n % 7 if n % 5 else None) for n in range(40)] + [(3, 3)], "file_id long, review_id long")
    findings = spark.range(300).select(
        F.when(F.col("id") % 50 != 0, F.col("id") % 45).alias("file_id"), F.concat(F.lit("m"), F.col("id")).alias("message")
    )
    reviews = spark.range(7).select(F.col("id").alias("review_id"), F.lit("done").alias("status"))
    return findings, files, reviews


def _shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan)


def test_findings_are_moved_once(spark):
    findings, files, _ = _frames(spark)
    assert Counter(_shuffles(T.stored_findings(findings, files, 4))) == {"hashpartitioning": 2}  # both sides of the join
    assert "rebalance" in T.stored_findings(findings, files)._jdf.queryExecution().logical().toString().lower()


def test_stored_rows_do_not_depend_on_the_number_of_buckets(spark, tmp_path):
    findings, files, reviews = _frames(spark)
    want = Counter(map(tuple, findings.join(files, "file_id").collect()))
    for buckets in (4, 64):
        folder = f"{tmp_path}/{buckets}"
        for _ in range(2):
            T.write_review_tables(findings, files, reviews, folder, buckets=buckets)
        stored = T.read_review_table(spark, folder, "findings").select("file_id", "message", "review_id")
        assert Counter(map(tuple, stored.collect())) == want
        assert T.read_review_table(spark, folder, "file_reviews").count() == 41
        assert T.read_review_table(spark, folder, "reviews").count() == 7


def _rows(df):
    return sorted(map(str, df.collect()))


def test_files_are_put_together_in_one_pass_and_once(spark, sf):
    files = B.pr_files(spark, sf)
    # sizes and texts come from one scan of the lines
    assert len(re.findall(r"Relation \[.*l_orderkey", files._jdf.queryExecution().optimizedPlan().toString())) == 1
    lines = B.snippet_lines(B.table(spark, sf, "lineitem"), 3)
    sizes = B._sizes(lines, "l_orderkey", "code").withColumnRenamed("l_orderkey", "file_id")
    want = sizes.join(files.select("file_id"), "file_id").select("file_id", "content_bytes", "additions", "deletions")
    assert _rows(files.join(sizes.select("file_id"), "file_id", "left_semi").select(*want.columns)) == _rows(want)
    together = B.put_together(files)
    assert "lineitem" not in together._jdf.queryExecution().analyzed().toString()
    assert _rows(together) == _rows(files)


def test_patches_are_put_together_and_extracted_once(spark, sf):
    files = B.file_headers(spark, sf).join(B.patches(spark, sf), "file_id", "left").select(
        "*", F.lit(1).alias("additions"), F.lit(0).alias("deletions")
    )
    together = B.put_together(files_with_text(files))
    assert "patch" not in together.columns and together.where("status = 'removed'").isEmpty()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert together.select("file_id", "content").rdd.getNumPartitions() == parts  # not put together by their bytes
    once, anew = review_files(together), review_files(files)
    for name in ("files", "reviews", "findings"):
        assert _rows(getattr(once, name)) == _rows(getattr(anew, name))
    query = QUERIES["review_patches"][0](spark, sf)
    assert "l_orderkey" not in query._jdf.queryExecution().analyzed().toString()
