"""Times of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores. Every query
runs in full into a sink that drops its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "review_all_rules", "review_patches", "worst_files", "review_files", "rules_python", "secrets", "loop_query",
    "function_findings", "function_metrics", "generic_functions", "symbol_inventory", "duplicate_blocks",
    "corpus_duplicate_blocks", "patch_lines", "long_lines", "line_context", "drop_ignored", "file_scores", "review_scores",
    "category_cube", "dedupe_findings", "nested_reviews", "newest_per_project", "review_stats", "score_moves",
    "new_findings", "markdown_report", "pr_comment", "review_prompts", "valid_signature", "webhook_records",
    "event_rates", "event_sessions", "dedupe_deliveries_stream", "scan_stream",
)


def run(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def scan_rates(spark, sf_dir):
    """Throughput of the full rule scan on texts that lie in a table already."""
    from pyspark.sql import functions as F

    from checks.q_files import text_files
    from reviewlake.operators.scan import scan_rules
    from reviewlake.session import materialize

    texts = materialize(
        text_files(spark, sf_dir).where("not is_blank").select("file_id", "language", "content"), "bench-texts"
    )
    files, size = texts.agg(F.count("*"), F.sum(F.octet_length("content"))).first()
    seconds = run(lambda *_: scan_rules(texts), spark, sf_dir)
    return {
        "files": files, "mb": round(size / 1e6, 3), "seconds": seconds,
        "files_per_s": round(files / seconds), "mb_per_s": round(size / 1e6 / seconds, 3),
    }


def main():
    from checks import registry
    from reviewlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("reviewlake-bench", os.environ.get("BENCH_CPUS", "8"))
    queries = {name: registry.ALL[name][0] for name in HEADLINES}
    run(queries["review_stats"], spark, sf_dir)  # start-up is not measured
    times = {name: run(query, spark, sf_dir) for name, query in queries.items()}
    result = {
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir), "scan": scan_rates(spark, sf_dir),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
