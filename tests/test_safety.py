"""Patterns that hold up on long texts, ignore patterns in the JVM, and streams that agree with batches."""

import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions.patterns import jvm_pattern
from reviewlake.operators.blocks import python_imports
from reviewlake.operators.scan import scan_rules
from reviewlake.operators.selection import drop_ignored, rejected_patterns
from reviewlake.plans.review import ReviewOptions, review_files
from reviewlake.rules.model import pattern_rules
from reviewlake.session import run_folder
from reviewlake.streaming import runs

LONG = 400_000


def rules(*ids):
    return [r for r in pattern_rules() if r.id in ids]


def test_long_lines_do_not_exhaust_the_stack(spark):
    texts = [
        ("python", "x = a.get(" + "1," * LONG + "1).b"),
        ("python", "x = a.get(" + "(1)," * (LONG // 4) + "1).b"),
        ("python", "def f(" + "a=(1), " * (LONG // 7) + "b=[]): pass"),
        ("javascript", "fetch(u)" + ".then(f)" * (LONG // 8) + ".catch(g)"),
    ]
    files = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "file_id long, language string, content string")
    found = scan_rules(files, rules("PY-BUG-AST001", "PY-BUG-AST004", "ARCH-ERR002")).select("file_id", "rule_id")
    assert {tuple(r) for r in found.collect()} == {
        (0, "PY-BUG-AST001"), (1, "PY-BUG-AST001"), (2, "PY-BUG-AST004"), (3, "ARCH-ERR002"),
    }
    names = ", ".join(f"name_{i}" for i in range(20_000))
    imports = spark.createDataFrame([(1, "python", f"import {names}")], "file_id long, language string, content string")
    assert python_imports(imports).count() == 20_000


@pytest.mark.parametrize("text", [
    "fetch(a).catch(b)", "fetch(a).then(b).catch(c)", "fetch(a).then(b)", "fetch(a)\n .then(b).then(c).catch(d)", "fetch(a) .catch(b); fetch(c)",
])
def test_fetch_agrees_with_the_plain_spelling(text):
    from reviewlake.rules.catalog import MISSING_ERROR_HANDLING
    from reviewlake.rules.model import FETCH_UNGUARDED

    plain = MISSING_ERROR_HANDLING[1][2]
    assert [m.span() for m in re.finditer(FETCH_UNGUARDED, text)] == [m.span() for m in re.finditer(plain, text)]


@pytest.mark.parametrize("text", [
    "def f(a=[], b={}): pass", "def f(a=(1), b=[2], c=(3)): pass", "def f(a=g(h), b=(2)): pass", "def f(a): pass\ndef g(b=[]): pass", "def f(a, b = {",
])
def test_mutable_defaults_agree_with_the_lazy_spelling(text):
    lazy = r"(\bdef[ \t]+(\w+)[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*?=[ \t]*)([\[{])"
    ours = rules("PY-BUG-AST004")[0].pattern
    assert [m.span(3) for m in re.finditer(ours, text)] == [m.span(3) for m in re.finditer(lazy, text)]


def test_java_methods_agree_with_the_plain_spelling(spark):
    import random

    from reviewlake.operators.symbols import java_symbols
    from reviewlake.rules.catalog import JAVA_METHOD_SHAPE

    rng = random.Random(7)
    parts = ["public", "static", "private", " ", " ", "\n", "int", "foo", "(", ")", "{", "}", "<T>", "[]", "throws E", ", ", "publicity", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 40))) for _ in range(4000)]
    texts += ["public Foo() {", "  public Foo () {", "static static int a(b c) throws D {", "x public static void main(String[] a) {\n} private int b(){", "staticpublic foo() {"]
    rows = [(i, "java", t) for i, t in enumerate(texts)]
    found = java_symbols(spark.createDataFrame(rows, "file_id long, language string, content string")).where("kind = 'function'")
    want = sorted((i, m[1], t[: m.start()].count("\n") + 1) for i, _, t in rows for m in re.finditer(JAVA_METHOD_SHAPE, t))
    assert sorted(tuple(r) for r in found.select("file_id", "name", "line_number").collect()) == want and len(want) > 15


def test_long_runs_of_modifiers_and_many_functions(spark):
    import time

    from reviewlake.operators.blocks import generic_functions
    from reviewlake.operators.symbols import java_symbols

    schema = "file_id long, language string, content string"
    long = ["static " * 60_000, " " * 400_000, "\n" * 400_000, "public " * 60_000 + "int f() {", "static" * 60_000]
    start = time.time()
    found = java_symbols(spark.createDataFrame([(i, "java", t) for i, t in enumerate(long)], schema)).collect()
    assert [(r.file_id, r["name"]) for r in found] == [(3, "f")]
    many = "fn f() {\n}\n" * 16_000
    found = generic_functions(spark.createDataFrame([(1, "rust", many)], schema))
    assert [tuple(r) for r in found.selectExpr("count(*)", "max(end_line)", "min(end_line - start_line)").collect()] == [(16_000, 32_000, 1)]
    assert time.time() - start < 60


PATTERNS = [
    "[[]", "x{", "foo{,3}", "(?P<n_1>a)", "(a)?b(?(1)c|d)", r"test_.*\.py", r"\w+é$", r"^(?i:AB)c\Z", "(?s)a.b", "(?x) a b # c",
    "(?P<q>[\"']).*(?P=q)", "a|b|", "[^\\]\\[a-z\\d]+?", "(?<=x)y(?!z)", "a{2,3}+", "[&&x]", "\\.py$",
]
NAMES = ["[", "x{", "foo{", "fo", "aXa", "abc", "bd", "ab", "test_a.py", "tést_é", "ABc", "aBc", "a\nb", '"x"', "'y", "", "A]1-]", "xyq", "xyz", "aaa", "&&", "m.py", "m.py\n"]


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_ignore_patterns_mean_the_same_in_the_jvm(spark):
    rows = [(n, p, jvm_pattern(p)) for n in NAMES for p in PATTERNS]
    found = spark.createDataFrame(rows, "n string, p string, j string").select("n", "p", F.rlike("n", F.col("j")).alias("m")).collect()
    assert [r for r in found if r.m != bool(re.search(r.p, r.n))] == []
    files = spark.createDataFrame([(1, n) for n in NAMES], "project_id long, filename string")
    table = spark.createDataFrame([(1, p) for p in [*PATTERNS[:5], "(", None]], "project_id long, pattern string")
    kept = {r.filename for r in drop_ignored(files, table).collect()}
    assert kept == {n for n in NAMES if not any(re.search(p, n) for p in PATTERNS[:5])}
    assert {r.pattern for r in rejected_patterns(table).collect()} == {"(", None}


def test_a_patch_of_a_large_file_is_analysed(spark):
    row = (1, 7, "a.py", "modified", 1, 0, "@@ -1 +1 @@\n+eval(x)", None, 600 * 1024)
    files = spark.createDataFrame([row], "file_id long, review_id long, filename string, status string, additions int, deletions int, patch string, content string, content_bytes long")
    result = review_files(files)
    assert result.findings.count() > 0 and result.files.first()["score"] < 100


def test_a_review_over_two_batches_has_one_score(spark):
    rows = [(1, 7, "a.py", "modified", 1, 0, "eval(x)\n" * 3), (2, 7, "b.py", "modified", 1, 0, "y = 1\n"), (1, 7, "a.py", "modified", 1, 0, "eval(x)\n")]
    schema = "file_id long, review_id long, filename string, status string, additions int, deletions int, content string"
    source, out = run_folder(spark, "files"), run_folder(spark, "out")
    options = ReviewOptions(categories=("security",))
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        runs.review_stream(stream, out, options).awaitTermination()
    batch = review_files(spark.createDataFrame(rows[1:], schema), options)
    columns = ["review_id", "files_analyzed", "total_findings", "score"]
    assert runs.stored_reviews(spark, out).select(columns).collect() == batch.reviews.select(columns).collect()


def test_a_redelivery_is_recorded_once(spark):
    import datetime
    import json

    at = datetime.datetime(2024, 1, 1)
    body = json.dumps({"action": "opened", "pull_request": {"html_url": "https://github.com/o/r/pull/7", "number": 7}, "repository": {"full_name": "o/r"}})
    schema = "delivery_id string, event_type string, signature string, body string, received_at timestamp"
    source, out = run_folder(spark, "incoming"), run_folder(spark, "recorded")
    projects = lambda: spark.sql("select 1 as project_id, 'o' as owner, 'r' as repo, true as auto_watch")
    for _ in range(2):
        spark.createDataFrame([("d1", "pull_request", "", body, at)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        runs.record_deliveries(stream, projects, out).awaitTermination()
    assert spark.read.parquet(f"{out}/webhooks").count() == 1
    assert spark.read.parquet(f"{out}/reviews").count() == 1
