"""The whole review on small inputs, options, and properties."""

import json

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import aggregates as A
from reviewlake.operators import findings as FI
from reviewlake.operators import selection as S
from reviewlake.plans.review import ReviewOptions, register_pack, review_files, select_files, unregister_pack
from reviewlake.rules.model import Rule

SCHEMA = (
    "file_id long, review_id string, filename string, status string, additions int, deletions int,"
    " patch string, content string, project_id long"
)


def files(spark, *rows):
    base = {"review_id": "r", "status": "modified", "additions": 1, "deletions": 0, "patch": None, "content": None, "project_id": 1}
    return spark.createDataFrame(
        [tuple({**base, "file_id": n, **row}[c.split()[0]] for c in SCHEMA.split(", ")) for n, row in enumerate(rows)], SCHEMA
    )


EVAL = {"filename": "a.py", "patch": "@@ -1,2 +1,3 @@\n def f(x):\n-    return x\n+    return eval(x)\n"}


def test_patch_is_reviewed(spark):
    result = review_files(files(spark, EVAL), ReviewOptions(categories=("bugs", "security")))
    row = result.reviews.first()
    assert row["files_analyzed"] == 1 and row["critical_count"] >= 1 and row["score"] < 100
    assert {r["category"] for r in result.findings.collect()} <= {"bugs", "security"}
    assert result.files.first()["lines_added"] == 1


def test_left_out_and_kept_files(spark):
    big = "x = 1\n" * 90_000
    result = review_files(files(
        spark, {"filename": "gone.py", "status": "removed"}, {"filename": "s.css", "content": "eval(x)"},
        {"filename": "blank.py", "content": " \n\t"}, {"filename": "none.py"},
        {"filename": "big.py", "content": big}, {"filename": "Makefile", "content": "eval(x)"},
    ))
    rows = {r["filename"]: r for r in result.files.collect()}
    assert set(rows) == {"blank.py", "none.py", "big.py"}
    assert all(r["score"] == 100 and r["findings_count"] == 0 for r in rows.values())
    assert rows["big.py"]["parse_error"] == S.TOO_LARGE and rows["blank.py"]["parse_error"] is None
    assert result.reviews.first()["files_analyzed"] == 3


def test_size_limit_is_exclusive(spark):
    df = files(spark, {"filename": "a.py", "content": "é" * 256_000}, {"filename": "b.py", "content": "é" * 256_000 + "x"})
    assert [r["is_oversize"] for r in S.flag_oversize(df).orderBy("file_id").collect()] == [False, True]


def test_ignore_patterns(spark):
    patterns = spark.createDataFrame([(1, r"test_.*\.py"), (1, "(broken"), (2, ".*"),
                                     (1, r"^(?P<twice>ab)(?P=twice)\.py\Z")], "project_id long, pattern string")
    df = files(spark, {"filename": "x/test_a.py"}, {"filename": "x/main.py"}, {"filename": "y.py", "project_id": 3},
               {"filename": "abab.py"}, {"filename": "abcb.py"})
    assert {r["filename"] for r in select_files(df, patterns).collect()} == {"x/main.py", "y.py", "abcb.py"}


def test_no_files(spark):
    result = review_files(files(spark, EVAL).where("false"))
    assert result.files.count() == 0 and result.findings.count() == 0
    reviews = spark.createDataFrame([("r",)], "review_id string")
    row = A.score_all_reviews(reviews, result.reviews).first()
    assert row["score"] == 100 and row["files_analyzed"] == 0


def test_clean_code_has_no_critical(spark):
    clean = "def add(a, b):\n    return a + b\n"
    result = review_files(files(spark, {"filename": "a.py", "content": clean}))
    assert result.findings.where("severity = 'critical'").count() == 0


def test_scores_follow_findings(spark):
    schema = "file_id long, severity string"
    def score(*severities):
        found = spark.createDataFrame([(1, s) for s in severities], schema)
        header = spark.createDataFrame([(1, "r")], "file_id long, review_id string")
        return A.file_scores(header, found).first()["score"]

    assert score() == 100 and score("critical") == 90 and score(*["critical"] * 11) == 0
    assert score("critical", "warning", "suggestion") == 84 and score("odd") == 99


def test_dedupe_keeps_first(spark):
    rows = [
        (1, "bugs", 3, "R1", "a", 2), (1, "bugs", 3, "R1", "b", 1), (1, "bugs", None, "R1", "c", 3), (1, "bugs", None, "R1", "d", 4),
        (1, "bugs", 3, "", "m" * 50 + "x", 5), (1, "bugs", 3, None, "m" * 50 + "y", 6), (2, "bugs", 3, "R1", "e", 7),
    ]
    df = spark.createDataFrame(rows, "file_id long, category string, line_number int, rule_id string, message string, ordinal long")
    kept = FI.dedupe_findings(df)
    assert sorted(r["ordinal"] for r in kept.collect()) == [1, 3, 5, 7]
    assert FI.dedupe_findings(kept).count() == 4


def test_packs_and_extra_rules(spark):
    def pack(texts):
        return texts.select(
            "file_id", "language", F.lit("style").alias("category"), F.lit("warning").alias("severity"), F.lit("P-1").alias("rule_id"),
            F.lit(1).alias("line_number"), F.lit(1).alias("end_line"), F.lit("hello").alias("message"), F.lit("").alias("code_snippet"),
            F.lit("").alias("suggestion"), F.lit(5).cast("long").alias("ordinal"),
        )

    df = files(spark, {"filename": "a.py", "content": "frob = 1\nfrob = 2"})
    register_pack("own", pack)
    try:
        extra = Rule("X-1", "bugs", "critical", "frob", "frob", "", ("python",))
        ids = [r["rule_id"] for r in review_files(df, ReviewOptions(extra_rules=(extra,))).findings.collect()]
    finally:
        unregister_pack("own")
    assert ids.count("P-1") == 1 and ids.count("X-1") == 2


def test_strict_case(spark):
    df = files(spark, {"filename": "a.py", "content": "def lower():\n    pass\ndef camelCase():\n    pass"})
    def lines(**options):
        found = review_files(df, ReviewOptions(**options)).findings.where("rule_id = 'PY-STY001'")
        return sorted(r["line_number"] for r in found.collect())

    assert lines() == [1, 3] and lines(strict_case=True) == [3]


def operators(df):
    """Names of the physical operators of a plan."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        out.append(node.nodeName())
        children = node.children()
        todo += [children.apply(n) for n in range(children.size())]
    return out


def test_findings_need_no_shuffle(spark, sf):
    from checks import bindings as B
    from reviewlake.operators.scan import scan_rules
    from reviewlake.operators.structure_rules import block_findings

    df = B.prose(spark, sf).withColumn("language", F.lit("python"))
    for plan in (scan_rules(df), block_findings(df)):
        names = operators(plan)
        assert not [n for n in names if "Exchange" in n or "Python" in n or "Arrow" in n or "Join" in n], names
        assert sum("Scan" in n for n in names) == 1


def test_skewed_keys_stay_whole(spark):
    from reviewlake.operators.history import nested_reviews, score_moves
    from reviewlake.operators.skew import with_part

    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    parted = with_part(hot, ["k"], F.col("v"), 100)
    sizes = parted.groupBy("k", "part").count()
    assert parted.count() == 3000 and sizes.agg(F.max("count")).first()[0] <= 110
    reviews = spark.createDataFrame([(1,)], "review_id long")
    rows = spark.range(1000).select(F.col("id").alias("file_id"), F.lit(1).cast("long").alias("review_id"), F.lit("f").alias("filename"))
    found = spark.range(5000).select((F.col("id") % 10).alias("file_id"), F.col("id").alias("ordinal"), F.lit("bugs").alias("category"))
    nested = nested_reviews(reviews, rows, found, limit=50)
    total = nested.select(F.explode("files").alias("f")).select(F.size("f.findings").alias("n"))
    assert total.agg(F.sum("n")).first()[0] == 5000
    assert nested.agg(F.max(F.size("files"))).first()[0] <= 120
    moves = spark.range(500).select(
        F.col("id").alias("review_id"), F.lit("hot").alias("repo_name"), F.col("id").cast("double").alias("score"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("created_at"))
    last = score_moves(moves).where("review_id = 499").first()
    assert (last["position"], last["change"], last["moving_average"]) == (500, 1.0, 497.0)


def test_texts_of_large_groups_are_whole(spark, sf):
    from checks import bindings as B

    df = B.code_files(spark, sf)
    sizes = B.snippet_lines(B.table(spark, sf, "lineitem"), 5).groupBy("l_suppkey").agg(F.sum(F.octet_length("code") + 1).alias("n"))
    both = df.join(sizes, df["file_id"] == sizes["l_suppkey"])
    assert both.count() == df.count() == sizes.count() and both.where("octet_length(content) = n - 1").count() == df.count()


@pytest.mark.parametrize("name", ["summary", "json"])
def test_reply_forms(spark, name):
    from reviewlake.functions.replies import NO_REPLY, parse_reply

    replies = [None, "", "plain " * 200, '{"summary": "s", "suggestions": ["a"]}', "```json\n{\"summary\": \"t\"}\n```", "{broken", "[1]"]
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    rows = [r["p"] for r in df.select(parse_reply(F.col("reply")).alias("p")).collect()]
    assert [r["summary"] for r in rows] == [NO_REPLY, NO_REPLY, ("plain " * 200)[:500], "s", "t", "{broken", "[1]"]
    assert rows[3]["suggestions"] == ["a"] and json.dumps(rows[4]["suggestions"]) == "[]"


def test_text_tree_has_a_file_for_each_id_in_few_folders(spark, tmp_path):
    from checks import bindings as B
    from reviewlake.sources import pull_requests as PR

    rows = [(n, f"text {n}\nü") for n in range(700)] + [(3, "again"), (None, "x"), (None, None), (800, None), (801, "")]
    folder = f"{tmp_path}/tree"
    B.write_text_tree(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert len(list((tmp_path / "tree").iterdir())) <= B.FOLDERS
    found = {r["filename"].rsplit("/", 1)[1]: r["content"] for r in PR.read_code_tree(spark, folder, "*.txt").collect()}
    assert len(found) == 703
    assert found["5.txt"] == "text 5\nü\n" and found["800.txt"] == found["801.txt"] == "\n"
    assert sorted(found["3.txt"].splitlines()) == ["again", "text 3", "ü"]
    assert sorted(found["without-id.txt"].split("\n")) == ["", "", "x"]
    empty = f"{tmp_path}/empty"
    B.write_text_tree(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert PR.read_code_tree(spark, empty, "*.txt").count() == 0


def test_tree_is_read_as_sparks_reader_reads_it(spark, tmp_path, monkeypatch):
    from reviewlake.sources import pull_requests as PR
    from reviewlake.sources import trees

    monkeypatch.setattr(trees, "ENTRIES", 3)
    monkeypatch.setattr(trees, "FILES", 4)
    monkeypatch.setattr(trees, "BATCH", 20)
    root = tmp_path / "a tree"
    for n in range(30):
        folder = root / f"d{n % 5}" / ("e" * (n % 4 + 1)) / "x=1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{n}.py").write_bytes(f"line {n}\n".encode() * (n % 3) + (b"\xff\xc3" if n % 7 == 0 else b""))
    for name in ("top.py", "ü.py", "no.txt", "_hidden.py", ".git.py", "_a=b.py", "_metadata.py", "c.py._COPYING_", "{a,b}.py"):
        (root / name).write_text(name)
    (root / "link.py").symlink_to(root / "top.py")
    (root / "dead.py").symlink_to(root / "nothing")
    for hidden in ("_h", ".git", "_metadata", "g._COPYING_"):
        (root / hidden).mkdir()
        (root / hidden / "f.py").write_text("hidden")
    (root / "d0" / "linked").symlink_to(root / "d1")

    def rows(df):
        return sorted(map(tuple, df.select("filename", "content").collect()))

    for pattern in ("*", "f[12]?.py", "{top,no}.*", "none"):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(str(root))
        want = rows(raw.select(F.col("path").alias("filename"), PR.decode_utf8(F.col("content")).alias("content")))
        assert rows(PR.read_code_tree(spark, str(root), pattern)) == want, pattern
    monkeypatch.undo()
    assert rows(PR.read_code_tree(spark, f"file://{root}/", "*.py")) == rows(PR.read_code_tree(spark, f"{tmp_path}/a*", "*.py"))
    assert rows(PR.read_code_tree(spark, f"{root}/top.py")) == [(f"file:{root}/top.py", "top.py")]
    plan = PR.read_code_tree(spark, str(root))._jdf.queryExecution().analyzed().toString()
    assert "binaryFile" not in plan  # no record of each file in the driver
