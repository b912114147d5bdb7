"""Languages, addresses, scores, signatures, text."""

import hashlib
import hmac
import pathlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.functions import scores, signature, text, urls
from reviewlake.functions.languages import language_of
from reviewlake.operators import patches as P
from reviewlake.rules import catalog as C
from reviewlake.sources.settings import read_settings


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in df.repartition(2).select("n", expression(F.col("v")).alias("x")).orderBy("n").select("x").collect()]


def test_languages(spark):
    names = ["main.py", "a.JS", "x/y.tsx", "Makefile", ".py", "a.", "..py", "d.py/", "pic.png", "a.b.sol", "x/.bashrc", "a.exs", ""]
    want = [C.EXTENSIONS.get(pathlib.PurePosixPath(n).suffix.lower(), "unknown") for n in names]
    assert column(spark, names, language_of) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n\r\t\x0b\x0c\x1c\x85 é", max_size=12), min_size=20, max_size=40))
def test_lines_and_strip_equal_python(spark, values):
    assert column(spark, values, text.split_lines) == [v.splitlines() for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.is_blank) == [not v.strip() for v in values]


def test_scores_round_as_python(spark):
    values = [100 - p / (2 * f) for f in range(1, 40) for p in range(0, 200, 7)] + [89.5, 0.05, 0.25, 0.35, 99.85, 99.95]
    assert column(spark, values, scores.one_decimal, "double") == [f"{v:.1f}" for v in values]
    rows = column(spark, values, scores.score_summary, "double")
    assert [r["percentage"] for r in rows] == [round(v) for v in values]
    assert [r["score"] for r in rows] == [round(v, 1) for v in values]


def test_bands(spark):
    values = [95.0, 75.0, 55.0, 20.0, 89.5, 100.0, 0.0]
    assert column(spark, values, scores.score_label, "double") == ["Excellent", "Good", "Needs Work", "Poor", "Poor", "Excellent", "Poor"]
    assert column(spark, [89.5], lambda c: scores.score_label(c, True), "double") == ["Good"]


@pytest.mark.parametrize("secret", ["s", "k" * 100])
def test_signatures(spark, secret):
    bodies = ["", "{}", "é" * 100]
    want = [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
    assert column(spark, bodies, lambda c: signature.hmac_sha256(c.cast("binary"), secret)) == want
    header = "sha256=" + want[1]
    assert column(spark, bodies, lambda c: signature.valid_signature(c.cast("binary"), F.lit(header), secret)) == [False, True, False]
    assert column(spark, bodies, lambda c: signature.valid_signature(c.cast("binary"), F.lit(""), secret)) == [False] * 3
    assert column(spark, bodies, lambda c: signature.valid_signature(c.cast("binary"), F.lit(None), secret)) == [False] * 3
    assert column(spark, bodies, lambda c: signature.valid_signature(c.cast("binary"), F.lit(""), "")) == [True] * 3


def test_addresses(spark):
    good = ["https://github.com/o/r/pull/1", "github.com/o/r.x/pull/22/files", "HTTP://GITHUB.COM/o/r.git/pull/3"]
    rows = column(spark, good + ["https://x.com/o/r/pull/1", "github.com/o/r/pulls/1", ""], urls.parse_pr_url)
    assert [tuple(r) if r else None for r in rows] == [("o", "r", 1), ("o", "r.x", 22), ("o", "r", 3), None, None, None]
    rows = column(spark, ["https://github.com/o/r", "github.com/o/r.git", "github.com/o/r/", "gitlab.com/o/r"], urls.parse_repo_url)
    assert [tuple(r) if r else None for r in rows] == [("o", "r"), ("o", "r"), ("o", "r"), None]
    assert column(spark, ["refs/heads/a/b", "refs/tags/v1", ""], urls.branch_of) == ["a/b", "refs/tags/v1", ""]


def test_patches(spark):
    patch = "--- a\n+++ b\n@@ -9,4 +10,5 @@ def\n same\n+new\n+    two\n-old\n    deep\n\\ No newline"
    got = column(spark, [patch, "+a\r\n b\r\n", ""], P.patch_content)
    assert got == ["same\nnew\n    two\ndeep\n\\ No newline", "a\nb", ""]
    df = spark.createDataFrame([(1, patch)], "file_id long, patch string")
    rows = P.patch_lines(df).orderBy("position").collect()
    assert [(r["line_number"], r["is_added"], r["is_removed"]) for r in rows if r["position"] > 2] == [
        (10, False, False), (11, True, False), (12, True, False), (12, False, True), (13, False, False), (14, False, False)]
    assert sum(r["is_added"] for r in rows) == 2


def test_case_converters(spark):
    assert column(spark, ["getUserName", "HTTPServer", "a1B"], text.to_snake_case) == ["get_user_name", "http_server", "a1_b"]
    assert column(spark, ["my_long_name", "a_b", "a__b"], text.to_camel_case) == ["myLongName", "aB", "aB"]


def test_settings(spark):
    defaults = spark.sql("select * from values ('github_token', ''), ('api_port', '8765'), ('log_level', 'INFO') as t(key, value)")
    stored = spark.sql("select * from values ('github_token', 'abc'), ('log_level', cast(null as string)) as t(key, value)")
    rows = {r["key"]: (r["value"], r["number"]) for r in read_settings(stored, defaults).collect()}
    assert rows == {"github_token": ("***", None), "api_port": ("8765", 8765), "log_level": ("", None)}


def test_checkpoint_folder_comes_from_the_session():
    from types import SimpleNamespace

    from reviewlake.session import run_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "/shared/x/"}[key]))
    assert run_folder(session, "run").startswith("/shared/x/run-")
    assert run_folder(session, "run") != run_folder(session, "run")


def test_patches_in_one_pass_are_those_by_lines(spark):
    rng = random.Random(3)
    parts = ["+", "-", "@@", "+++", "++", " ", "   ", "\t", "x", "\u00e9", "\\", "$1", "\n", "\n", "\n\n", "\r\n", "\u2028"]
    texts = ["".join(rng.choices(parts[: rng.choice((15, 17))], k=rng.randrange(0, 14))) for _ in range(1500)]

    def by_lines(text):
        lines = re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", re.sub("(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])\\Z", "", text))
        kept = [l for l in lines if not l.startswith(("-", "+++", "@@"))]
        return "\n".join(l[1:] if l.startswith("+") else l.lstrip(" ") for l in kept)

    assert column(spark, [*texts, None], P.patch_content) == [*map(by_lines, texts), None]
    many = "-gone\n" * 50_000 + "+kept\n" * 50_000  # no stack is used
    assert column(spark, [many], P.patch_content) == ["\n".join(["kept"] * 50_000)]
    plain = spark.createDataFrame([("+a",)], "patch string").select(P.patch_content(F.col("patch")))
    assert "(?:\\n(?:-|" in plain._jdf.queryExecution().analyzed().toString()
