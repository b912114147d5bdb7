"""Blocks and structural rules, among others against Python's syntax tree on real sources."""

import ast
import glob
import os

from pyspark.sql import functions as F

from reviewlake.operators import blocks as K
from reviewlake.operators import metrics as M
from reviewlake.operators import structure_rules as SR
from reviewlake.operators import symbols as Y
from reviewlake.operators.scan import scan_rules
from reviewlake.rules.model import pattern_rules

SCHEMA = "file_id long, language string, content string"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def frame(spark, *texts, language="python"):
    return spark.createDataFrame([(n, language, t) for n, t in enumerate(texts)], SCHEMA)


def sources():
    paths = sorted(glob.glob(f"{ROOT}/reviewlake/**/*.py", recursive=True)) + [os.path.abspath(ast.__file__)]
    for folder in (os.path.dirname(ast.__file__),):
        paths += sorted(glob.glob(f"{folder}/[a-e]*.py"))[:40]
    return [open(p, encoding="utf-8").read() for p in paths]


def test_python_blocks_equal_syntax_tree(spark):
    texts = [t for t in sources() if len(t) < 500_000]
    functions, classes, handlers = set(), set(), set()
    for n, text in enumerate(texts):
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                functions.add((n, node.name, node.lineno, node.end_lineno))
            elif isinstance(node, ast.ClassDef):
                classes.add((n, node.name, node.lineno, node.end_lineno))
            elif isinstance(node, ast.Try):
                handlers |= {
                    (n, h.lineno) for h in node.handlers if len(h.body) == 1 and isinstance(h.body[0], ast.Pass)
                }
    df = frame(spark, *texts).repartition(4)
    got = K.code_blocks(df, ("function", "class")).select("kind", "file_id", "name", "start_line", "end_line").collect()
    assert {tuple(r)[1:] for r in got if r["kind"] == "function"} == functions
    assert {tuple(r)[1:] for r in got if r["kind"] == "class"} == classes
    rule = [r for r in pattern_rules() if r.id == "PY-BUG-AST003"]
    assert {tuple(r) for r in scan_rules(df, rule).select("file_id", "line_number").collect()} == handlers
    assert len(functions) > 500 and len(handlers) > 20


def test_decorators_params_imports(spark):
    text = "import os, sys as s\nfrom a.b import (c,\n   d as e)\n@deco(1)\n@other\nasync def f(a, b: D[str, int] = {}, *args, k=1):\n    pass\n"
    df = frame(spark, text)
    row = K.python_blocks(df, "function").select("decorators", K.python_params(F.col("text")).alias("params")).first()
    assert (row["decorators"], row["params"]) == (["deco(1)", "other"], ["a", "b"])
    assert {r["module"] for r in K.python_imports(df).collect()} == {"os", "sys", "a.b.c", "a.b.d"}


def test_generic_functions(spark):
    text = "pub fn skip() {}\nfn main(a: i32) {\n    if x { y() }\n}\npublic fn b (x) {\n}\ndef foo(a)\n  b\nend\n"
    rows = K.generic_functions(frame(spark, text, language="rust")).select("name", "start_line", "end_line").collect()
    assert sorted(map(tuple, rows)) == [("b", 5, 6), ("foo", 7, 8), ("main", 2, 4)]


def test_symbols(spark):
    js = "import React from 'react'\nfunction load(a) {\n}\nconst go = (x) => x\nclass Panel {}\nif (a) {\n}\nFoo(a) {\n"
    got = {(r["kind"], r["name"], r["line_number"]) for r in Y.js_symbols(frame(spark, js, language="javascript")).collect()}
    assert got == {("import", "react", 1), ("function", "load", 2), ("function", "go", 4), ("class", "Panel", 5), ("function", "if", 6)}
    go = 'import "fmt"\nfunc main() {\n}\nfunc (s *Srv) Run() {\n}\ntype Srv struct {\n'
    got = {(r["kind"], r["name"], r["line_number"]) for r in Y.go_symbols(frame(spark, go, language="go")).collect()}
    assert got == {("import", "fmt", 1), ("function", "main", 2), ("function", "Run", 4), ("class", "Srv", 6)}


def rules_of(df, **options):
    return sorted((r["rule_id"], r["line_number"], r["end_line"]) for r in SR.structure_findings(df, **options).collect())


def test_lengths_and_nesting(spark):
    long = "def big_one():\n" + "".join(f"    a{n} = {n}\n" for n in range(109))
    deep = "def deep_one():\n" + "".join("    " * d + f"if x{d}:\n" for d in range(1, 5)) + "    " * 5 + "y()\n"
    got = rules_of(frame(spark, long, deep))
    assert ("ARCH-GOD001", 1, 110) in got and ("STY-LEN002", 1, 110) in got
    assert ("ARCH-NEST001", 1, 6) in got
    text = "def f():\n    if a and b or c:\n        for x in y:\n            while z:\n                if q:\n                    pass\n"
    row = M.functions_with_metrics(frame(spark, text)).first()
    assert (row["complexity"], row["nesting"], row["length"]) == (7, 5, 6)


def test_names_classes_chains(spark):
    text = "class lower_case:\n    def camelCase(self):\n        pass\n    def _Private(self):\n        pass\n"
    assert rules_of(frame(spark, text)) == [("PY-NAM001", 2, 2), ("PY-NAM002", 1, 1)]
    many = "class Big:\n" + "".join(f"    def m{n}(self):\n        return {n}\n\n" for n in range(21))
    got = rules_of(frame(spark, many))
    assert ("PY-ARCH-AST001", 1, 63) in got and ("PY-ARCH-AST002", 1, 63) in got
    with_init = many.replace("m0", "__init__")
    assert ("PY-ARCH-AST002", 1, 63) not in rules_of(frame(spark, with_init))
    chain = "".join(f"{'el' if n else ''}if isinstance(a, T{n}):\n    f{n}()\n" for n in range(5))
    assert [r for r in rules_of(frame(spark, chain)) if r[0] == "PY-ARCH-AST003"] == [
        ("PY-ARCH-AST003", 1, 1), ("PY-ARCH-AST003", 3, 3), ("PY-ARCH-AST003", 5, 5)]


def test_loop_subscripts(spark):
    text = "a = b[i + 1]\nfor i in x:\n    for j in y:\n        c = d[j + 1]\n    e = f[g(i + 1)]\n    s = 'q[i + 1]'\n"
    assert rules_of(frame(spark, text), categories=("bugs",)) == [("PY-BUG-AST002", 4, 4)]


def test_duplicates(spark):
    block = "".join(f"line_{n}\n\n" for n in range(7))
    got = [(r["line_number"], r["end_line"]) for r in SR.duplicate_findings(frame(spark, block + block)).orderBy("line_number").collect()]
    assert got == [(8, 14), (9, 15)]
    assert SR.duplicate_findings(frame(spark, block)).count() == 0


def test_switched_off_pack(spark):
    long = "def big():\n" + "".join(f"    a{n} = {n}\n" for n in range(51))
    assert ("ARCH-SRP002", 1, 52) in rules_of(frame(spark, long), solid=True)
    assert ("ARCH-SRP002", 1, 52) not in rules_of(frame(spark, long))
