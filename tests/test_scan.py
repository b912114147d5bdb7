"""Native match positions against brute force with Python's own expressions."""

import random
import re

from pyspark.sql import functions as F

from checks.snippets import SNIPPETS
from reviewlake.operators import scan
from reviewlake.operators.scan import CODE_VIEW, cheapest_first, digit_run, rules_literal, scan_rules, with_candidates
from reviewlake.rules import catalog as C
from reviewlake.rules.model import BLOCK_RULES, Rule, pattern_rules, required_literals, required_size

FLAGS = {"m": re.M, "i": re.I, "s": re.S}


def corpus(seed, count=60):
    rng = random.Random(seed)
    extras = ("café = motdepasse  ", "x = 12.5 + 1234", "naïve_été(été) # TODO ärger", "\t\t\t\tdeep()", "a=1\r",
              "                    very(deep)", "x" * 121, "y" * 120, "", "for i in range(3):", "PASSWORD = 'LongEnough'",
              "ſelect * from t + x", "K = 3")
    for number in range(count):
        lines = [rng.choice(SNIPPETS + extras) for _ in range(rng.randint(0, 40))]
        yield number, rng.choice(C.SUPPORTED_LANGUAGES), "\n".join("    " * rng.randint(0, 3) + l for l in lines)


def in_comment(stripped, language):
    return stripped.startswith("#") if language in ("python", "ruby") else stripped.startswith(("//", "*", "/*"))


def brute_force(rule, language, text):
    flags = sum(FLAGS[f] for f in rule.flags)
    view = text
    if rule.view == "code" and language == "python":
        view = re.sub(CODE_VIEW, '""', text)
    lines, out = text.split("\n"), {}
    for match in re.finditer(rule.pattern.replace(r"\z", r"\Z"), view, flags):
        number = view[: match.start(rule.rest) if rule.lead else match.start()].count("\n") + 1
        line = lines[number - 1]
        stripped = line.strip()
        if rule.guard == "comment" and in_comment(stripped, language):
            continue
        if rule.guard == "secret" and any(w in line.lower() for w in C.PLACEHOLDER_WORDS):
            continue
        if rule.guard == "number" and (
            re.match(r"\s*[A-Z_]+\s*=", line) or stripped.startswith(("#", "//", "*"))
            or re.match(r"\s*(import|from|require|#include)", line)
        ):
            continue
        rule_id = rule.id.replace("{1}", match.group(1).upper()) if rule.guard == "tag" else rule.id
        snippet = stripped
        if rule.guard == "secret":
            snippet = re.sub(C.REDACTED_LITERAL, C.REDACTION, stripped)
        elif rule.guard == "long":
            snippet = line[:100] + "..."
        out.setdefault((rule_id, number), snippet)
    return {(r, n, s) for (r, n), s in out.items()}


def original(rule):
    """The pattern as stated in the catalogue (Python spelling)."""
    for entries in C.CATALOGUE.values():
        for entry in entries:
            if entry[0] == rule.id and rule.id != "JS-SEC005":
                return entry[3]
    return rule.pattern


def test_every_line_rule_equals_brute_force(spark):
    from dataclasses import replace

    rules = [r for r in pattern_rules(True) if r.id not in BLOCK_RULES and r.id != "BUG-INF001"]
    texts = [row for seed in range(1, 6) for row in corpus(seed)]
    rows = [(i, language, text) for i, (_, language, text) in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_id long, language string, content string").repartition(4)
    got = {tuple(r) for r in scan_rules(df, rules).select("file_id", "rule_id", "line_number", "code_snippet").collect()}
    want = set()
    for number, language, text in rows:
        for rule in rules:
            if rule.applies_to(language):
                want |= {(number, *f) for f in brute_force(replace(rule, pattern=original(rule)), language, text)}
    assert len(want) > 1500
    assert not want - got, sorted(want - got)[:5]
    assert not got - want, sorted(got - want)[:5]


def test_infinite_loop_window(spark):
    rule = [r for r in pattern_rules() if r.id == "BUG-INF001" and "python" in r.languages]
    head = "while True:"
    room = C.INFINITE_LOOP_WINDOW - len(head)
    cases = {
        "no exit": ("\n  x()\n" * 10, True),
        "break": ("\n  break", False),
        "last place": (" " * (room - 5) + "break", False),
        "cut inside the word": (" " * (room - 4) + "break", True),
        "whole word cut by the window": (" " * (room - 5) + "breaks", False),
        "longer word inside": (" breaks " + "x " * 400, True),
        "upper case": ("\n BREAK", True),
        "return": ("\n return 1", False),
    }
    rows = [(n, "python", head + tail) for n, (tail, _) in enumerate(cases.values())]
    df = spark.createDataFrame(rows, "file_id long, language string, content string")
    hit = {r[0] for r in scan_rules(df, rule).select("file_id").collect()}
    for n, (name, (tail, expected)) in enumerate(cases.items()):
        text = head + tail
        brute = not re.search(r"\bbreak\b|\breturn\b|\bexit\b|\bpanic\b", text[:500])
        assert brute == expected, name
        assert (n in hit) == expected, name


def test_required_literals_never_hide_a_match():
    for rule in pattern_rules(True):
        for snippet in SNIPPETS:
            for match in re.finditer(rule.pattern.replace(r"\z", r"\Z"), snippet, sum(FLAGS[f] for f in rule.flags)):
                text = match.group(0).lower()
                for one_of in required_literals(rule.pattern):
                    assert any(l in text for l in one_of) or any(l in snippet.lower() for l in one_of), rule.id


def test_control_characters_do_not_disturb(spark):
    text = "a\x01b\x02 = 1\nresult = eval(x)\x03"
    df = spark.createDataFrame([(1, "python", text)], "file_id long, language string, content string")
    got = scan_rules(df, [r for r in pattern_rules() if r.id == "PY-SEC001"]).collect()
    assert [(r["line_number"]) for r in got] == [2]


def test_own_rule(spark):
    rule = Rule("X-1", "style", "warning", r"frob(\w+)", "no `{1}`", "stop", ("go",), captures=(1,))
    df = spark.createDataFrame([(1, "go", "a\nFROBnicate()"), (2, "java", "frobX")], "file_id long, language string, content string")
    rows = scan_rules(df, [rule]).collect()
    assert [(r["file_id"], r["line_number"], r["message"]) for r in rows] == [(1, 2, "no `nicate`")]


def found(spark, language, text, *ids):
    df = spark.createDataFrame([(1, language, text)], "file_id long, language string, content string")
    rules = [r for r in pattern_rules() if r.id in ids]
    return sorted((r["rule_id"], r["line_number"]) for r in scan_rules(df, rules).collect())


def test_block_rules(spark):
    loop = "for u in users:\n    # note .query(\n\n    a = 1\n    for v in u:\n        db.query(v)\nother.query(1)\n"
    assert found(spark, "python", loop, "PERF001", "PERF-N1001") == [("PERF-N1001", 1), ("PERF001", 1)]
    assert found(spark, "python", "for u in users:\n    a = 1\ndb.query(u)\n", "PERF001", "PERF-N1001") == []
    assert found(spark, "python", "while True:\n    x = 1\n    out.append(x)\n", "PERF-UNB001") == [("PERF-UNB001", 1)]
    grow = "items = []\nn = 0\nfor x in xs:\n    items.append(x)\n"
    assert found(spark, "python", grow, "PERF-UNB002") == [("PERF-UNB002", 1)]
    assert found(spark, "python", grow.replace("items.app", "other.app"), "PERF-UNB002") == []
    call = "(bool ok, ) = to.call{value: v}('');\nlog(1);\nbalance = 0;\n"
    assert found(spark, "solidity", call, "SOL-BUG001") == [("SOL-BUG001", 1)]
    assert found(spark, "solidity", call.replace("balance = 0", "send(1)"), "SOL-BUG001") == []
    wait = "async function f() {\n  if (a) { b(); }\n  await g();\n}\n"
    assert found(spark, "javascript", wait, "ARCH-ERR001") == [("ARCH-ERR001", 1)]
    guarded = "async function f() {\n  try { x(); }\n  await g(); } catch (e) { }\n"
    pattern = r"async\s+function\s+\w+[^{]*\{(?:[^{}]|\{[^{}]*\})*?await\s+[^;]+;(?![^{}]*catch)"
    assert bool(found(spark, "javascript", guarded, "ARCH-ERR001")) == bool(re.search(pattern, guarded))


def test_backtracking_hazard_is_gone(spark):
    body = "".join(f"    value_{n} = compute(value_{n})\n" for n in range(4000))
    text = "for item in things:\n" + body
    assert found(spark, "python", text, "PERF001", "PY-PERF004", "PERF-N1001", "PERF-UNB002") == []


def test_literal_tests_are_fewer_and_decide_the_same():
    assert cheapest_first([("secret_key", "secret", "auth_secret"), ("=", ":")]) == [["secret"], ["=", ":"]]
    fewer = 0
    for rule in pattern_rules():
        old = required_literals(rule.pattern)
        new = cheapest_first(old)
        assert sorted(map(sorted, new)) == sorted(sorted(x for x in s if all(y == x or y not in x for y in s)) for s in old)
        fewer += sum(map(len, old)) - sum(map(len, new))
    assert fewer > 0


def test_size_that_a_match_needs():
    assert required_size(r"^[^\r\n]{121,}") == (121, 0)
    assert required_size(r"(?<!\w)(?=\d{3,}\b)0*(\d+)") == (1, 3)
    assert required_size(r"a(?:\d{4}|\d\d)?(?:[0-9x]{9}|\d{2})") == (3, 0)
    assert required_size(r"(?:\d{4}-|v\d+)x*") == (2, 1)
    assert required_size(r"\h(") == (0, 0)


def _prepared(spark, texts):
    rows = spark.createDataFrame([(n, language, text) for n, (language, text) in enumerate(texts)], "file_id long, language string, content string")
    ascii_ = scan.X.is_ascii(F.col("content"))
    return rows.select(
        "*", scan.X.fold(F.col("content")).alias("folded"), ascii_.alias("ascii"), F.length("content").alias("chars"),
        digit_run(F.col("content"), ascii_).alias("digits"), F.lit(None).cast("string").alias("code"),
    )


def test_texts_too_short_or_without_digits_are_not_tried(spark):
    rules = pattern_rules()
    texts = [("go", "x := 12"), ("go", "x := 1234"), ("go", "x" * 121), ("go", "x := \u0661\u0662\u0663"), ("python", "a = 7")]
    tried = {}
    for file, number in with_candidates(_prepared(spark, texts), rules, rules_literal(rules)).select("file_id", "rule_no").collect():
        tried.setdefault(file, set()).add(rules[number - 1].id)
    sized = {"ARCH-MAG001", "STY-LEN001", "PY-ARCH001"}
    assert [tried.get(n, set()) & sized for n in range(5)] == [set(), {"ARCH-MAG001"}, {"STY-LEN001"}, {"ARCH-MAG001"}, set()]


def test_runs_of_digits_and_rare_characters(spark):
    texts = ["", "a", "1a2", "x12", "1\n23", "x2345y", "\u00e9", "caf\u00e9 1"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    runs = rows.select("n", digit_run(F.col("t"), scan.X.is_ascii(F.col("t")))).orderBy("n").collect()
    assert [r[1] for r in runs] == [0, 0, 1, 2, 2, 3, 3, 3]
    ends = [*scan.X.OTHER_LINE_BREAKS, "\n", "\u00c2", "\u2027", "\x00"]
    rows = spark.createDataFrame([(n, f"a{c}b") for n, c in enumerate(ends)] + [(99, None)], "n int, t string")
    held = rows.select("n", scan.X.holds_any(F.col("t"), scan.X.OTHER_LINE_BREAKS)).orderBy("n").collect()
    assert [r[1] for r in held] == [True] * 9 + [False] * 4 + [None]


def test_spelled_rules_are_those_looked_up(spark, monkeypatch):
    rules = pattern_rules()
    rng = random.Random(5)
    languages = sorted({x for r in rules for x in r.languages if x != "*"}) + ["kotlin", None]
    texts = [(rng.choice(languages), "\n".join(rng.choices(SNIPPETS, k=rng.randrange(1, 5)))) for _ in range(300)]
    texts += [(language, text) for language in languages for text in ("", "caf\u00e9 = '\u0130f x'", "it's a \\ 'quote'")]
    files = spark.createDataFrame([(n, *row) for n, row in enumerate(texts)], "file_id long, language string, content string")
    want = None
    for spelled in (scan.MOST_SPELLED, 40, 0):
        monkeypatch.setattr(scan, "MOST_SPELLED", spelled)
        got = sorted(map(str, scan_rules(files, rules).collect()))
        assert got and want in (None, got)
        want = got
