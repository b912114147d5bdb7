"""Interval joins and tables of rules against brute force."""

import random
import re

import pytest

from reviewlake.operators import intervals as I
from reviewlake.operators.scan import scan_rules
from reviewlake.rules.model import pattern_rules
from reviewlake.rules.table import objection, rules_of


def brute(places, extents):
    return sorted((k, p, s, e, n) for k, p in places for k2, s, e, n in extents if None not in (k, p, s, e) and k == k2 and s <= p <= e)


def frames(spark, places, extents):
    return spark.createDataFrame(places, "file_id long, line_number int"), spark.createDataFrame(extents, "file_id long, start_line int, end_line int, name string")


@pytest.mark.parametrize("seed", range(3))
def test_holding(spark, seed):
    rng = random.Random(seed)
    places = [(rng.randint(0, 3), rng.randint(-50, 3000)) for _ in range(400)] + [(None, 5), (1, None), (1, 7), (1, 7)]
    extents = []
    for i in range(150):
        start = rng.randint(-60, 2500)
        extents.append((rng.randint(0, 3), start, start + rng.choice([0, 1, 2, 3, 7, 8, 9, 100, 1023, 1024, 1025, 2900]), str(i)))
    extents += [(None, 0, 9, "n"), (1, None, 9, "n"), (1, 0, None, "n"), (1, 9, 5, "backwards"), extents[0]]
    found = I.holding(*frames(spark, places, extents), ["file_id"])
    assert sorted(tuple(r) for r in found.select("file_id", "line_number", "start_line", "end_line", "name").collect()) == brute(places, extents)
    inner = {(r.file_id, r.line_number): (r.held_by, r.start_line, r.end_line, r["name"]) for r in I.innermost(*frames(spark, places, extents), ["file_id"]).collect()}
    want = {}
    for k, p, s, e, n in brute(sorted(set(places), key=str), extents):
        want.setdefault((k, p), []).append((-s, e, n))
    assert inner == {at: (len(v), -min(v)[0], min(v)[1], min(v)[2]) for at, v in want.items()}


def test_a_long_file_with_long_extents(spark, monkeypatch):
    places = spark.range(100_000).selectExpr("1L as file_id", "cast(id as int) as line_number")
    extents = [(1, 10 * i, 10 * i + 4, f"s{i}") for i in range(5_000)] + [(1, 0, 99_999, "all"), (1, 5, 70_000, "most")]
    found = I.innermost(places, frames(spark, [(1, 1)], extents)[1], ["file_id"]).groupBy("held_by").count().collect()
    want = {}
    for line in range(100_000):
        n = 1 + (5 <= line <= 70_000) + (line < 50_000 and line % 10 < 5)
        want[n] = want.get(n, 0) + 1
    assert {r.held_by: r["count"] for r in found} == want


def test_nothing_and_clashing_names(spark):
    places, extents = frames(spark, [(1, 1)], [(1, 1, 2, "a")])
    assert I.holding(places, extents.where("false"), ["file_id"]).count() == 0
    assert I.holding(places.where("false"), extents, ["file_id"]).count() == 0
    with pytest.raises(ValueError, match="name"):
        I.holding(places.selectExpr("*", "'x' as name"), extents, ["file_id"])


SCHEMA = "id string, category string, severity string, pattern string, message string, suggestion string, languages array<string>, flags string"


def test_rules_of_a_table(spark):
    rows = [
        ("A1", "style", "warning", r"print\s*\(", "print", "log", ["python"], None), ("A2", "bugs", "critical", r"\bgoto\s+(\w+)", "goto", None, None, "m"),
        ("B1", "bugs", "critical", r"(a+)+b", "slow", "", None, None), ("B2", "bugs", "critical", "(unclosed", "bad", "", None, None), ("B3", "bugs", "critical", r"(?:ab|\s)+c", "deep", "", None, None),
        ("B4", "bugs", "critical", "x*", "empty", "", None, None), ("B5", "bugs", "critical", None, "none", "", None, None), ("B6", "bugs", "critical", "x", None, "", None, None),
        ("A1", "style", "warning", "zzz", "again", "", None, None), (None, "style", "warning", "x", "no id", "", None, None), ("B7", "bugs", "critical", "x", "m", "", None, "xq"),
        ("A3", "bugs", "critical", r"(?:ab|\s)++c", "kept", "", None, None),
    ]
    good, aside = rules_of(spark.createDataFrame(rows, SCHEMA))
    assert [r.id for r in good] == ["A1", "A2", "A3"]
    reasons = dict(aside)
    assert reasons.keys() == {"A1", "B1", "B2", "B3", "B4", "B5", "B6", "B7", None}
    assert reasons["B1"].startswith("grows") and reasons["B3"].startswith("recursion") and reasons["B2"].startswith("no pattern")
    files = spark.createDataFrame([(1, "python", "x = 1\nPRINT (x)"), (2, "go", "print(1)\ngoto end")], "file_id long, language string, content string")
    found = sorted((r.file_id, r.rule_id, r.line_number) for r in scan_rules(files, good).collect())
    assert found == [(1, "A1", 2), (2, "A2", 2)]
    assert rules_of(spark.createDataFrame(rows, SCHEMA).where("false")) == ([], [])


def test_objections():
    for fine in (r"\w+\s*=", r"(?:a|b)c", r"[^)]*\)", r"(?:ab){2,5}", r"x(?:a\w)?y"):
        assert objection(fine) is None, fine
    assert objection("(?P<n>x)") and objection(r"(?:\w+,)*x") and objection("")
    assert sum(objection(r.pattern, r.flags) is None for r in pattern_rules(True)) > 150


def test_first_characters_never_hide_a_match():
    from checks.snippets import SNIPPETS
    from reviewlake.rules.model import beginning

    used = 0
    for rule in pattern_rules(True):
        ahead = beginning(rule.pattern, "i" in rule.flags)
        used += bool(ahead)
        flags = sum({"m": re.M, "i": re.I, "s": re.S}[f] for f in rule.flags)
        plain = rule.pattern.replace(r"\z", r"\Z")
        inline = re.match(r"\(\?[a-z]+\)", plain)
        both = (inline[0] if inline else "") + ahead + plain[inline.end() if inline else 0 :]
        for text in ("\n".join(SNIPPETS), *SNIPPETS):
            if text.isascii():
                assert [m.span() for m in re.finditer(both, text, flags)] == [m.span() for m in re.finditer(plain, text, flags)], rule.id
    assert used > 60


def test_places_are_looked_up_in_every_second_level_only(spark):
    lengths = sorted({max(1, 2**b + d) for b in range(41) for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(5, 5 + n - 1, n) for n in lengths], "s long, e long, n long")
    levels = {r.n: r.level for r in rows.select("n", I._level(rows.s, rows.e).alias("level")).collect()}
    assert all(n <= 2 ** levels[n] < max(2, 4 * n) for n in lengths)
    assert len(set(levels.values())) <= 22
