"""Rule scans and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.bindings_sql import q, sql
from checks.q_files import WS, text_files
from reviewlake.operators import structure_rules as SR
from reviewlake.operators.scan import scan_rules
from reviewlake.rules import catalog as C
from reviewlake.rules.model import BLOCK_RULES, pattern_rules

QUERIES = {}
OUT = ["file_id", "rule_id", "category", "severity", "line_number", "message", "code_snippet"]

# patterns that need look-around (and the blocks) have no counterpart in the SQL dialect
NO_SQL = {
    "PY-ARCH001", "JS-BUG001", "JS-BUG002", "JS-BUG003", "JS-ARCH002", "TS-BUG003", "TS-BUG005", "GO-BUG002",
    "SOL-SEC003", "PERF-MEM001", "PERF-MEM002", "PERF-MEM003", "ARCH-ERR002", "ARCH-ERR003", "ARCH-MAG001",
    "BUG-INF001", "PY-BUG-AST003", "PY-BUG-AST001", "PY-BUG-AST004", "PY-SEC-AST001", "PY-PERF-AST003",
}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = (function, oracle)
        return function

    return add


def rules_named(*ids):
    return [r for r in pattern_rules(True) if r.id in ids]


def scanned(spark, sf, rules):
    return scan_rules(text_files(spark, sf), rules).select(*OUT)


def _in(languages, column="language"):
    if "*" in languages:
        return "true"
    return f"{column} in ({', '.join(q(x) for x in languages)})"


GUARD_SQL = {
    "": "true",
    "comment": "not case when language in ('python', 'ruby') then starts_with(stripped, '#') else"
               " starts_with(stripped, '//') or starts_with(stripped, '*') or starts_with(stripped, '/*') end",
    "secret": f"not regexp_matches(lower(line), '{'|'.join(C.PLACEHOLDER_WORDS)}')",
    "tag": "true",
    "long": "true",
}


def marked_lines(pattern, flags, languages, captures=(), source="text_files", text="content"):
    """SQL: lines of the text that hold the start of a match, with the captures of the first."""
    caught = "||chr(3)||".join(rf"'\{n}'" for n in captures) or "''"
    return rf"""
      select file_id, language, line_number, line, trim(line, {WS}) as stripped, captures from (
        select *, regexp_replace(marked_line, chr(1) || '[^' || chr(2) || ']*' || chr(2), '', 'g') as line,
          string_split(string_split(string_split(marked_line, chr(1))[2], chr(2))[1], chr(3)) as captures
        from (
          select file_id, language, unnest(parts) as marked_line, unnest(range(1, len(parts) + 1))::int as line_number
          from (select file_id, language, string_split(regexp_replace({text}, {q('(?' + flags + ')' + pattern)},
                  chr(1) || {caught} || chr(2) || '\0', 'g'), chr(10)) as parts
                from {source} where {_in(languages)}))
        where contains(marked_line, chr(1)))"""


def rule_sql(rule, pattern=None, source="text_files"):
    message = q(rule.message)
    for n in range(1, len(rule.captures) + 1):
        message = f"replace({message}, '{{{n}}}', captures[{n}])"
    snippet = "stripped"
    if rule.guard == "secret":
        snippet = """regexp_replace(stripped, '["''][^"'']{4,}["'']', '"[REDACTED]"', 'g')"""
    rule_id, severity = q(rule.id), q(rule.severity)
    if rule.guard == "tag":
        message = f"replace({q(rule.message)}, '{{1}}', upper(captures[1]))"
        rule_id = f"replace({q(rule.id)}, '{{1}}', upper(captures[1]))"
        severity = "case when upper(captures[1]) in ('BUG', 'FIXME') then 'warning' else 'suggestion' end"
    if rule.guard == "long":
        message = f"replace({q(rule.message)}, '{{n}}', length(line)::varchar)"
        snippet = "line[1:100] || '...'"
    return f"""
      select file_id, {rule_id} as rule_id, {q(rule.category)} as category, {severity} as severity, line_number,
        {message} as message, {snippet} as code_snippet
      from ({marked_lines(pattern or rule.pattern, rule.flags, rule.languages, rule.captures, source)})
      where {GUARD_SQL[rule.guard]}"""


def rules_sql(rules, needs=("text_files",)):
    return sql(needs, " union all ".join(rule_sql(r) for r in rules))


def _catalogue(language):
    ids = {entry[0] for entry in C.CATALOGUE[language]}
    return [r for r in pattern_rules() if r.id in ids and r.id not in NO_SQL and r.id not in BLOCK_RULES]


def _register_catalogue():
    for language in C.CATALOGUE:
        rules = _catalogue(language)
        name = "rules_universal" if language == "*" else f"rules_{language}"
        query(name, rules_sql(rules))(lambda spark, sf, rules=rules: scanned(spark, sf, rules))


_register_catalogue()


def _register_pack(name, *ids):
    rules = rules_named(*ids)
    query(name, rules_sql(rules))(lambda spark, sf: scanned(spark, sf, rules))


_register_pack("secrets", *[s[0] for s in C.SECRETS])
_register_pack("sql_injection", *[s[0] for s in C.SQL_INJECTION])
_register_pack("xss", *[s[0] for s in C.XSS])
_register_pack("command_injection", *[s[0] for s in C.COMMAND_INJECTION])
_register_pack("off_by_one", "BUG-OBO001")
_register_pack("line_length", "STY-LEN001")
_register_pack("redundant_loops", *[s[0] for s in C.REDUNDANT_LOOPS])
_register_pack("comment_tags", "ARCH-{1}001")
_register_pack("f_string_queries", "PY-SEC-AST002")
_register_pack("isinstance_pattern", "ARCH-OCP001")


@query("n_plus_one_braces", rules_sql([r for r in rules_named("PERF-N1001") if "python" not in r.languages]))
def _(spark, sf):
    return scanned(spark, sf, [r for r in rules_named("PERF-N1001") if "python" not in r.languages])


@query("js_naming", sql(["text_files"], f"""
  select file_id, line_number, captures[1] as name,
    'Rename to `' || parts[1] || array_to_string(list_transform(parts[2:],
      lambda p: upper(p[1:1]) || lower(p[2:])), '') || '`.' as suggestion
  from (select *, string_split(captures[1], '_') as parts from
    ({marked_lines(C.JS_SNAKE_NAME, '', ('javascript', 'typescript'), (1,))}))"""))
def _(spark, sf):
    found = scan_rules(text_files(spark, sf), rules_named("JS-NAM001"))
    return found.select(
        "file_id", "line_number", F.regexp_extract("message", "`(\\w+)`", 1).alias("name"), "suggestion"
    )


_EXITS = "|".join(rf"\b{w}\b" for w in C.INFINITE_LOOP_EXITS)


def _infinite_sql(language, head):
    return f"""
      select file_id, line_number from (
        select file_id, 1 + length(before) - length(replace(before, chr(10), '')) as line_number,
          left(array_to_string(parts[i:], ''), {C.INFINITE_LOOP_WINDOW}) as ahead
        from (select *, array_to_string(parts[1:i - 1], '') as before from (
          select *, unnest(range(2, len(parts) + 1)) as i from (
            select file_id, string_split(regexp_replace(content, {q('(?i)' + head)}, chr(1) || '\\0', 'g'), chr(1)) as parts
            from text_files where language = {q(language)}))))
      where not regexp_matches(ahead, '{_EXITS}')"""


@query("infinite_loops", sql(["text_files"], "select distinct file_id, line_number from (" + " union all ".join(
    _infinite_sql(k, v) for k, v in C.INFINITE_LOOP_HEADS.items()) + ")"))
def _(spark, sf):
    return scanned(spark, sf, rules_named("BUG-INF001")).select("file_id", "line_number")


_ACCEPTED = ", ".join(str(n) for n in C.ACCEPTABLE_NUMBERS)


@query("magic_numbers", sql(["text_files"], rf"""
  select file_id, line_number, 'Magic number `' || numbers[1] || '` — define as a named constant' as message,
    trim(line, {WS}) as code_snippet
  from (select *, list_filter(list_transform(regexp_extract_all(
        regexp_replace(line, '([^0-9A-Za-z_])', '\1\1', 'g'), '(?:^|[^''"\w.])(\d{{3,}})(?:$|[^\w''"])', 1),
        lambda n: n::bigint), lambda n: n not in ({_ACCEPTED})) as numbers
    from (select file_id, unnest(string_split(content, chr(10))) as line,
        unnest(range(1, len(string_split(content, chr(10))) + 1))::int as line_number from text_files where content <> ''))
  where len(numbers) > 0 and not regexp_matches(line, '^\s*[A-Z_]+\s*=') and not regexp_matches(trim(line, {WS}), '^(#|//|\*)')
    and not regexp_matches(line, '^\s*(import|from|require|#include)')"""))
def _(spark, sf):
    return scanned(spark, sf, rules_named("ARCH-MAG001")).select("file_id", "line_number", "message", "code_snippet")


@query("any_numbers", sql(["text_files"], r"""
  select file_id, line_number from (select file_id, language, unnest(string_split(content, chr(10))) as line,
        unnest(range(1, len(string_split(content, chr(10))) + 1))::int as line_number from text_files where content <> '')
  where language in ('python', 'javascript') and len(regexp_extract_all(
    regexp_replace(line, '([^0-9A-Za-z_])', '\1\1', 'g'), '(?:^|[^''"\w.])(\d{2,})(?:$|[^\w''"])', 1)) > 0"""))
def _(spark, sf):
    return scanned(spark, sf, rules_named("PY-ARCH001", "JS-ARCH002")).select("file_id", "line_number")


@query("lookaround_rules")
def _(spark, sf):
    """Patterns with look-around: no SQL dialect counterpart, tested against brute force."""
    ids = NO_SQL - {"PY-BUG-AST003"}
    return scanned(spark, sf, rules_named(*ids))


# ---- blocks by indentation -------------------------------------------------------------
SKIP = r"^[ \t]*(#.*)?$"
CLOSER = r"^[ \t]*[)\]}]"


def lines_sql(source):
    """SQL: lines classified, with their indentation."""
    return rf"""
      select file_id, language, n, line, regexp_extract(line, '^[ \t]*') as indent,
        regexp_matches(line, {q(SKIP)}) as skip, regexp_matches(line, {q(CLOSER)}) as closer
      from (select file_id, language, unnest(string_split(content, chr(10))) as line,
          unnest(range(1, len(string_split(content, chr(10))) + 1))::int as n from {source} where content <> '')"""


_DEEPER = "starts_with(b.line, h.indent) and regexp_matches(b.line[length(h.indent) + 1:], '^[ \\t]')"


def block_rule_sql(source, header, call, flags, languages, at_line_start=False):
    """SQL: per header the first line of its block that holds the call; of headers that lead to
    the same line the outermost."""
    head = rf"(?{flags})^[ \t]*{header}:[ \t]*(#.*)?$"
    target = rf"(?{flags})^[ \t]*{call}" if at_line_start else f"(?{flags}){call}"
    return f"""
      with lines as materialized ({lines_sql(source)}),
      pairs as (
        select h.file_id, h.n as start, b.n, not (b.skip or b.closer or ({_DEEPER})) as ends,
          not b.skip and not b.closer and ({_DEEPER}) and regexp_matches(b.line, {q(target)}) as calls
        from lines h join lines b on h.file_id = b.file_id and b.n > h.n
        where regexp_matches(h.line, {q(head)}) and {_in(languages, 'h.language')}),
      first as (select file_id, start, min(n) filter (ends) as ends, min(n) filter (calls) as call from pairs group by 1, 2)
      select file_id, min(start)::int as line_number from first
      where call is not null and (ends is null or call < ends) group by file_id, call"""


_FOR = r"(async[ \t]+)?for\s.+"
_FOR_NAMES = r"(async[ \t]+)?for\s+\w+\s+in\s+\w+[^:]*"


def _register_block(name, rule_id, header, call, flags, languages, at_line_start=False, long=False):
    source = "code_files" if long else "text_files"
    rules = [r for r in rules_named(rule_id) if set(languages) <= set(r.languages)]

    def run(spark, sf):
        files = B.code_files(spark, sf) if long else text_files(spark, sf)
        return scan_rules(files, rules).select("file_id", "line_number")

    query(name, sql([source], block_rule_sql(source, header, call, flags, languages, at_line_start)))(run)


for _suffix, _long in (("", False), ("_long_files", True)):
    _register_block("loop_query" + _suffix, "PERF001", _FOR, r"(\.filter\(|\.find\(|\.query\(|SELECT)", "mi", ("*",), long=_long)
    _register_block("loop_global" + _suffix, "PY-PERF004", _FOR, r"global\s", "mi", ("python",), True, _long)
    _register_block("n_plus_one_python" + _suffix, "PERF-N1001", _FOR_NAMES, C.N_PLUS_ONE_PYTHON_CALLS, "m", ("python",), long=_long)
    _register_block("unbounded_while" + _suffix, "PERF-UNB001", r"while\s+True[^:]*", r"\w+\.(append|add|update|push)\s*\(", "m", ("*",), True, _long)


@query("list_growth_and_reentrancy")
def _(spark, sf):
    """Block rules without SQL counterpart (group references), tested on fixtures."""
    rules = rules_named("PERF-UNB002", "SOL-BUG001", "ARCH-ERR001")
    return scan_rules(B.code_files(spark, sf), rules).select("file_id", "rule_id", "line_number", "code_snippet")


def _except_sql(source):
    return rf"""
      with lines as ({lines_sql(source)}),
      code as (select *, lead(line) over w as l1, lead(line, 2) over w as l2 from lines
        where language = 'python' and not skip window w as (partition by file_id order by n))
      select file_id, n as line_number from code
      where regexp_matches(line, '^[ \t]*except\b.*:') and (
        regexp_matches(line, '^[ \t]*except\b.*?:[ \t]*pass[ \t]*(#.*)?$')
        or (regexp_matches(line, '^[ \t]*except\b.*?:[ \t]*(#.*)?$')
          and starts_with(l1, indent) and regexp_matches(l1[length(indent) + 1:], '^[ \t]+pass[ \t]*(#.*)?$')
          and not coalesce(starts_with(l2, indent) and regexp_matches(l2[length(indent) + 1:], '^[ \t]'), false)))"""


@query("except_pass", sql(["text_files"], _except_sql("text_files")))
def _(spark, sf):
    return scan_rules(text_files(spark, sf), rules_named("PY-BUG-AST003")).select("file_id", "line_number")


@query("except_pass_long_files", sql(["code_files"], _except_sql("code_files")))
def _(spark, sf):
    return scan_rules(B.code_files(spark, sf), rules_named("PY-BUG-AST003")).select("file_id", "line_number")


_CODE_VIEW = r'''"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|#[^\n]*'''


def _code_rules_sql():
    parts = []
    for rule in rules_named("PY-BUG-AST001", "PY-SEC-AST001", "PY-PERF-AST003"):
        # the look-around parts in the words of the SQL dialect
        pattern = rule.pattern.replace("*+", "*")  # the dialect takes linear time without possessive repeats
        pattern = pattern.replace(r"(?=[ec])(?<!\bdef )", "").replace(
            r"(?=[aslmt])(?<![.\w])", r"(?:^|[^.\w\n])"
        )
        caught = f"lower(captures[1])" if rule.id == "PY-BUG-AST001" else "captures[1]"
        parts.append(f"""
          select file_id, {q(rule.id)} as rule_id, line_number, {caught} as name from (
            {marked_lines(pattern, rule.flags, rule.languages, rule.captures, 'viewed', 'code')})
          where {GUARD_SQL[rule.guard]}""")
    viewed = f"""with viewed as materialized (
      select *, regexp_replace(content, {q(_CODE_VIEW)}, '""', 'g') as code from text_files where language = 'python')"""
    return sql(["text_files"], viewed + " union all ".join(parts))


@query("python_calls", _code_rules_sql())
def _(spark, sf):
    found = scan_rules(text_files(spark, sf), rules_named("PY-BUG-AST001", "PY-SEC-AST001", "PY-PERF-AST003"))
    return found.select(
        "file_id", "rule_id", "line_number",
        F.regexp_extract("message", "`\\.?(\\w+)(?:\\(\\))?`", 1).alias("name"),
    )


@query("mutable_defaults", sql(["text_files"], rf"""
  select file_id, line_number, captures[1] as name from ({marked_lines(
    r"(?:\bdef[ \t]+(\w+)[ \t]*\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*?=[ \t]*)[\[{]", "m", ("python",), (1,))})"""))
def _(spark, sf):
    found = scan_rules(text_files(spark, sf), rules_named("PY-BUG-AST004"))
    return found.select("file_id", "line_number", F.regexp_extract("message", "`(\\w+)\\(\\)`", 1).alias("name"))


@query("loop_subscripts", sql(["code_files"], rf"""
  with lines as materialized ({lines_sql('code_files')}),
  pairs as (
    select h.file_id, h.n as start, b.n, not (b.skip or b.closer or ({_DEEPER})) as ends, b.line, b.skip
    from lines h join lines b on h.file_id = b.file_id and b.n > h.n
    where h.language = 'python' and regexp_matches(h.line, '^[ \t]*(async[ \t]+)?for\b.*:[ \t]*(#.*)?$')),
  extents as (select file_id, start, coalesce(min(n) filter (ends), 1000000000) as ends from pairs group by 1, 2),
  bodies as (select p.file_id, p.n as line_number, p.line from pairs p join extents e using (file_id, start)
    where p.n < e.ends
    union select h.file_id, h.n, h.line from extents e join lines h on h.file_id = e.file_id and h.n = e.start)
  select distinct file_id, line_number, trim(line, {WS}) as code_snippet from bodies
  where regexp_matches(regexp_replace(line, {q(_CODE_VIEW)}, '""', 'g'), {q(SR.SUM_SUBSCRIPT)})"""))
def _(spark, sf):
    return SR.loop_subscript_findings(B.code_files(spark, sf)).select("file_id", "line_number", "code_snippet")


# a table of rules made from benchmark texts: a word of each, some in patterns that must not be used
_OWN = """select item_id, case when item_id % 5 = 0 then '(' || word when item_id % 5 = 1 then '(' || word || '+)+' else word end as pattern
  from (select item_id, regexp_extract(text, '[a-z]{6,}', 0) as word from benchmark)"""


@query("rules_of_a_table", f"""
  with own as (select 'OWN' || item_id as rule_id, pattern from ({_OWN}) where item_id % 5 > 1 and pattern <> ''),
  lines as (select doc_id as file_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line_number
    from documents where text is not null)
  select file_id, rule_id, line_number, 'style' as category, 'suggestion' as severity, 'word' as message
  from lines join own on contains(lower(line), pattern)""")
def _(spark, sf):
    from reviewlake.rules.table import rules_of

    B.table(spark, sf, "benchmark").createOrReplaceTempView("benchmark_for_rules")
    rules, _ = rules_of(spark.sql(f"""
      select 'OWN' || item_id as id, 'style' as category, 'suggestion' as severity, pattern, 'word' as message, '' as suggestion,
        cast(null as array<string>) as languages, 'i' as flags from ({_OWN.replace("from benchmark)", "from benchmark_for_rules)")})"""))
    documents = B.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.lit("text").alias("language"), F.col("text").alias("content"))
    return scan_rules(documents, rules).select("file_id", "rule_id", "line_number", "category", "severity", "message")
