"""Code structure, metrics and structural findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.bindings_sql import q, sql
from checks.q_files import WS, text_files
from checks.q_rules import _DEEPER, lines_sql
from reviewlake.operators import blocks as K
from reviewlake.operators import intervals as I
from reviewlake.operators import metrics as M
from reviewlake.operators import structure_rules as SR
from reviewlake.operators import symbols as Y
from reviewlake.rules import catalog as C

QUERIES = {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = (function, oracle)
        return function

    return add


HEADS = {
    "function": r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(",
    "class": r"^[ \t]*class[ \t]+(\w+)[ \t]*[:(]",
    "chain": r"^[ \t]*(?:el)?(if)\b",
}


def blocks_sql(kind, name):
    """SQL expressions (as CTEs): extents of python blocks by indentation."""
    deeper = _DEEPER
    if kind == "chain":
        deeper = f"({_DEEPER} or (starts_with(b.line, h.indent || 'elif') and regexp_matches(b.line[length(h.indent) + 1:], '^elif\\b')))"
    return rf"""
      {name}_heads as (select *, regexp_extract(line, {q(HEADS[kind])}, 1) as name from lines
        where language = 'python' and regexp_matches(line, {q(HEADS[kind])})),
      {name}_pairs as (select h.file_id, h.n as start, b.n, b.skip, not (b.skip or b.closer or {deeper}) as ends
        from {name}_heads h join lines b on h.file_id = b.file_id and b.n > h.n),
      {name}_ends as (select file_id, start, coalesce(min(n) filter (ends), 1000000000) as stop from {name}_pairs group by 1, 2),
      {name}_last as (select file_id, start, max(n) as last from {name}_pairs join {name}_ends using (file_id, start)
        where n < stop and not skip group by 1, 2),
      {name} as materialized (select h.file_id, h.name, h.n as start_line, coalesce(l.last, h.n) as end_line, h.indent,
          (select string_agg(b.line, chr(10) order by b.n) from lines b where b.file_id = h.file_id
            and b.n between h.n and coalesce(l.last, h.n)) as text, h.line as head
        from {name}_heads h left join {name}_last l on h.file_id = l.file_id and h.n = l.start)"""


def lines_cte(source="code_files"):
    return f"with lines as materialized ({lines_sql(source)})"


def _count(token):
    return f"len(regexp_extract_all(text, '(?i){token}'))"


def complexity_sql():
    cases = " ".join(
        f"when {q(language)} then 1 + " + " + ".join(_count(t) for t in tokens)
        for language, tokens in C.BRANCH_TOKENS.items()
    )
    return f"case language {cases} end"


NESTING = f"""coalesce(list_max(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l, {WS}) <> ''),
  lambda l: (length(l) - length(ltrim(l, {WS}))) // 4)), 0)"""

_KEYWORD = rf"^({'|'.join(C.GENERIC_FUNCTION_WORDS)}) "


def generic_sql(languages, name="generic"):
    """SQL: functions of brace languages by gaps and islands."""
    inside = ", ".join(q(x) for x in languages)
    return rf"""
      {name}_tagged as (select *, regexp_matches(ltrim(line, {WS}), {q(_KEYWORD)}) as keyword,
          regexp_extract(trim(line, {WS}), '[\s(](\w+)\s*\(', 1) as fname,
          length(replace(line, '}}', '')) - length(replace(line, '{{', '')) as delta
        from lines where language in ({inside})),
      {name}_islands as (select *, sum((keyword and fname <> '')::int) over (partition by file_id order by n) as island
        from {name}_tagged),
      {name}_depths as (select *, sum(case when keyword and fname = '' then 0 else delta end)
          over (partition by file_id, island order by n) as depth from {name}_islands where island > 0),
      {name}_found as (select file_id, any_value(language) as language, island,
          max(case when keyword and fname <> '' then fname end) as name, min(n) as start_line,
          min(n) filter (not keyword and depth <= 0) as end_line
        from {name}_depths group by file_id, island),
      {name} as materialized (select file_id, language, name, start_line, end_line,
          (select string_agg(b.line, chr(10) order by b.n) from lines b where b.file_id = g.file_id
            and b.n between g.start_line and g.end_line) as text from {name}_found g where end_line is not null)"""


def functions_sql():
    return f"""{lines_cte()}, {blocks_sql('function', 'fns')}, {generic_sql(('rust', 'ruby', 'solidity'))},
      functions as (select file_id, 'python' as language, name, start_line, end_line, text from fns
        union all select file_id, language, name, start_line, end_line, text from generic),
      measured as (select *, end_line - start_line + 1 as length, ({complexity_sql()}) as complexity,
        {NESTING} as nesting from functions)"""


@query("python_functions", sql(["code_files"], f"""{lines_cte()}, {blocks_sql('function', 'fns')}
  select file_id, name, start_line::int as start_line, end_line::int as end_line, indent, text from fns"""))
def _(spark, sf):
    return K.python_blocks(B.code_files(spark, sf), "function").drop("decorators")


@query("python_classes", sql(["code_files"], f"""{lines_cte()}, {blocks_sql('class', 'cls')}
  select file_id, name, start_line::int as start_line, end_line::int as end_line from cls"""))
def _(spark, sf):
    return K.python_blocks(B.code_files(spark, sf), "class").select("file_id", "name", "start_line", "end_line")


@query("python_imports", sql(["code_files"], r"""
  select file_id, case when module = '' then part else module || '.' || part end as module from (
    select file_id, module, regexp_extract(unnest(string_split(names, ',')), '^\s*([\w.*]+)', 1) as part from (
      select file_id, regexp_extract(line, '^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+)?import[ \t]+([^\n#;(]+)', 1) as module,
        regexp_extract(line, '^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+)?import[ \t]+([^\n#;(]+)', 2) as names
      from (select file_id, language, unnest(string_split(content, chr(10))) as line from code_files)
      where language = 'python' and regexp_matches(line, '^[ \t]*(from[ \t]+[\w.]+[ \t]+)?import[ \t]')))
  where part <> ''"""))
def _(spark, sf):
    return K.python_imports(B.code_files(spark, sf))


def _shape_sql(kind, languages, pattern, groups, source="code_files"):
    return f"""select file_id, {q(kind)} as kind,
      coalesce({', '.join(f"nullif(c[{g}], '')" for g in range(1, groups + 1))}) as name, line_number
    from (select file_id, line_number, string_split(string_split(unnest(string_split(marked_line, chr(1))[2:]), chr(2))[1], chr(3)) as c
      from (select file_id, unnest(parts) as marked_line, unnest(range(1, len(parts) + 1))::int as line_number
        from (select file_id, string_split(regexp_replace(content, {q('(?m)' + pattern)},
            chr(1) || {"||chr(3)||".join(f"'{chr(92)}{g}'" for g in range(1, groups + 1))} || chr(2) || '\\0', 'g'), chr(10)) as parts
          from {source} where language in ({', '.join(q(x) for x in languages)}))))"""


@query("js_symbols", sql(["code_files"], f"""
  select * from ({_shape_sql('function', ('javascript', 'typescript'), C.JS_FUNCTION_SHAPES, 3)})
    where not regexp_matches(name, '^[A-Z]')
  union all {_shape_sql('import', ('javascript', 'typescript'), C.JS_IMPORT_SHAPE, 1)}
  union all {_shape_sql('class', ('javascript', 'typescript'), C.JS_CLASS_SHAPE, 1)}"""))
def _(spark, sf):
    return Y.js_symbols(B.code_files(spark, sf))


@query("java_symbols", sql(["code_files"], f"""
  {_shape_sql('function', ('java',), C.JAVA_METHOD_SHAPE, 1)}
  union all {_shape_sql('class', ('java',), C.JAVA_CLASS_SHAPE, 1)}
  union all {_shape_sql('import', ('java',), C.JAVA_IMPORT_SHAPE, 1)}"""))
def _(spark, sf):
    return Y.java_symbols(B.code_files(spark, sf))


@query("go_symbols", sql(["code_files"], f"""
  {_shape_sql('function', ('go',), C.GO_FUNCTION_SHAPE, 1)}
  union all {_shape_sql('class', ('go',), C.GO_STRUCT_SHAPE, 1)}
  union all {_shape_sql('import', ('go',), C.GO_IMPORT_SHAPE, 1)}"""))
def _(spark, sf):
    return Y.go_symbols(B.code_files(spark, sf))


@query("generic_functions", sql(["code_files"], f"""{lines_cte()}, {generic_sql(('rust', 'ruby', 'solidity'))}
  select file_id, language, name, start_line::int as start_line, end_line::int as end_line, text as body from generic"""))
def _(spark, sf):
    return K.generic_functions(B.code_files(spark, sf))


@query("brace_extents", sql(["code_files"], f"""{lines_cte()}, {generic_sql(('javascript', 'typescript', 'java', 'go'))}
  select file_id, language, name, start_line::int as start_line, end_line::int as end_line from generic"""))
def _(spark, sf):
    found = K.generic_functions(B.code_files(spark, sf), ("javascript", "typescript", "java", "go"))
    return found.drop("body")


@query("function_metrics", sql(["code_files"], f"""{functions_sql()}
  select file_id, language, name, start_line::int as start_line, length::int as length, complexity::int as complexity,
    nesting::int as nesting from measured"""))
def _(spark, sf):
    found = M.functions_with_metrics(B.code_files(spark, sf))
    return found.select("file_id", "language", "name", "start_line", "length", "complexity", "nesting")


@query("cyclomatic_files", sql(["text_files"], f"""
  select file_id, language, ({complexity_sql()})::int as complexity from (select *, content as text from text_files)"""))
def _(spark, sf):
    return text_files(spark, sf).select(
        "file_id", "language", M.cyclomatic(F.col("content"), F.col("language")).alias("complexity")
    )


@query("max_nesting_files", sql(["text_files"], f"""
  select file_id, ({NESTING})::int as nesting from (select *, content as text from text_files)"""))
def _(spark, sf):
    return text_files(spark, sf).select("file_id", M.max_nesting(F.col("content")).alias("nesting"))


@query("function_length_quantiles", sql(["code_files"], f"""{functions_sql()}
  select language, count(*) as functions, quantile_disc(length, 0.5)::int as median_length,
    quantile_disc(length, 0.9)::int as p90_length, max(length)::int as longest from measured group by 1"""))
def _(spark, sf):
    return M.function_length_quantiles(M.functions_with_metrics(B.code_files(spark, sf)))


def _function_finding(rule, test, message, last="end_line"):
    return f"""select file_id, {q(rule)} as rule_id, start_line::int as line_number, {last}::int as end_line,
      {message} as message from measured where {test}"""


@query("function_findings", sql(["code_files"], functions_sql() + " union all ".join([
    _function_finding("STY-LEN002", "length > 60", "'Function `' || name || '` is ' || length || ' lines long (max recommended 60)'"),
    _function_finding("STY-CC001", "complexity >= 10",
                      "'High cyclomatic complexity (' || complexity || ') in `' || name || '` — hard to test'"),
    _function_finding("PY-NAM001", "language = 'python' and not regexp_matches(name, '^[a-z_][a-z0-9_]*$')",
                      "'Function `' || name || '` should be snake_case'", "start_line"),
    _function_finding("ARCH-GOD001", "length > 100",
                      "'God function: `' || name || '` is ' || length || ' lines — violates Single Responsibility'"),
    _function_finding("ARCH-NEST001", "nesting > 4",
                      "'Deep nesting (' || nesting || ' levels) in `' || name || '` — hard to read and test'"),
])))
def _(spark, sf):
    return SR.function_findings(B.code_files(spark, sf)).select(
        "file_id", "rule_id", "line_number", "end_line", "message"
    )


@query("class_findings", sql(["code_files"], rf"""{lines_cte()}, {blocks_sql('class', 'cls')},
  counted as (select *, len(regexp_extract_all(text, '(?m)^[ \t]+(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(')) as methods from cls)
  select file_id, 'PY-NAM002' as rule_id, start_line::int as line_number, start_line::int as end_line,
    'Class `' || name || '` should be PascalCase' as message from counted where not regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')
  union all select file_id, 'PY-ARCH-AST001', start_line::int, end_line::int,
    'God class `' || name || '` has ' || methods || ' methods — violates SRP' from counted where methods > 20
  union all select file_id, 'PY-ARCH-AST002', start_line::int, end_line::int,
    'Large class `' || name || '` has no `__init__` — consider using dataclass' from counted
    where end_line - start_line > 50 and not regexp_matches(text, 'def[ \t]+__init__')"""))
def _(spark, sf):
    return SR.class_findings(B.code_files(spark, sf)).select("file_id", "rule_id", "line_number", "end_line", "message")


@query("isinstance_chains", sql(["code_files"], rf"""{lines_cte()}, {blocks_sql('chain', 'chains')},
  tests as (select c.file_id, c.start_line, count(*) as tests from chains c join lines l on l.file_id = c.file_id
    and l.n between c.start_line and c.end_line and l.indent = c.indent
    and regexp_matches(l.line, '^[ \t]*(?:el)?if[ \t]+isinstance[ \t]*\([^\n]*\)[ \t]*:') group by 1, 2)
  select file_id, start_line::int as line_number, 'Chain of ' || tests || ' isinstance() checks — consider polymorphism' as message
  from tests where tests >= 3"""))
def _(spark, sf):
    return SR.isinstance_chain_findings(B.code_files(spark, sf)).select("file_id", "line_number", "message")


@query("symbol_inventory", sql(["code_files"], rf"""{lines_cte()}, {blocks_sql('function', 'fns')}, {blocks_sql('class', 'cls')},
  {generic_sql(('rust', 'ruby', 'solidity'))},
  imports as (select file_id, regexp_extract(unnest(string_split(regexp_extract(line,
        '^[ \t]*(?:from[ \t]+[\w.]+[ \t]+)?import[ \t]+([^\n#;(]+)', 1), ',')), '^\s*([\w.*]+)', 1) as name
      from lines where language = 'python' and regexp_matches(line, '^[ \t]*(from[ \t]+[\w.]+[ \t]+)?import[ \t]')),
  symbols as (
    select file_id, 'function' as kind from fns union all select file_id, 'class' from cls
    union all select file_id, 'import' from imports where name <> ''
    union all select file_id, 'function' from generic
    union all select file_id, kind from ({_shape_sql('function', ('javascript', 'typescript'), C.JS_FUNCTION_SHAPES, 3)})
      where not regexp_matches(name, '^[A-Z]')
    union all select file_id, kind from ({_shape_sql('import', ('javascript', 'typescript'), C.JS_IMPORT_SHAPE, 1)})
    union all select file_id, kind from ({_shape_sql('class', ('javascript', 'typescript'), C.JS_CLASS_SHAPE, 1)})
    union all select file_id, kind from ({_shape_sql('function', ('java',), C.JAVA_METHOD_SHAPE, 1)})
    union all select file_id, kind from ({_shape_sql('class', ('java',), C.JAVA_CLASS_SHAPE, 1)})
    union all select file_id, kind from ({_shape_sql('import', ('java',), C.JAVA_IMPORT_SHAPE, 1)})
    union all select file_id, kind from ({_shape_sql('function', ('go',), C.GO_FUNCTION_SHAPE, 1)})
    union all select file_id, kind from ({_shape_sql('class', ('go',), C.GO_STRUCT_SHAPE, 1)})
    union all select file_id, kind from ({_shape_sql('import', ('go',), C.GO_IMPORT_SHAPE, 1)}))
  select file_id, count(*) filter (kind = 'function') as function_count, count(*) filter (kind = 'class') as class_count,
    count(*) filter (kind = 'import') as import_count from symbols group by 1"""))
def _(spark, sf):
    return Y.symbol_inventory(B.code_files(spark, sf))


@query("most_imported", sql(["code_files"], rf"""{lines_cte()},
  statements as (select file_id, regexp_extract(line, '^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+)?import', 1) as module,
      regexp_extract(unnest(string_split(regexp_extract(line, '^[ \t]*(?:from[ \t]+[\w.]+[ \t]+)?import[ \t]+([^\n#;(]+)', 1), ',')),
        '^\s*([\w.*]+)', 1) as part
    from lines where language = 'python' and regexp_matches(line, '^[ \t]*(from[ \t]+[\w.]+[ \t]+)?import[ \t]')),
  modules as (
    select case when module = '' then part else module || '.' || part end as name from statements where part <> ''
    union all select name from ({_shape_sql('import', ('javascript', 'typescript'), C.JS_IMPORT_SHAPE, 1)})
    union all select name from ({_shape_sql('import', ('java',), C.JAVA_IMPORT_SHAPE, 1)})
    union all select name from ({_shape_sql('import', ('go',), C.GO_IMPORT_SHAPE, 1)}))
  select name as module, count(*) as imports from modules group by 1"""))
def _(spark, sf):
    return Y.most_imported(B.code_files(spark, sf))


@query("duplicate_findings", sql(["code_files"], f"""
  with filled as (select file_id, list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(l, {WS})),
      lambda l: l <> '') as parts from code_files),
  windows as (select file_id, unnest(range(1, len(parts) - 4)) as position, parts from filled where len(parts) >= 6),
  keyed as (select file_id, position, parts[position:position + 5] as block, parts[position] as code_snippet from windows)
  select file_id, position::int as line_number, (position + 6)::int as end_line, code_snippet from (
    select *, row_number() over (partition by file_id, block order by position) as nth from keyed) where nth > 1
  union all select null, 0, 0, count(*)::varchar from keyed"""))
def _(spark, sf):
    """Repeats in source files; one summary row tells how many windows were looked at."""
    files = B.code_files(spark, sf)
    found = SR.duplicate_findings(files).select("file_id", "line_number", "end_line", "code_snippet")
    lines = F.filter(F.split("content", "\n", -1), lambda l: F.trim(l) != "")
    seen = files.agg(F.sum(F.greatest(F.size(lines) - 5, F.lit(0))).cast("string").alias("code_snippet"))
    return found.unionByName(seen.select(
        F.lit(None).cast("bigint").alias("file_id"), F.lit(0).alias("line_number"), F.lit(0).alias("end_line"), "code_snippet"
    ))


# extents of very different lengths, some beyond all places: stretches of part numbers that a supplier's lines span
_SPAN = "(1 << (l_orderkey % 12)::int) - 1 + l_linenumber"


@query("interval_join", f"""
  with extents as (select l_suppkey as file_id, l_partkey % 3000 as start_line, l_partkey % 3000 + {_SPAN} as end_line from lineitem where l_orderkey % 7 = 0),
  places as (select l_suppkey as file_id, l_orderkey % 5000 as line_number from lineitem)
  select file_id, line_number, count(*) as extents, sum(end_line - start_line)::bigint as length
  from places p join extents e using (file_id) where line_number between start_line and end_line group by 1, 2""")
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    start = F.col("l_partkey") % 3000
    span = F.pow(F.lit(2), F.col("l_orderkey") % 12).cast("bigint") - 1 + F.col("l_linenumber")
    extents = lines.where("l_orderkey % 7 = 0").select(F.col("l_suppkey").alias("file_id"), start.alias("start_line"), (start + span).alias("end_line"))
    places = lines.select(F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") % 5000).alias("line_number"))
    return I.holding(places, extents, ["file_id"]).groupBy("file_id", "line_number").agg(
        F.count("*").alias("extents"), F.sum(F.col("end_line") - F.col("start_line")).alias("length")
    )


@query("lines_in_functions", sql(["code_files"], f"""{lines_cte()}, {generic_sql(('rust', 'ruby', 'solidity'))}
  select l.file_id, l.n::int as line_number, 1::bigint as held_by, g.name, g.start_line::int as start_line, g.end_line::int as end_line
  from lines l join generic g on l.file_id = g.file_id and l.n between g.start_line and g.end_line where contains(l.line, '(')"""))
def _(spark, sf):
    from reviewlake.operators.lines import explode_lines

    files = B.code_files(spark, sf)
    extents = K.generic_functions(files).select("file_id", "name", "start_line", "end_line")
    places = explode_lines(files).where(F.contains("content", F.lit("("))).select("file_id", "line_number")
    return I.innermost(places, extents, ["file_id"])
