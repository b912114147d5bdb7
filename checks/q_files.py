"""Files, filters, patches and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.bindings_sql import sql
from reviewlake.functions.languages import supported_only, with_language
from reviewlake.operators import lines as L
from reviewlake.operators import patches as P
from reviewlake.operators import scan as R
from reviewlake.operators import selection as S
from reviewlake.plans.review import select_files, with_text
from reviewlake.rules import catalog as C

WS = "' ' || chr(9) || chr(10) || chr(13)"
QUERIES = {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = (function, oracle)
        return function

    return add


def text_files(spark, sf):
    """Analysed text files, with their language."""
    files = S.flag_blank(S.flag_oversize(with_text(select_files(B.pr_files(spark, sf)))))
    return files.where("not is_oversize")


@query("pr_files", sql(["pr_files"], """
  select file_id, review_id, filename, status, additions, deletions, content from pr_files"""))
def _(spark, sf):
    return B.pr_files(spark, sf).drop("content_bytes")


@query("with_language", sql(["named_files"], """
  select language, count(*) as files, count(distinct filename) as names from named_files group by 1"""))
def _(spark, sf):
    return with_language(B.pr_files(spark, sf)).groupBy("language").agg(
        F.count("*").alias("files"), F.count_distinct("filename").alias("names")
    )


@query("supported_only", sql(["named_files"], f"""
  select file_id, filename, language from named_files
  where language in ({", ".join(f"'{x}'" for x in C.SUPPORTED_LANGUAGES)})"""))
def _(spark, sf):
    return supported_only(with_language(B.file_headers(spark, sf))).select("file_id", "filename", "language")


@query("drop_removed", sql(["file_headers"], """
  select file_id, status from file_headers where status <> 'removed'"""))
def _(spark, sf):
    return S.drop_removed(B.file_headers(spark, sf)).select("file_id", "status")


def _headers_of_projects(spark, sf):
    return B.file_headers(spark, sf).withColumn("project_id", F.col("review_id") % 25)


@query("drop_ignored", sql(["file_headers", "ignore_patterns"], """
  select file_id, filename, project_id from (select *, review_id % 25 as project_id from file_headers) h
  where not exists (select 1 from ignore_patterns i
    where i.project_id = h.project_id and regexp_matches(h.filename, i.pattern))"""))
def _(spark, sf):
    kept = S.drop_ignored(_headers_of_projects(spark, sf), B.ignore_patterns(spark, sf))
    return kept.select("file_id", "filename", "project_id")


@query("flag_oversize", """
  select doc_id as file_id, strlen(text) > 20 * 1024 as is_oversize from documents""")
def _(spark, sf):
    return S.flag_oversize(B.prose(spark, sf), max_kb=20).select("file_id", "is_oversize")


@query("flag_blank", sql(["pr_files"], """
  select file_id, not regexp_matches(content, '\\S') as is_blank from pr_files"""))
def _(spark, sf):
    return S.flag_blank(B.pr_files(spark, sf)).select("file_id", "is_blank")


@query("enabled_categories", sql(["findings", "file_reviews", "reviews", "projects"], """
  select category, severity, count(*) as findings from findings join file_reviews using (file_id)
    join reviews using (review_id) join projects using (project_id)
  where trim(enabled_categories) = '' or list_contains(
    list_transform(string_split(enabled_categories, ','), lambda x: trim(x)), category)
  group by 1, 2"""))
def _(spark, sf):
    joined = (
        B.findings(spark, sf).join(B.file_reviews(spark, sf).select("file_id", "review_id"), "file_id")
        .join(B.reviews(spark, sf).select("review_id", "project_id"), "review_id")
        .join(B.projects(spark, sf).select("project_id", "enabled_categories"), "project_id")
    )
    return S.enabled_categories(joined, "enabled_categories").groupBy("category", "severity").agg(
        F.count("*").alias("findings")
    )


def _code_lines(spark, sf):
    lines = L.explode_lines(text_files(spark, sf))
    return lines.join(text_files(spark, sf).select("file_id", "language"), "file_id")


_SQL_LINES = """
  with lines as (select file_id, language, unnest(parts) as line,
    unnest(range(1, len(parts) + 1)) as line_number from (
      select *, string_split(regexp_replace(content, '\\n$', ''), chr(10)) as parts from text_files where content <> ''))"""


@query("not_comment_line", sql(["text_files"], _SQL_LINES + f"""
  select language, count(*) as lines from (select *, trim(line, {WS}) as t from lines)
  where not case when language in ('python', 'ruby') then starts_with(t, '#')
    else starts_with(t, '//') or starts_with(t, '*') end
    and not starts_with(t, '/*') group by 1"""))
def _(spark, sf):
    lines = _code_lines(spark, sf)
    stripped = F.trim("content")
    # the sources hold no /* in python and ruby, so both texts agree on it
    return lines.where(~R.comment_line(stripped, F.col("language"))).groupBy("language").agg(
        F.count("*").alias("lines")
    )


@query("not_placeholder_line", sql(["lines3"], f"""
  select count(*) as lines, sum(length(code)) as chars from lines3
  where not regexp_matches(lower(code), '{"|".join(C.PLACEHOLDER_WORDS)}')"""))
def _(spark, sf):
    lines = B.snippet_lines(B.table(spark, sf, "lineitem"), 3)
    return lines.where(~R.placeholder_line(F.col("code"))).agg(
        F.count("*").alias("lines"), F.sum(F.length("code")).alias("chars")
    )


@query("redact_literals", sql(["lines3"], """
  select shown, count(*) as lines from (
    select regexp_replace(code, '["''][^"'']{4,}["'']', '"[REDACTED]"', 'g') as shown from lines3) group by 1"""))
def _(spark, sf):
    lines = B.snippet_lines(B.table(spark, sf, "lineitem"), 3)
    return lines.groupBy(R.redact_literals(F.col("code")).alias("shown")).agg(F.count("*").alias("lines"))


@query("patch_content", sql(["patches"], """
  select file_id, array_to_string(list_transform(list_filter(string_split(patch, chr(10)),
      lambda l: not (starts_with(l, '-') or starts_with(l, '+++') or starts_with(l, '@@'))),
      lambda l: case when starts_with(l, '+') then l[2:] else ltrim(l, ' ') end), chr(10)) as content
  from patches"""))
def _(spark, sf):
    return B.patches(spark, sf).select("file_id", P.patch_content(F.col("patch")).alias("content"))


_SQL_PATCH_LINES = """
  with raw as (select file_id, unnest(string_split(patch, chr(10))) as raw,
      unnest(range(0, len(string_split(patch, chr(10))))) as position from patches),
  tagged as (select *, starts_with(raw, '@@') as head,
      starts_with(raw, '+') and not starts_with(raw, '+++') as is_added,
      starts_with(raw, '-') and not starts_with(raw, '---') as is_removed,
      try_cast(nullif(regexp_extract(case when starts_with(raw, '@@') then raw else '' end, '\\+(\\d+)', 1), '') as int) as base,
      not (starts_with(raw, '@@') or starts_with(raw, '-') or starts_with(raw, '+++')) as in_extract from raw),
  hunked as (select *, count(base) over (partition by file_id order by position) as hunk,
      sum(in_extract::int) over (partition by file_id order by position) as extracted from tagged),
  numbered as (select *, coalesce(max(base) over (partition by file_id, hunk), 1) - 1
      + coalesce(sum(case when head or is_removed then 0 else 1 end)
          over (partition by file_id, hunk order by position), 0) as line_number from hunked),
  patch_lines as (select file_id, position, line_number, is_added, is_removed,
      case when is_added or is_removed then raw[2:] else ltrim(raw, ' ') end as content,
      case when in_extract then extracted end as extract_line from numbered where not head)"""


@query("patch_lines", sql(["patches"], _SQL_PATCH_LINES + """
  select file_id, position, line_number::int as line_number, content, is_added, is_removed,
    extract_line::int as extract_line from patch_lines"""))
def _(spark, sf):
    return P.patch_lines(B.patches(spark, sf))


@query("new_line_numbers", sql(["patches"], _SQL_PATCH_LINES + """
  select file_id, extract_line::int as line_number, line_number::int as new_line, is_added from patch_lines
  where extract_line is not null and regexp_matches(content, 'eval|password|todo')"""))
def _(spark, sf):
    patches = B.patches(spark, sf)
    extracts = patches.select("file_id", P.patch_content(F.col("patch")).alias("content"))
    found = L.explode_lines(extracts).where(F.col("content").rlike("eval|password|todo"))
    return P.new_line_numbers(found.select("file_id", "line_number"), patches)


@query("explode_lines", """
  select file_id, line_number, line as content from (
    select doc_id as file_id, unnest(parts) as line, unnest(range(1, len(parts) + 1))::int as line_number
    from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as parts from documents))""")
def _(spark, sf):
    return L.explode_lines(B.prose(spark, sf))


@query("line_context", sql(["text_files"], _SQL_LINES + """
  select file_id, line_number::int as line_number, string_agg(shown, chr(10) order by other) as context from (
    select a.file_id, a.line_number, b.line_number as other, printf('%4d: %s', b.line_number, b.line) as shown
    from lines a join lines b on a.file_id = b.file_id and b.line_number between a.line_number - 2 and a.line_number + 2)
  group by 1, 2"""))
def _(spark, sf):
    return L.line_context(text_files(spark, sf))


@query("line_at", sql(["findings", "text_files"], f"""
  select file_id, ordinal, line_number, case when line_number > 0
    then coalesce(trim(string_split(content, chr(10))[line_number], {WS}), '') else '' end as code_snippet
  from findings join text_files using (file_id)"""))
def _(spark, sf):
    texts = text_files(spark, sf).select("file_id", "content")
    found = B.findings(spark, sf).join(texts.select("file_id"), "file_id", "left_semi")
    return L.with_snippet(found.select("file_id", "ordinal", "line_number"), texts)


@query("long_lines", """
  select doc_id as file_id, line_number, length(line) as length, line[1:100] || '...' as code_snippet from (
    select doc_id, unnest(parts) as line, unnest(range(1, len(parts) + 1))::int as line_number
    from (select doc_id, string_split(text, chr(10)) as parts from documents)) where length(line) > 120""")
def _(spark, sf):
    return L.long_lines(B.prose(spark, sf))


_SQL_WINDOWS = f"""
  with filled as (select file_id, list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(l, {WS})),
      lambda l: l <> '') as parts from %s),
  windows as (select file_id, unnest(range(1, len(parts) - 4)) as position, parts from filled where len(parts) >= 6),
  keyed as (select file_id, position, parts[position:position + 5] as block, parts[position] as code_snippet from windows)"""


@query("duplicate_blocks", sql([], (_SQL_WINDOWS % "(select doc_id as file_id, text as content from documents)") + """
  select file_id, position::int as position, (position + 6)::int as end_position, code_snippet from (
    select *, row_number() over (partition by file_id, block order by position) as nth from keyed) where nth > 1"""))
def _(spark, sf):
    return L.duplicate_blocks(B.prose(spark, sf))


@query("corpus_duplicate_blocks", sql([], (_SQL_WINDOWS % "(select doc_id as file_id, text as content from documents)") + """
  select md5(array_to_string(block, chr(10))) as block, count(*) as occurrences,
    min(file_id) as first_file, arg_min(position, file_id * 1000000 + position)::int as first_position
  from keyed group by 1 having count(*) > 1"""))
def _(spark, sf):
    return L.corpus_duplicate_blocks(B.prose(spark, sf))
