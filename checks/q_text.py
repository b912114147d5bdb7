"""Scalar functions, reports and prompts, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.bindings_sql import sql
from reviewlake.functions import replies, scores, signature, text, urls
from reviewlake.plans import reports as G
from reviewlake.rules import catalog as C
from reviewlake.session import run_folder
from reviewlake.sources import pull_requests as PR
from reviewlake.sources import tables as T

QUERIES = {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = (function, oracle)
        return function

    return add


# ---- addresses and names ----------------------------------------------------------------
def _urls(spark, sf):
    number = F.col("o_orderkey").cast("string")
    form = F.col("o_orderkey") % 7
    url = (
        F.when(form == 0, F.concat(F.lit("https://github.com/Org/Repo.git/pull/"), number))
        .when(form == 1, F.concat(F.lit("github.com/a-b/c.d/pull/"), number, F.lit("/files")))
        .when(form == 2, F.concat(F.lit("HTTP://GitHub.com/x/y/PULL/"), number))
        .when(form == 3, F.concat(F.lit("https://example.com/x/y/pull/"), number))
        .when(form == 4, F.concat(F.lit("https://github.com/x/y/issues/"), number))
        .when(form == 5, F.lit("https://github.com/x/y.git/"))
        .otherwise("")
    )
    return B.table(spark, sf, "orders").select("o_orderkey", url.alias("pr_url"))


_URLS_SQL = """
  with urls as (select o_orderkey, case o_orderkey % 7
      when 0 then 'https://github.com/Org/Repo.git/pull/' || o_orderkey
      when 1 then 'github.com/a-b/c.d/pull/' || o_orderkey || '/files'
      when 2 then 'HTTP://GitHub.com/x/y/PULL/' || o_orderkey
      when 3 then 'https://example.com/x/y/pull/' || o_orderkey
      when 4 then 'https://github.com/x/y/issues/' || o_orderkey
      when 5 then 'https://github.com/x/y.git/' else '' end as pr_url from orders)"""
_PR = r"'(?i)(?:https?://)?github\.com/([^/]+)/([^/]+)/pull/(\d+)'"
_REPO = r"'(?i)(?:https?://)?github\.com/([^/]+)/([^/\s]+?)(?:\.git)?/?$'"


@query("parse_pr_url", _URLS_SQL + rf"""
  select o_orderkey, regexp_extract(pr_url, {_PR}, 1) as owner,
    regexp_replace(regexp_extract(pr_url, {_PR}, 2), '\.git$', '') as repo,
    regexp_extract(pr_url, {_PR}, 3)::bigint as number
  from urls where regexp_matches(pr_url, {_PR})""")
def _(spark, sf):
    good, _ = urls.split_by_pr_url(_urls(spark, sf))
    return good.select("o_orderkey", "owner", "repo", "number")


@query("rejected_pr_urls", _URLS_SQL + f"""
  select o_orderkey, 'Cannot parse pull request URL: ' || pr_url as reason from urls where not regexp_matches(pr_url, {_PR})""")
def _(spark, sf):
    _, bad = urls.split_by_pr_url(_urls(spark, sf))
    return bad.select("o_orderkey", "reason")


@query("parse_repo_url", _URLS_SQL + f"""
  select o_orderkey, regexp_extract(u, {_REPO}, 1) as owner, regexp_extract(u, {_REPO}, 2) as repo
  from (select o_orderkey, rtrim(pr_url, '/') as u from urls) where regexp_matches(u, {_REPO})""")
def _(spark, sf):
    good, _ = urls.split_by_repo_url(_urls(spark, sf).withColumnRenamed("pr_url", "repo_url"))
    return good.select("o_orderkey", "owner", "repo")


@query("branch_of", """
  select event_id, case when starts_with(ref, 'refs/heads/') then replace(ref, 'refs/heads/', '') else ref end as branch
  from (select event_id, case event_id % 3 when 0 then 'refs/heads/f/' when 1 then 'refs/tags/v' else '' end || user_id as ref from events)""")
def _(spark, sf):
    kind = F.col("event_id") % 3
    ref = F.concat(F.when(kind == 0, "refs/heads/f/").when(kind == 1, "refs/tags/v").otherwise(""), F.col("user_id").cast("string"))
    return B.table(spark, sf, "events").select("event_id", urls.branch_of(ref).alias("branch"))


@query("case_converters", r"""
  with names as (select p_partkey, replace(p_name, ' ', '_') as snake,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), '') || p_size as pascal from part)
  select p_partkey, string_split(snake, '_')[1] || array_to_string(list_transform(string_split(snake, '_')[2:],
      lambda w: upper(w[1:1]) || lower(w[2:])), '') as camel,
    lower(regexp_replace(regexp_replace(pascal, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) as snake
  from names""")
def _(spark, sf):
    name = F.col("p_name")
    pascal = F.concat(F.replace(F.initcap(name), F.lit(" "), F.lit("")), F.col("p_size").cast("string"))
    return B.table(spark, sf, "part").select(
        "p_partkey", text.to_camel_case(F.replace(name, F.lit(" "), F.lit("_"))).alias("camel"),
        text.to_snake_case(pascal).alias("snake"),
    )


@query("text_helpers", """
  select doc_id, upper(source[1:1]) || lower(source[2:]) as capital, text[1:80] as short,
    case when length(text) > 6000 then text[1:6000] || '... (truncated)' else text end as cut_text,
    array_to_string(list_filter(list_transform(string_split(replace(source, '-', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts
  from documents""")
def _(spark, sf):
    from reviewlake.operators.selection import split_csv

    source, body = F.col("source"), F.col("text")
    return B.table(spark, sf, "documents").select(
        "doc_id", text.capitalise(source).alias("capital"), text.cut(body, 80).alias("short"),
        F.when(F.length(body) > 6000, F.concat(text.cut(body, 6000), F.lit("... (truncated)"))).otherwise(body).alias("cut_text"),
        F.array_join(split_csv(F.replace(source, F.lit("-"), F.lit(" , "))), "|").alias("parts"),
    )


# ---- scores ------------------------------------------------------------------------------
def _band_sql(column, field, continuous=False):
    tests = " ".join(
        f"when {column} >= {b[0]}" + ("" if continuous else f" and {column} <= {b[1]}") + f" then '{b[field]}'"
        for b in C.SCORE_BANDS
    )
    return f"case {tests} else '{C.SCORE_BANDS[-1][field]}' end"


_SCORES_SQL = "(select o_orderkey, 100.0 - (o_orderkey % 2000)::double / (2 * (1 + o_orderkey % 13)) as s from orders)"


def _scores(spark, sf):
    key = F.col("o_orderkey")
    score = F.lit(100.0) - (key % 2000).cast("double") / (F.lit(2) * (F.lit(1) + key % 13))
    return B.table(spark, sf, "orders").select("o_orderkey", score.alias("s"))


@query("score_bands", f"""
  select o_orderkey, {_band_sql('s', 2)} as label, {_band_sql('s', 3)} as colour, {_band_sql('s', 2, True)} as continuous
  from {_SCORES_SQL}""")
def _(spark, sf):
    s = F.col("s")
    return _scores(spark, sf).select(
        "o_orderkey", scores.score_label(s).alias("label"), scores.score_colour(s).alias("colour"),
        scores.score_label(s, continuous=True).alias("continuous"),
    )


@query("score_summary", f"""
  select o_orderkey, printf('%.1f', s)::double as score, {_band_sql('s', 2)} as label, {_band_sql('s', 3)} as colour,
    printf('%.0f', s)::double::int as percentage from {_SCORES_SQL}""")
def _(spark, sf):
    return _scores(spark, sf).select("o_orderkey", scores.score_summary(F.col("s")).alias("x")).select("o_orderkey", "x.*")


@query("score_bar", f"""
  select o_orderkey, repeat('█', floor(s / 5)::int) || repeat('░', 20 - floor(s / 5)::int) as bar,
    printf('%.1f', s) as shown from (select o_orderkey, greatest(0, least(100, s)) as s from {_SCORES_SQL})""")
def _(spark, sf):
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("s")))
    return _scores(spark, sf).select(
        "o_orderkey", scores.score_bar(s).alias("bar"), scores.one_decimal(s).alias("shown")
    )


@query("severity_scales", """
  select event_type, case lower(s) when 'critical' then 0 when 'warning' then 1 when 'suggestion' then 2 else 3 end as rank,
    case lower(s) when 'critical' then '#ef4444' when 'warning' then '#fbbf24' when 'suggestion' then '#4f8cff' else '#94a3b8' end as colour,
    count(*) as events
  from (select event_type, (['Critical', 'WARNING', 'suggestion', 'other'])[(event_id % 4)::int + 1] as s from events) group by 1, 2, 3""")
def _(spark, sf):
    names = B.constant_array(("Critical", "WARNING", "suggestion", "other"))
    s = F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))
    events = B.table(spark, sf, "events").select("event_type", s.alias("s"))
    return events.groupBy(
        "event_type", scores.severity_rank(F.col("s")).alias("rank"), scores.severity_colour(F.col("s")).alias("colour")
    ).agg(F.count("*").alias("events"))


# ---- signatures and replies --------------------------------------------------------------
SECRET = "s3cret-key"


def _pads():
    key = SECRET.encode().ljust(64, b"\0")
    return tuple("".join(f"{b ^ pad:02x}" for b in key) for pad in (0x36, 0x5C))


@query("valid_signature", sql(["deliveries"], f"""
  with hashed as (select *, sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || encode(body)))) as digest from deliveries)
  select delivery_id, copy, digest, case when substr(delivery_id, 2)::bigint % 5 = 0 then false else true end as valid from hashed"""))
def _(spark, sf):
    body = F.col("body").cast("binary")
    digest = signature.hmac_sha256(body, SECRET)
    signed = B.deliveries(spark, sf).withColumn("digest", digest)
    wrong = F.substring("delivery_id", 2, 20).cast("bigint") % 5 == 0
    header = F.when(wrong & (F.col("copy") == 1), F.lit("")).when(wrong, F.concat(F.lit("sha256="), F.reverse("digest"))).otherwise(
        F.concat(F.lit("sha256="), "digest")
    )
    return signed.select("delivery_id", "copy", "digest", signature.valid_signature(body, header, SECRET).alias("valid"))


def _reply_texts(spark, sf):
    form = (F.col("conv_id") + F.col("turn")) % 4
    packed = F.to_json(F.struct(F.col("text").alias("summary"), F.array("role").alias("suggestions")))
    reply = (
        F.when(form == 0, F.concat(F.lit("Here you are:\n```json\n"), packed, F.lit("\n```\nDone.")))
        .when(form == 1, F.lit('{"overall_assessment": "good"}'))
        .when(form == 2, F.lit(""))
        .otherwise(F.col("text"))
    )
    return B.table(spark, sf, "conversations").select("conv_id", "turn", "text", "role", reply.alias("reply"))


@query("parse_reply", """
  select conv_id, turn, case (conv_id + turn) % 4 when 0 then text when 1 then '' when 2 then 'AI review unavailable'
      else trim(text, ' ' || chr(9) || chr(10) || chr(13))[1:500] end as summary,
    case (conv_id + turn) % 4 when 0 then role else '' end as suggestions,
    case (conv_id + turn) % 4 when 1 then 'good' else 'needs_work' end as overall_assessment,
    (conv_id + turn) % 4 in (0, 1) as parsed
  from conversations""")
def _(spark, sf):
    parsed = _reply_texts(spark, sf).select("conv_id", "turn", replies.parse_reply(F.col("reply")).alias("p"))
    return parsed.select(
        "conv_id", "turn", "p.summary", F.array_join("p.suggestions", ",").alias("suggestions"), "p.overall_assessment", "p.parsed"
    )


# ---- reports and prompts -----------------------------------------------------------------
def _report_tables(spark, sf):
    return B.reviews(spark, sf), B.file_reviews(spark, sf), B.findings(spark, sf)


_REPORT_CTES = f"""
  with r as (select *, coalesce(score, 0.0) as s from reviews),
  located as (select f.*, review_id, filename from findings f join file_reviews using (file_id)),
  f as (select *, case when score = 0 then 100.0 else score end as shown from file_reviews),
  nth as (select *, row_number() over (partition by file_id order by ordinal, category) as c from located where severity = 'critical')"""


def _label(column):
    return _band_sql(column, 2)


_RANKS = "case category when 'bugs' then 1 when 'security' then 2 when 'performance' then 3 when 'architecture' then 4 else 5 end"


@query("markdown_report", sql(["reviews", "file_reviews", "findings"], f"""{_REPORT_CTES},
  parts as (
    select review_id, 0 as section, 0 as k1, 0 as k2, 0 as k3, 0 as k4,
      '# Code Review Report' || chr(10) || chr(10) || '**PR:** [' || pr_title || '](' || pr_url || ')' || chr(10)
      || '**Date:** ' || strftime(created_at, '%Y-%m-%d %H:%M UTC') || chr(10)
      || '**Score:** ' || printf('%.1f', s) || '/100 — ' || {_label('s')} || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
      || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10) || '| Files Changed | ' || files_changed || ' |' || chr(10)
      || '| Lines Added | +' || lines_added || ' |' || chr(10) || '| Lines Removed | -' || lines_removed || ' |' || chr(10)
      || '| Critical Issues | ' || coalesce(critical_count, 0) || ' |' || chr(10) || '| Warnings | ' || coalesce(warning_count, 0) || ' |' || chr(10)
      || '| Suggestions | ' || coalesce(suggestion_count, 0) || ' |' || chr(10) || '| Total Findings | ' || coalesce(total_findings, 0) || ' |' || chr(10)
      || chr(10) || '## Score' || chr(10) || chr(10) || '```' || chr(10) || '[' || repeat('█', floor(s / 5)::int)
      || repeat('░', 20 - floor(s / 5)::int) || '] ' || printf('%.1f', s) || '/100 (' || {_label('s')} || ')' || chr(10) || '```' || chr(10) as text
    from r
    union all select distinct review_id, 1, 0, 0, 0, 0, '## File Analysis' || chr(10) from f
    union all select f.review_id, 2, f.file_id, 0, 0, 0, '### `' || filename || '`' || chr(10) || chr(10) || '**Language:** '
      || upper(language[1:1]) || language[2:] || ' | **Score:** ' || printf('%.1f', shown) || '/100 (' || {_label('shown')} || ') | **Findings:** '
      || coalesce(n, 0) || chr(10) || chr(10) || case when n > 0 then '| Severity | Line | Category | Issue |' || chr(10)
      || '|----------|------|----------|-------|' else 'No issues found in this file.' || chr(10) end
      from f left join (select file_id, count(*) as n from located group by 1) using (file_id)
    union all select review_id, 2, file_id, 1, ordinal, 0, '| ' || upper(severity) || ' | ' || case when coalesce(line_number, 0) = 0 then '-'
      else line_number::varchar end || ' | ' || upper(category[1:1]) || category[2:] || ' | ' || message[1:80] || ' |' from located
    union all select distinct review_id, 2, file_id, 2, 0, 0, '' from located
    union all select review_id, 2, file_id, 3, c, 0, '**Critical at line ' || coalesce(line_number::varchar, 'None') || ':**' || chr(10) || '```'
      || chr(10) || code_snippet || chr(10) || '```' || chr(10) || case when suggestion is not null then '> ' || suggestion || chr(10) else '' end
      from nth where c <= 3
    union all select distinct review_id, 3, 0, 0, 0, 0, '## Findings by Category' || chr(10) from located
    union all select review_id, 4, {_RANKS}, -1, 0, 0, '### ' || upper(category[1:1]) || category[2:] || ' (' || count(*) || ')' || chr(10)
      from located group by review_id, category
    union all select distinct review_id, 4, {_RANKS}, 9, 0, 0, '' from located
    union all select review_id, 4, {_RANKS}, case severity when 'critical' then 0 when 'warning' then 1 else 2 end, file_id, ordinal,
      '- `' || severity || '` **' || filename || ':' || coalesce(line_number::varchar, 'None') || '** — ' || message
      || case when suggestion is not null then chr(10) || '  - Fix: ' || suggestion else '' end from located
    union all select review_id, 9, 0, 0, 0, 0, '---' || chr(10) || '*Generated by reviewlake*' from r)
  select review_id, 0 as volume, string_agg(text, chr(10) order by section, k1, k2, k3, k4, text) as text from parts group by 1"""))
def _(spark, sf):
    return G.assemble(G.report_parts(*_report_tables(spark, sf)))


_COMMENT_PARTS = f"""{_REPORT_CTES},
  top as (select *, row_number() over (partition by review_id order by file_id, ordinal) as t,
      count(*) over (partition by review_id) as n from located where severity = 'critical'),
  parts as (
    select review_id, 0 as section, 0 as k1, 0 as k2, '## Code Review — ' || printf('%.1f', s) || '/100 (' || {_label('s')} || ')' || chr(10) || chr(10)
      || '| Files | +Added | -Removed | Critical | Warning | Suggestion |' || chr(10)
      || '|-------|--------|----------|-------------|------------|---------------|' || chr(10)
      || '| ' || files_changed || ' | +' || lines_added || ' | -' || lines_removed || ' | ' || coalesce(critical_count, 0) || ' | '
      || coalesce(warning_count, 0) || ' | ' || coalesce(suggestion_count, 0) || ' |' || chr(10) as text from r
    union all select distinct review_id, 1, 0, 0, '<details>' || chr(10) || '<summary>Critical Issues (' || n || ')</summary>' || chr(10) from top
    union all select review_id, 1, 1, t, '**`' || filename || '`:' || coalesce(line_number::varchar, 'None') || '** — ' || message || chr(10)
      || case when suggestion is not null then '> ' || suggestion || chr(10) else '' end
      || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10) from top where t <= 10
    union all select distinct review_id, 1, 2, 0, '</details>' || chr(10) from top
    union all select distinct review_id, 2, 0, 0, '<details>' || chr(10) || '<summary>File Scores</summary>' || chr(10) || chr(10)
      || '| File | Language | Score | Critical | Warnings |' || chr(10) || '|------|----------|-------|----------|----------|' from f
    union all select f.review_id, 3, f.file_id, 0, '| `' || filename || '` | ' || language || ' | ' || printf('%.1f', shown) || ' (' || {_label('shown')}
      || ') | ' || coalesce(critical, 0) || ' | ' || coalesce(warning, 0) || ' |' from f left join (
        select file_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning
        from findings group by 1) using (file_id)
    union all select distinct review_id, 4, 0, 0, chr(10) || '</details>' || chr(10) from f
    union all select review_id, 9, 0, 0, '---' || chr(10) || '*Generated by reviewlake*' from r)"""


@query("pr_comment", sql(["reviews", "file_reviews", "findings"], f"""{_COMMENT_PARTS}
  select review_id, 0 as volume, string_agg(text, chr(10) order by section, k1, k2) as text from parts group by 1"""))
def _(spark, sf):
    return G.assemble(G.comment_parts(*_report_tables(spark, sf)))


@query("oversize_reports", sql(["reviews", "file_reviews", "findings"], f"""{_COMMENT_PARTS},
  placed as (select *, coalesce(sum(length(text) + 1) over (partition by review_id order by section, k1, k2
    rows between unbounded preceding and 1 preceding), 0) as before from parts)
  select review_id, (before // 1000)::int as volume, string_agg(text, chr(10) order by section, k1, k2) as text
  from placed group by 1, 2"""))
def _(spark, sf):
    """The same reports in volumes of 1000 characters."""
    return G.assemble(G.comment_parts(*_report_tables(spark, sf)), max_chars=1000)


@query("default_summaries", sql(["reviews", "file_reviews", "findings"], f"""{_REPORT_CTES},
  sums as (select review_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning from located group by 1),
  counts as (select review_id, count(*) as files from file_reviews group by 1)
  select review_id, 'Code review completed for ''' || pr_title || '''. Overall score: ' || printf('%.1f', s) || '/100 (' || {_label('s')}
    || '). Found ' || coalesce(critical, 0) || ' critical issue(s) and ' || coalesce(warning, 0) || ' warning(s) across ' || coalesce(files, 0)
    || ' file(s). ' || case when coalesce(critical, 0) > 0 then 'Address critical issues before merging.' else 'No critical issues found.' end as summary
  from r left join sums using (review_id) left join counts using (review_id)"""))
def _(spark, sf):
    return G.default_summaries(*_report_tables(spark, sf))


@query("review_prompts", sql(["file_reviews", "findings", "patches"], """
  with first as (select file_id, string_agg(item, chr(10) order by nth) as items from (
      select file_id, '- [' || upper(severity) || '] Line ' || coalesce(line_number::varchar, 'None') || ': ' || message as item,
        row_number() over (partition by file_id order by ordinal, category) as nth from findings) where nth <= 10 group by 1)
  select file_id, 'Review this ' || language || ' file: `' || filename || '`' || chr(10) || chr(10) || '```diff' || chr(10) || patch[1:6000]
    || case when length(patch) > 6000 then chr(10) || '... (truncated)' else '' end || chr(10) || '```'
    || case when items is not null then chr(10) || chr(10) || 'Static analysis already found:' || chr(10) || items else '' end
    || chr(10) || chr(10) || 'Provide additional semantic insights not already covered by static analysis.' as prompt
  from file_reviews join patches using (file_id) left join first using (file_id)"""))
def _(spark, sf):
    files = B.file_reviews(spark, sf).join(B.patches(spark, sf), "file_id")
    return G.review_prompts(files, B.findings(spark, sf))


@query("summary_prompts", sql(["reviews", "file_reviews", "findings"], f"""{_REPORT_CTES},
  counted as (select file_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning from findings group by 1),
  first as (select review_id, string_agg(item, chr(10) order by nth) as items from (
      select review_id, '- ' || filename || ': score=' || printf('%.0f', score) || ', critical=' || coalesce(critical, 0) || ', warning='
        || coalesce(warning, 0) as item, row_number() over (partition by review_id order by file_id) as nth
      from file_reviews left join counted using (file_id)) where nth <= 20 group by 1)
  select review_id, 'PR: ' || pr_title || chr(10) || 'Overall score: ' || printf('%.1f', s) || '/100' || chr(10) || chr(10) || 'Files analyzed:' || chr(10)
    || coalesce(items, '') || chr(10) || chr(10) || 'Write a 3-4 sentence executive summary of this code review. '
    || 'Be specific about the main concerns and overall code quality.' as prompt
  from r left join first using (review_id)"""))
def _(spark, sf):
    return G.summary_prompts(*_report_tables(spark, sf))


# ---- sources and sinks -------------------------------------------------------------------
@query("read_pr_files", sql(["file_headers", "patches"], """
  select review_id::varchar as review_id, filename, coalesce(case when file_id % 3 <> 0 then status end, 'modified') as status,
    case when file_id % 2 = 0 then (file_id % 9)::int else 0 end as additions, 0 as deletions, md5(coalesce(patch, '')) as patch_md5
  from file_headers left join patches using (file_id)"""))
def _(spark, sf):
    folder = run_folder(spark, "pr-files")
    key = F.col("file_id")
    B.file_headers(spark, sf).join(B.patches(spark, sf), "file_id", "left").select(
        F.col("review_id").cast("string").alias("review_id"), "filename",
        F.when(key % 3 != 0, F.col("status")).alias("status"),
        F.when(key % 2 == 0, (key % 9).cast("int")).alias("additions"), "patch",
    ).write.json(folder)
    return PR.read_pr_files(spark, folder).select(
        "review_id", "filename", "status", "additions", "deletions", F.md5(F.coalesce("patch", F.lit(""))).alias("patch_md5")
    )


@query("read_pr_headers", sql(["reviews"], """
  select pr_number as number, pr_title as title, 'f/' || pr_number as head_ref, 'main' as base_ref, md5(pr_url) as head_sha,
    repo_owner, repo_name, lines_added as additions, 0 as deletions, files_changed as changed_files, status || ',x' as labels, false as draft
  from reviews"""))
def _(spark, sf):
    folder = run_folder(spark, "pr-headers")
    B.reviews(spark, sf).select(
        F.col("pr_number").alias("number"), F.col("pr_title").alias("title"), F.lit("open").alias("state"),
        F.col("pr_url").alias("html_url"),
        F.struct(F.concat(F.lit("f/"), F.col("pr_number").cast("string")).alias("ref"), F.md5("pr_url").alias("sha")).alias("head"),
        F.struct(F.lit("main").alias("ref"), F.struct(
            F.col("repo_name").alias("name"), F.struct(F.col("repo_owner").alias("login")).alias("owner")).alias("repo")).alias("base"),
        F.col("lines_added").alias("additions"), F.col("files_changed").alias("changed_files"),
        F.array(F.struct(F.col("status").alias("name")), F.struct(F.lit("x").alias("name"))).alias("labels"),
    ).write.json(folder)
    return PR.read_pr_headers(spark, folder).withColumn("labels", F.array_join("labels", ",")).drop("body", "state", "html_url")


@query("header_files", sql(["file_headers"], """
  select review_id::int as number, filename, status, (row_number() over (partition by review_id order by file_id) - 1)::int as position,
    0 as additions from file_headers"""))
def _(spark, sf):
    folder = run_folder(spark, "pr-nested")
    files = F.sort_array(F.collect_list(F.struct("file_id", "filename", "status")))
    B.file_headers(spark, sf).groupBy("review_id").agg(files.alias("files")).select(
        F.col("review_id").cast("int").alias("number"),
        F.transform("files", lambda f: F.struct(f["filename"].alias("filename"), f["status"].alias("status"))).alias("files"),
    ).write.json(folder)
    from reviewlake import schemas

    found = PR.header_files(spark.read.schema(schemas.PR_HEADERS).json(folder))
    return found.select("number", "filename", "status", "position", "additions")


@query("decode_contents", """
  select doc_id as file_id, text as content from documents""")
def _(spark, sf):
    packed = B.prose(spark, sf).withColumn("content", F.base64(F.col("content").cast("binary")))
    return PR.decode_contents(packed)


@query("read_code_tree", "select sum(length(text))::bigint as chars, count(*) as files from documents")
def _(spark, sf):
    """documents written as one text file each, over a fixed number of folders, and read back as whole files."""
    folder = run_folder(spark, "tree")
    B.write_text_tree(B.table(spark, sf, "documents"), folder)
    tree = PR.read_code_tree(spark, folder, "*.txt")
    return tree.agg(F.sum(F.length("content") - 1).alias("chars"), F.count("*").alias("files"))


@query("write_review_tables", sql(["file_reviews", "findings", "reviews"], """
  select 'findings' as name, count(*) as rows from findings union all select 'file_reviews', count(*) from file_reviews
  union all select 'reviews', count(*) from reviews"""))
def _(spark, sf):
    """Written twice: a second run replaces what the first one stored."""
    folder = run_folder(spark, "tables")
    reviews, files, findings = _report_tables(spark, sf)
    for _ in range(2):
        T.write_review_tables(findings, files, reviews, folder, buckets=4)
    out = None
    for name in ("findings", "file_reviews", "reviews"):
        rows = T.read_review_table(spark, folder, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("write_reports", sql(["reviews", "file_reviews", "findings"], f"""{_COMMENT_PARTS}
  select 'review_' || repo_owner || '_' || repo_name || '_pr' || pr_number || '_' || strftime(created_at, '%Y%m%d_%H%M%S') || '.md' as name,
    0 as volume, string_agg(text, chr(10) order by section, k1, k2) as text
  from parts join reviews using (review_id) where status = 'completed' group by 1, review_id"""))
def _(spark, sf):
    reviews, files, findings = _report_tables(spark, sf)
    done = reviews.where("status = 'completed'")
    parts = G.comment_parts(done, files.join(done.select("review_id"), "review_id", "left_semi"), findings)
    name = T.report_name(F.col("repo_owner"), F.col("repo_name"), F.col("pr_number"), F.col("created_at"))
    documents = G.assemble(parts).join(done.select("review_id", name.alias("name")), "review_id")
    folder = run_folder(spark, "reports")
    T.write_reports(documents, folder)
    return T.read_reports(spark, folder)
