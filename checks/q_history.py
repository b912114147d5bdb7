"""Stored reviews: joins, aggregates, windows, top-k, sets; and the scored review of changed files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import bindings as B
from checks.bindings_sql import sql
from checks.q_rules import NO_SQL, rule_sql
from reviewlake.operators import aggregates as A
from reviewlake.operators import findings as FI
from reviewlake.operators import history as H
from reviewlake.plans.review import ReviewOptions, files_with_text, review_files
from reviewlake.rules.model import BLOCK_RULES, pattern_rules
from reviewlake.session import materialize
from reviewlake.sources.settings import read_settings

QUERIES = {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = (function, oracle)
        return function

    return add


WEIGHT = "case severity when 'critical' then 10 when 'warning' then 5 else 1 end"
SCORED = f"""
  scored as (select file_id, review_id, count(severity) as findings_count,
      count(*) filter (severity = 'critical') as critical_count, count(*) filter (severity = 'warning') as warning_count,
      count(*) filter (severity = 'suggestion') as suggestion_count,
      coalesce(sum(case when severity is not null then {WEIGHT} end), 0)::bigint as penalty
    from file_reviews left join findings using (file_id) group by 1, 2)"""


def _scored(spark, sf):
    files = B.file_reviews(spark, sf).select("file_id", "review_id")
    return A.file_scores(files, B.findings(spark, sf))


@query("file_scores", sql(["file_reviews", "findings"], f"""with {SCORED.strip()}
  select *, greatest(0.0, least(100.0, 100.0 - penalty))::double as score from scored"""))
def _(spark, sf):
    return _scored(spark, sf)


_REVIEW_SUMS = """review_id, count(*) as files_analyzed, sum(findings_count)::bigint as total_findings,
    sum(critical_count)::bigint as critical_count, sum(warning_count)::bigint as warning_count,
    sum(suggestion_count)::bigint as suggestion_count"""


@query("review_scores", sql(["file_reviews", "findings"], f"""with {SCORED.strip()}
  select {_REVIEW_SUMS}, greatest(0.0, least(100.0, 100.0 - sum(penalty)::double / greatest(count(*) * 2, 1)))::double as score
  from scored group by 1"""))
def _(spark, sf):
    return A.review_scores(_scored(spark, sf))


@query("review_scores_plain", sql(["file_reviews", "findings"], f"""with {SCORED.strip()}
  select review_id, greatest(0.0, least(100.0, 100.0 - sum(penalty)::double))::double as score from scored group by 1"""))
def _(spark, sf):
    return A.review_scores(_scored(spark, sf), normalise=False).select("review_id", "score")


@query("all_review_scores", sql(["file_reviews", "findings"], f"""with {SCORED.strip()},
  r as (select {_REVIEW_SUMS}, greatest(0.0, least(100.0, 100.0 - sum(penalty)::double / greatest(count(*) * 2, 1)))::double as score
    from scored group by 1)
  select c_custkey as review_id, coalesce(files_analyzed, 0) as files_analyzed, coalesce(total_findings, 0) as total_findings,
    coalesce(critical_count, 0) as critical_count, coalesce(warning_count, 0) as warning_count,
    coalesce(suggestion_count, 0) as suggestion_count, coalesce(score, 100.0) as score
  from customer left join r on c_custkey = review_id"""))
def _(spark, sf):
    everyone = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("review_id"))
    return A.score_all_reviews(everyone, A.review_scores(_scored(spark, sf)))


@query("analysed_counts", """
  select o_custkey as review_id, count(*) filter (o_orderpriority <> '1-URGENT') as files_analyzed,
    count(*) filter (o_orderpriority = '1-URGENT') as files_skipped from orders group by 1""")
def _(spark, sf):
    error = F.when(F.col("o_orderpriority") == "1-URGENT", "failed")
    files = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("review_id"), error.alias("error"))
    return A.analysed_counts(files)


@query("severity_counts", sql(["findings"], """
  select category, count(*) filter (severity = 'critical') as critical_count,
    count(*) filter (severity = 'warning') as warning_count, count(*) filter (severity = 'suggestion') as suggestion_count
  from findings group by 1"""))
def _(spark, sf):
    return B.findings(spark, sf).groupBy("category").agg(*A.severity_counts())


@query("severity_pivot", sql(["findings"], """
  select file_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning
  from findings group by 1"""))
def _(spark, sf):
    return A.severity_pivot(B.findings(spark, sf))


@query("rule_hit_rate", sql(["findings"], """
  select rule_id, count(*) as findings, count(distinct file_id) as files from findings group by 1"""))
def _(spark, sf):
    return A.rule_hit_rate(B.findings(spark, sf))


@query("category_cube", sql(["findings", "file_reviews"], """
  select category, severity, language, grouping_id(category, severity, language) as level, count(*) as findings
  from findings join file_reviews using (file_id) group by cube (category, severity, language)"""))
def _(spark, sf):
    languages = B.file_reviews(spark, sf).select("file_id", "language")
    return A.category_cube(B.findings(spark, sf).join(languages, "file_id"))


@query("filter_reviews", sql(["reviews"], """
  select review_id, repo_name, status, score from reviews
  where status = 'completed' and repo_name ilike '%nation_1%' and score >= 20 and score <= 90"""))
def _(spark, sf):
    found = H.filter_reviews(B.reviews(spark, sf), "completed", "NATION_1", 20.0, 90.0)
    return found.select("review_id", "repo_name", "status", "score")


_NEWEST = "order by created_at desc, review_id desc"


@query("review_page", sql(["reviews"], f"""
  select review_id, created_at, status from reviews {_NEWEST} limit 20 offset 40"""))
def _(spark, sf):
    return H.page(B.reviews(spark, sf), 3, 20).select("review_id", "created_at", "status")


@query("review_page_after", sql(["reviews"], f"""
  select review_id, created_at, status from reviews
  where created_at < timestamp '1995-06-01' or (created_at = timestamp '1995-06-01' and review_id < 100)
  {_NEWEST} limit 20"""))
def _(spark, sf):
    return H.page_after(B.reviews(spark, sf), "1995-06-01 00:00:00", 100).select("review_id", "created_at", "status")


@query("page_counts", sql(["reviews"], """
  select count(*) as total, greatest(1, ceil(count(*) / 20.0))::bigint as pages from reviews"""))
def _(spark, sf):
    return H.page_counts(B.reviews(spark, sf))


@query("recent_reviews", sql(["reviews"], f"select review_id, created_at from reviews {_NEWEST} limit 10"))
def _(spark, sf):
    return H.recent(B.reviews(spark, sf)).select("review_id", "created_at")


@query("review_stats", sql(["reviews"], """
  select count(*) as total_reviews, printf('%.1f', coalesce(avg(score), 0))::double as avg_score,
    coalesce(sum(total_findings), 0)::bigint as total_findings_sum, coalesce(sum(critical_count), 0)::bigint as critical_count_sum,
    coalesce(sum(warning_count), 0)::bigint as warning_count_sum, coalesce(sum(suggestion_count), 0)::bigint as suggestion_count_sum
  from reviews"""))
def _(spark, sf):
    return H.review_stats(B.reviews(spark, sf))


@query("reviews_by_status", sql(["reviews"], "select status, count(*) as reviews from reviews group by 1"))
def _(spark, sf):
    return H.reviews_by_status(B.reviews(spark, sf))


@query("top_languages", sql(["file_reviews"], """
  select language, count(*) as files from file_reviews group by 1 order by files desc, language limit 5"""))
def _(spark, sf):
    return H.top_languages(B.file_reviews(spark, sf))


@query("score_trend", sql(["reviews"], f"""
  select review_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as date, score
  from (select * from reviews where score is not null {_NEWEST} limit 10)"""))
def _(spark, sf):
    return H.score_trend(B.reviews(spark, sf))


@query("newest_per_project", sql(["reviews", "projects"], """
  select review_id, project_id, owner, repo, rank::int as rank from (
    select *, row_number() over (partition by project_id order by created_at desc, review_id desc) as rank from reviews)
  join projects using (project_id) where rank <= 5"""))
def _(spark, sf):
    found = H.project_reviews(B.reviews(spark, sf), B.projects(spark, sf), 5)
    return found.select("review_id", "project_id", "owner", "repo", "rank")


@query("project_patterns", sql(["projects", "ignore_patterns"], """
  select project_id, owner, repo, pattern, is_regex from projects join ignore_patterns using (project_id)
  union all select project_id, owner, repo, '(broken', true from projects where project_id % 5 = 0"""))
def _(spark, sf):
    return H.project_patterns(B.projects(spark, sf), B.ignore_patterns(spark, sf))


@query("new_projects", sql(["reviews", "projects"], """
  select distinct repo_url, project_id from (select 'https://github.com/' || case when project_id % 2 = 0 then owner else 'other' end
    || '/' || repo as repo_url, project_id from reviews join projects using (project_id)) r
  where not exists (select 1 from projects p where p.repo_url = r.repo_url)"""))
def _(spark, sf):
    known = B.projects(spark, sf)
    owner = F.when(F.col("project_id") % 2 == 0, F.col("owner")).otherwise("other")
    asked = B.reviews(spark, sf).select("project_id").join(known, "project_id").select(
        F.concat(F.lit("https://github.com/"), owner, F.lit("/"), "repo").alias("repo_url"), "project_id"
    ).distinct()
    return H.new_projects(asked, known)


@query("nested_reviews", sql(["reviews", "file_reviews", "findings"], """
  with per_file as (select file_id, string_agg(category || ':' || severity || ':' || coalesce(line_number::varchar, '-'), ','
      order by ordinal, category, severity, line_number) as listed from findings group by 1)
  select review_id, status, string_agg(filename || '[' || coalesce(listed, '') || ']', ';' order by file_id) as files
  from reviews left join file_reviews using (review_id) left join per_file using (file_id) group by 1, 2"""))
def _(spark, sf):
    nested = H.nested_reviews(B.reviews(spark, sf), B.file_reviews(spark, sf), B.findings(spark, sf))
    shown = F.transform(
        "files",
        lambda f: F.concat(
            f["filename"], F.lit("["),
            F.array_join(F.transform(f["findings"], lambda x: F.concat_ws(
                ":", x["category"], x["severity"], F.coalesce(x["line_number"].cast("string"), F.lit("-")))), ","),
            F.lit("]"),
        ),
    )
    return nested.select("review_id", "status", F.array_join(shown, ";").alias("files"))


@query("nested_reviews_in_parts", sql(["reviews", "file_reviews", "findings"], """
  with big as (select file_id, ceil(count(*) / 3.0)::bigint as parts from findings group by 1 having count(*) > 3),
  pieces as (select file_id, coalesce(ordinal % parts, 0) as piece, count(*) as n from findings left join big using (file_id) group by 1, 2),
  files as (select review_id, file_id, coalesce(piece, 0) as piece, coalesce(n, 0) as n from file_reviews left join pieces using (file_id)),
  hot as (select review_id, ceil(count(*) / 3.0)::bigint as parts from files group by 1 having count(*) > 3)
  select review_id, coalesce((file_id + piece) % parts, 0) as part, count(*) as files, sum(n)::bigint as findings
  from reviews join files using (review_id) left join hot using (review_id) group by 1, 2"""))
def _(spark, sf):
    nested = H.nested_reviews(B.reviews(spark, sf), B.file_reviews(spark, sf), B.findings(spark, sf), limit=3)
    counted = F.aggregate(F.transform("files", lambda f: F.size(f["findings"])), F.lit(0), lambda a, b: a + b)
    return nested.select(
        "review_id", "part", F.size("files").cast("bigint").alias("files"), counted.cast("bigint").alias("findings")
    )


@query("score_moves", sql(["reviews"], """
  select repo_name, row_number() over w as position, review_id, created_at, score,
    round(score - lag(score) over w, 6) as change,
    round(avg(score) over (partition by repo_name order by created_at, review_id rows between 4 preceding and current row), 6)
      as moving_average
  from reviews where score is not null window w as (partition by repo_name order by created_at, review_id)"""))
def _(spark, sf):
    moved = H.score_moves(B.reviews(spark, sf))
    return moved.withColumns(
        {"change": F.round("change", 6), "moving_average": F.round("moving_average", 6)}
    )


@query("latest_settings", sql(["settings_log"], """
  select key, arg_max(value, (updated_at, event_id)) as value, max(updated_at) as updated_at from settings_log group by 1"""))
def _(spark, sf):
    return H.latest_settings(B.settings_log(spark, sf), "event_id")


@query("read_settings", sql(["settings_log"], """
  with stored as (select key, arg_max(case when event_id % 3 = 0 then '' else value end, (updated_at, event_id)) as v
    from settings_log group by 1),
  defaults as (select 'error' as key, 'x' as value union all select 'click', 'y' union all select 'other', 'z' union all select 'api_port', '8765')
  select key, case when key = 'click' then case when s <> '' then '***' else '' end else s end as value,
    case when key = 'api_port' then try_cast(s as int) end as number
  from (select key, coalesce(v, value, '') as s from defaults left join stored using (key))"""))
def _(spark, sf):
    log = B.settings_log(spark, sf).withColumn("value", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("value")))
    defaults = spark.sql(
        "select * from values ('error', 'x'), ('click', 'y'), ('other', 'z'), ('api_port', '8765') as t(key, value)"
    )
    return read_settings(H.latest_settings(log, "event_id"), defaults, sensitive=("click",))


@query("purge_reviews", sql(["reviews", "file_reviews", "findings"], """
  with gone as (select review_id from reviews where status = 'failed')
  select 'reviews' as name, count(*) as rows from reviews where review_id not in (select * from gone)
  union all select 'file_reviews', count(*) from file_reviews where review_id not in (select * from gone)
  union all select 'findings', count(*) from findings where file_id not in (
    select file_id from file_reviews where review_id in (select * from gone))"""))
def _(spark, sf):
    reviews = B.reviews(spark, sf)
    doomed = reviews.where("status = 'failed'").select("review_id")
    tables = H.purge(reviews, B.file_reviews(spark, sf), B.findings(spark, sf), doomed)
    counts = [
        t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        for n, t in zip(("reviews", "file_reviews", "findings"), tables)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("purge_projects", sql(["projects", "ignore_patterns", "reviews"], """
  select coalesce(case when project_id % 3 <> 1 then project_id end, -1) as project_id, count(*) as reviews
  from reviews group by 1"""))
def _(spark, sf):
    projects = B.projects(spark, sf)
    doomed = projects.where("project_id % 3 = 1").select("project_id")
    _, _, reviews = H.purge_projects(projects, B.ignore_patterns(spark, sf), B.reviews(spark, sf), doomed)
    return reviews.groupBy(F.coalesce("project_id", F.lit(-1)).alias("project_id")).agg(F.count("*").alias("reviews"))


@query("files_with_patch", sql(["file_headers", "patches"], """
  with changed as (select review_id, split_part(filename, '/', 2) as filename, patch, file_id as position
    from file_headers join patches using (file_id)),
  first as (select review_id, filename, arg_min(patch, position) as patch from changed group by 1, 2)
  select h.file_id, f.patch from (select *, split_part(filename, '/', 2) as folder from file_headers) h
  left join first f on f.review_id = h.review_id and f.filename = h.folder"""))
def _(spark, sf):
    folder = F.split_part("filename", F.lit("/"), F.lit(2))
    headers = B.file_headers(spark, sf).withColumn("filename", folder)
    changed = headers.join(B.patches(spark, sf), "file_id").withColumn("position", F.col("file_id"))
    return H.files_with_patch(headers.select("file_id", "review_id", "filename"), changed).select("file_id", "patch")


_DEDUPED = """select * from (select *, row_number() over (partition by file_id, category, line_number,
    coalesce(nullif(rule_id, ''), message[1:50]) order by ordinal, severity, message) as nth from findings) where nth = 1"""


@query("dedupe_findings", sql(["findings"], f"""
  select file_id, category, line_number, coalesce(nullif(rule_id, ''), message[1:50]) as key, ordinal from ({_DEDUPED})"""))
def _(spark, sf):
    kept = FI.dedupe_findings(B.findings(spark, sf))
    return kept.select("file_id", "category", "line_number", FI.finding_key().alias("key"), "ordinal")


@query("sort_findings", sql(["findings"], f"""
  select file_id, ordinal, severity, line_number, row_number() over (order by
    case severity when 'critical' then 0 when 'warning' then 1 when 'suggestion' then 2 else 3 end,
    coalesce(line_number, 0), file_id, ordinal) - 1 as place from findings"""))
def _(spark, sf):
    """All findings in order; the place is that in the sorted, written table."""
    ordered = FI.sort_findings(B.findings(spark, sf), "file_id", "ordinal").select("file_id", "ordinal", "severity", "line_number")
    parts = ordered.withColumn("at", F.monotonically_increasing_id())  # part and row of the sort by range
    stored = materialize(parts.withColumn("part", F.shiftright("at", 33)), "sorted")
    sizes = stored.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored.join(sizes.select("part", "first", before.alias("before")), "part")
    return placed.select("file_id", "ordinal", "severity", "line_number", (F.col("before") + F.col("at") - F.col("first")).alias("place"))


@query("newest_projects", sql(["projects", "reviews"], """
  select project_id, owner, repo, min(created_at) as created_at from projects join reviews using (project_id)
  group by 1, 2, 3 order by created_at desc, project_id desc limit 10"""))
def _(spark, sf):
    """The ten newest projects, each as old as its first review."""
    since = B.reviews(spark, sf).groupBy("project_id").agg(F.min("created_at").alias("created_at"))
    projects = B.projects(spark, sf).join(since, "project_id").select("project_id", "owner", "repo", "created_at")
    return H.newest_projects(projects, 10)


def _halves(spark, sf):
    named = B.findings(spark, sf).join(B.file_reviews(spark, sf).select("file_id", "filename", "review_id"), "file_id")
    by_name = named.withColumn("filename", F.concat(F.lit("m"), (F.col("file_id") % 199).cast("string")))
    return by_name.where("review_id % 2 = 0"), by_name.where("review_id % 2 = 1")


_HALVES = """with named as (select f.*, review_id, 'm' || (file_id % 199) as filename from findings f join file_reviews using (file_id))"""


@query("new_findings", sql(["findings", "file_reviews"], _HALVES + """
  select file_id, ordinal, rule_id from named a where review_id % 2 = 1 and not exists (
    select 1 from named b where b.review_id % 2 = 0 and a.filename = b.filename
      and a.rule_id is not distinct from b.rule_id and a.code_snippet = b.code_snippet)"""))
def _(spark, sf):
    before, after = _halves(spark, sf)
    return FI.new_findings(before, after).select("file_id", "ordinal", "rule_id")


@query("fixed_findings", sql(["findings", "file_reviews"], _HALVES + """
  select file_id, ordinal, rule_id from named a where review_id % 2 = 0 and not exists (
    select 1 from named b where b.review_id % 2 = 1 and a.filename = b.filename
      and a.rule_id is not distinct from b.rule_id and a.code_snippet = b.code_snippet)"""))
def _(spark, sf):
    before, after = _halves(spark, sf)
    return FI.fixed_findings(before, after).select("file_id", "ordinal", "rule_id")


# ---- the whole review, restricted to rules that the SQL dialect can express ---------------
COMMON = [r for r in pattern_rules() if r.id not in NO_SQL and r.id not in BLOCK_RULES]
COMMON = [r for r in COMMON if r.id not in ("PERF-LOOP001", "JS-NAM001")]


def _findings_cte():
    return "found as materialized (" + " union all ".join(rule_sql(r) for r in COMMON) + ")"


def reviewed(spark, sf, rules=COMMON, **options):
    files = B.pr_files(spark, sf)
    return review_files(files, ReviewOptions(rules=rules, **options))


_FILE_ROWS = f"""
  rows as (select t.file_id, t.review_id, t.filename, t.language, count(severity) as findings_count,
      count(*) filter (severity = 'critical') as critical_count,
      coalesce(sum(case when severity is not null then {WEIGHT} end), 0)::bigint as penalty
    from text_files t left join found using (file_id) group by 1, 2, 3, 4),
  files as (select *, greatest(0.0, least(100.0, 100.0 - penalty))::double as score from rows)"""


@query("worst_files", sql(["text_files"], f"""with {_findings_cte()}, {_FILE_ROWS}
  select file_id, filename, language, findings_count, critical_count, score from files
  order by score, file_id limit 20"""))
def _(spark, sf):
    files = reviewed(spark, sf).files.orderBy("score", "file_id").limit(20)
    return files.select("file_id", "filename", "language", "findings_count", "critical_count", "score")


@query("review_files", sql(["text_files"], f"""with {_findings_cte()}, {_FILE_ROWS}
  select review_id, count(*) as files_analyzed, sum(findings_count)::bigint as total_findings,
    sum(critical_count)::bigint as critical_count,
    greatest(0.0, least(100.0, 100.0 - sum(penalty)::double / greatest(count(*) * 2, 1)))::double as score
  from files group by 1"""))
def _(spark, sf):
    return reviewed(spark, sf).reviews.select(
        "review_id", "files_analyzed", "total_findings", "critical_count", "score"
    )


@query("review_security_only", sql(["text_files"], f"""with {_findings_cte()}
  select rule_id, severity, count(*) as findings from found where category = 'security' group by 1, 2"""))
def _(spark, sf):
    found = reviewed(spark, sf, categories=("security",)).findings
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))


@query("review_all_rules")
def _(spark, sf):
    """Everything switched on, over the whole corpus: findings per rule."""
    return review_files(B.put_together(B.pr_files(spark, sf))).findings.groupBy("category", "rule_id", "severity").agg(
        F.count("*").alias("findings"), F.count_distinct("file_id").alias("files")
    )


@query("review_patches")
def _(spark, sf):
    """Everything, on unified diffs."""
    files = B.file_headers(spark, sf).join(B.patches(spark, sf), "file_id", "left").select(
        "*", F.lit(1).alias("additions"), F.lit(0).alias("deletions")
    )
    return review_files(B.put_together(files_with_text(files))).files.groupBy("language").agg(
        F.count("*").alias("files"), F.sum("findings_count").alias("findings"), F.avg("score").alias("score")
    )
