"""The derivations of ``bindings`` as DuckDB common table expressions."""

from __future__ import annotations

from checks.bindings import EXTENSIONS, IGNORED
from checks.snippets import SNIPPETS
from reviewlake.rules.catalog import EXTENSIONS as LANGUAGE_OF, SUPPORTED_LANGUAGES


def q(text: str) -> str:
    """SQL string literal; line breaks are spelled as chr(10)."""
    return "'" + text.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def items(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _lines(levels: int) -> str:
    indent = f"repeat('    ', (l_linenumber % {levels})::int)"
    return f"""select *, {indent} || replace(snip, chr(10), chr(10) || {indent}) as code
      from (select *, ({items(SNIPPETS)})[(l_partkey % {len(SNIPPETS)})::int + 1] as snip from lineitem)"""


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_LANGUAGE_CASE = "case suffix " + " ".join(
    f"when {q(k)} then {q(v)}" for k, v in LANGUAGE_OF.items()
) + " else 'unknown' end"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines3": ((), _lines(3)),
    "lines5": ((), _lines(5)),
    "file_headers": ((), f"""
      select o_orderkey as file_id, o_custkey as review_id,
             'src/mod' || (o_orderkey % 97) || '/f' || o_orderkey
               || ({items(EXTENSIONS)})[(o_orderkey % 10)::int + 1] as filename,
             case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 'removed'
                  when o_orderstatus = 'O' then 'added' else 'modified' end as status
      from orders"""),
    "pr_files": (("lines3", "file_headers"), f"""
      select h.*, coalesce(additions, 0) as additions, coalesce(deletions, 0) as deletions,
             coalesce(content, '') as content
      from file_headers h left join (
        select l_orderkey, string_agg(code, chr(10) order by {_ORDER}) as content,
               count(*) filter (l_returnflag = 'A') as additions,
               count(*) filter (l_returnflag = 'R') as deletions
        from lines3 group by 1) c on c.l_orderkey = h.file_id"""),
    "named_files": (("pr_files",), f"""
      select *, {_LANGUAGE_CASE} as language
      from (select *, lower(regexp_extract(filename, '[^/](\\.[^./]+)/*$', 1)) as suffix from pr_files)"""),
    "text_files": (("named_files",), f"""
      select file_id, review_id, filename, language, additions, deletions, content from named_files
      where status <> 'removed' and language in ({", ".join(q(x) for x in SUPPORTED_LANGUAGES)})"""),
    "code_files": (("lines5",), """
      select l_suppkey as file_id,
             (['python', 'rust', 'ruby', 'solidity', 'javascript', 'go', 'java', 'typescript'])
               [(l_suppkey % 8)::int + 1] as language,
             string_agg(code, chr(10) order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate)
               as content
      from lines5 group by 1, 2"""),
    "patches": (("lines3",), f"""
      select l_orderkey as file_id, string_agg(diff, chr(10) order by {_ORDER}) as patch
      from (select *, case when l_linenumber in (1, 4) then hunk || chr(10) else '' end || signed as diff
            from (select *, sign || replace(code, chr(10), chr(10) || sign) as signed,
                    '@@ -' || (l_orderkey % 50 + l_linenumber * 100) || ',3 +'
                      || (l_orderkey % 70 + l_linenumber * 100) || ',3 @@' as hunk
                  from (select *, case l_returnflag when 'A' then '+' when 'R' then '-' else ' ' end as sign
                        from lines3)))
      group by 1"""),
    "projects": ((), """
      select n_nationkey::bigint as project_id, replace(lower(r_name), ' ', '-') as owner, lower(n_name) as repo,
             'https://github.com/' || replace(lower(r_name), ' ', '-') || '/' || lower(n_name) as repo_url,
             n_nationkey % 2 = 0 as auto_watch,
             case n_nationkey % 3 when 0 then 'bugs, security' when 1 then 'style,performance ,architecture'
               else '' end as enabled_categories
      from nation join region on n_regionkey = r_regionkey"""),
    "ignore_patterns": ((), f"""
      select n_nationkey::bigint as project_id, unnest({items(IGNORED)}) as pattern, true as is_regex
      from nation where n_nationkey % 5 = 0"""),
    "reviews": ((), """
      select c_custkey as review_id, c_nationkey::bigint as project_id,
             'https://github.com/org' || c_nationkey || '/nation_' || c_nationkey || '/pull/' || c_custkey as pr_url,
             c_custkey as pr_number, 'Change ' || c_name as pr_title, 'org' || c_nationkey as repo_owner,
             'Nation_' || c_nationkey as repo_name,
             case when done then (whole % 1001)::double / 10.0 end as score, status, files_changed,
             whole % 500 as lines_added, whole % 300 as lines_removed,
             case when done then whole % 40 end as total_findings,
             case when done then whole % 7 end as critical_count,
             case when done then whole % 13 end as warning_count,
             case when done then whole % 20 end as suggestion_count,
             created_at, case when done then last end as completed_at
      from (select *, status = 'completed' as done from (
        select *, floor(abs(c_acctbal))::bigint as whole,
               case c_mktsegment when 'BUILDING' then 'pending' when 'MACHINERY' then 'running'
                 when 'HOUSEHOLD' then 'failed' else 'completed' end as status
        from customer join (
          select o_custkey, min(o_orderdate) as created_at, max(o_orderdate) as last, count(*) as files_changed
          from orders group by 1) on c_custkey = o_custkey))"""),
    "file_reviews": ((), """
      select o_orderkey as file_id, o_custkey as review_id, 'src/f' || o_orderkey as filename,
             (['python', 'javascript', 'typescript', 'go', 'rust', 'java', 'ruby', 'solidity', 'python', 'go'])
               [(o_orderkey % 10)::int + 1] as language,
             (floor(o_totalprice)::bigint % 101)::double as score
      from orders"""),
    "findings": ((), """
      select l_orderkey as file_id,
             (['bugs', 'security', 'style', 'performance', 'architecture'])[l_linenumber % 5 + 1] as category,
             case l_returnflag when 'A' then 'critical' when 'R' then 'warning' else 'suggestion' end as severity,
             case when l_linenumber <> 7 then l_quantity::int end as line_number,
             'Issue kind ' || (l_partkey % 20) || ' seen' as message,
             'code_' || (l_partkey % 50) || '()' as code_snippet,
             case when l_partkey % 3 <> 0 then 'Fix ' || (l_partkey % 20) end as suggestion,
             case l_partkey % 20 when 0 then null when 1 then '' else 'R' || (l_partkey % 20) end as rule_id,
             l_linenumber::bigint * 10000000000 + l_partkey * 1000 + l_suppkey % 1000 as ordinal
      from lineitem"""),
    "deliveries": (("projects",), """
      select 'd' || event_id as delivery_id, event_type, body, ts as received_at, unnest(range(1, copies + 1)) as copy
      from (
        select *, case when event_id % 97 = 0 then '{broken' when event_type = 'pull_request' then
            '{"action":"' || (['opened', 'synchronize', 'reopened', 'closed'])[(event_id % 4)::int + 1]
            || '","pull_request":{"html_url":"'
            || case when event_id % 11 = 0 then '' else 'https://github.com/' || full_name || '/pull/' || event_id end
            || '","number":' || event_id || '},"repository":{"full_name":"' || full_name || '"}}'
          when event_type = 'push' then
            '{"ref":"refs/heads/b' || (user_id % 7) || '","repository":{"full_name":"' || full_name || '"}}'
          else '{}' end as body,
          case when event_id % 10 = 0 then 2 else 1 end as copies
        from (
          select event_id, ts, user_id,
                 case when event_type = 'click' then 'push' when event_type in ('purchase', 'signup') then 'pull_request'
                   else event_type end as event_type,
                 upper(coalesce(owner, 'nobody')) || '/' || coalesce(repo, 'none') as full_name
          from events left join projects on user_id % 30 = project_id))"""),
    "settings_log": ((), """
      select event_type as key, value::decimal(18,2)::varchar as value, ts as updated_at, event_id from events"""),
}


def sql(needs, body: str) -> str:
    """``body`` behind the derivations it needs, each computed once."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in CTES[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} as materialized ({CTES[name][1]})" for name in order]
    body = body.strip()
    if body.startswith("with "):
        return "with " + ",\n".join([*parts, body[5:]]) if parts else body
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
