"""Webhook deliveries as batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks import q_history as H
from checks.bindings_sql import sql
from checks.q_files import text_files
from checks.q_rules import rules_named, rules_sql
from reviewlake.plans.review import ReviewOptions
from reviewlake.operators.scan import scan_rules
from reviewlake.rules import catalog as C
from reviewlake.session import run_folder
from reviewlake.streaming import events as E
from reviewlake.streaming import runs

QUERIES = {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = (function, oracle)
        return function

    return add


def plain(df):
    """Times without a zone, as in the given tables."""
    return df.select(
        *[F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n) for n, t in df.dtypes]
    )


def stream_of(spark, df, name, pieces=2):
    """The rows of a table as a stream, in several files."""
    folder = run_folder(spark, name)
    df.repartition(pieces).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)


_JSON = "json_valid(body)"
_PULLS = f"""
  valid as materialized (select *, case when json_valid(body) then body else '{{}}' end as doc, json_valid(body) as is_valid from deliveries),
  pulls as (select d.*, json_extract_string(doc, '$.action') as action, json_extract_string(doc, '$.pull_request.html_url') as pr_url,
      json_extract_string(doc, '$.pull_request.number')::bigint as pr_number,
      lower(json_extract_string(doc, '$.repository.full_name')) as full_name
    from valid d where event_type = 'pull_request' and is_valid),
  triaged as (select pulls.*, project_id from pulls join projects on lower(owner || '/' || repo) = full_name
    where action in ('opened', 'synchronize', 'reopened') and pr_url <> '' and pr_number <> 0 and auto_watch)"""


@query("check_deliveries", sql(["deliveries"], f"""
  select delivery_id, copy, case when not {_JSON} then 'Invalid JSON payload' end as rejected from deliveries"""))
def _(spark, sf):
    return E.check_deliveries(B.deliveries(spark, sf)).select("delivery_id", "copy", "rejected")


@query("route_events", sql(["deliveries"], """
  select event_type, count(*) as deliveries from deliveries where event_type in ('pull_request', 'push') group by 1"""))
def _(spark, sf):
    return E.route_events(B.deliveries(spark, sf)).groupBy("event_type").agg(F.count("*").alias("deliveries"))


def _good(spark, sf):
    return E.route_events(E.accepted(E.check_deliveries(B.deliveries(spark, sf))))


@query("triage_pull_requests", sql(["deliveries", "projects"], f"""with {_PULLS.strip()}
  select delivery_id, copy, project_id, action, pr_url, pr_number from triaged"""))
def _(spark, sf):
    found = E.triage_pull_requests(_good(spark, sf), B.projects(spark, sf))
    return found.select("delivery_id", "copy", "project_id", "action", "pr_url", "pr_number")


_QUEUED = """select md5('review:' || delivery_id) as review_id, project_id, pr_url, pr_number, split_part(pr_url, '/', 4) as repo_owner,
    split_part(pr_url, '/', 5) as repo_name, 'pending' as status, received_at as created_at from triaged"""


@query("queue_reviews", sql(["deliveries", "projects"], f"with {_PULLS.strip()} {_QUEUED}"))
def _(spark, sf):
    return plain(E.queue_reviews(E.triage_pull_requests(_good(spark, sf), B.projects(spark, sf))))


_RECORDS = f"""with {_PULLS.strip()},
  pushes as (select d.*, project_id, json_extract_string(doc, '$.ref') as ref, json_extract_string(doc, '$.repository.full_name') as full_name
    from valid d join projects on lower(owner || '/' || repo) = lower(json_extract_string(doc, '$.repository.full_name'))
    where event_type = 'push' and is_valid),
  records as (
    select project_id, 'pull_request' as event_type, body as payload, delivery_id, md5('review:' || delivery_id) as review_id from triaged
    union all select project_id, 'push', '{{"ref":"' || ref || '","repo":"' || full_name || '","delivery_id":"' || delivery_id || '"}}',
      delivery_id, null from pushes)"""


@query("webhook_records", sql(["deliveries", "projects"], _RECORDS + " select *, true as processed from records"))
def _(spark, sf):
    return E.webhook_records(_good(spark, sf), B.projects(spark, sf)).drop("received_at")


@query("dedupe_deliveries", sql(["deliveries"], "select distinct delivery_id, event_type from deliveries"))
def _(spark, sf):
    return E.dedupe_deliveries(B.deliveries(spark, sf)).select("delivery_id", "event_type")


@query("dedupe_deliveries_stream", sql(["deliveries"], "select distinct delivery_id, event_type from deliveries"))
def _(spark, sf):
    rows = B.deliveries(spark, sf).select("delivery_id", "event_type", "received_at")
    stream = E.dedupe_deliveries(stream_of(spark, rows, "dedupe"), late="400 days")
    return runs.run_available(stream, "deduped").select("delivery_id", "event_type")


_RATES = """select time_bucket(interval '1 hour', received_at) as starts, time_bucket(interval '1 hour', received_at) + interval '1 hour' as ends,
  event_type, count(*) as deliveries from deliveries group by 1, 2, 3"""


@query("event_rates", sql(["deliveries"], _RATES))
def _(spark, sf):
    return plain(E.event_rates(B.deliveries(spark, sf)))


@query("event_rates_stream", sql(["deliveries"], _RATES + """
  having time_bucket(interval '1 hour', received_at) + interval '1 hour' <= (select max(received_at) - interval '1 minute' from deliveries)"""))
def _(spark, sf):
    """Closed windows only: one file per batch, in order of time, so that nothing is late."""
    folder = run_folder(spark, "ordered")
    rows = B.deliveries(spark, sf).select("event_type", "received_at")
    rows.repartitionByRange(1, "received_at").write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    return plain(runs.run_available(E.event_rates(stream, late="1 minute"), "rates"))


@query("event_rates_sliding", sql(["deliveries"], """
  select starts, starts + interval '2 hours' as ends, event_type, count(*) as deliveries from (
    select event_type, unnest([time_bucket(interval '1 hour', received_at), time_bucket(interval '1 hour', received_at) - interval '1 hour']) as starts
    from deliveries) group by 1, 2, 3"""))
def _(spark, sf):
    return plain(E.event_rates(B.deliveries(spark, sf), "2 hours", "1 hour"))


@query("event_sessions", sql(["deliveries"], """
  with gaps as (select *, (received_at - lag(received_at) over w >= interval '5 minutes')::int as cut from deliveries
      window w as (partition by event_type order by received_at, delivery_id, copy)),
  runs as (select *, sum(coalesce(cut, 0)) over (partition by event_type order by received_at, delivery_id, copy
    rows unbounded preceding) as run from gaps)
  select min(received_at) as starts, max(received_at) + interval '5 minutes' as ends, event_type, count(*) as deliveries
  from runs group by event_type, run"""))
def _(spark, sf):
    return plain(E.event_sessions(B.deliveries(spark, sf), "5 minutes"))


def _lifecycles(spark, sf):
    orders = B.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey")
    started = orders.select(key.alias("review_id"), F.col("o_orderdate").alias("started_at"))
    finished = orders.where(key % 4 != 0).select(
        key.alias("review_id"),
        (F.col("o_orderdate") + F.make_interval(mins=(key % 90).cast("int"))).alias("finished_at"),
        F.when(key % 5 == 0, "failed").otherwise("completed").alias("status"),
    )
    return started, finished


_LIFE = """
  select o_orderkey as review_id, o_orderdate as started_at,
    case when done then o_orderdate + to_minutes(o_orderkey % 90) end as finished_at,
    case when done then case when o_orderkey % 5 = 0 then 'failed' else 'completed' end else 'timeout' end as outcome,
    case when done then (o_orderkey % 90)::double * 60 end as seconds
  from (select *, o_orderkey % 4 <> 0 and o_orderkey % 90 <= 60 as done from orders)"""


@query("review_lifecycle", _LIFE)
def _(spark, sf):
    return plain(E.review_lifecycle(*_lifecycles(spark, sf)))


@query("review_lifecycle_stream", _LIFE + """
  where done or o_orderdate + interval '1 hour' < (select max(o_orderdate) - interval '2 days' from orders)""")
def _(spark, sf):
    """As a stream-stream join. A time-out shows once its time has passed; the last two days are
    left out, as theirs may still be open when the data ends."""
    started, finished = _lifecycles(spark, sf)
    streams = []
    for name, rows, at in (("started", started, "started_at"), ("finished", finished, "finished_at")):
        folder = run_folder(spark, name)
        rows.repartitionByRange(1, at).write.parquet(folder)
        streams.append(spark.readStream.schema(rows.schema).parquet(folder))
    found = runs.run_available(E.review_lifecycle(*streams), "lifecycle")
    last = started.agg(F.max("started_at")).scalar()
    closed = (F.col("outcome") != "timeout") | (
        F.col("started_at") + F.expr("interval 1 hour") < last - F.expr("interval 2 days")
    )
    return plain(found.where(closed))


@query("read_deliveries", sql(["deliveries"], f"""
  select delivery_id, event_type, body, received_at, case when not {_JSON} then 'Invalid JSON payload' end as rejected from deliveries"""))
def _(spark, sf):
    """Deliveries from JSON lines with bodies in base64, read as a stream, with the reason for those put aside."""
    folder = run_folder(spark, "json")
    rows = B.deliveries(spark, sf).select(
        "delivery_id", "event_type", F.lit("").alias("signature"), F.col("body").cast("binary").alias("body"), "received_at"
    )
    rows.repartition(3).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    read = runs.run_available(E.check_deliveries(E.stream_deliveries(spark, folder)), "read")
    return plain(read.select("delivery_id", "event_type", F.col("body").cast("string").alias("body"), "received_at", "rejected"))


_ONCE = _RECORDS.replace("from deliveries)", "from (select distinct on (delivery_id) * from deliveries))")


@query("record_deliveries_stream", sql(["deliveries", "projects"], _ONCE + f"""
  select 'webhooks' as name, delivery_id, event_type, payload, review_id from records
  union all select 'reviews', null, null, pr_url, md5('review:' || delivery_id) from triaged
  union all select 'rejected', delivery_id, event_type, 'Invalid JSON payload', null from valid where not {_JSON}"""))
def _(spark, sf):
    folder = run_folder(spark, "recorded")
    rows = B.deliveries(spark, sf).select("delivery_id", "event_type", "body", "received_at")
    stream = stream_of(spark, rows, "incoming", pieces=4)
    runs.record_deliveries(stream, lambda: B.projects(spark, sf), folder, late="400 days").awaitTermination()
    read = lambda name, *columns: spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), *columns)
    none = F.lit(None).cast("string")
    hooks = read("webhooks", "delivery_id", "event_type", "payload", "review_id")
    reviews = read("reviews", none.alias("delivery_id"), none.alias("event_type"), F.col("pr_url").alias("payload"), "review_id")
    bad = read("rejected", "delivery_id", "event_type", F.col("rejected").alias("payload"), none.alias("review_id"))
    return hooks.unionByName(reviews).unionByName(bad)


_SECRET_RULES = [s[0] for s in C.SECRETS]


@query("scan_stream", rules_sql(rules_named(*_SECRET_RULES)))
def _(spark, sf):
    """The rule scan as a continuous query; the same function as on a table."""
    texts = text_files(spark, sf).select("file_id", "language", "content")
    found = scan_rules(stream_of(spark, texts, "texts"), rules_named(*_SECRET_RULES))
    columns = ["file_id", "rule_id", "category", "severity", "line_number", "message", "code_snippet"]
    return runs.run_available(found.select(*columns), "scanned")


@query("review_stream", H.QUERIES["review_files"][1])
def _(spark, sf):
    """Files of one review come in several batches; the stored reviews are those of a batch run."""
    folder = run_folder(spark, "reviewed")
    files = B.pr_files(spark, sf)
    options = ReviewOptions(rules=H.COMMON)
    runs.review_stream(stream_of(spark, files, "files", pieces=4), folder, options).awaitTermination()
    return runs.stored_reviews(spark, folder).select("review_id", "files_analyzed", "total_findings", "critical_count", "score")
