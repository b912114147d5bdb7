"""Streams give what batches give."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from checks import bindings as B
from checks.q_streams import stream_of
from reviewlake.session import run_folder
from reviewlake.streaming import events as E
from reviewlake.streaming import runs

SCHEMA = "delivery_id string, event_type string, signature string, body string, received_at timestamp"


def delivery(n, event, payload, signature="", raw=None):
    import datetime

    body = raw if raw is not None else json.dumps(payload)
    return (f"d{n}", event, signature, body, datetime.datetime(2024, 1, 1, 0, n % 60))


def pull(action="opened", url="https://github.com/Org/Repo/pull/7", number=7, name="ORG/repo"):
    return {"action": action, "pull_request": {"html_url": url, "number": number}, "repository": {"full_name": name}}


def projects(spark):
    return spark.sql("select * from values (1, 'org', 'repo', true), (2, 'org', 'quiet', false), (3, 'Org', 'Repo', false) as t(project_id, owner, repo, auto_watch)")


def test_triage(spark):
    rows = [
        delivery(1, "pull_request", pull()), delivery(2, "pull_request", pull("closed")), delivery(3, "pull_request", pull(url="")),
        delivery(4, "pull_request", pull(name="org/quiet")), delivery(5, "pull_request", pull(name="no/one")),
        delivery(6, "issues", pull()), delivery(7, "pull_request", None, raw="{broken"),
        delivery(8, "push", {"ref": "refs/heads/x/y", "repository": {"full_name": "org/quiet"}}), delivery(9, "pull_request", pull(number=0)),
    ]
    checked = E.check_deliveries(spark.createDataFrame(rows, SCHEMA))
    assert [r["delivery_id"] for r in E.rejected(checked).collect()] == ["d7"]
    good = E.route_events(E.accepted(checked))
    queued = E.queue_reviews(E.triage_pull_requests(good, projects(spark))).collect()
    assert [(r["project_id"], r["pr_number"], r["repo_owner"], r["repo_name"], r["status"]) for r in queued] == [(1, 7, "Org", "Repo", "pending")]
    records = {r["delivery_id"]: r for r in E.webhook_records(good, projects(spark)).collect()}
    assert set(records) == {"d1", "d8"} and records["d1"]["review_id"] == queued[0]["review_id"]
    assert json.loads(records["d8"]["payload"]) == {"ref": "refs/heads/x/y", "repo": "org/quiet", "delivery_id": "d8"}


def test_bad_signature_is_rejected_first(spark):
    body = json.dumps(pull())
    right = "sha256=" + hmac.new(b"key", body.encode(), hashlib.sha256).hexdigest()
    rows = [delivery(1, "push", None, right, body), delivery(2, "push", None, "sha256=00", body), delivery(3, "push", None, "", "{broken")]
    out = {r["delivery_id"]: r["rejected"] for r in E.check_deliveries(spark.createDataFrame(rows, SCHEMA), "key").collect()}
    assert out == {"d1": None, "d2": "Invalid webhook signature", "d3": "Invalid webhook signature"}


def test_recording_resumes_without_doubling(spark, sf):
    rows = B.deliveries(spark, sf).select("delivery_id", "event_type", "body", "received_at")
    known = B.projects(spark, sf)
    folder = run_folder(spark, "test-recorded")
    stream = stream_of(spark, rows, "test-incoming")
    for _ in range(2):
        runs.record_deliveries(stream, lambda: known, folder, late="400 days").awaitTermination()
    good = E.route_events(E.accepted(E.check_deliveries(E.dedupe_deliveries(rows))))
    want = E.webhook_records(good, known).count()
    assert spark.read.parquet(f"{folder}/webhooks").count() == want > 0


def test_dedupe_and_rates_match_batch(spark, sf):
    rows = B.deliveries(spark, sf).select("delivery_id", "event_type", "received_at")
    stream = E.dedupe_deliveries(stream_of(spark, rows, "test-dedupe"), late="400 days")
    got = runs.run_available(stream, "test-deduped")
    assert got.count() == rows.select("delivery_id").distinct().count() == E.dedupe_deliveries(rows).count()


def test_sessions_equal_session_windows(spark, sf):
    rows = B.deliveries(spark, sf).select("event_type", "received_at")
    for gap in ("5 minutes", "45 minutes"):
        native = rows.groupBy(F.session_window("received_at", gap), "event_type").agg(F.count("*").alias("deliveries")).select(
            F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "event_type", "deliveries")
        ours = E.event_sessions(rows, gap)
        assert native.exceptAll(ours).count() == 0 and ours.exceptAll(native).count() == 0
