"""Webhook deliveries, as a batch or as a stream: every step is one function over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.functions.signature import valid_signature
from reviewlake.functions.urls import branch_of, parse_pr_url

# FIXED VALUES
SUPPORTED_EVENTS = ("pull_request", "push")
REVIEWED_ACTIONS = ("opened", "synchronize", "reopened")
PAYLOAD_CHARS = 65535


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """Deliveries from JSON lines (body in base64)."""
    return spark.read.schema(schemas.DELIVERIES).json(path)


def stream_deliveries(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.DELIVERIES).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def check_deliveries(deliveries: DataFrame, secret: str = "") -> DataFrame:
    """Add ``rejected``: a wrong signature is looked for first, then a body that is no JSON."""
    body = F.col("body").cast("binary")
    signed = (
        valid_signature(body, F.col("signature"), secret) if secret else F.lit(True)
    )
    is_json = F.try_parse_json(F.col("body").cast("string")).isNotNull()
    return deliveries.withColumn(
        "rejected",
        F.when(~signed, "Invalid webhook signature").when(~is_json, "Invalid JSON payload"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("rejected").isNull()).drop("rejected")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("rejected").isNotNull())


def route_events(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("event_type").isin(*SUPPORTED_EVENTS))


def with_payload(deliveries: DataFrame) -> DataFrame:
    """Extracted payload fields."""
    data = F.from_json(F.col("body").cast("string"), schemas.PAYLOAD)
    return deliveries.withColumn("_p", data).withColumns(
        {
            "action": F.col("_p.action"),
            "pr_url": F.col("_p.pull_request.html_url"),
            "pr_number": F.col("_p.pull_request.number"),
            "full_name": F.coalesce("_p.repository.full_name", F.lit("")),
            "ref": F.coalesce("_p.ref", F.lit("")),
            "branch": branch_of(F.coalesce("_p.ref", F.lit(""))),
        }
    ).drop("_p")


def _known_projects(projects: DataFrame) -> DataFrame:
    """One project per repository, the first one registered, by lower-case full name."""
    name = F.lower(F.concat_ws("/", "owner", "repo"))
    return projects.groupBy(name.alias("_name")).agg(
        F.min_by(F.struct("project_id", "auto_watch"), F.col("project_id")).alias("_project")
    ).select("_name", "_project.*")


def find_projects(deliveries: DataFrame, projects: DataFrame) -> DataFrame:
    """Deliveries of known repositories. For a stream this is a stream-static join."""
    known = _known_projects(projects)
    return deliveries.join(known, F.lower("full_name") == F.col("_name")).drop("_name")


def triage_pull_requests(deliveries: DataFrame, projects: DataFrame) -> DataFrame:
    """Pull-request deliveries that ask for a review: action, address and number given, project
    known and watched."""
    wanted = with_payload(deliveries.where(F.col("event_type") == "pull_request")).where(
        F.col("action").isin(*REVIEWED_ACTIONS)
        & (F.coalesce("pr_url", F.lit("")) != "") & (F.coalesce("pr_number", F.lit(0)) != 0)
    )
    return find_projects(wanted, projects).where(F.col("auto_watch"))


def recorded_pushes(deliveries: DataFrame, projects: DataFrame) -> DataFrame:
    return find_projects(with_payload(deliveries.where(F.col("event_type") == "push")), projects)


def review_id_of(delivery_id: Column) -> Column:
    """The same delivery always asks for the same review."""
    return F.md5(F.concat(F.lit("review:"), delivery_id))


def queue_reviews(triaged: DataFrame) -> DataFrame:
    """Pending reviews, with owner and repository filled from the address."""
    parsed = parse_pr_url(F.col("pr_url"))
    return triaged.select(
        review_id_of(F.col("delivery_id")).alias("review_id"),
        "project_id", "pr_url", "pr_number",
        parsed["owner"].alias("repo_owner"), parsed["repo"].alias("repo_name"),
        F.lit("pending").alias("status"),
        F.col("received_at").alias("created_at"),
    )


def webhook_records(deliveries: DataFrame, projects: DataFrame) -> DataFrame:
    """What is kept of handled deliveries; a pull request carries the review it asked for."""
    pulls = triage_pull_requests(deliveries, projects).select(
        "project_id", F.lit("pull_request").alias("event_type"),
        F.substring(F.col("body").cast("string"), 1, PAYLOAD_CHARS).alias("payload"), "delivery_id",
        F.lit(True).alias("processed"), review_id_of(F.col("delivery_id")).alias("review_id"), "received_at",
    )
    pushes = recorded_pushes(deliveries, projects).select(
        "project_id", F.lit("push").alias("event_type"),
        F.substring(
            F.to_json(F.struct("ref", F.col("full_name").alias("repo"), "delivery_id")), 1, PAYLOAD_CHARS
        ).alias("payload"),
        "delivery_id", F.lit(True).alias("processed"), F.lit(None).cast("string").alias("review_id"),
        "received_at",
    )
    return pulls.unionByName(pushes)


def dedupe_deliveries(deliveries: DataFrame, late: str = "1 day") -> DataFrame:
    """A redelivered id counts once. A stream keeps ids for the lateness allowed only."""
    if deliveries.isStreaming:
        return deliveries.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["delivery_id"])
    return deliveries.dropDuplicates(["delivery_id"])


def event_rates(
    deliveries: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day",
    by: tuple[str, ...] = ("event_type",),
) -> DataFrame:
    """Deliveries per tumbling or sliding window; on a stream, rows later than allowed drop out."""
    source = deliveries.withWatermark("received_at", late) if deliveries.isStreaming else deliveries
    return (
        source.groupBy(F.window("received_at", width, slide), *by).agg(F.count("*").alias("deliveries"))
        .select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), *by, "deliveries")
    )


def event_sessions(
    deliveries: DataFrame, gap: str = "30 minutes", late: str = "1 day", by: tuple[str, ...] = ("event_type",)
) -> DataFrame:
    """Bursts of deliveries with no pause of ``gap`` in between.

    A stream keeps session state. A table is first summed per key and time slot as wide as the
    gap (rows of one slot are always in one burst), so what is ordered per key is bounded by the
    time covered and not by the number of deliveries.
    """
    if deliveries.isStreaming:
        return (
            deliveries.withWatermark("received_at", late)
            .groupBy(F.session_window("received_at", gap), *by).agg(F.count("*").alias("deliveries"))
            .select(
                F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"),
                *by, "deliveries",
            )
        )
    pause = F.expr(f"interval {gap}")
    slots = deliveries.groupBy(F.window("received_at", gap).alias("_slot"), *by).agg(
        F.min("received_at").alias("_first"), F.max("received_at").alias("_last"), F.count("*").alias("_n")
    )
    order = Window.partitionBy(*by).orderBy("_first")
    opens = F.coalesce(F.col("_first") >= F.lag("_last").over(order) + pause, F.lit(True))
    runs = slots.withColumn("_opens", opens.cast("int")).withColumn(
        "_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return runs.groupBy(*by, "_run").agg(
        F.min("_first").alias("starts"), (F.max("_last") + pause).alias("ends"), F.sum("_n").alias("deliveries")
    ).select("starts", "ends", *by, "deliveries")


def review_lifecycle(started: DataFrame, finished: DataFrame, limit: str = "1 hour") -> DataFrame:
    """started(review_id, started_at) ⟕ finished(review_id, finished_at, status): how long a review
    took; one not finished within the limit is a time-out. On streams both sides are bounded by
    watermarks, so the state is too."""
    if started.isStreaming:
        started = started.withWatermark("started_at", limit)
        finished = finished.withWatermark("finished_at", limit)
    done = finished.select(F.col("review_id").alias("_done"), "finished_at", F.col("status").alias("outcome"))
    joined = started.join(
        done,
        (F.col("review_id") == F.col("_done"))
        & (F.col("finished_at") >= F.col("started_at"))
        & (F.col("finished_at") <= F.col("started_at") + F.expr(f"interval {limit}")),
        "left_outer",
    )
    return joined.select(
        "review_id", "started_at", "finished_at",
        F.coalesce("outcome", F.lit("timeout")).alias("outcome"),
        (
            F.col("finished_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
        ).alias("seconds"),
    )
