"""Running streams: available data to files, and recorded deliveries to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators.aggregates import file_scores, review_scores
from reviewlake.plans.review import ReviewOptions, review_files
from reviewlake.session import run_folder
from reviewlake.streaming import events as E


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what a stream has now and return it as a batch.

    Output and progress go to the shared folder, so a lost executor or driver resumes.
    """
    spark = stream.sparkSession
    folder = run_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch that is run again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def record_deliveries(stream: DataFrame, projects, path: str, secret: str = "", late: str = "1 day"):
    """Start recording: handled deliveries, queued reviews and rejects, per micro-batch.

    ``projects`` is a function returning the project table, read again for each batch. A delivery that comes again within
    ``late`` is recorded once; deliveries are checked before, so that a forged one does not stand in for the real one.
    """
    checked = E.check_deliveries(stream, secret).withWatermark("received_at", late)
    once = checked.dropDuplicatesWithinWatermark(["delivery_id", "rejected"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = projects()
        batch.persist()
        good = E.route_events(E.accepted(batch))
        _write_batch(E.webhook_records(good, known), f"{path}/webhooks", batch_id)
        _write_batch(E.queue_reviews(E.triage_pull_requests(good, known)), f"{path}/reviews", batch_id)
        _write_batch(E.rejected(batch), f"{path}/rejected", batch_id)
        batch.unpersist()

    return (
        once.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )


def review_stream(stream: DataFrame, path: str, options: ReviewOptions | None = None):
    """Review changed files as they arrive.

    Findings and scored files are stored per micro-batch, and then the reviews that the batch touches are scored anew from
    all their stored files, so that a review may be spread over batches. Texts are scanned once. ``stored_files`` and
    ``stored_reviews`` read the results.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        result = review_files(batch, options)
        _write_batch(result.findings, f"{path}/findings", batch_id)
        found = spark.read.schema(result.findings.schema).parquet(f"{path}/findings/batch={batch_id}")
        _write_batch(file_scores(result.headers, found), f"{path}/file_reviews", batch_id)
        files = stored_files(spark, path).where(F.col("batch") <= batch_id)
        touched = files.where(F.col("batch") == batch_id).select("review_id").distinct()
        _write_batch(review_scores(files.join(touched, "review_id", "left_semi")), f"{path}/reviews", batch_id)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of a key those of its last batch."""
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_last"))
    return rows.join(last, (F.col(key) == F.col("_key")) & (F.col("batch") == F.col("_last")), "left_semi")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Scored files as last reviewed, with their batch."""
    return _latest(spark.read.parquet(f"{path}/file_reviews"), "file_id")


def stored_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews as last scored."""
    return _latest(spark.read.parquet(f"{path}/reviews"), "review_id").drop("batch")
