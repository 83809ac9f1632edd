"""Event stream to review contexts, and the review of each micro-batch.

Intake is stateless: every micro-batch is judged with the batch operators. Each batch writes its own folder
with overwrite, so a batch that is run again after a failure replaces its rows instead of adding to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hunkwise.operators.events import review_contexts, with_disposition

OnBatch = Callable[[DataFrame, int], None]


def judged_rows(events: DataFrame, secret: str) -> DataFrame:
    """Delivery, disposition and, where accepted, the review context: one flat row per delivery."""
    judged = with_disposition(events, secret)
    accepted = review_contexts(judged.withColumn("verdict_of", F.col("disposition")).withColumn(
        "disposition", F.lit("accepted")), ["delivery_id", "verdict_of"])
    context = [c for c in accepted.columns if c not in ("delivery_id", "verdict_of")]
    taken = F.col("verdict_of") == "accepted"
    return accepted.select(
        "delivery_id", F.col("verdict_of").alias("disposition"), *[F.when(taken, F.col(c)).alias(c) for c in context])


def start_intake(events: DataFrame, secret: str, out: str, checkpoint: str, on_batch: OnBatch | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Judge a stream of ``pr_events``. ``on_batch(contexts, batch_id)`` runs the batch review on the accepted
    reviews of each micro-batch, for example :func:`hunkwise.plans.review.review` and a sink."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out}/batch_id={batch_id}"
        judged_rows(batch, secret).write.mode("overwrite").parquet(folder)
        if on_batch is not None:
            landed = batch.sparkSession.read.parquet(folder)
            on_batch(landed.where("disposition = 'accepted'").drop("delivery_id", "disposition"), batch_id)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_judged(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch_id")
