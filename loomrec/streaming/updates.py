"""Online learning and running sums over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomrec.functions import is_finite
from loomrec.scratch import stow
from loomrec.sources.triplets import Interactions


def learn_from_stream(model, stream: DataFrame, checkpoint: str, *, after: Callable | None = None, available_now: bool = True) -> StreamingQuery:
    """Feed every micro-batch of ``stream`` to ``model.update`` (FTRL, FactorizationMachine) in order.

    ``after(model, batch_id)`` runs on the driver after each batch, for example to save the model.  A batch that is replayed after
    a failure is learned from again unless ``after`` made its effect durable.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            model.update(batch)
            if after:
                after(model, batch_id)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def extend_matrix_from_stream(model, matrix: Interactions, stream: DataFrame, checkpoint: str, *, n_iters: int = 1) -> StreamingQuery:
    """Add each micro-batch of ``user_id, item_id, value`` to the matrix and continue ElementwiseALS from its factors.

    The grown matrix is kept as ``query.matrix`` holder: a one-element list on the returned query.
    """
    held = [matrix]

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("user_id", "item_id", "value").dropna().filter(is_finite(F.col("value")))
        if not rows.limit(1).count():
            return
        before = held[0]
        x = before.x.select("user_id", "item_id", "value").union(rows).groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))
        held[0] = replace(
            before,
            x=stow(x),
            users=stow(before.users.select("user_id").union(rows.select("user_id")).distinct()),
            items=stow(before.items.select("item_id").union(rows.select("item_id")).distinct()),
        )
        model.update(held[0], n_iters)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.matrix = held
    return query


def running_sums(stream: DataFrame, time: str, *, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Streaming ``window, user_id, item_id, value``: sums per window of event time; rows later than ``late`` are dropped by the
    watermark, rows sent again (equal in ids, value and time) within it count once."""
    kept = stream.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & is_finite(F.col("value")) & F.col(time).isNotNull())
    marked = kept.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    once = marked.dropDuplicates(["user_id", "item_id", "value", "_t"])
    return once.groupBy(F.window("_t", window), "user_id", "item_id").agg(F.sum("value").alias("value"))
