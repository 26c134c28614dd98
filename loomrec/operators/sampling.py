"""Weighted draws, shuffles and membership over distributed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.scratch import stow

#: Draws come from a portable linear congruence with this period.
PERIOD = 1_000_003


def uniform(counter: Column, seed: int) -> Column:
    """A portable pseudo-random number in [0, 1) of a counter."""
    return F.pmod(counter % PERIOD * 48_271 + F.lit(seed) * 9_973, F.lit(PERIOD)) / F.lit(float(PERIOD))


def cumulative_weights(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """``<key>, low, high``: the interval each key takes of the running sum of weights in order of the key.

    Range partitions are summed on their own and shifted by the sums before them, so no task sees more than its partition.
    Weights that are null or not positive take no interval.
    """
    kept = weights.filter(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w"))
    placed = stow(kept.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    offsets, total = [], 0.0
    for r in placed.groupBy("_p").agg(F.sum("_w").alias("s")).orderBy("_p").collect():  # one row a partition
        offsets.append((r["_p"], total))
        total += r["s"]
    starts = weights.sparkSession.createDataFrame(offsets, "_p int, _start double")
    upto = F.sum("_w").over(Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("_high", upto).join(F.broadcast(starts), "_p")
    return summed.select(key, (F.col("_start") + F.col("_high") - F.col("_w")).alias("low"), (F.col("_start") + F.col("_high")).alias("high"))


def draw_weighted(weights: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement by weight: ``draw`` (from 0), ``<key>``.

    The running sum is cut into as many equal buckets as there are keys; intervals and draws meet on their bucket, so each draw
    looks at the few intervals around it.
    """
    intervals = stow(cumulative_weights(weights, key, weight))
    about = intervals.agg(F.count("*").alias("n"), F.max("high").alias("total")).first()
    if not about["n"]:
        raise ValueError("no weight is positive")
    buckets, total = about["n"], about["total"]
    bucket = lambda c: F.least(F.floor(c / F.lit(total) * buckets), F.lit(buckets - 1)).cast("long")
    spread = intervals.withColumn("b", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform(F.col("id"), seed) * F.lit(total)).alias("at"))
    draws = draws.withColumn("b", bucket(F.col("at")))
    return draws.join(spread, "b").filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("draw", key)


def shuffled(rows: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Rows in a pseudo-random order of their keys: a distributed sort by hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def membership(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """``user_id, item_id, stored``: whether each pair is an entry of ``x``."""
    mine = x.select("user_id", "item_id").distinct().withColumn("_in", F.lit(True))
    joined = pairs.select("user_id", "item_id").join(mine, ["user_id", "item_id"], "left")
    return joined.select("user_id", "item_id", F.coalesce("_in", F.lit(False)).alias("stored"))
