"""Hold-outs per user: by hash and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int) -> Column:
    """A portable pseudo-random order of (user, item) pairs."""
    return F.pmod(F.pmod(F.col("user_id"), F.lit(1_000_003)) * 48_271 + F.pmod(F.col("item_id"), F.lit(1_000_003)) * 69_621 + F.lit(seed) * 9_973, F.lit(1_000_003))


def random_holdout(x: DataFrame, test_fraction: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: of each user's n entries ``max(1, n x fraction rounded half to even)`` go to test, none if n = 1.

    The entries are taken in a pseudo-random order of the ids and the seed, so the split doesn't depend on partitions.  Every
    entry is in exactly one part.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must be between 0 and 1")
    marked = _marked(x, draw(seed), test_fraction)
    return marked.filter("NOT _test").drop("_test"), marked.filter("_test").drop("_test")


def _marked(x: DataFrame, key: Column, fraction: float) -> DataFrame:
    w = Window.partitionBy("user_id")
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(key, "item_id"))
    n_test = F.when(n == 1, 0).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("int")))
    return x.withColumn("_test", place <= n_test)


def temporal_split(x: DataFrame, time: str = "rated_at", train_fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: each user's first ``n x fraction`` entries (rounded half to even) by time, then item, are train.

    Entries without a time come first.
    """
    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy(F.asc_nulls_first(time), "item_id"))
    marked = x.withColumn("_train", place <= F.bround(F.count("*").over(w) * F.lit(train_fraction)).cast("int"))
    return marked.filter("_train").drop("_train"), marked.filter("NOT _train").drop("_train")
