"""Ranking and error metrics over recommendation and truth tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions import is_finite
from loomrec.sources.triplets import require_k


def check_rankings(recs: DataFrame, users: DataFrame, items: DataFrame | None, k: int) -> int:
    """Validate ``user_id, rank, item_id`` rows and return the number of evaluated places, ``min(k, list width)``.

    Raises ``ValueError`` for k < 1, an empty table, users that don't agree with the universe, ids outside that of the items (if
    given), and an item that occurs twice among the evaluated places of a user.
    """
    require_k(k)
    width = recs.agg(F.max("rank")).first()[0]
    if not width:
        raise ValueError("the recommendations have no column")
    places = min(k, int(width))
    prefix = recs.filter(F.col("rank") <= places).select("user_id", "item_id")
    named = recs.select("user_id", F.lit(1).alias("r")).distinct().join(users.select("user_id", F.lit(1).alias("u")).distinct(), "user_id", "full_outer")
    faults = [
        named.filter("r IS NULL OR u IS NULL").limit(1).select(F.lit("recommendations and universe have different users").alias("fault")),
        prefix.groupBy("user_id", "item_id").count().filter("count > 1").limit(1).select(F.lit("an item is recommended twice to a user")),
    ]
    if items is not None:
        faults.append(prefix.join(items.select("item_id"), "item_id", "left_anti").limit(1).select(F.lit("an item id is out of range")))
    found = reduce(DataFrame.union, faults).first()
    if found:
        raise ValueError(found["fault"])
    return places


def ranking_metrics(
    recs: DataFrame, truth: DataFrame, users: DataFrame, k: int, *, width: int | None = None, items: DataFrame | None = None, check: bool = True
) -> DataFrame:
    """``user_id, ap, ndcg, precision, recall`` at ``k`` for every user of the universe.

    With p = min(k, list width) places and rel(u) the stored entries of ``truth`` (an explicit zero is relevant): average
    precision divides by min(p, |rel|); NDCG uses the stored value as linear gain over log2(place + 1) and is 0 without
    positive ideal gain; precision divides by p; recall by |rel|.  Users without relevant items have 0 throughout.  The width is
    the largest rank unless given.  One join of the tables and windows over at most p rows a user.

    The table is validated by :func:`check_rankings` first, ids against ``items`` if given; ``check=False`` leaves that out and
    runs no job for it.
    """
    require_k(k)
    if check:
        places = check_rankings(recs, users, items, k)
        width = places if width is None else width
    elif width is None:
        width = recs.agg(F.max("rank")).first()[0] or k
    p = min(k, int(width))
    relevant = truth.select("user_id", "item_id", F.col("value").alias("gain"))
    placed = recs.filter(F.col("rank") <= p).select("user_id", "item_id", "rank")
    hits = placed.join(relevant, ["user_id", "item_id"])
    upto = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("so_far", F.count("*").over(upto))
    found = hits.groupBy("user_id").agg(
        F.count("*").alias("hits"),
        F.sum(F.col("so_far") / F.col("rank")).alias("precisions"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    n_rel = relevant.groupBy("user_id").agg(F.count("*").alias("n_rel"))
    by_gain = Window.partitionBy("user_id").orderBy(F.desc("gain"))
    ideal = relevant.withColumn("place", F.row_number().over(by_gain)).filter(F.col("place") <= p)
    ideal = ideal.groupBy("user_id").agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1.0)).alias("idcg"))
    joined = users.join(n_rel, "user_id", "left").join(found, "user_id", "left").join(ideal, "user_id", "left")
    zero = F.lit(0.0)
    return joined.select(
        "user_id",
        F.coalesce(F.col("precisions") / F.least(F.lit(p), F.col("n_rel")), zero).alias("ap"),
        F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg"), zero) / F.col("idcg")).otherwise(zero).alias("ndcg"),
        (F.coalesce("hits", F.lit(0)) / F.lit(p)).alias("precision"),
        F.coalesce(F.col("hits") / F.col("n_rel"), zero).alias("recall"),
    )


def _one(name):
    def metric(recs: DataFrame, truth: DataFrame, users: DataFrame, k: int = 10, **args) -> DataFrame:
        return ranking_metrics(recs, truth, users, k, **args).select("user_id", F.col(name).alias("value"))

    def mean(recs: DataFrame, truth: DataFrame, users: DataFrame, k: int = 10, **args) -> float:
        return float(ranking_metrics(recs, truth, users, k, **args).agg(F.avg(name)).first()[0])

    metric.__doc__ = f"``user_id, value`` with the {name} at k of every user of the universe; further arguments as in ranking_metrics."
    mean.__doc__ = f"Mean {name} at k over all users, also those without relevant items."
    return metric, mean


ap_at_k, mean_ap_at_k = _one("ap")
ndcg_at_k, mean_ndcg_at_k = _one("ndcg")
precision_at_k, mean_precision_at_k = _one("precision")
recall_at_k, mean_recall_at_k = _one("recall")


def errors(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``rmse, mae, n`` over the entries of ``truth`` (``user_id, item_id, value``) with their ``prediction``."""
    joined = truth.select("user_id", "item_id", "value").join(predictions.select("user_id", "item_id", "prediction"), ["user_id", "item_id"])
    e = F.col("prediction") - F.col("value")
    return joined.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


def _error(name):
    def error(predictions: DataFrame, truth: DataFrame) -> float:
        n = truth.count()
        if not n:
            raise ValueError("there is nothing to compare with")
        joined = truth.select("user_id", "item_id").join(predictions, ["user_id", "item_id"], "left")
        if joined.filter(~is_finite(F.col("prediction"))).limit(1).count():
            raise ValueError("predictions must be there and finite for every test entry")
        return float(errors(predictions, truth).first()[name])

    error.__doc__ = f"{name.upper()} over the stored entries of ``truth``."
    return error


rmse, mae = _error("rmse"), _error("mae")
mean_rmse, mean_mae = rmse, mae


def log_loss(scored: DataFrame, guard: float = 1e-10) -> DataFrame:
    """One row ``loss``: mean of -ln p or -ln(1 - p) over rows ``y, p``."""
    p, y = F.col("p"), F.col("y")
    return scored.agg(F.avg(-(y * F.log(p + F.lit(guard)) + (1 - y) * F.log(1 - p + F.lit(guard)))).alias("loss"))


def squared_loss(scored: DataFrame) -> DataFrame:
    """One row ``loss``: mean squared difference of ``y`` and ``p``."""
    d = F.col("p") - F.col("y")
    return scored.agg(F.avg(d * d).alias("loss"))
