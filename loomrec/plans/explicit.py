"""Rating prediction: biases, slope one, user neighbourhoods.  All of it joins and aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.operators.matrix import global_mean
from loomrec.operators.nearest import NearRows
from loomrec.operators.pairs import both_ways, neighbour_sums, pair_sums
from loomrec.operators.topk import DIGITS
from loomrec.plans.base import ExplicitModel
from loomrec.scratch import discard, small_enough, spread, stow
from loomrec.sources.triplets import Interactions, require_dimensions, require_finite


class _Predictor(ExplicitModel):
    def score(self, pairs: DataFrame) -> DataFrame:
        return self.predict(pairs)

    @staticmethod
    def grid(matrix: Interactions) -> DataFrame:
        """All user-item pairs of the universes; as large as it sounds."""
        return matrix.users.select("user_id").join(matrix.items.select("item_id"))


@dataclass
class BaselineOnly(_Predictor):
    """mean + user bias + item bias, by alternating regularized means: b_u = sum(r - mean - b_i) / (n_u + l2), then b_i.

    An entity without ratings has bias 0, also for l2 = 0.  Unknown ids are predicted with bias 0.
    """

    l2: float = 0.02
    max_iter: int = 10
    STATE = ("mean", "user_bias", "item_bias")

    def __post_init__(self):
        if self.l2 < 0 or self.max_iter < 1:
            raise ValueError("BaselineOnly: parameter out of range")

    def _fit(self, matrix: Interactions, *, run) -> dict:
        require_dimensions(matrix, "BaselineOnly")
        require_finite(matrix, "BaselineOnly")
        matrix = matrix.settled()
        mean = global_mean(matrix)
        x = matrix.x.select("user_id", "item_id", (F.col("value") - F.lit(mean)).alias("r"))
        bias = {"user_id": None, "item_id": None}
        for step in range(1, self.max_iter + 1):
            for mine, other in (("user_id", "item_id"), ("item_id", "user_id")):
                rest = x
                if bias[other] is not None:
                    rest = x.join(bias[other], other).withColumn("r", F.col("r") - F.col("b"))
                old = bias[mine]
                # Each half-step is written, so plans stay short and nothing is computed twice.
                bias[mine] = stow(rest.groupBy(mine).agg((F.sum("r") / (F.count("*") + F.lit(self.l2))).alias("b")))
                if old is not None:
                    discard(old)
            if run.epoch(step, None):
                break
        return {"mean": mean, "user_bias": bias["user_id"], "item_bias": bias["item_id"]}

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``user_id, item_id, prediction``."""
        self.require_fitted()
        u = self.user_bias.withColumnRenamed("b", "b_u")
        i = self.item_bias.withColumnRenamed("b", "b_i")
        zero = F.lit(0.0)
        joined = pairs.select("user_id", "item_id").join(u, "user_id", "left").join(i, "item_id", "left")
        prediction = F.lit(self.mean) + F.coalesce("b_u", zero) + F.coalesce("b_i", zero)
        return joined.select("user_id", "item_id", prediction.alias("prediction"))


@dataclass
class SlopeOne(_Predictor):
    """Unweighted slope one: prediction = user mean + mean over the user's other items of the mean deviation.

    Without a common item the user's mean is predicted; for a user without ratings the mean of the non-zero user means.
    """

    STATE = ("deviations", "user_means", "cold", "ratings")

    def _fit(self, matrix: Interactions, *, run) -> dict:
        matrix = matrix.settled()
        require_dimensions(matrix, "SlopeOne")
        require_finite(matrix, "SlopeOne")
        rows = matrix.x.withColumn("one", F.lit(1.0))
        pairs = both_ways(pair_sums(rows, "user_id", "item_id", "value", "one"))
        deviations = pairs.select("src", "dst", ((F.col("ab") - F.col("ba")) / F.col("n")).alias("dev"), F.col("n").alias("freq"))
        means = stow(matrix.x.groupBy("user_id").agg(F.avg("value").alias("mean")))
        cold = means.filter("mean <> 0").agg(F.coalesce(F.avg("mean"), F.lit(0.0))).first()[0]
        return {"deviations": stow(deviations), "user_means": means, "cold": float(cold), "ratings": matrix.x}

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``user_id, item_id, prediction``; only items that occur together enter, so the work is that of the joins."""
        self.require_fitted()
        asked = pairs.select("user_id", "item_id")
        own = self.ratings.select("user_id", F.col("item_id").alias("dst"))
        steps = asked.join(own, "user_id").filter("item_id <> dst").join(self.deviations.withColumnRenamed("src", "item_id"), ["item_id", "dst"])
        moved = steps.groupBy("user_id", "item_id").agg(F.avg("dev").alias("d"))
        joined = asked.join(self.user_means, "user_id", "left").join(moved, ["user_id", "item_id"], "left")
        prediction = F.coalesce("mean", F.lit(self.cold)) + F.coalesce("d", F.lit(0.0))
        return joined.select("user_id", "item_id", prediction.alias("prediction"))


@dataclass
class PearsonKNN(_Predictor):
    """User neighbourhoods: centred ratings, similarity sum(c_u c_v) / (|r_u| |r_v|) with the norms of the raw rows; the ``k``
    most similar with positive similarity, none if they are fewer than ``min_k``.

    Prediction: user mean + sum(s c_v) / sum(s) over neighbours who rated the item (a centred rating of 0 counts); else the mean.
    """

    k: int = 40
    min_k: int = 1
    STATE = ("neighbours", "centred", "user_means")

    def __post_init__(self):
        if self.k < 1 or self.min_k < 1:
            raise ValueError("PearsonKNN: parameter out of range")

    def _fit(self, matrix: Interactions, *, run) -> dict:
        matrix = matrix.settled()
        require_dimensions(matrix, "PearsonKNN")
        require_finite(matrix, "PearsonKNN")
        # One shuffle of the ratings by user; means, centred ratings and rows are read off its result.
        entry = F.struct(F.col("item_id").cast("long").alias("g"), F.col("value").cast("double").alias("v"))
        size = F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
        rows = spread(matrix.x, "user_id").groupBy("user_id").agg(F.avg("value").alias("mean"), size, F.array_sort(F.collect_list(entry)).alias("e"))
        rows = stow(rows)
        centred = rows.select("user_id", "mean", F.inline("e")).select("user_id", F.col("g").alias("item_id"), (F.col("v") - F.col("mean")).alias("c"))
        scale = F.when(F.col("norm") > 0, 1 / F.col("norm")).otherwise(0.0).alias("scale")
        near = NearRows(rows.select(F.col("user_id").cast("long").alias("m"), F.col("mean").alias("shift"), scale, "e"), self.k, DIGITS, least=self.min_k)
        kept = near.neighbours().select(F.col("src").alias("user_id"), F.col("dst").alias("other"), "similarity")
        kept._near = near
        return {"neighbours": kept, "centred": centred, "user_means": rows.select("user_id", "mean")}

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``user_id, item_id, prediction``; an unknown user is predicted 0.

        Pairs that fit a broadcast are sent to the neighbours; only more of them are joined with what neighbours rated."""
        self.require_fitted()
        asked = pairs.select("user_id", "item_id")
        rated = self.centred.select(F.col("user_id").alias("other"), "item_id", "c")
        near = getattr(self.neighbours, "_near", None)
        if small_enough(asked.count(), 16):
            asking = near.asking(asked) if near else None
            if asking and len(near.blocks) == 1:
                sums = near.sums(asking)
            else:
                neighbours = self.neighbours
                if asking:
                    names = neighbours.columns
                    neighbours = stow(near.neighbours(asking).toDF(*names))
                sums = neighbour_sums(neighbours, rated, asked)
            moved = sums.select("user_id", "item_id", (F.col("wc") / F.col("w")).alias("d"))
        else:
            met = asked.join(self.neighbours, "user_id").join(rated, ["other", "item_id"])
            moved = met.groupBy("user_id", "item_id").agg((F.sum(F.col("similarity") * F.col("c")) / F.sum("similarity")).alias("d"))
        joined = asked.join(self.user_means, "user_id", "left").join(moved, ["user_id", "item_id"], "left")
        zero = F.lit(0.0)
        return joined.select("user_id", "item_id", (F.coalesce("mean", zero) + F.coalesce("d", zero)).alias("prediction"))
