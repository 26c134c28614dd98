"""Sparse regression: online proximal gradient and factorization machines.

Samples are rows ``sample_id, y[, weight], idx ARRAY<INT>, val ARRAY<DOUBLE>`` with features from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.functions import Link, is_finite, link
from loomrec.operators.metrics import log_loss, squared_loss
from loomrec.plans import shards
from loomrec.plans.base import SparseRegression
from loomrec.scratch import stow


def checked_samples(samples: DataFrame, n_features: int | None, model: str) -> tuple[DataFrame, int, int]:
    """The needed columns, the number of features and of samples; raises on non-finite values, negative or unknown features."""
    if "weight" not in samples.columns:
        samples = samples.withColumn("weight", F.lit(1.0))
    rows = samples.select("sample_id", F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val"))
    odd = ~is_finite(F.col("y")) | ~is_finite(F.col("weight")) | F.exists("val", lambda v: ~is_finite(v)) | (F.size("idx") != F.size("val"))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.coalesce(odd, F.lit(True))).alias("odd"), F.min(F.array_min("idx")).alias("lo"), F.max(F.array_max("idx")).alias("hi")).first()
    if seen["odd"]:
        raise ValueError(f"{model}: features, targets and weights must be finite and of equal length")
    if seen["lo"] is not None and seen["lo"] < 0:
        raise ValueError(f"{model}: features are numbered from 0")
    most = (seen["hi"] if seen["hi"] is not None else -1) + 1
    if n_features is not None and most > n_features:
        raise ValueError(f"{model}: {most} features given, the model has {n_features}")
    return rows, max(1, most) if n_features is None else n_features, seen["n"]


def linear_predictor(samples: DataFrame, coef: DataFrame) -> DataFrame:
    """``sample_id, eta`` = sum of weight x value over a sample's features (``coef``: ``feature, weight``)."""
    long = samples.select("sample_id", F.explode_outer(F.arrays_zip("idx", "val")).alias("e"))
    long = long.select("sample_id", F.col("e.idx").alias("feature"), F.col("e.val").alias("x"))
    joined = long.join(coef.select("feature", F.col("weight").alias("w")), "feature", "left")
    return joined.groupBy("sample_id").agg(F.coalesce(F.sum(F.col("w") * F.col("x")), F.lit(0.0)).alias("eta"))


@dataclass
class FTRL(SparseRegression):
    """Follow-the-regularized-leader proximal regression, one sample after another; no intercept.

    ``dropout`` hides features from the forward pass; gradients are clipped at ``grad_clip``.  ``fit`` runs ``max_iter`` epochs,
    ``update`` one more, also over a stream's micro-batches.
    """

    lr: float = 0.1
    lr_decay: float = 0.5
    reg: float = 0.0
    l1_ratio: float = 1.0
    dropout: float = 0.0
    grad_clip: float = 1000.0
    family: str = "binomial"
    max_iter: int = 1
    n_shards: int | None = None
    seed: int = 0
    STATE = ("state_z", "state_n")

    def __post_init__(self):
        self.family = Link(self.family).value
        if self.lr <= 0 or self.lr_decay < 0 or self.reg < 0 or not 0 <= self.l1_ratio <= 1 or not 0 <= self.dropout < 1 or self.grad_clip <= 0:
            raise ValueError("FTRL: parameter out of range")

    def _fit(self, samples: DataFrame, *, run) -> dict:
        rows, size, n = checked_samples(samples, None, "FTRL")
        rows = stow(rows)
        state = {"z": np.zeros(size), "n": np.zeros(size)}
        for step in range(1, self.max_iter + 1):
            state = self._epoch(rows, state, n, step)
            self.state_z, self.state_n = state["z"].tolist(), state["n"].tolist()
            if run.epoch(step, self._loss(rows) if run.callbacks else None):
                break
        return {"state_z": state["z"].tolist(), "state_n": state["n"].tolist()}

    def update(self, samples: DataFrame):
        """One more epoch over new samples; features stay those of the first ones."""
        if not self.is_fitted:
            return self.fit(samples)
        rows, _, n = checked_samples(samples, len(self.state_z), "FTRL")
        state = self._epoch(rows, {"z": np.asarray(self.state_z), "n": np.asarray(self.state_n)}, n, 0)
        self._assign({"state_z": state["z"].tolist(), "state_n": state["n"].tolist()})
        return self

    def _epoch(self, rows: DataFrame, state: dict, n: int, step: int) -> dict:
        lr, beta, clip, dropout, family, seed = self.lr, self.lr_decay, self.grad_clip, self.dropout, self.family, self.seed
        l1, l2 = self.reg * self.l1_ratio, self.reg * (1 - self.l1_ratio)

        def train(columns, p, shard):
            z, acc, loss = p["z"], p["n"], 0.0
            idx, off = columns["idx"]
            val, _ = columns["val"]
            rng = np.random.default_rng([seed, step, shard])
            for s, (y, weight) in enumerate(zip(columns["y"].tolist(), columns["weight"].tolist())):
                j, x = idx[off[s] : off[s + 1]], val[off[s] : off[s + 1]]
                w = weights_of(z[j], acc[j], lr, beta, l1, l2)
                shown = rng.random(len(j)) >= dropout if dropout else slice(None)
                eta = float(w[shown] @ x[shown])
                mean = float(_logistic(eta)) if family == "binomial" else float(np.exp(eta)) if family == "poisson" else eta
                g = np.clip((mean - y) * weight * x, -clip, clip)
                root = np.sqrt(acc[j] + g * g)
                np.add.at(z, j, g - (root - np.sqrt(acc[j])) / lr * w)
                np.add.at(acc, j, g * g)
            return loss

        return shards.epoch(rows.sparkSession, rows, shards.shard_count(n, self.n_shards), ["sample_id"], "sample_id", state, train)["params"]

    def weights(self) -> np.ndarray:
        self.require_fitted()
        return weights_of(np.asarray(self.state_z), np.asarray(self.state_n), self.lr, self.lr_decay, self.reg * self.l1_ratio, self.reg * (1 - self.l1_ratio))

    def coef(self, spark: SparkSession) -> DataFrame:
        """``feature, weight``."""
        return spark.createDataFrame([(i, float(w)) for i, w in enumerate(self.weights())], "feature int, weight double")

    def predict(self, samples: DataFrame) -> DataFrame:
        """``sample_id, prediction`` = link of the linear predictor."""
        eta = linear_predictor(samples, self.coef(samples.sparkSession))
        return eta.select("sample_id", link(F.col("eta"), self.family).alias("prediction"))

    def _loss(self, rows: DataFrame) -> float:
        scored = self._predict_any(rows).join(rows.select("sample_id", "y"), "sample_id").withColumnRenamed("prediction", "p")
        return float((log_loss if self.family == "binomial" else squared_loss)(scored).first()[0])

    def _predict_any(self, rows: DataFrame) -> DataFrame:
        fitted, self._fitted = self.is_fitted, True
        try:
            return self.predict(rows)
        finally:
            self._fitted = fitted


def _logistic(x):
    e = np.exp(-abs(x))
    return 1 / (1 + e) if x >= 0 else e / (1 + e)


def weights_of(z: np.ndarray, n: np.ndarray, lr: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Closed-form weights of the proximal state: 0 up to the l1 threshold."""
    low = (beta + np.sqrt(n)) / lr + l2
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / np.where(low > 0, low, 1.0))


@dataclass
class FactorizationMachine(SparseRegression):
    """Second-order factorization machine by AdaGrad, one sample after another.

    eta = w0 + sum w x + 1/2 sum_f [(sum v x)^2 - sum v^2 x^2].  ``binomial`` targets are positive or not; the intercept moves by a plain
    gradient step, weights and vectors by AdaGrad from accumulators of 1.
    """

    rank: int = 4
    lr_w: float = 0.2
    lr_v: float | None = None
    reg_w: float = 0.0
    reg_v: float = 0.0
    intercept: bool = True
    family: str = "binomial"
    max_iter: int = 10
    tol: float = -1.0
    min_iter: int = 1
    n_shards: int | None = None
    seed: int = 0
    STATE = ("w0", "w", "v", "gw", "gv")

    def __post_init__(self):
        self.family = Link(self.family).value
        if self.family == "poisson" or self.rank < 1 or self.lr_w <= 0 or self.reg_w < 0 or self.reg_v < 0 or self.max_iter < 1:
            raise ValueError("FactorizationMachine: parameter out of range")

    def _fit(self, samples: DataFrame, *, run) -> dict:
        rows, size, n = checked_samples(samples, None, "FactorizationMachine")
        rows = stow(rows)
        v = np.random.default_rng(self.seed).normal(0, 0.001, (size, self.rank))
        state = {"w0": np.zeros(1), "w": np.zeros(size), "v": v, "gw": np.ones(size), "gv": np.ones((size, self.rank))}
        for step in range(1, self.max_iter + 1):
            got = self._epoch(rows, state, n)
            state = got["params"]
            self.__dict__.update(self._listed(state))
            if run.epoch(step, got["loss"] / max(1, n) if run.wants_loss else None):
                break
        return self._listed(state)

    @staticmethod
    def _listed(state: dict) -> dict:
        return {"w0": float(state["w0"][0])} | {k: state[k].tolist() for k in ("w", "v", "gw", "gv")}

    def update(self, samples: DataFrame):
        """One more epoch over new samples."""
        if not self.is_fitted:
            return self.fit(samples)
        rows, _, n = checked_samples(samples, len(self.w), "FactorizationMachine")
        state = {"w0": np.array([self.w0])} | {k: np.asarray(getattr(self, k), float) for k in ("w", "v", "gw", "gv")}
        self._assign(self._listed(self._epoch(rows, state, n)["params"]))
        return self

    def _epoch(self, rows: DataFrame, state: dict, n: int) -> dict:
        lr_w, lr_v = self.lr_w, self.lr_v or self.lr_w
        reg_w, reg_v, intercept, binomial = self.reg_w, self.reg_v, self.intercept, self.family == "binomial"

        def train(columns, p, shard):
            w, v, gw, gv, loss = p["w"], p["v"], p["gw"], p["gv"], 0.0
            idx, off = columns["idx"]
            val, _ = columns["val"]
            for s, (y, weight) in enumerate(zip(columns["y"].tolist(), columns["weight"].tolist())):
                j, x = idx[off[s] : off[s + 1]], val[off[s] : off[s + 1]]
                vj = v[j]
                vx = x @ vj
                eta = float(p["w0"][0] + w[j] @ x + 0.5 * (vx @ vx - (x * x) @ (vj * vj).sum(1)))
                if binomial:
                    sign = 1.0 if y > 0 else -1.0
                    slope = -sign * float(_logistic(-sign * eta)) * weight
                    loss += -float(np.log(_logistic(sign * eta) + 1e-10))
                else:
                    slope = (eta - y) * weight
                    loss += (eta - y) ** 2
                if intercept:
                    p["w0"][0] -= lr_w * slope
                g = slope * x + reg_w * w[j]
                w[j] -= lr_w * g / np.sqrt(gw[j])
                gw[j] += g * g
                g = slope * (x[:, None] * vx - vj * (x * x)[:, None]) + reg_v * vj
                v[j] -= lr_v * g / np.sqrt(gv[j])
                gv[j] += g * g
            return loss

        return shards.epoch(rows.sparkSession, rows, shards.shard_count(n, self.n_shards), ["sample_id"], "sample_id", state, train)

    def tables(self, spark: SparkSession) -> DataFrame:
        """``feature, weight, vector``."""
        self.require_fitted()
        return spark.createDataFrame([(i, float(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(self.w, self.v))], "feature int, weight double, vector array<double>")

    def predict(self, samples: DataFrame) -> DataFrame:
        """``sample_id, prediction``."""
        eta = machine_predictor(samples, self.tables(samples.sparkSession), self.w0)
        return eta.select("sample_id", link(F.col("eta"), self.family).alias("prediction"))


def machine_predictor(samples: DataFrame, table: DataFrame, w0: float) -> DataFrame:
    """``sample_id, eta`` of a factorization machine given ``feature, weight, vector``, by joins and two aggregations."""
    long = samples.select("sample_id", F.explode_outer(F.arrays_zip("idx", "val")).alias("e"))
    long = long.select("sample_id", F.col("e.idx").alias("feature"), F.col("e.val").alias("x"))
    joined = long.join(table.select("feature", "weight", "vector"), "feature", "left")
    linear = joined.groupBy("sample_id").agg(F.coalesce(F.sum(F.col("weight") * F.col("x")), F.lit(0.0)).alias("lin"))
    parts = joined.select("sample_id", "x", F.posexplode("vector").alias("f", "v")).groupBy("sample_id", "f").agg(F.sum(F.col("v") * F.col("x")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("x") * F.col("x")).alias("q"))
    pairs = parts.groupBy("sample_id").agg((0.5 * F.sum(F.col("s") * F.col("s") - F.col("q"))).alias("pair"))
    return linear.join(pairs, "sample_id", "left").select("sample_id", (F.lit(w0) + F.col("lin") + F.coalesce("pair", F.lit(0.0))).alias("eta"))
