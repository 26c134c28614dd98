"""Matrix factorization by alternating least squares and its coordinate-wise variant."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.functions import dot
from loomrec.operators.matrix import factor_gram, sampled_product, seeded_normals
from loomrec.operators.normal_equations import Rules, Table, fits_broadcast, half_sweep, half_sweep_joined, observed_loss, segments
from loomrec.operators.topk import all_scores, pair_scores, recommend_dense, score_totals, similar_all, similar_to
from loomrec.plans.base import MatrixFactorization
from loomrec.scratch import BROADCAST_BYTES, discard, stow
from loomrec.sources.triplets import Interactions, require_dimensions, require_finite, require_minimum


class Solver(str, Enum):
    CHOLESKY = "cholesky"
    CG = "cg"
    NONNEGATIVE = "nonnegative"


class Feedback(str, Enum):
    IMPLICIT = "implicit"
    EXPLICIT = "explicit"


class _Factors(MatrixFactorization):
    """Scoring shared by all factor models: ``user_factors`` and ``item_factors`` with ``id, factors``."""

    STATE = ("user_factors", "item_factors")

    def recommend(self, matrix: Interactions, k: int = 10) -> DataFrame:
        """``user_id, rank, item_id, score`` for the stored users, items of ``matrix`` masked as seen."""
        self.require_fitted()
        return recommend_dense(self.user_factors, self.item_factors, matrix.x, k)

    def score(self, pairs: DataFrame | None = None) -> DataFrame:
        """Scores of given ``user_id, item_id`` pairs, or of all."""
        self.require_fitted()
        return all_scores(self.user_factors, self.item_factors) if pairs is None else pair_scores(pairs, self.user_factors, self.item_factors)

    def score_totals(self) -> DataFrame:
        """``user_id, n, total, best`` over the scores of all items, without a row for each."""
        self.require_fitted()
        return score_totals(self.user_factors, self.item_factors)

    def predict(self, pairs: DataFrame) -> DataFrame:
        return self.score(pairs).withColumnRenamed("score", "prediction")

    def similar_items(self, item: int, k: int = 10) -> DataFrame:
        self.require_fitted()
        return similar_to(self.item_factors, item, k)

    def similar_users(self, user: int, k: int = 10) -> DataFrame:
        self.require_fitted()
        return similar_to(self.user_factors, user, k)

    def all_similar_items(self, k: int = 10) -> DataFrame:
        self.require_fitted()
        return similar_all(self.item_factors, self.item_factors, k)


def ids_of(df: DataFrame, column: str) -> np.ndarray:
    return np.sort(df.select(column).toArrow()[column].to_numpy())


def start_table(ids: np.ndarray, given: DataFrame | None, rank: int, seed: int, extra: np.ndarray | None = None, scale: float = 0.01) -> Table:
    """Start factors: hashed normals, replaced by ``given`` (``id, factors``) where it has an id."""
    factors = seeded_normals(ids, rank, scale, seed)
    if given is not None:
        got = given.select("id", "factors").toArrow()
        keys = got["id"].to_numpy()
        table = np.asarray([list(v) for v in got["factors"].to_pylist()], float).reshape(len(keys), -1)
        if len(keys) and table.shape[1] != rank:
            raise ValueError("start factors have another rank")
        at = np.searchsorted(ids, keys)
        ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == keys)
        factors[at[ok]] = table[ok]
    return Table(ids, factors, extra)


def normals_frame(ids: DataFrame, rank: int, seed: int, scale: float = 0.01) -> DataFrame:
    """``id, factors`` with the start factors of :func:`start_table`, drawn in the tasks."""

    def draw(batches):
        for batch in batches:
            drawn = seeded_normals(batch.column(0).to_numpy(), rank, scale, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(drawn), pa.list_(pa.float64()))], names=["id", "factors"])

    return ids.mapInArrow(draw, "id long, factors array<double>")


class _Alternating(_Factors):
    """Loop over half-sweeps; picks broadcast arrays or joins by the counted size of both sides."""

    broadcast_bytes = BROADCAST_BYTES

    def _rules(self, side: str, base: np.ndarray, mean: float) -> Rules:
        raise NotImplementedError

    def _weights(self, matrix: Interactions, ids: np.ndarray) -> np.ndarray | None:
        return None

    def _loop(self, matrix: Interactions, run, user_init=None, item_init=None, mean: float = 0.0, steps: int | None = None) -> dict:
        spark = matrix.spark
        matrix = matrix.settled()
        n_users, n_items = matrix.users.count(), matrix.items.count()
        if not (fits_broadcast(n_users, self.rank, self.broadcast_bytes) and fits_broadcast(n_items, self.rank, self.broadcast_bytes)):
            return self._loop_joined(matrix, run, user_init, item_init, mean, steps)
        user_ids, item_ids = ids_of(matrix.users, "user_id"), ids_of(matrix.items, "item_id")
        u = start_table(user_ids, user_init, self.rank, self.seed)
        v = start_table(item_ids, item_init, self.rank, self.seed + 1, self._weights(matrix, item_ids))
        by_user = segments(matrix.x, "user_id", "item_id", matrix.users)
        by_item = segments(matrix.x, "item_id", "user_id", matrix.items)
        for step in range(1, (steps or self.max_iter) + 1):
            u = half_sweep(spark, by_user, self._rules("user", self._base(v, "user"), mean), u, v)
            v = half_sweep(spark, by_item, self._rules("item", self._base(u, "item"), mean), v, u)
            if run is not None and run.callbacks:  # they see the state while fitting
                self.__dict__.update(self._tables(spark, u, v, mean))
            loss = None
            if run is not None and run.wants_loss:
                loss = observed_loss(spark, by_user, self._rules("user", np.zeros((0, 0)), mean), u, v) + self._shared_loss(u, v)
            if run is not None and run.epoch(step, loss):
                break
        return {k: stow(x) if isinstance(x, DataFrame) else x for k, x in self._tables(spark, u, v, mean).items()}

    def _shared_loss(self, u: Table, v: Table) -> float:
        """The part of the objective that needs no entries."""
        return self.reg * float((u.factors**2).sum() + (v.factors**2).sum())

    def _base(self, fixed: Table, side: str) -> np.ndarray:
        """Shared Gram matrix of the fixed side."""
        return fixed.factors.T @ fixed.factors

    def _tables(self, spark, u: Table, v: Table, mean: float) -> dict:
        return {"user_factors": u.to_frame(spark), "item_factors": v.to_frame(spark)}

    def _loop_joined(self, matrix, run, user_init, item_init, mean, steps) -> dict:
        def start(universe, column, given, salt, extra):
            rows = normals_frame(universe.select(F.col(column).alias("id")), self.rank, self.seed + salt)
            if extra is not None:
                rows = rows.join(extra, "id", "left").withColumn("extra", F.coalesce("extra", F.lit(0.0)))
            else:
                rows = rows.withColumn("extra", F.lit(0.0))
            if given is not None:
                rows = rows.join(given.select("id", F.col("factors").alias("g")), "id", "left")
                rows = rows.select("id", F.coalesce("g", "factors").alias("factors"), "extra")
            return stow(rows)

        u = start(matrix.users, "user_id", user_init, 0, None)
        v = start(matrix.items, "item_id", item_init, 1, self._weight_frame(matrix))
        for step in range(1, (steps or self.max_iter) + 1):
            last_u, last_v = u, v
            u = half_sweep_joined(matrix.x, "user_id", "item_id", matrix.users, self._rules("user", self._gram(v, "user"), mean), u, v)
            v = half_sweep_joined(matrix.x, "item_id", "user_id", matrix.items, self._rules("item", self._gram(u, "item"), mean), v, u)
            discard(last_u)
            discard(last_v)
            self.__dict__.update(self._frames(u, v, mean))
            loss = self._loss(matrix, mean) if run is not None and run.wants_loss else None
            if run is not None and run.epoch(step, loss):
                break
        return self._frames(u, v, mean)

    def _gram(self, fixed: DataFrame, side: str) -> np.ndarray:
        return factor_gram(fixed)

    def _weight_frame(self, matrix) -> DataFrame | None:
        return None

    def _frames(self, u: DataFrame, v: DataFrame, mean: float) -> dict:
        return {"user_factors": u.select("id", "factors"), "item_factors": v.select("id", "factors")}

    def _norms(self) -> float:
        total = 0.0
        for side in (self.user_factors, self.item_factors):
            total += side.agg(F.coalesce(F.sum(dot("factors", "factors")), F.lit(0.0))).first()[0]
        return total


@dataclass
class WeightedMF(_Alternating):
    """Weighted matrix factorization.

    ``implicit``: confidence c = max(1, 1 + alpha r), preference 1 on stored entries and 0 elsewhere; x_u = (Y'Y + reg I +
    sum (c - 1) y y')^-1 sum c y, users then items.  ``explicit``: mean + biases + factors on the rating residuals, the system of an
    entity being that of y extended by 1, plus Y'Y over all items, reg on the diagonal and twice on the bias.  An entity without
    entries gets zeros.  ``recommend`` and ``score`` of ``implicit`` fold the given users in from zero; ``predict`` uses the fitted
    factors.
    """

    rank: int = 10
    reg: float = 0.1
    alpha: float = 1.0
    max_iter: int = 10
    tol: float = 0.005
    solver: str = "cg"
    feedback: str = "implicit"
    cg_steps: int = 3
    min_iter: int = 1
    seed: int = 0
    STATE = ("user_factors", "item_factors", "user_bias", "item_bias", "mean")

    def __post_init__(self):
        self.solver, self.feedback = Solver(self.solver).value, Feedback(self.feedback).value
        if self.rank < 1 or self.reg < 0 or self.alpha < 0 or self.max_iter < 1 or self.cg_steps < 1:
            raise ValueError("WeightedMF: parameter out of range")
        if self.solver == "nonnegative" and self.feedback == "explicit":
            raise ValueError("WeightedMF: the nonnegative solver is for implicit feedback")

    @property
    def explicit(self) -> bool:
        return self.feedback == "explicit"

    def _rules(self, side, base, mean):
        return Rules("biased" if self.explicit else "weighted", self.solver, self.alpha, self.reg, self.cg_steps, mean, base)

    def _shared_loss(self, u, v):
        biases = self.reg * float((u.extra**2).sum() + (v.extra**2).sum()) if self.explicit else 0.0
        return super()._shared_loss(u, v) + biases

    def _tables(self, spark, u, v, mean):
        out = super()._tables(spark, u, v, mean)
        if self.explicit:
            out |= {"user_bias": u.to_frame(spark, "bias").select("id", "bias"), "item_bias": v.to_frame(spark, "bias").select("id", "bias")}
        return out | {"mean": mean}

    def _frames(self, u, v, mean):
        out = super()._frames(u, v, mean) | {"mean": mean}
        if self.explicit:
            out |= {"user_bias": u.select("id", F.col("extra").alias("bias")), "item_bias": v.select("id", F.col("extra").alias("bias"))}
        return out

    def _fit(self, matrix: Interactions, user_init: DataFrame | None = None, item_init: DataFrame | None = None, *, run) -> dict:
        require_finite(matrix, "WeightedMF")
        mean = float(matrix.x.agg(F.coalesce(F.avg("value"), F.lit(0.0))).first()[0]) if self.explicit else 0.0
        return self._loop(matrix, run, user_init, item_init, mean)

    def _loss(self, matrix: Interactions, mean: float) -> float:
        near = sampled_product(matrix.x, self.user_factors, self.item_factors)
        rows = matrix.x.join(near, ["user_id", "item_id"])
        if self.explicit:
            rows = self._biases(rows)
            e = F.col("value") - F.lit(mean) - F.col("b_u") - F.col("b_i") - F.col("approx")
            biases = self.user_bias.union(self.item_bias).agg(F.coalesce(F.sum(F.col("bias") * F.col("bias")), F.lit(0.0))).first()[0]
            part = rows.agg(F.coalesce(F.sum(e * e), F.lit(0.0))).first()[0]
            return part + self.reg * (self._norms() + biases)
        c = F.greatest(F.lit(1.0), 1 + F.lit(self.alpha) * F.col("value"))
        e = 1 - F.col("approx")
        return rows.agg(F.coalesce(F.sum(c * e * e), F.lit(0.0))).first()[0] + self.reg * self._norms()

    def loss(self, matrix: Interactions) -> float:
        """Training objective over the stored entries."""
        self.require_fitted()
        return self._loss(matrix, self.mean)

    def _biases(self, rows: DataFrame) -> DataFrame:
        zero = F.lit(0.0)
        u = self.user_bias.select(F.col("id").alias("user_id"), F.col("bias").alias("b_u"))
        i = self.item_bias.select(F.col("id").alias("item_id"), F.col("bias").alias("b_i"))
        joined = rows.join(u, "user_id", "left").join(i, "item_id", "left")
        return joined.withColumns({"b_u": F.coalesce("b_u", zero), "b_i": F.coalesce("b_i", zero)})

    def transform(self, matrix: Interactions) -> DataFrame:
        """Fold in the users of ``matrix`` with fixed items, from zero: ``id, factors[, bias]``.  Sides beyond the broadcast
        limit are joined."""
        self.require_fitted()
        spark = matrix.spark
        sides = matrix.users.count(), self.item_factors.count()
        if not all(fits_broadcast(n, self.rank, self.broadcast_bytes) for n in sides):
            return self._transform_joined(matrix)
        item_ids = ids_of(self.item_factors, "id")
        v = start_table(item_ids, self.item_factors, self.rank, self.seed)
        if self.explicit:
            bias = dict(zip(*[c.to_numpy() for c in self.item_bias.toArrow().columns]))
            v.extra = np.array([bias.get(i, 0.0) for i in v.ids])
        user_ids = ids_of(matrix.users, "user_id")
        zero = Table(user_ids, np.zeros((len(user_ids), self.rank)))
        rules = self._rules("user", self._base(v, "user"), self.mean)
        return half_sweep(spark, segments(matrix.x, "user_id", "item_id", matrix.users), rules, zero, v).to_frame(spark, "bias" if self.explicit else None)

    def _transform_joined(self, matrix: Interactions) -> DataFrame:
        zeros = F.array_repeat(F.lit(0.0), self.rank)
        users = matrix.users.select(F.col("user_id").alias("id"), zeros.alias("factors"), F.lit(0.0).alias("extra"))
        items = self.item_factors.withColumn("extra", F.lit(0.0))
        if self.explicit:
            bias = self.item_bias.select("id", F.col("bias").alias("extra"))
            items = self.item_factors.join(bias, "id", "left").withColumn("extra", F.coalesce("extra", F.lit(0.0)))
        rules = self._rules("user", self._gram(items, "user"), self.mean)
        solved = half_sweep_joined(matrix.x, "user_id", "item_id", matrix.users, rules, users, items)
        return solved.select("id", "factors", *([F.col("extra").alias("bias")] if self.explicit else []))

    def recommend(self, matrix: Interactions, k: int = 10) -> DataFrame:
        users = self.transform(matrix)
        if not self.explicit:
            return recommend_dense(users, self.item_factors, matrix.x, k)
        items = self.item_factors.join(self.item_bias, "id")
        ranked = recommend_dense(users, items, matrix.x, k, item_bias=True)
        own = users.select(F.col("id").alias("user_id"), "bias")
        return ranked.join(own, "user_id").select("user_id", "rank", "item_id", (F.col("score") + F.col("bias") + F.lit(self.mean)).alias("score"))

    def score_matrix(self, matrix: Interactions) -> DataFrame:
        """Scores of all items for the folded-in users of ``matrix``."""
        users = self.transform(matrix)
        scored = all_scores(users, self.item_factors)
        if not self.explicit:
            return scored
        own = users.select(F.col("id").alias("user_id"), F.col("bias").alias("b_u"))
        item = self.item_bias.select(F.col("id").alias("item_id"), F.col("bias").alias("b_i"))
        joined = scored.join(own, "user_id").join(item, "item_id")
        return joined.select("user_id", "item_id", (F.col("score") + F.col("b_u") + F.col("b_i") + F.lit(self.mean)).alias("score"))

    def score(self, pairs: DataFrame | None = None) -> DataFrame:
        scored = super().score(pairs)
        if not self.explicit:
            return scored
        return self._biases(scored).select("user_id", "item_id", (F.col("score") + F.col("b_u") + F.col("b_i") + F.lit(self.mean)).alias("score"))


@dataclass
class CachedALS(_Alternating):
    """Implicit ALS with a cached Gram matrix: A = S'S + reg I + sum alpha r y y', b = sum (1 + alpha r) y.  Values must not be
    negative."""

    rank: int = 64
    reg: float = 0.01
    alpha: float = 40.0
    max_iter: int = 15
    tol: float = 0.005
    solver: str = "cholesky"
    cg_steps: int = 3
    min_iter: int = 1
    seed: int = 0

    def __post_init__(self):
        self.solver = Solver(self.solver).value
        if self.rank < 1 or self.reg < 0 or self.alpha < 0 or self.max_iter < 1 or self.solver == "nonnegative":
            raise ValueError("CachedALS: parameter out of range")

    def _rules(self, side, base, mean):
        return Rules("cached", self.solver, self.alpha, self.reg, self.cg_steps, 0.0, base)

    def _fit(self, matrix: Interactions, user_init: DataFrame | None = None, item_init: DataFrame | None = None, *, run) -> dict:
        require_dimensions(matrix, "CachedALS")
        require_finite(matrix, "CachedALS")
        require_minimum(matrix, "CachedALS", 0.0)
        return self._loop(matrix, run, user_init, item_init)

    def _loss(self, matrix: Interactions, mean: float = 0.0) -> float:
        rows = matrix.x.join(sampled_product(matrix.x, self.user_factors, self.item_factors), ["user_id", "item_id"])
        e = 1 - F.col("approx")
        c = 1 + F.lit(self.alpha) * F.col("value")
        return rows.agg(F.coalesce(F.sum(c * e * e), F.lit(0.0))).first()[0] + self.reg * self._norms()

    loss = _loss


def unobserved_weights(matrix: Interactions, c0: float, exponent: float) -> DataFrame:
    """``id, weight`` per item: max(c0 f^a / sum f^a, 1e-12) with f the degree; even if a = 0 or nothing is stored."""
    n = F.lit(float(max(1, matrix.items.count())))
    degree = matrix.items.join(matrix.x.groupBy("item_id").agg(F.count("*").alias("f")), "item_id", "left")
    power = F.when(F.coalesce("f", F.lit(0)) > 0, F.pow(F.col("f").cast("double"), F.lit(exponent))).otherwise(0.0) if exponent > 0 else F.lit(1.0)
    degree = degree.select(F.col("item_id").alias("id"), power.alias("p"))
    total = degree.agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0]
    weight = F.lit(c0) * F.col("p") / F.lit(total) if total > 0 else F.lit(c0) / n
    return degree.select("id", F.greatest(weight, F.lit(1e-12)).alias("weight"))


@dataclass
class ElementwiseALS(_Alternating):
    """Element-wise ALS with popularity-weighted unobserved entries: one coordinate sweep per half-step.

    User coordinates minimise sum over own items (1 + c_i)(1 - y)^2 plus c_i y^2 over all others; users without items keep their
    factors, items without users decay.  ``update`` continues with new interactions, users and items.
    """

    rank: int = 64
    reg: float = 0.01
    unobserved_weight: float = 1.0
    popularity_exponent: float = 0.5
    max_iter: int = 15
    tol: float = 0.005
    min_iter: int = 1
    seed: int = 0
    STATE = ("user_factors", "item_factors", "item_weights")

    def __post_init__(self):
        if self.rank < 1 or self.reg < 0 or self.unobserved_weight < 0 or self.max_iter < 1 or self.popularity_exponent < 0:
            raise ValueError("ElementwiseALS: parameter out of range")

    def _weight_frame(self, matrix):
        return unobserved_weights(matrix, self.unobserved_weight, self.popularity_exponent).select("id", F.col("weight").alias("extra"))

    def _weights(self, matrix, ids):
        got = self._weight_frame(matrix).toArrow()
        out = np.zeros(len(ids))
        out[np.searchsorted(ids, got["id"].to_numpy())] = got["extra"].to_numpy()
        return out

    def _base(self, fixed: Table, side: str) -> np.ndarray:
        weight = fixed.extra[:, None] if side == "user" else 1.0
        return (fixed.factors * weight).T @ fixed.factors

    def _shared_loss(self, u, v):
        weighted = (v.factors * v.extra[:, None]).T @ v.factors
        return super()._shared_loss(u, v) + float((u.factors.T @ u.factors * weighted).sum())

    def _gram(self, fixed, side):
        return factor_gram(fixed, "extra" if side == "user" else None)

    def _rules(self, side, base, mean):
        return Rules("rows" if side == "user" else "columns", "cholesky", 1.0, self.reg, 0, 0.0, base)

    def _tables(self, spark, u, v, mean):
        weights = v.to_frame(spark, "weight").select("id", "weight")
        return super()._tables(spark, u, v, mean) | {"item_weights": weights}

    def _frames(self, u, v, mean):
        return super()._frames(u, v, mean) | {"item_weights": v.select("id", F.col("extra").alias("weight"))}

    def _fit(self, matrix: Interactions, user_init: DataFrame | None = None, item_init: DataFrame | None = None, *, run) -> dict:
        require_dimensions(matrix, "ElementwiseALS")
        require_finite(matrix, "ElementwiseALS")
        return self._loop(matrix, run, user_init, item_init)

    def _loss(self, matrix: Interactions, mean: float = 0.0) -> float:
        w = self.item_weights.select(F.col("id").alias("item_id"), "weight")
        rows = matrix.x.join(sampled_product(matrix.x, self.user_factors, self.item_factors), ["user_id", "item_id"]).join(w, "item_id")
        y, c = F.col("approx"), F.col("weight")
        seen = rows.agg(F.coalesce(F.sum((1 + c) * (1 - y) * (1 - y) - c * y * y), F.lit(0.0))).first()[0]
        gram_u = factor_gram(self.user_factors)
        gram_v = factor_gram(self.item_factors.join(self.item_weights, "id"), "weight")
        return float(seen + (gram_u * gram_v).sum() + self.reg * self._norms())

    loss = _loss

    def update(self, matrix: Interactions, n_iters: int = 1):
        """Continue from the fitted factors with the interactions of ``matrix``; new users and items start at random."""
        if not self.is_fitted:
            return self.fit(matrix)
        state = self._loop(matrix, None, self.user_factors, self.item_factors, steps=n_iters)
        self._assign(state)
        return self
