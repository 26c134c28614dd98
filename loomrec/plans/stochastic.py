"""Models trained by stochastic gradients: pairwise ranking, co-occurrence vectors, logistic and probabilistic factorization."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.functions import dot, sigmoid
from loomrec.operators.matrix import seeded_normals
from loomrec.operators.normal_equations import Table, _batch, _matrix, segments
from loomrec.operators.topk import all_scores, pair_scores, recommend_dense
from loomrec.plans import shards
from loomrec.plans.base import ExplicitModel
from loomrec.plans.factorization import _Factors, ids_of
from loomrec.scratch import discard, stow
from loomrec.sources.triplets import Interactions, require_dimensions, require_finite

BATCH = 256


class Sampling(str, Enum):
    """How unobserved items are drawn."""

    UNIFORM = "uniform"
    POPULAR = "popular"
    DYNAMIC = "dynamic"


def _logistic(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def _places(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(ids, values)


@dataclass
class PairwiseRanking(_Factors):
    """Bayesian personalized ranking: draws of an observed (u, i) and an unobserved j, in small batches.

    With s = sigmoid(u (j - i)): u += lr (s (i - j) - reg_user u), i += lr (s u - reg_positive i), j += lr (-s u - reg_negative j).
    ``n_samples`` draws an epoch (0: as many as there are eligible entries).  Users who own every item are left out; if nobody
    is left, fitting raises ``ValueError``.  Negatives are uniform, by the square root of the degree (``popular``), or the best
    scored of ``dynamic_candidates`` (``dynamic``).  In several shards i and j come from the same block of items; every epoch deals
    other blocks, and entries of users who own a whole block sit out until the next deal.
    """

    rank: int = 64
    lr: float = 0.05
    reg_user: float = 0.01
    reg_positive: float = 0.01
    reg_negative: float = 0.01
    n_samples: int = 0
    max_iter: int = 100
    tol: float = -1.0
    min_iter: int = 3
    sampling: str = "uniform"
    dynamic_candidates: int = 5
    n_shards: int | None = None
    seed: int = 0

    def __post_init__(self):
        self.sampling = Sampling(self.sampling).value
        if self.rank < 1 or self.lr <= 0 or self.max_iter < 1 or self.n_samples < 0 or self.dynamic_candidates < 1:
            raise ValueError("PairwiseRanking: parameter out of range")

    def _fit(self, matrix: Interactions, *, run) -> dict:
        require_finite(matrix, "PairwiseRanking")
        spark = matrix.spark
        users, items = ids_of(matrix.users, "user_id"), ids_of(matrix.items, "item_id")
        full = matrix.x.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= len(items)).select("user_id")
        able = stow(matrix.x.select("user_id", "item_id").join(full, "user_id", "left_anti"))
        total = able.count()
        if not total:
            raise ValueError("PairwiseRanking: no user has both an observed and an unobserved item")
        degree = np.zeros(len(items))
        counts = matrix.x.groupBy("item_id").agg(F.count("*").alias("n")).toArrow()
        degree[_places(items, counts["item_id"].to_numpy())] = counts["n"].to_numpy()
        params = {"u": seeded_normals(users, self.rank, 0.01, self.seed), "v": seeded_normals(items, self.rank, 0.01, self.seed + 1)}
        n_shards = shards.shard_count(total, self.n_shards)
        draws = self.n_samples or total
        for step in range(1, self.max_iter + 1):
            lr, sampling, tries, seed = self.lr, self.sampling, self.dynamic_candidates, self.seed
            regs = (self.reg_user, self.reg_positive, self.reg_negative)

            dealt = shards.cells(able, n_shards, "user_id", "item_id", step)
            blocks = np.zeros(len(items), int)
            if n_shards > 1:
                got = matrix.items.select("item_id", shards.block("item_id", n_shards, step).alias("b")).toArrow()
                blocks[_places(items, got["item_id"].to_numpy())] = got["b"].to_numpy()

            def train(columns, p, shard, turn, lr=lr, step=step, blocks=blocks):
                rng = np.random.default_rng([seed, step, shard + n_shards * turn])
                u, i = _places(users, columns["user_id"]), _places(items, columns["item_id"])
                owned = np.sort(u * len(items) + i)
                can = np.flatnonzero(blocks == (shard + turn) % n_shards)
                popular = np.cumsum(np.sqrt(degree[can]))
                if n_shards > 1:
                    able = np.bincount(u)[u] < len(can)
                    u, i = u[able], i[able]
                many = int(draws * len(u) / total + np.random.default_rng([seed, step, shard, turn]).random())

                def unseen(who, j):
                    key = who * len(items) + j
                    at = np.minimum(np.searchsorted(owned, key), len(owned) - 1)
                    return owned[at] != key

                def propose(size):
                    if sampling == "popular" and popular[-1] > 0:
                        return can[np.searchsorted(popular, rng.random(size) * popular[-1], side="right")]
                    return can[rng.integers(0, len(can), size)]

                loss = 0.0
                batch = max(1, min(BATCH, min(len(users), len(items)) // 4))  # few draws of a batch share a row
                for lo in range(0, many, batch):
                    at = rng.integers(0, len(u), min(batch, many - lo))
                    a, b = u[at], i[at]
                    c = propose(len(at))
                    for _ in range(len(can)):
                        bad = ~unseen(a, c)
                        if not bad.any():
                            break
                        c[bad] = propose(int(bad.sum()))
                    if sampling == "dynamic":
                        for _ in range(tries - 1):
                            other = propose(len(at))
                            better = unseen(a, other) & ((p["u"][a] * (p["v"][other] - p["v"][c])).sum(1) > 0)
                            c = np.where(better, other, c)
                    ok = unseen(a, c)
                    a, b, c = a[ok], b[ok], c[ok]
                    fu, fi, fj = p["u"][a], p["v"][b], p["v"][c]
                    s = _logistic((fu * (fj - fi)).sum(1))
                    loss += float(-np.log(1 - s + 1e-10).sum())
                    s = s[:, None]
                    np.add.at(p["u"], a, lr * (s * (fi - fj) - regs[0] * fu))
                    np.add.at(p["v"], b, lr * (s * fu - regs[1] * fi))
                    np.add.at(p["v"], c, lr * (-s * fu - regs[2] * fj))
                return loss

            got = shards.cell_epoch(dealt, n_shards, ["user_id", "item_id"], params, train)
            discard(dealt)
            params = got["params"]
            self.__dict__.update(user_factors=Table(users, params["u"]).to_frame(spark), item_factors=Table(items, params["v"]).to_frame(spark))
            if run.epoch(step, got["loss"] / draws):
                break
        return {"user_factors": stow(self.user_factors), "item_factors": stow(self.item_factors)}


@dataclass
class GlobalVectors(_Factors):
    """Vectors from a positive, square co-occurrence table ``word, context, count``.

    Weight (x / x_max)^alpha below x_max, else 1; difference b_i + c_j + w_i v_j - ln x; AdaGrad from accumulators of 1 on vectors
    and biases, small batches in order of (word, context); ``reg`` on vectors only.  ``embeddings`` are the sums of both sides.
    """

    rank: int = 50
    x_max: float = 100.0
    lr: float = 0.05
    alpha: float = 0.75
    reg: float = 0.0
    max_iter: int = 25
    tol: float = -1.0
    min_iter: int = 1
    n_shards: int | None = None
    seed: int = 0
    STATE = ("user_factors", "item_factors", "words", "contexts", "seen")

    def __post_init__(self):
        if self.rank < 1 or self.x_max <= 0 or self.lr <= 0 or self.reg < 0 or self.max_iter < 1:
            raise ValueError("GlobalVectors: parameter out of range")

    def _fit(self, pairs: DataFrame, *, run) -> dict:
        bad = pairs.agg(F.count("*").alias("n"), F.min("count").alias("low"), F.max(F.isnan("count") | (F.abs("count") == float("inf"))).alias("odd")).first()
        if not bad["n"] or bad["odd"] or bad["low"] is None or bad["low"] <= 0:
            raise ValueError("GlobalVectors: counts must be there, finite and positive")
        spark = pairs.sparkSession
        pairs = stow(pairs.select("word", "context", F.col("count").cast("double").alias("count")))
        names = np.union1d(ids_of(pairs.select("word").distinct(), "word"), ids_of(pairs.select("context").distinct(), "context"))
        n, k = len(names), self.rank
        rng = np.random.default_rng(self.seed)
        params = {"w": rng.uniform(-0.5, 0.5, (n, k)), "v": rng.uniform(-0.5, 0.5, (n, k)), "b": rng.uniform(-0.5, 0.5, n), "c": rng.uniform(-0.5, 0.5, n)}
        params |= {f"g{key}": np.ones_like(p) for key, p in list(params.items())}
        n_shards = shards.shard_count(bad["n"], self.n_shards)
        dealt = shards.cells(pairs, n_shards, "word", "context")
        for step in range(1, self.max_iter + 1):
            lr, reg, x_max, alpha = self.lr, self.reg, self.x_max, self.alpha

            def train(columns, p, shard, turn, lr=lr):
                i, j = _places(names, columns["word"]), _places(names, columns["context"])
                x = columns["count"]
                weight, cost = np.minimum((x / x_max) ** alpha, 1.0), 0.0
                for lo in range(0, len(i), BATCH):
                    a, b, w = i[lo : lo + BATCH], j[lo : lo + BATCH], weight[lo : lo + BATCH]
                    wi, vj = p["w"][a], p["v"][b]
                    diff = (wi * vj).sum(1) + p["b"][a] + p["c"][b] - np.log(x[lo : lo + BATCH])
                    cost += 0.5 * float((w * diff * diff).sum())
                    g = w * diff
                    for key, at, grad in (("w", a, g[:, None] * vj + reg * wi), ("v", b, g[:, None] * wi + reg * vj), ("b", a, g), ("c", b, g)):
                        np.add.at(p[key], at, -lr * grad / (np.sqrt(p[f"g{key}"][at]) + 1e-8))
                        np.add.at(p[f"g{key}"], at, grad * grad)
                return cost

            got = shards.cell_epoch(dealt, n_shards, ["word", "context"], params, train)
            params = got["params"]
            if not np.isfinite(got["loss"]):
                raise FloatingPointError("GlobalVectors: the cost is not finite")
            if run.epoch(step, got["loss"] / bad["n"]):
                break
        both = Table(names, params["w"] + params["v"])
        out = {"user_factors": both.to_frame(spark), "item_factors": both.to_frame(spark), "words": Table(names, params["w"], params["b"]).to_frame(spark, "bias"), "contexts": Table(names, params["v"], params["c"]).to_frame(spark, "bias")}
        return {key: stow(df) for key, df in out.items()} | {"seen": pairs.select("word", "context")}

    def embeddings(self) -> DataFrame:
        """``id, factors``: word plus context vectors."""
        self.require_fitted()
        return self.user_factors

    def recommend(self, pairs: DataFrame | None = None, k: int = 10, *, exclude_self: bool = False) -> DataFrame:
        """Words by inner product of embeddings, those of ``pairs`` (default: the fitted ones) masked as seen."""
        self.require_fitted()
        seen = (self.seen if pairs is None else pairs).select(F.col("word").alias("user_id"), F.col("context").alias("item_id"))
        if exclude_self:
            seen = seen.union(self.user_factors.select("id", F.col("id"))).distinct()
        return recommend_dense(self.user_factors, self.item_factors, seen, k)


def glove_cost(pairs: DataFrame, words: DataFrame, contexts: DataFrame, x_max: float, alpha: float) -> DataFrame:
    """One row ``cost``: 1/2 sum of weight x squared difference over a co-occurrence table, given vectors with biases."""
    w = words.select(F.col("id").alias("word"), F.col("factors").alias("_w"), F.col("bias").alias("_b"))
    c = contexts.select(F.col("id").alias("context"), F.col("factors").alias("_c"), F.col("bias").alias("_d"))
    rows = pairs.join(w, "word").join(c, "context")
    weight = F.least(F.pow(F.col("count") / F.lit(x_max), F.lit(alpha)), F.lit(1.0))
    diff = F.col("_b") + F.col("_d") + dot("_w", "_c") - F.log("count")
    return rows.agg((0.5 * F.sum(weight * diff * diff)).alias("cost"))


def _whole(segs: DataFrame, other: Table) -> dict[int, np.ndarray]:
    """Places of all entries, in order, of the entities that have several segments; four bytes an entry."""
    parts: dict[int, list] = {}
    for r in segs.filter("segs > 1").select("id", "others").toLocalIterator():
        parts.setdefault(r["id"], []).append(other.rows(np.asarray(r["others"], np.int64)).astype(np.int32))
    return {i: np.sort(np.concatenate(p)) for i, p in parts.items()}


@dataclass
class LogisticMF(_Factors):
    """Logistic matrix factorization (experimental): factors plus a bias column on each side, AdaGrad or RMSProp per entity.

    A half-sweep moves every entity along sum over entries alpha r sigmoid(-s) v minus sum over drawn negatives sigmoid(s) v minus reg
    u; negatives are ``n_negative`` times the entries (at most all others), drawn by degree.  Entities without entries are zero.
    """

    rank: int = 10
    reg: float = 0.6
    alpha: float = 1.0
    lr: float = 1.0
    max_iter: int = 30
    n_negative: int = 30
    optimizer: str = "adagrad"
    tol: float = -1.0
    min_iter: int = 1
    seed: int = 0

    def __post_init__(self):
        if self.optimizer not in ("adagrad", "rmsprop"):
            raise ValueError("LogisticMF: optimizer must be adagrad or rmsprop")
        if self.rank < 1 or self.reg < 0 or self.lr <= 0 or self.max_iter < 1 or self.n_negative < 0:
            raise ValueError("LogisticMF: parameter out of range")

    def _fit(self, matrix: Interactions, *, run) -> dict:
        require_dimensions(matrix, "LogisticMF")
        require_finite(matrix, "LogisticMF")
        matrix = matrix.settled()
        if not matrix.x.limit(1).count():
            raise ValueError("LogisticMF: the matrix has no entry")
        spark, k = matrix.spark, self.rank
        sides = []
        for n, (column, universe) in enumerate((("user_id", matrix.users), ("item_id", matrix.items))):
            ids = ids_of(universe, column)
            f = np.concatenate([seeded_normals(ids, k, 0.1, self.seed + n), np.zeros((len(ids), 2))], axis=1)
            pinned = k + 1 - n  # the column that multiplies the other side's bias
            f[:, pinned] = 1.0
            got = matrix.x.groupBy(column).agg(F.count("*").alias("n")).toArrow()
            degree = np.zeros(len(ids))
            degree[_places(ids, got[column].to_numpy())] = got["n"].to_numpy()
            f[degree == 0] = 0.0
            sides.append([Table(ids, f, degree), np.zeros_like(f), pinned])
        by = [segments(matrix.x, "user_id", "item_id", matrix.users), segments(matrix.x, "item_id", "user_id", matrix.items)]
        whole = [_whole(by[s], sides[1 - s][0]) for s in (0, 1)]
        for step in range(1, self.max_iter + 1):
            for s in (0, 1):
                (mine, total, pinned), other = sides[s], sides[1 - s][0]
                grad = self._gradient(spark, by[s], mine, other, step, whole[s])
                grad[:, pinned] = 0.0
                total[:] = 0.9 * total + 0.1 * grad**2 if self.optimizer == "rmsprop" else total + grad**2
                mine.factors += self.lr * grad / (np.sqrt(total) + 1e-6)
                mine.factors[mine.extra == 0] = 0.0
            frames = {"user_factors": sides[0][0].to_frame(spark), "item_factors": sides[1][0].to_frame(spark)}
            self.__dict__.update(frames)
            if run.epoch(step, self._loss(matrix) if run.wants_loss else None):
                break
        return {key: stow(df) for key, df in frames.items()}

    def _gradient(self, spark, segs: DataFrame, mine: Table, other: Table, step: int, whole: dict[int, np.ndarray]) -> np.ndarray:
        held = spark.sparkContext.broadcast((mine, other, np.cumsum(other.extra), whole))
        alpha, reg, many, seed = self.alpha, self.reg, self.n_negative, self.seed

        def kernel(batches):
            mine, other, popular, whole = held.value
            for batch in batches:
                ids, out = batch.column(0).to_numpy(), []
                offsets = batch.column(2).offsets.to_numpy()
                offsets = offsets - offsets[0]
                at = other.rows(batch.column(2).flatten().to_numpy(zero_copy_only=False))
                vals = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                me = mine.rows(ids)
                for r, i in enumerate(ids):
                    own, v = at[offsets[r] : offsets[r + 1]], vals[offsets[r] : offsets[r + 1]]
                    u = mine.factors[me[r]]
                    share = len(own) / max(1.0, mine.extra[me[r]])  # of the regularization, if there are several segments
                    e = other.factors[own]
                    g = (alpha * v * _logistic(-(e @ u))) @ e - reg * share * u
                    every = whole.get(int(i), own)  # the entity's entries in all of its segments
                    draws = min(len(other.ids), len(every) * many)
                    if draws and popular[-1] > 0:
                        rng = np.random.default_rng([seed, step, int(i) & 0x7FFFFFFF, len(every)])
                        j = np.searchsorted(popular, rng.random(draws) * popular[-1], side="right")
                        if len(every) > len(own):  # the entity's draws are dealt to its entries in turn
                            j = j[np.isin(np.arange(draws) % len(every), np.searchsorted(every, own))]
                        j = j[~np.isin(j, every)]
                        f = other.factors[j]
                        g = g - _logistic(f @ u) @ f
                    out.append(g)
                yield _batch(ids, np.asarray(out), None)

        got = segs.mapInArrow(kernel, "id long, factors array<double>, partial array<double>").toArrow()
        grad = np.zeros_like(mine.factors)
        np.add.at(grad, mine.rows(got["id"].to_numpy()), _matrix(got["factors"]))
        held.destroy()
        return grad

    def _loss(self, matrix: Interactions) -> float:
        scored = pair_scores(matrix.x, self.user_factors, self.item_factors)
        return float(scored.agg(F.avg(-F.log(sigmoid(F.col("score")) + F.lit(1e-300)))).first()[0])


@dataclass
class ProbabilisticMF(ExplicitModel):
    """Probabilistic factorization (experimental): sequential gradient steps in order of (user, item); err = r - u v."""

    rank: int = 10
    reg: float = 0.1
    lr: float = 0.01
    max_iter: int = 30
    n_shards: int | None = None
    seed: int = 0
    STATE = ("user_factors", "item_factors")

    def __post_init__(self):
        if self.rank < 1 or self.reg < 0 or self.lr <= 0 or self.max_iter < 1:
            raise ValueError("ProbabilisticMF: parameter out of range")

    def _fit(self, matrix: Interactions, *, run) -> dict:
        require_dimensions(matrix, "ProbabilisticMF")
        require_finite(matrix, "ProbabilisticMF")
        matrix = matrix.settled()
        spark = matrix.spark
        users, items = ids_of(matrix.users, "user_id"), ids_of(matrix.items, "item_id")
        params = {"u": seeded_normals(users, self.rank, 0.1, self.seed), "v": seeded_normals(items, self.rank, 0.1, self.seed + 1)}
        n_shards = shards.shard_count(matrix.x.count(), self.n_shards)
        dealt = shards.cells(matrix.x, n_shards, "user_id", "item_id")
        for step in range(1, self.max_iter + 1):
            lr, reg = self.lr, self.reg

            def train(columns, p, shard, turn, lr=lr):
                pu, pv, loss = p["u"], p["v"], 0.0
                for a, b, r in zip(_places(users, columns["user_id"]).tolist(), _places(items, columns["item_id"]).tolist(), columns["value"].tolist()):
                    u, v = pu[a], pv[b]
                    err = r - float(u @ v)
                    loss += err * err
                    old = u.copy()
                    u += lr * (err * v - reg * u)
                    v += lr * (err * old - reg * v)
                return loss

            got = shards.cell_epoch(dealt, n_shards, ["user_id", "item_id"], params, train)
            params = got["params"]
            if run.epoch(step, got["loss"] / max(1, got["n"])):
                break
        return {"user_factors": stow(Table(users, params["u"]).to_frame(spark)), "item_factors": stow(Table(items, params["v"]).to_frame(spark))}

    def score(self, pairs: DataFrame | None = None) -> DataFrame:
        self.require_fitted()
        return all_scores(self.user_factors, self.item_factors) if pairs is None else pair_scores(pairs, self.user_factors, self.item_factors)

    def predict(self, pairs: DataFrame) -> DataFrame:
        return self.score(pairs).withColumnRenamed("score", "prediction")
