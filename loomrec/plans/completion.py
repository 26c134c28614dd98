"""Low-rank completion: soft-thresholded SVD of the stored entries by alternating steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.operators.matrix import seeded_normals
from loomrec.operators.normal_equations import Table, _batch, _matrix, fits_broadcast, segments, sums_by_row
from loomrec.plans.base import SoftALS
from loomrec.plans.factorization import ids_of, start_table
from loomrec.scratch import stow
from loomrec.sources.triplets import Interactions, require_dimensions, require_finite


def sparse_times(spark, segs: DataFrame, mine: Table, other: Table, d: np.ndarray | None = None) -> np.ndarray:
    """Rows of X F for every entity of ``mine`` (F the factors of ``other``), or, with ``d``, of (X - U diag(d) V' on the stored
    entries) F.  Both sides are broadcast; partial rows of hot entities are added on the driver."""
    held = spark.sparkContext.broadcast((mine, other, d))

    def kernel(batches):
        mine, other, d = held.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            counts = np.diff(batch.column(2).offsets.to_numpy())
            e = other.factors[other.rows(batch.column(2).flatten().to_numpy(zero_copy_only=False))]
            vals = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            if d is not None:
                own = np.repeat(mine.factors[mine.rows(ids)] * d, counts, axis=0)
                vals = vals - (own * e).sum(1)
            yield _batch(ids, sums_by_row(e * vals[:, None], counts), None)

    got = segs.mapInArrow(kernel, "id long, factors array<double>, partial array<double>").toArrow()
    out = np.zeros((len(mine.ids), other.factors.shape[1]))
    if len(got):
        np.add.at(out, mine.rows(got["id"].to_numpy()), _matrix(got["factors"]))
    held.destroy()
    return out


class _Completion(SoftALS):
    STATE = ("user_factors", "item_factors", "singular")
    impute = False

    def _fit(self, matrix: Interactions, user_init: DataFrame | None = None, *, run) -> dict:
        name = type(self).__name__
        require_dimensions(matrix, name)
        require_finite(matrix, name)
        matrix = matrix.settled()
        spark = matrix.spark
        users, items = ids_of(matrix.users, "user_id"), ids_of(matrix.items, "item_id")
        rank = min(self.rank, len(users), len(items))
        if not (fits_broadcast(len(users), rank) and fits_broadcast(len(items), rank)):
            raise MemoryError(f"{name}: the factors of {len(users)} users and {len(items)} items exceed what may be broadcast")
        by_user = segments(matrix.x, "user_id", "item_id", matrix.users)
        by_item = segments(matrix.x, "item_id", "user_id", matrix.items)
        first = seeded_normals(users, rank, 1.0, self.seed) if user_init is None else start_table(users, user_init, rank, self.seed).factors
        u = Table(users, np.linalg.qr(first)[0])
        v, d = Table(items, np.zeros((len(items), rank))), np.ones(rank)
        lam, before = self.reg, None
        for step in range(1, self.max_iter + 1):
            for mine, other, segs in ((v, u, by_item), (u, v, by_user)):
                hat = sparse_times(spark, segs, mine, other, d if self.impute else None) * (d / (d + lam))
                if self.impute:
                    hat += mine.factors * (d * d / (d + lam))
                q, s, r = np.linalg.svd(hat, full_matrices=False)
                mine.factors, other.factors, d = q, other.factors @ r.T, np.maximum(s, 1e-12)
            energy = float((d * d).sum())
            self.__dict__.update(self._state(spark, u, v, d))
            stop = run.epoch(step, energy)
            if stop or (before is not None and abs(before - energy) / (before + 1e-12) < self.conv):
                break
            before = energy
        if self.final_svd:
            last = sparse_times(spark, by_user, u, v, d if self.impute else None)
            if self.impute:
                last += u.factors * d
            q, s, r = np.linalg.svd(last, full_matrices=False)
            kept = max(1, int((s - lam > 0).sum()))
            d = np.maximum(s - lam, 0)[:kept]
            u.factors, v.factors = q[:, :kept], (v.factors @ r.T)[:, :kept]
        return {k: stow(x) if isinstance(x, DataFrame) else x for k, x in self._state(spark, u, v, d).items()}

    def _state(self, spark, u: Table, v: Table, d: np.ndarray) -> dict:
        return {"user_factors": u.to_frame(spark), "item_factors": v.to_frame(spark), "singular": [float(x) for x in d]}

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``user_id, item_id, prediction`` = sum over f of U_uf d_f V_if; an unknown id predicts 0."""
        self.require_fitted()
        u = self.user_factors.select(F.col("id").alias("user_id"), F.col("factors").alias("_u"))
        v = self.item_factors.select(F.col("id").alias("item_id"), F.col("factors").alias("_v"))
        d = F.array(*(F.lit(x) for x in self.singular))
        scaled = F.zip_with("_u", d, lambda a, b: a * b)
        value = F.aggregate(F.zip_with(scaled, "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        joined = pairs.select("user_id", "item_id").join(u, "user_id", "left").join(v, "item_id", "left")
        return joined.select("user_id", "item_id", F.coalesce(value, F.lit(0.0)).alias("prediction"))

    score = predict


@dataclass
class SoftImpute(_Completion):
    """Completion that imputes the low-rank estimate at entries not stored; ``conv`` is the relative change of sum d^2 to stop at."""

    rank: int = 10
    reg: float = 0.0
    max_iter: int = 100
    conv: float = 1e-3
    final_svd: bool = True
    seed: int = 0
    impute = True

    def __post_init__(self):
        if self.rank < 1 or self.reg < 0 or self.max_iter < 1:
            raise ValueError(f"{type(self).__name__}: parameter out of range")


@dataclass
class SoftSVD(_Completion):
    """Soft-thresholded SVD of the matrix with entries not stored taken as 0."""

    rank: int = 10
    reg: float = 1.0
    max_iter: int = 100
    conv: float = 1e-3
    final_svd: bool = True
    seed: int = 0

    __post_init__ = SoftImpute.__post_init__


@dataclass
class PureSVD(_Completion):
    """Truncated SVD of the matrix: :class:`SoftSVD` without threshold and final step."""

    rank: int = 10
    max_iter: int = 100
    conv: float = 1e-3
    seed: int = 0
    reg = 0.0
    final_svd = False

    __post_init__ = SoftImpute.__post_init__
