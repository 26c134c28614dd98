"""Structure of the sparse matrix: degrees, norms, means, Gram matrices, sampled products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.functions import dot
from loomrec.operators.pairs import both_ways, pair_sums, row_products
from loomrec.sources.triplets import Interactions


def row_norms(matrix: Interactions, p: float = 2.0) -> DataFrame:
    """Lp norm of every user's row, ``user_id, norm``; users without entries have 0."""
    if p <= 0:
        raise ValueError("p must be positive")
    v = F.abs("value")
    if p == 1:
        agg = F.sum(v)
    elif p == 2:
        agg = F.sqrt(F.sum(v * v))
    else:
        agg = F.pow(F.sum(F.pow(v, F.lit(p))), F.lit(1.0 / p))
    norms = matrix.x.groupBy("user_id").agg(agg.alias("norm"))
    return matrix.users.join(norms, "user_id", "left").select("user_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def row_nnz(matrix: Interactions) -> DataFrame:
    """Entries of every user, ``user_id, nnz``."""
    counts = matrix.x.groupBy("user_id").agg(F.count("*").alias("nnz"))
    return matrix.users.join(counts, "user_id", "left").select("user_id", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def col_nnz(matrix: Interactions) -> DataFrame:
    """Entries of every item, ``item_id, nnz``."""
    counts = matrix.x.groupBy("item_id").agg(F.count("*").alias("nnz"))
    return matrix.items.join(counts, "item_id", "left").select("item_id", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def weighted_degrees(matrix: Interactions) -> DataFrame:
    """Sum of values per user and per item: ``side, id, degree``."""
    u = matrix.x.groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("degree"))
    i = matrix.x.groupBy(F.col("item_id").alias("id")).agg(F.sum("value").alias("degree"))
    return u.select(F.lit("user").alias("side"), "id", "degree").union(i.select(F.lit("item"), "id", "degree"))


def global_mean(matrix: Interactions) -> float:
    """Mean of the stored values, 0 if there are none."""
    return float(matrix.x.agg(F.coalesce(F.avg("value"), F.lit(0.0))).first()[0])


def gram(matrix: Interactions, *, binary: bool = False, side: str = "item", diagonal: bool = True) -> DataFrame:
    """Gram matrix of items (X'X) or users (XX'): ``src, dst, dot, n`` with n the size of the common support.

    ``binary`` takes every value as 1.  Only pairs with a common partner come out.  Users mostly share one hot item and no more,
    so their pairs are not shuffled but come from row products.
    """
    member, group = ("item_id", "user_id") if side == "item" else ("user_id", "item_id")
    v = F.lit(1.0) if binary else F.col("value")
    rows = matrix.x.select(member, group, v.alias("v"))
    if side == "user":
        pairs = row_products(rows, group, member, "v")
        return pairs if diagonal else pairs.filter("src <> dst")
    pairs = both_ways(pair_sums(rows, group, member, "v")).select("src", "dst", F.col("ab").alias("dot"), "n")
    if not diagonal:
        return pairs
    own = rows.groupBy(F.col(member).alias("src")).agg(F.sum(F.col("v") * F.col("v")).alias("dot"), F.count("*").alias("n"))
    return pairs.union(own.select("src", F.col("src"), "dot", "n"))


def factor_gram(factors: DataFrame, weight: str | None = None) -> np.ndarray:
    """``sum w f f'`` over all rows of ``id, factors``; partial sums per task, k x k numbers each."""

    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            f = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            w = batch.column(1).to_numpy()[:, None]
            g = (f * w).T @ f
            total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["g"])

    w = F.lit(1.0) if weight is None else F.col(weight)
    out = factors.select("factors", w.cast("double").alias("w")).mapInArrow(partial, "g array<double>")
    k2 = [r["g"] for r in out.collect()]  # one k x k matrix a task
    if not k2:
        return np.zeros((0, 0))
    total = np.sum(np.asarray(k2), axis=0)
    k = int(round(len(total) ** 0.5))
    return total.reshape(k, k)


def sampled_product(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``user_id, item_id, approx``: inner products of the two factor tables at the given positions; missing factors drop out."""
    a = left.select(F.col("id").alias("user_id"), F.col("factors").alias("_a"))
    b = right.select(F.col("id").alias("item_id"), F.col("factors").alias("_b"))
    return pairs.join(a, "user_id").join(b, "item_id").select("user_id", "item_id", dot("_a", "_b").alias("approx"))


def seeded_normals(ids: np.ndarray, rank: int, scale: float, seed: int) -> np.ndarray:
    """Normal start factors that depend on id and seed alone (counter-based hash, Box-Muller), never on partitions."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (
            np.arange(2 * rank, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed & 0xFFFFFFFF)
        )
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    u = (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return scale * np.sqrt(-2 * np.log(np.maximum(u[:, :rank], 1e-300))) * np.cos(2 * np.pi * u[:, rank:])
