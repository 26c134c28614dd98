"""Filling fixed-capacity containers: vector best-fit under token, document-count and attention-cost capacities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.tokens import token_count
from loomrec.scratch import stow

#: Documents a shard holds on average; a shard is packed by one task.
SHARD_DOCS = 4_096


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> np.ndarray:
    """Bin of each item; items (rows of demands, one column a constraint) must come in the order of packing.

    Of the open bins with room under every constraint the item goes to the one with the smallest weighted norm of what is
    left over (``score="norm"``) or the largest weighted dot product of demand and residual (``"dot"``); the oldest bin wins
    ties, and a new bin is opened only if none has room.  An item larger than a capacity gets a bin of its own.
    """
    scaled = sizes / capacity
    bins = np.empty(len(sizes), np.int64)
    left = np.empty((256, sizes.shape[1]))
    names = np.empty(256, np.int64)
    open_bins = made = 0
    least = scaled.min(axis=0) if len(scaled) else None
    for k, need in enumerate(scaled):
        rest = left[:open_bins]
        if open_bins:
            after = rest - need
            fits = (after >= -1e-12).all(axis=1)
            value = (weights * after * after).sum(axis=1) if score == "norm" else -(weights * need * rest).sum(axis=1)
            value = np.where(fits, value, np.inf)
            at = int(value.argmin())
        if not open_bins or not fits[at]:
            if open_bins == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            at, left[open_bins], names[open_bins] = open_bins, 1.0, made
            open_bins, made = open_bins + 1, made + 1
        bins[k] = names[at]
        left[at] -= need
        if (left[at] < least - 1e-12).any():  # nothing fits in any more
            open_bins -= 1
            left[at], names[at] = left[open_bins], names[open_bins]
    return bins


def pack_shard(table: pa.Table, capacity: int, max_docs: int, attention: float, weights, score: str, shard_limit: int):
    """Arrow kernel: one shard of (shard, id, n_tokens) to (container, id, piece, start_token, n_tokens)."""
    shard = table["shard"][0].as_py() if len(table) else 0
    ids, tokens = table["id"].to_numpy(), table["n_tokens"].to_numpy()
    order = np.lexsort((ids, -tokens))
    ids, tokens = ids[order], tokens[order]
    full = np.maximum(0, -(-tokens // capacity) - 1)
    out = {"c": [], "id": [], "piece": [], "start": [], "n": []}
    base = 0
    # Items above the capacity: all pieces but the last fill a container each.
    if full.any():
        which = np.repeat(np.arange(len(ids)), full)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
        for key, x in zip(out, (np.arange(len(which)), ids[which], piece, piece * capacity, np.full(len(which), capacity))):
            out[key].append(x)
        base = len(which)
    rest = tokens - full * capacity
    order = np.lexsort((ids, -rest))
    for at in range(0, len(order), shard_limit):
        part = order[at : at + shard_limit]
        need = np.stack([rest[part], np.ones(len(part)), rest[part].astype(float) ** 2], axis=1).astype(float)
        found = best_fit(need, np.array([capacity, max_docs, attention], float), np.asarray(weights, float), score)
        for key, x in zip(out, (found + base, ids[part], full[part], full[part] * capacity, rest[part])):
            out[key].append(x)
        base += int(found.max()) + 1 if len(found) else 0
    c, i, p, s, n = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out.values())
    return pa.table(
        {"container": (np.int64(shard) << 32) + c, "id": i, "piece": p.astype(np.int32), "start_token": s, "n_tokens": n}
    )


def pack_documents(
    docs: DataFrame,
    doc_id: str,
    text: str,
    *,
    capacity: int = 4_096,
    max_docs: int = 1_024,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2),
    score: str = "norm",
    shard_docs: int = SHARD_DOCS,
    vocabulary: str | None = None,
) -> DataFrame:
    """Assign every document to containers: ``container, <doc_id>, piece, start_token, n_tokens, over_attention``.

    A container holds at most ``capacity`` tokens, ``max_docs`` documents and an attention cost (sum of squared lengths) of
    ``attention`` (default: ``capacity`` squared, which never binds).  A document stays whole unless it has more tokens than ``capacity``; then
    its pieces are consecutive token ranges, full ones with a container of their own and a last one that is packed like a
    document.  A piece over ``attention`` by itself gets its own container and is marked ``over_attention``.

    Documents are spread over shards of about ``shard_docs`` by a hash of id and size and each shard is packed by vector
    best-fit in order of falling size, so the work is linear in the documents, no shard depends on another, and only the last
    containers of a shard stay partly empty.  Null and empty texts have size 0 and still get a container; rows with a null id
    are left out; repeated ids are packed as often as they occur.  An empty table gives no rows.
    """
    # The filter stands before the count: above it, Spark would evaluate the count twice.
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    sizes = stow(named.select("id", token_count(F.col("text"), vocabulary).alias("n_tokens")))
    shards = max(1, -(-sizes.count() // shard_docs))
    cost = float(capacity) ** 2 if attention is None else float(attention)
    limit = 4 * shard_docs

    def kernel(table: pa.Table) -> pa.Table:
        return pack_shard(table, capacity, max_docs, cost, weights, score, limit)

    spread = sizes.withColumn("shard", F.pmod(F.xxhash64(F.lit(42), "id", "n_tokens"), F.lit(shards)))
    packed = spread.groupBy("shard").applyInArrow(
        kernel, "container long, id long, piece int, start_token long, n_tokens long"
    )
    tokens = F.col("n_tokens").cast("double")
    return packed.withColumn("over_attention", tokens * tokens > cost).withColumnRenamed("id", doc_id)


def packing_report(packed: DataFrame, capacity: int, max_docs: int, attention: float) -> DataFrame:
    """One row on a packing: ``containers, filled`` (share of the token capacity in use), ``full_tokens, full_docs,
    full_attention`` (containers that reach 0.95 of a limit, for documents the limit itself), ``broken`` (containers beyond a
    limit that hold more than one piece) and ``over_attention`` (pieces that exceed the attention limit by themselves)."""
    n = F.col("n_tokens").cast("double")
    per = packed.groupBy("container").agg(
        F.count("*").alias("docs"), F.sum(n).alias("tokens"), F.sum(n * n).alias("cost"), F.sum(F.col("over_attention").cast("long")).alias("over")
    )
    beyond = (F.col("docs") > max_docs) | (F.col("tokens") > capacity) | (F.col("cost") > attention)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return per.agg(
        F.count("*").alias("containers"),
        (F.sum("tokens") / (F.count("*") * F.lit(float(capacity)))).alias("filled"),
        count(F.col("tokens") >= 0.95 * capacity).alias("full_tokens"),
        count(F.col("docs") >= max_docs).alias("full_docs"),
        count(F.col("cost") >= 0.95 * attention).alias("full_attention"),
        count(beyond & (F.col("docs") > 1)).alias("broken"),
        F.coalesce(F.sum("over"), F.lit(0)).alias("over_attention"),
    )
