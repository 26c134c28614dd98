"""Stochastic training in shards.

Samples of two sides are dealt to cells that share no parameter row, so every row takes all of its updates (:func:`cell_epoch`); samples
of many features are trained on copies, whose changes are averaged by row (:func:`epoch`).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import stow

#: Samples of one shard; fewer samples are trained in one exact sequential pass.
SHARD_SAMPLES = 2_000_000
#: Bytes of parameters that may come back from all shards together; cells return a row once at most.
RETURN_BYTES = 1 << 30


def shard_count(samples: int, given: int | None = None) -> int:
    return given or max(1, -(-samples // SHARD_SAMPLES))


def _trained(rows: DataFrame, names: list[str], order: list[str], params: dict[str, np.ndarray], train) -> list:
    """Each ``_shard`` of ``rows`` trained on its own copy of ``params``: one row a shard with the changed rows of each parameter."""
    held = rows.sparkSession.sparkContext.broadcast(params)

    def run(table: pa.Table) -> pa.Table:
        shard = int(table["_shard"][0].as_py())
        table = table.sort_by([(c, "ascending") for c in order])
        own = {k: p.copy() for k, p in held.value.items()}
        columns = {}
        for c in names:
            flat = table[c].combine_chunks()
            if pa.types.is_list(flat.type):
                flat = flat if isinstance(flat, pa.ListArray) else flat.chunk(0)
                columns[c] = (flat.flatten().to_numpy(zero_copy_only=False), flat.offsets.to_numpy() - flat.offsets[0].as_py())
            else:
                columns[c] = table[c].to_numpy()
        loss, changed = train(columns, own, shard), {}
        for k, p in held.value.items():
            at = np.flatnonzero((own[k] != p).reshape(len(p), -1).any(1))
            changed[k] = at, own[k][at]
        return pa.table({"n": [len(table)], "loss": [float(loss)], "payload": pa.array([pickle.dumps(changed)], pa.binary())})

    got = rows.groupBy("_shard").applyInArrow(lambda t: run(t), "n long, loss double, payload binary").collect()  # one a shard
    held.destroy()
    return got


def epoch(spark, samples: DataFrame, shards: int, order: list[str], key: str, params: dict[str, np.ndarray], train) -> dict:
    """One epoch: ``train(columns, params, shard)`` changes its copy of ``params`` in place over the samples of a shard (numpy
    columns by name, in the given order) and returns its summed loss.  Returns the parameters and the loss; a row's change is the
    average over the shards that changed it.

    Samples are placed by a hash of ``key``; with one shard the epoch is the exact sequential pass.
    """
    size = sum(p.nbytes for p in params.values())
    if size * shards > RETURN_BYTES:
        raise MemoryError(f"{shards} shards of {size} bytes of parameters exceed {RETURN_BYTES} bytes")
    placed = samples.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)) if shards > 1 else F.lit(0))
    rows = _trained(placed, samples.columns, order, params, train)
    total, times = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros(len(p)) for k, p in params.items()}
    loss, n = 0.0, 0
    for r in rows:
        for k, (at, new) in pickle.loads(r["payload"]).items():
            total[k][at] += new - params[k][at]
            times[k][at] += 1
        loss, n = loss + r["loss"], n + r["n"]
    out = {k: p + total[k] / np.maximum(times[k], 1).reshape(-1, *[1] * (p.ndim - 1)) for k, p in params.items()}
    return {"params": out, "loss": loss, "n": n}


def block(column: str, shards: int, deal: int = 0):
    """The block of an id of the other side than the shards', 0 to ``shards`` - 1; another ``deal`` gives other blocks."""
    return F.pmod(F.xxhash64(F.col(column).cast("long"), F.lit(deal)), F.lit(shards)).cast("int")


def cells(samples: DataFrame, shards: int, left: str, right: str, deal: int = 0) -> DataFrame:
    """``samples`` with the shard of ``left`` and the turn in which that shard meets the block of ``right``, stowed by turn."""
    if shards == 1:
        return samples.withColumns({"_shard": F.lit(0), "_turn": F.lit(0)})
    placed = samples.withColumn("_shard", F.pmod(F.xxhash64(left), F.lit(shards)).cast("int"))
    return stow(placed.withColumn("_turn", F.pmod(block(right, shards, deal) - F.col("_shard"), F.lit(shards))).sortWithinPartitions("_turn"))


def cell_epoch(dealt: DataFrame, shards: int, order: list[str], params: dict[str, np.ndarray], train) -> dict:
    """One epoch over :func:`cells`: in each turn every shard has another block, so no two of them share a row of either side, and
    the next turn starts from all changed rows.  The result is that of one pass over all samples in the order of the turns; with one
    shard it is the exact sequential pass.  ``train(columns, params, shard, turn)``: see :func:`epoch`.
    """
    size = sum(p.nbytes for p in params.values())
    if size > RETURN_BYTES:
        raise MemoryError(f"{size} bytes of parameters exceed {RETURN_BYTES} bytes")
    names = [c for c in dealt.columns if c not in ("_shard", "_turn")]
    out, loss, n = {k: p.copy() for k, p in params.items()}, 0.0, 0
    for turn in range(shards):
        rows = dealt.filter(F.col("_turn") == turn) if shards > 1 else dealt
        for r in _trained(rows, names, order, out, lambda columns, p, shard, turn=turn: train(columns, p, shard, turn)):
            for k, (at, new) in pickle.loads(r["payload"]).items():
                out[k][at] = new
            loss, n = loss + r["loss"], n + r["n"]
    return {"params": out, "loss": loss, "n": n}
