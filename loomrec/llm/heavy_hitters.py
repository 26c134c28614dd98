"""Most frequent values of a long column: three-phase threshold top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import stow

#: Distinct values a node may hold; a scan task that meets more ends its node and begins another.
NODE_VALUES = 1 << 20


def local_counts(batches, leaders: int, node_values: int):
    """Arrow kernel of phase one: the counts of one node after another, its ``leaders`` first values marked."""
    from pyspark import TaskContext

    task, nodes = TaskContext.get().partitionId(), 0
    held, seen, pending = None, 0, []

    def merged():
        table = pa.Table.from_batches(pending) if held is None else pa.concat_tables([held, pa.Table.from_batches(pending)])
        out = table.group_by("value", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"value": out["value"], "n": out["n_sum"]})

    def close():
        n = held["n"].to_numpy()
        mark = np.zeros(len(n), bool)
        if leaders:
            mark[np.argpartition(-n, min(leaders, len(n)) - 1)[:leaders]] = True
        size = len(n)
        node = (task << 24) + nodes
        return pa.table(
            {"node": pa.array(np.full(size, node, np.int64)), "node_rows": pa.array(np.full(size, seen, np.int64)),
             "value": held["value"], "n": held["n"], "leader": pa.array(mark)}
        ).combine_chunks().to_batches()

    waiting = 0
    for batch in batches:
        column = batch.column(0)
        seen += len(column)
        counts = pc.value_counts(column.drop_null())
        pending.append(pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["value", "n"]))
        waiting += len(counts)
        if waiting > max(65_536, len(held) if held is not None else 0):
            held, pending, waiting = merged(), [], 0
            if len(held) > node_values:
                yield from close()
                held, seen, nodes = None, 0, nodes + 1
    if pending:
        held = merged()
    if held is not None and len(held):
        yield from close()
    elif seen:  # only nulls: the node still counts with its rows
        held = pa.table({"value": pa.nulls(1, pending[0].schema.field("value").type), "n": pa.array([0], pa.int64())})
        leaders = 0
        yield from close()


def frequent_values(
    rows: DataFrame, column: str, *, k: int | None = None, min_share: float | None = None, node_values: int = NODE_VALUES
) -> DataFrame:
    """The most frequent values of ``column`` as ``value, n`` with exact row counts.

    Either the ``k`` first values by count (the smaller value wins ties) or all values in at least ``min_share`` of all rows.
    Nulls are no value but their rows count towards the share; repeated rows count each time.  An empty table gives no rows.

    1. Every node (a scan task, or a bounded part of one) holds its local counts, which are written once to the shared
       folder, and marks its leaders.  Leaders summed over nodes give a lower bound of the k-th count.  At most
       ``1 / min_share`` values can have that share: with so many leaders, the share of all rows and the lower bound both hold.
    2. A value above the bound has, in some node, more than the node's share of it (bound x rows of the node / all rows).  Only
       those are fetched; the bound is raised by what they sum up to, and values that can't reach it are left out.
    3. The remaining candidates, at most ``1 / share`` per node, are resolved exactly from the local counts.

    Memory of a node is bounded by ``node_values``.
    """
    if (k is None) == (min_share is None):
        raise ValueError("give either k or min_share")
    kind = rows.schema[column].dataType.simpleString()
    leaders = k if k is not None else max(1, int(1 / min_share + 1e-9))

    def kernel(batches):
        return local_counts(batches, leaders, node_values)

    schema = f"node long, node_rows long, value {kind}, n long, leader boolean"
    local = stow(rows.select(F.col(column).alias("value")).mapInArrow(kernel, schema))
    nodes = local.groupBy("node").agg(F.first("node_rows").alias("n"))  # the same in all rows of a node
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    local = local.filter(F.col("value").isNotNull())
    least = min_share * total if k is None else 1
    led = local.filter("leader").groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(leaders)
    firsts = [r["n"] for r in led.select("n").collect()]
    bound = max(least, firsts[-1]) if len(firsts) == leaders else least
    share = F.lit(float(bound)) / F.lit(float(max(total, 1)))
    fetched = stow(
        local.filter(F.col("n") >= F.col("node_rows") * share - 1e-9)
        .groupBy("value")
        .agg(F.sum("n").alias("partial"), F.sum("node_rows").alias("covered"))
    )
    best = [r["partial"] for r in fetched.select("partial").orderBy(F.desc("partial")).limit(leaders).collect()]
    raised = max(bound, best[-1]) if len(best) == leaders else bound
    most = F.col("partial") + share * (F.lit(total) - F.col("covered"))
    fetched = fetched.filter(most >= F.lit(float(raised)) - 1e-6)
    exact = local.join(fetched.select("value"), "value", "left_semi").groupBy("value").agg(F.sum("n").alias("n"))
    if k is not None:
        return exact.orderBy(F.desc("n"), "value").limit(k)
    return exact.filter(F.col("n") >= F.lit(float(least)))
