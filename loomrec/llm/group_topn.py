"""Top N items within every group by a mergeable, bounded aggregation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of bounded state a worker keeps before it hands them on and starts afresh.
STATE_ROWS = 1 << 20


def keep_best(table: pa.Table, n: int) -> pa.Table:
    """The ``n`` best rows of each group: score descending, then item ascending.  Columns: group, item, score."""
    order = pc.sort_indices(table, sort_keys=[("group", "ascending"), ("score", "descending"), ("item", "ascending")])
    table = table.take(order)
    group = table["group"].combine_chunks()
    size = len(group)
    if not size:
        return table
    starts = np.ones(size, bool)
    if size > 1:
        starts[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(starts)
    rank = np.arange(size) - np.repeat(first, np.diff(np.r_[first, size]))
    return table.filter(pa.array(rank < n))


def bounded_heaps(batches, n: int, state_rows: int):
    """Arrow kernel: merges batches into at most ``n`` rows a group; hands the state on whenever it holds too many groups."""
    state, waiting, held = None, [], 0

    def merged():
        parts = pa.Table.from_batches(waiting)
        return keep_best(parts if state is None else pa.concat_tables([state, parts]), n)

    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held > max(131_072, 2 * (state.num_rows if state is not None else 0)):
            state, waiting, held = merged(), [], 0
            if state.num_rows > state_rows:
                yield from state.combine_chunks().to_batches()
                state = None
    if waiting:
        state = merged()
    if state is not None:
        yield from state.combine_chunks().to_batches()


def top_n_per_group(
    rows: DataFrame, group: str, item: str, score: str, n: int, *, state_rows: int = STATE_ROWS
) -> DataFrame:
    """The ``n`` items of highest score in every group, as ``<group>, <item>, <score>, rank`` (rank from 1).

    Ties go to the smaller item.  Before the shuffle every task keeps a heap of ``n`` rows a group, so a group of millions of
    items sends at most ``n`` rows per task; the partial heaps are merged afterwards.  A group with fewer than ``n`` rows
    keeps them all.  Rows with a null group, item or score, or a NaN score, can't be ranked and are left out; repeated
    (group, item) rows are ranked separately, so sum or deduplicate them first (:func:`top_n_of_sums`).  Other columns are
    ignored; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, item, score)}
    three = rows.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).alias("score")).dropna()
    if kinds[score] in ("double", "float"):
        three = three.filter(~F.isnan("score"))

    def kernel(batches):
        return bounded_heaps(batches, n, state_rows)

    schema = f"`group` {kinds[group]}, item {kinds[item]}, score {kinds[score]}"
    partial = three.mapInArrow(kernel, schema)
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.asc("item"))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(F.col("group").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
    )


def top_n_of_sums(
    rows: DataFrame, group: str, item: str, value: str, n: int, *, same: tuple[str, ...] = ()
) -> DataFrame:
    """:func:`top_n_per_group` over the summed finite ``value`` of each (group, item).

    Rows equal in group, item, value and the columns ``same`` (null equal to null) count once if ``same`` is given; otherwise
    every row counts.  Rows with a null key or a null, NaN or infinite value don't count.  Both aggregations combine before
    their shuffle, so neither a hot group nor a hot item makes a hot task.
    """
    v = F.col(value).cast("double")
    kept = rows.filter(
        F.col(group).isNotNull() & F.col(item).isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ).select(F.col(group).alias("g"), F.col(item).alias("i"), v.alias("v"), *(F.col(c).alias(f"s{k}") for k, c in enumerate(same)))
    if same:
        kept = kept.distinct()
    sums = kept.groupBy("g", "i").agg(F.sum("v").alias("v"))
    return top_n_per_group(sums, "g", "i", "v", n).select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("v").alias("score"), "rank"
    )
