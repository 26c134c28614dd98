"""Per-key results when a few keys hold most rows: eager aggregation through joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import stow


def key_states(rows: DataFrame, keys: list[str], value: str | None = None, *, prefix: str = "") -> DataFrame:
    """Compact mergeable state of each key: ``n`` rows, ``n_value`` and ``sum`` of the finite values.

    Spark combines it before the shuffle, so a key with a third of all rows sends one row per task.  A null key is a group of
    its own; a null, NaN or infinite value counts as a row but not as a value.
    """
    aggs = [F.count("*").alias(f"{prefix}n")]
    if value is not None:
        v = F.col(value).cast("double")
        finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        aggs += [F.count(finite).alias(f"{prefix}n_value"), F.sum(finite).alias(f"{prefix}sum")]
    return rows.groupBy(*keys).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    left_value: str | None = None,
    right_value: str | None = None,
    left_group: tuple[str, ...] = (),
    right_group: tuple[str, ...] = (),
    how: str = "inner",
) -> DataFrame:
    """Aggregate ``left JOIN right ON key`` per key (and per group columns of either side) without ever building the join.

    Both inputs are first aggregated by the join key and their own group columns; the compact states are joined; counts multiply
    and sums combine: ``n_pairs = n_l * n_r``, ``sum_left = sum_l * n_r``, ``sum_right = n_l * sum_r`` and ``sum_product =
    sum_l * sum_r``.  A key with a million rows on either side costs one row, not 10^12.  The result equals aggregating the
    joined rows, except that null, NaN and infinite values are left out of the sums.

    ``how`` is ``inner`` or ``left`` (keys without partner keep ``n_r = 0``).  Null keys never join; with ``left`` they stay as
    rows of their own.  Rows come out as ``<on>, <left_group>, <right_group>, n_l, n_r, n_pairs[, sum_left][, sum_right][,
    sum_product]``; other columns, also ones of the same name on both sides, are ignored.  Group columns of the two sides
    must differ in name.  Empty tables give no rows.  Roll up further with :func:`roll_up`.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if set(left_group) & set(right_group):
        raise ValueError("group columns of the two sides must have different names")
    a = key_states(left, [on, *left_group], left_value, prefix="_l_")
    b = key_states(right, [on, *right_group], right_value, prefix="_r_")
    joined = a.join(b, on, how)
    n_l, n_r = F.col("_l_n"), F.coalesce(F.col("_r_n"), F.lit(0))
    out = [F.col(on), *map(F.col, left_group), *map(F.col, right_group), n_l.alias("n_l"), n_r.alias("n_r"), (n_l * n_r).alias("n_pairs")]
    sum_l, sum_r = F.coalesce("_l_sum", F.lit(0.0)), F.coalesce("_r_sum", F.lit(0.0))
    if left_value is not None:
        out.append((sum_l * n_r).alias("sum_left"))
    if right_value is not None:
        out.append((n_l * sum_r).alias("sum_right"))
    if left_value is not None and right_value is not None:
        out.append((sum_l * sum_r).alias("sum_product"))
    return joined.select(*out)


def roll_up(states: DataFrame, by: list[str]) -> DataFrame:
    """Combine the additive columns of :func:`eager_join_aggregate` per ``by``."""
    added = [c for c in states.columns if c in ("n_pairs", "sum_left", "sum_right", "sum_product")]
    return states.groupBy(*by).agg(*(F.sum(c).alias(c) for c in added))


def per_key_results(
    rows: DataFrame, keys: list[str], value: str, partners: dict[str, DataFrame], partner_value: str
) -> DataFrame:
    """Complete results for every value of each key column, joined with another table on that key.

    For each of ``keys`` the states of ``rows`` are joined with those of ``partners[key]``: ``key_field, key_id, n_rows,
    n_value, sum_value, n_partner, n_pairs, sum_product``.  Keys without a partner keep zeros; the null key is kept, with
    no partner.  ``sum_product`` sums value times partner value over all joined pairs.
    """
    parts = []
    for key in keys:
        a = key_states(rows, [key], value, prefix="_l_")
        b = key_states(partners[key], [key], partner_value, prefix="_r_")
        n_r = F.coalesce("_r_n", F.lit(0))
        sum_l = F.coalesce("_l_sum", F.lit(0.0))
        parts.append(
            a.join(b, key, "left").select(
                F.lit(key).alias("key_field"),
                F.col(key).cast("long").alias("key_id"),
                F.col("_l_n").alias("n_rows"),
                F.col("_l_n_value").alias("n_value"),
                sum_l.alias("sum_value"),
                n_r.alias("n_partner"),
                (F.col("_l_n") * n_r).alias("n_pairs"),
                (sum_l * F.coalesce("_r_sum", F.lit(0.0))).alias("sum_product"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def universe_results(rows: DataFrame, universes: dict[str, DataFrame]) -> DataFrame:
    """Complete results for every value of each key column, through the joined states of ``rows`` and the key's universe.

    ``universes[key]`` lists the valid keys.  ``key_field, key_id, n_rows, n_valid``: the rows of the key, and those of them
    that join a universe row, ``n_l * n_r`` over distinct universe keys; a null or unknown key keeps its rows with ``n_valid`` 0.
    """
    parts = []
    for key, universe in universes.items():
        joined = eager_join_aggregate(rows, universe.select(key).distinct(), key, how="left")
        parts.append(joined.select(F.lit(key).alias("key_field"), F.col(key).cast("long").alias("key_id"), F.col("n_l").alias("n_rows"), F.col("n_pairs").alias("n_valid")))
    return reduce(DataFrame.unionByName, parts)


def hot_keys(results: DataFrame, min_share: float, counted: str = "n_rows") -> DataFrame:
    """Keys of :func:`per_key_results` or :func:`universe_results` whose ``counted`` column is at least ``min_share`` of all rows.

    The number of all rows is the sum over one key field's states, the null key included, so the input isn't read again.
    """
    kept = stow(results.select("key_field", "key_id", "n_rows", F.col(counted).alias("counted")))
    total = kept.groupBy("key_field").agg(F.sum("n_rows").alias("all_rows"))  # one row a key field
    return (
        kept.join(F.broadcast(total), "key_field")
        .filter(F.col("key_id").isNotNull() & (F.col("counted") >= F.lit(min_share) * F.col("all_rows")))
        .select("key_field", "key_id", "n_rows")
    )
