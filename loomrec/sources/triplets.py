"""Ingest of (user, item, value) tables, universes and the checks every model shares."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrec.functions import is_finite
from loomrec.scratch import stow

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Interactions:
    """A sparse user-item matrix in long form.

    ``x``: ``user_id, item_id, value``, one row per stored entry (explicit zeros are entries).  ``users`` and ``items`` are the
    universes; ids that never occur in ``x`` are part of the matrix.
    """

    x: DataFrame
    users: DataFrame
    items: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.x.sparkSession

    def settled(self) -> Interactions:
        """The same matrix with ``x`` written once, for algorithms that read it several times."""
        return self if hasattr(self.x, "_stowed_at") else replace(self, x=stow(self.x))

    def transposed(self) -> Interactions:
        """Users and items exchanged."""
        return Interactions(
            self.x.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "value"),
            self.items.select(F.col("item_id").alias("user_id")),
            self.users.select(F.col("user_id").alias("item_id")),
        )


def _id_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"column {name!r} is missing")
    if not isinstance(df.schema[name].dataType, _NUMBERS):
        raise ValueError(f"ids in {name!r} must be integers")


def ingest_triplets(
    table: DataFrame,
    user_col: str = "user",
    item_col: str = "item",
    value_col: str | None = "value",
    *,
    n_users: int | None = None,
    n_items: int | None = None,
    index_base: int = 1,
) -> Interactions:
    """A validated matrix from any table of ids and numbers; values of a repeated (user, item) are summed.

    Without ``value_col`` every row counts 1.0.  Universes are ``index_base .. n`` with n the given size or the largest id.
    Raises ``ValueError`` on missing columns, non-integer or null ids, ids outside the bounds, null or non-numeric values and an
    empty table.  All of that is checked in one pass before anything is built.  Other columns are ignored.
    """
    _id_column(table, user_col)
    _id_column(table, item_col)
    if value_col is not None:
        if value_col not in table.columns:
            raise ValueError(f"column {value_col!r} is missing")
        if not isinstance(table.schema[value_col].dataType, _NUMBERS):
            raise ValueError(f"values in {value_col!r} must be numbers")
    u, i = F.col(user_col), F.col(item_col)
    v = F.lit(1.0) if value_col is None else F.col(value_col).cast("double")

    def flawed(c):
        return F.max(F.when(c.isNull() | (c.cast("double") != F.floor(c.cast("double"))), 1).otherwise(0))

    seen = table.agg(
        F.count("*").alias("rows"), flawed(u).alias("bad_u"), flawed(i).alias("bad_i"), F.max(v.isNull().cast("int")).alias("bad_v"),
        F.min(u).alias("lo_u"), F.max(u).alias("hi_u"), F.min(i).alias("lo_i"), F.max(i).alias("hi_i"),
    ).first()
    if not seen["rows"]:
        raise ValueError("the table is empty")
    if seen["bad_u"] or seen["bad_i"]:
        raise ValueError("ids must be integers and not null")
    if seen["bad_v"]:
        raise ValueError("values must not be null")
    top_u = int(seen["hi_u"]) if n_users is None else index_base + n_users - 1
    top_i = int(seen["hi_i"]) if n_items is None else index_base + n_items - 1
    if seen["lo_u"] < index_base or seen["lo_i"] < index_base or seen["hi_u"] > top_u or seen["hi_i"] > top_i:
        raise ValueError("ids are out of bounds")
    x = table.select(u.cast("long").alias("user_id"), i.cast("long").alias("item_id"), v.alias("value"))
    spark = table.sparkSession
    return Interactions(
        x.groupBy("user_id", "item_id").agg(F.sum("value").alias("value")),
        spark.range(index_base, top_u + 1).withColumnRenamed("id", "user_id"),
        spark.range(index_base, top_i + 1).withColumnRenamed("id", "item_id"),
    )


def to_triplets(matrix: Interactions) -> DataFrame:
    """Stored entries by item, then user."""
    return matrix.x.select("user_id", "item_id", "value").orderBy("item_id", "user_id")


def clean_ratings(rows: DataFrame, *, same: tuple[str, ...] = ("rated_at",)) -> DataFrame:
    """``user_id, item_id, value`` of a raw ratings table: rows without both ids or a finite value are dropped, rows sent again
    (equal in ids, value and ``same``) count once, and what is then repeated per (user, item) is summed."""
    kept = rows.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & is_finite(F.col("value")))
    kept = kept.select("user_id", "item_id", "value", *same).distinct()
    return kept.groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))


def from_ratings(rows: DataFrame, users: DataFrame, items: DataFrame, *, same: tuple[str, ...] = ("rated_at",)) -> Interactions:
    """The cleaned matrix of a raw ratings table over given universes."""
    return Interactions(clean_ratings(rows, same=same), users.select("user_id"), items.select("item_id"))


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """``rows`` with ``name`` = 0.. in the given order, without a single-task sort: range partitions are numbered and offset.

    Rows equal under the whole order are numbered in no particular one."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stow(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    starts = placed.groupBy("_p").agg(F.min("_k").alias("_first"), F.count("*").alias("_n")).orderBy("_p").collect()
    offsets, total = [], 0
    for r in starts:
        offsets.append((r["_p"], r["_first"], total))
        total += r["_n"]
    table = rows.sparkSession.createDataFrame(offsets, "_p int, _first long, _start long")
    at = (F.col("_k") - F.col("_first") + F.col("_start")).alias(name)
    return placed.join(F.broadcast(table), "_p").select(*rows.columns, at)  # a row a partition


def index_ids(ids: DataFrame, column: str) -> DataFrame:
    """``column, idx`` with idx = 0.. in order of the id."""
    return numbered(ids.select(column).distinct(), "idx", column)


def require_finite(matrix: Interactions, model: str) -> None:
    """Every value must be finite; the message names the model."""
    if matrix.x.filter(~is_finite(F.col("value"))).limit(1).count():
        raise ValueError(f"{model}: values must be finite")


def require_dimensions(matrix: Interactions, model: str) -> None:
    if not matrix.users.limit(1).count() or not matrix.items.limit(1).count():
        raise ValueError(f"{model}: the matrix needs at least one user and one item")


def require_minimum(matrix: Interactions, model: str, least: float, strict: bool = False) -> None:
    low = matrix.x.agg(F.min("value")).first()[0]
    if low is not None and (low <= least if strict else low < least):
        raise ValueError(f"{model}: values must be {'above' if strict else 'at least'} {least}")


def require_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def require_memory(n_items: int, matrices: int, limit: int, model: str) -> None:
    """Dense item-item algebra needs ``matrices`` of ``n_items`` squared doubles on the driver; fails before allocating them."""
    need = n_items * n_items * matrices * 8
    if need > limit:
        raise MemoryError(f"{model}: {need} bytes needed for {n_items} items, the limit is {limit}")
