"""The interaction matrix of the test tables, for queries and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.sources.tables import table
from loomrec.sources.triplets import Interactions, from_ratings


def matrix(spark: SparkSession, sf: str) -> Interactions:
    """Cleaned ratings over the universes of users and items."""
    return from_ratings(table(spark, sf, "triplets"), table(spark, sf, "users"), table(spark, sf, "items"))


def nonnegative(spark: SparkSession, sf: str) -> Interactions:
    """The entries that are not negative, for models that allow no others."""
    m = matrix(spark, sf)
    return Interactions(m.x.filter("value >= 0"), m.users, m.items)


def heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation pairs: rows without a value are dropped, repeated rows count once."""
    rows = table(spark, sf, "heldout").select("user_id", "item_id", "value").dropna().distinct()
    return rows.groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))


def factors(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """``id, factors`` of the valid 32-entry vectors, one an id."""
    v = F.col("factors")
    good = F.col("id").isNotNull() & (F.size(v) == 32) & (F.array_max(v) < float("inf")) & (F.array_min(v) > -float("inf"))
    rows = table(spark, sf, f"{side}_factors").filter(good & ~F.exists(v, lambda e: e.isNull()))
    return rows.groupBy("id").agg(F.min("factors").alias("factors"))


def start(universe: DataFrame, column: str, modulus: int) -> DataFrame:
    """Deterministic start factors of rank 1."""
    value = F.lit(0.1) + F.lit(0.01) * (F.col(column) % modulus)
    return universe.select(F.col(column).alias("id"), F.array(value).alias("factors"))


X = """x AS (SELECT user_id, item_id, sum(value) AS value FROM (
  SELECT DISTINCT user_id, item_id, value, rated_at FROM triplets
  WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND value IS NOT NULL AND isfinite(value)) GROUP BY 1, 2)"""
XP = f"{X}, xp AS (SELECT * FROM x WHERE value >= 0)"
HELD = """held AS (SELECT user_id, item_id, sum(value) AS value FROM (
  SELECT DISTINCT user_id, item_id, value FROM heldout WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND value IS NOT NULL)
  GROUP BY 1, 2)"""


def factor_sql(side: str, name: str) -> str:
    return f"""{name} AS (SELECT id, min(factors) AS v FROM {side}_factors WHERE len(factors) = 32
  AND len(list_filter(factors, lambda e: e IS NOT NULL AND isfinite(e))) = 32 GROUP BY id)"""
