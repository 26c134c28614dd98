"""Readers of other common forms of interaction data, and generators of sample matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.sources.triplets import Interactions


def read_ratings_text(spark: SparkSession, path: str, separator: str = "::") -> DataFrame:
    """``user, item, rating, timestamp`` lines with ``separator`` (``::`` or a tab): ``user_id, item_id, value, rated_at``.

    Lines with fewer than three parts or parts that aren't numbers are dropped.
    """
    parts = F.split("value", f"\\Q{separator}\\E")
    n = lambda k, kind: F.try_element_at(parts, F.lit(k)).try_cast(kind)
    rows = spark.read.text(path).select(
        n(1, "long").alias("user_id"), n(2, "long").alias("item_id"), n(3, "double").alias("value"),
        F.timestamp_seconds(n(4, "long")).alias("rated_at"),
    )
    return rows.dropna(subset=["user_id", "item_id", "value"])


def read_triplets_csv(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, val`` with a header line, as ``user_id, item_id, value``."""
    rows = spark.read.csv(path, header=True, schema="row long, col long, val double")
    return rows.select(F.col("row").alias("user_id"), F.col("col").alias("item_id"), F.col("val").alias("value"))


def read_dims_csv(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and columns of a matrix from a one-line table ``nr, nc``."""
    r = spark.read.csv(path, header=True, schema="nr long, nc long").first()
    return int(r["nr"]), int(r["nc"])


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """A dense matrix without header as ``row, col, val``, rows and columns from 1."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_k"), F.split("value", ",").alias("cells"))
    cells = lines.select("_k", F.posexplode("cells").alias("c", "cell"))
    # Files of matrices are small; the order of lines is that of the ids, which rise but have gaps.
    order = lines.select("_k").orderBy("_k").collect()
    rows = spark.createDataFrame([(r["_k"], n + 1) for n, r in enumerate(order)], "_k long, row long")
    return cells.join(F.broadcast(rows), "_k").select(
        "row", (F.col("c") + 1).cast("long").alias("col"), F.trim("cell").try_cast("double").alias("val")
    )


def read_metrics_json(spark: SparkSession, path: str) -> dict[str, float]:
    """A flat JSON object of numbers."""
    r = spark.read.json(path, multiLine=True).first()
    return {k: float(v) for k, v in r.asDict().items() if isinstance(v, int | float)}


def sample_matrix(spark: SparkSession, n_users: int, n_items: int, density: float, seed: int = 1) -> Interactions:
    """A random matrix: each cell of ``n_users x n_items`` is stored with the given probability, values 1 to 5.

    Per user the number of entries is drawn around ``n_items * density`` and so many item ids are drawn by hash; every draw depends
    on the ids and the seed alone, never on partitions.
    """
    users = spark.range(1, n_users + 1).withColumnRenamed("id", "user_id")
    items = spark.range(1, n_items + 1).withColumnRenamed("id", "item_id")
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    many = F.greatest(F.lit(1), F.floor(F.lit(2.0 * n_items * density) * draw("user_id") + 0.5)).cast("int")
    cells = users.select("user_id", F.explode(F.sequence(F.lit(1), many)).alias("k"))
    x = cells.select("user_id", (F.floor(draw("user_id", "k", F.lit(1)) * n_items) + 1).cast("long").alias("item_id"), (F.floor(draw("user_id", "k", F.lit(2)) * 5) + 1).cast("double").alias("value"))
    return Interactions(x.dropDuplicates(["user_id", "item_id"]), users, items)


def sample_cooccurrence(spark: SparkSession, n: int, density: float, seed: int = 1) -> DataFrame:
    """A symmetric positive co-occurrence table ``word, context, count`` without diagonal."""
    x = sample_matrix(spark, n, n, density / 2, seed).x.filter("user_id <> item_id")
    half = x.select(F.least("user_id", "item_id").alias("word"), F.greatest("user_id", "item_id").alias("context"), F.col("value").alias("count"))
    half = half.groupBy("word", "context").agg(F.sum("count").alias("count"))
    return half.union(half.select(F.col("context"), F.col("word"), "count"))
