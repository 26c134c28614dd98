"""Queries on ingest, structure of the matrix, scalar functions and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomrec.catalog.data import HELD, X, factor_sql, factors, heldout, matrix
from loomrec.functions import link, log1pexp, safe_inverse, sigmoid, soft_threshold
from loomrec.operators import matrix as ops
from loomrec.operators import sampling
from loomrec.operators.splits import random_holdout, temporal_split
from loomrec.scratch import shared_dir
from loomrec.sources.tables import table
from loomrec.sources.triplets import index_ids, ingest_triplets, to_triplets
from loomrec.streaming.updates import running_sums

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {X} SELECT * FROM x")
def ingest_ratings(spark, sf):
    return to_triplets(matrix(spark, sf))


@query("SELECT user_id, item_id, sum(value) AS value FROM heldout WHERE value IS NOT NULL GROUP BY 1, 2")
def ingest_duplicates_sum(spark, sf):
    rows = table(spark, sf, "heldout").filter("value IS NOT NULL")
    return ingest_triplets(rows, "user_id", "item_id", "value").x


@query("SELECT user_id, item_id, count(*)::DOUBLE AS value FROM triplets WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2")
def ingest_unit_values(spark, sf):
    rows = table(spark, sf, "triplets").filter("user_id IS NOT NULL AND item_id IS NOT NULL")
    return ingest_triplets(rows, "user_id", "item_id", None).x


@query(f"WITH {X} SELECT item_id AS user_id, user_id AS item_id, value FROM x")
def transposed(spark, sf):
    return matrix(spark, sf).transposed().x


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM items")
def dense_index(spark, sf):
    return index_ids(table(spark, sf, "items"), "item_id")


@query(f"WITH {X} SELECT u.user_id, count(x.item_id) AS nnz FROM users u LEFT JOIN x USING (user_id) GROUP BY 1")
def row_nnz(spark, sf):
    return ops.row_nnz(matrix(spark, sf))


@query(f"WITH {X} SELECT i.item_id, count(x.user_id) AS nnz FROM items i LEFT JOIN x USING (item_id) GROUP BY 1")
def col_nnz(spark, sf):
    return ops.col_nnz(matrix(spark, sf))


def _norm(p):
    agg = f"round(coalesce(pow(sum(pow(abs(x.value), {p})), {1 / p}), 0), 6)"
    sql = f"WITH {X} SELECT u.user_id, {agg} AS norm FROM users u LEFT JOIN x USING (user_id) GROUP BY 1"

    def run(spark, sf):
        return ops.row_norms(matrix(spark, sf), p).withColumn("norm", F.round("norm", 6))

    run.__name__ = f"row_norm_l{p}"
    query(sql)(run)


for _p in (1, 2, 3):
    _norm(_p)


@query(f"""WITH {X} SELECT 'user' AS side, user_id AS id, sum(value) AS degree FROM x GROUP BY 2
    UNION ALL SELECT 'item', item_id, sum(value) FROM x GROUP BY 2""")
def weighted_degrees(spark, sf):
    return ops.weighted_degrees(matrix(spark, sf))


@query(f"WITH {X} SELECT round(avg(value), 9) AS mean FROM x")
def global_mean(spark, sf):
    return spark.createDataFrame([(round(ops.global_mean(matrix(spark, sf)), 9),)], "mean double")


@query(f"""WITH {X} SELECT a.item_id AS src, b.item_id AS dst, round(sum(a.value * b.value), 6) AS dot, count(*) AS n
    FROM x a JOIN x b USING (user_id) GROUP BY 1, 2""")
def gram_items(spark, sf):
    return ops.gram(matrix(spark, sf)).withColumn("dot", F.round("dot", 6))


@query(f"""WITH {X} SELECT a.item_id AS src, b.item_id AS dst, count(*)::DOUBLE AS dot, count(*) AS n
    FROM x a JOIN x b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2""")
def gram_binary(spark, sf):
    return ops.gram(matrix(spark, sf), binary=True, diagonal=False)


@query(f"""WITH {HELD} SELECT a.user_id AS src, b.user_id AS dst, round(sum(a.value * b.value), 6) AS dot, count(*) AS n
    FROM held a JOIN held b USING (item_id) GROUP BY 1, 2""")
def gram_users(spark, sf):
    m = matrix(spark, sf)
    held = type(m)(heldout(spark, sf), m.users, m.items)
    return ops.gram(held, side="user").withColumn("dot", F.round("dot", 6))


@query(f"""WITH {factor_sql('item', 'g')}, e AS (SELECT id, unnest(v) AS x, unnest(range(32)) AS f FROM g)
    SELECT a.f AS row, b.f AS col, round(sum(a.x * b.x), 5) AS value FROM e a JOIN e b USING (id) GROUP BY 1, 2""")
def factor_gram(spark, sf):
    g = ops.factor_gram(factors(spark, sf, "item"))
    rows = [(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))]
    return spark.createDataFrame(rows, "row long, col long, value double").withColumn("value", F.round("value", 5))


@query(f"""WITH {X}, {factor_sql('user', 'a')}, {factor_sql('item', 'b')}
    SELECT user_id, item_id, round(list_inner_product(a.v, b.v), 6) AS approx FROM x JOIN a ON a.id = user_id JOIN b ON b.id = item_id""")
def sampled_product(spark, sf):
    got = ops.sampled_product(matrix(spark, sf).x, factors(spark, sf, "user"), factors(spark, sf, "item"))
    return got.withColumn("approx", F.round("approx", 6))


@query(f"""WITH {X} SELECT user_id, item_id, round(1 / (1 + exp(-value)), 9) AS sigmoid, round(CASE WHEN value > 33.3 THEN value ELSE ln(1 + exp(least(value, 33.3))) END, 9) AS log1pexp,
    round(1 / (abs(value) + 1 + 1e-12), 9) AS inverse, round(sign(value) * greatest(abs(value) - 1.5, 0), 9) AS soft,
    round(value, 9) AS identity, round(exp(value / 100), 9) AS poisson FROM x""")
def scalar_functions(spark, sf):
    v = F.col("value")
    columns = {
        "sigmoid": sigmoid(v), "log1pexp": log1pexp(v), "inverse": safe_inverse(F.abs(v) + 1), "soft": soft_threshold(v, 1.5),
        "identity": link(v, "gaussian"), "poisson": link(v / 100, "poisson"),
    }
    return matrix(spark, sf).x.select("user_id", "item_id", *(F.round(c, 9).alias(n) for n, c in columns.items()))


_DRAW = "((user_id % 1000003) * 48271 + (item_id % 1000003) * 69621 + 3 * 9973) % 1000003"
_SPLIT = f"""WITH {X}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_DRAW}, item_id) AS p,
    count(*) OVER (PARTITION BY user_id) AS n FROM x),
    t AS (SELECT *, p <= CASE WHEN n = 1 THEN 0 ELSE greatest(1, round_even(n * 0.2, 0)) END AS test FROM s)"""


@query(f"{_SPLIT} SELECT user_id, item_id, value FROM t WHERE NOT test")
def split_hash_train(spark, sf):
    return random_holdout(matrix(spark, sf).x, 0.2, 3)[0]


@query(f"{_SPLIT} SELECT user_id, item_id, value FROM t WHERE test")
def split_hash_test(spark, sf):
    return random_holdout(matrix(spark, sf).x, 0.2, 3)[1]


_TIMED = """WITH x AS (SELECT user_id, item_id, max(rated_at) AS rated_at FROM triplets
    WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rated_at NULLS FIRST, item_id) AS p,
    count(*) OVER (PARTITION BY user_id) AS n FROM x)"""


def _timed(spark, sf):
    rows = table(spark, sf, "triplets").filter("user_id IS NOT NULL AND item_id IS NOT NULL")
    return temporal_split(rows.groupBy("user_id", "item_id").agg(F.max("rated_at").alias("rated_at")))


@query(f"{_TIMED} SELECT user_id, item_id FROM s WHERE p <= round_even(n * 0.8, 0)")
def split_temporal_train(spark, sf):
    return _timed(spark, sf)[0].select("user_id", "item_id")


@query(f"{_TIMED} SELECT user_id, item_id FROM s WHERE p > round_even(n * 0.8, 0)")
def split_temporal_test(spark, sf):
    return _timed(spark, sf)[1].select("user_id", "item_id")


_LOW = f"""WITH {X}, w AS (SELECT item_id, count(*)::DOUBLE AS w FROM x GROUP BY 1),
    c AS (SELECT item_id, sum(w) OVER (ORDER BY item_id) - w AS low, sum(w) OVER (ORDER BY item_id) AS high FROM w)"""


def _degrees(spark, sf):
    return matrix(spark, sf).x.groupBy("item_id").agg(F.count("*").alias("w"))


@query(f"{_LOW} SELECT item_id, low, high FROM c")
def cumulative_weights(spark, sf):
    return sampling.cumulative_weights(_degrees(spark, sf), "item_id", "w")


@query(f"""{_LOW}, d AS (SELECT k AS draw, ((k % 1000003 * 48271 + 5 * 9973) % 1000003) / 1000003.0::DOUBLE * (SELECT max(high) FROM c) AS pos FROM range(20000) t(k))
    SELECT draw, item_id FROM d JOIN c ON pos >= low AND pos < high""")
def draw_by_degree(spark, sf):
    return sampling.draw_weighted(_degrees(spark, sf), "item_id", "w", 20_000, 5)


@query(f"WITH {X}, {HELD} SELECT h.user_id, h.item_id, x.value IS NOT NULL AS stored FROM held h LEFT JOIN x ON x.user_id = h.user_id AND x.item_id = h.item_id")
def membership(spark, sf):
    return sampling.membership(heldout(spark, sf), matrix(spark, sf).x)


@query(f"WITH {X} SELECT user_id, item_id, value FROM x")
def shuffled(spark, sf):
    return sampling.shuffled(matrix(spark, sf).x, ["user_id", "item_id"], 1)


@query("""SELECT CAST(date_trunc('day', rated_at) AS DATE) AS day, user_id, item_id, sum(value) AS value FROM (
    SELECT DISTINCT user_id, item_id, value, rated_at FROM triplets
    WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND rated_at IS NOT NULL AND isfinite(value)) GROUP BY 1, 2, 3""")
def stream_running_sums(spark, sf):
    path = f"{shared_dir(spark)}/sums-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "triplets").schema).parquet(f"{sf}/triplets.parque[t]")  # a pattern, as a stream takes no single file
    sums = running_sums(stream, "rated_at", late="3650 days")
    sums = sums.select(F.to_date("window.start").alias("day"), "user_id", "item_id", "value")
    writer = sums.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")
