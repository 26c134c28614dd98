"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.llm.cooccurrence import cooccurring_items
from loomrec.llm.group_topn import top_n_of_sums
from loomrec.llm.heavy_hitters import frequent_values
from loomrec.llm.mixing import mix_sources, short_sources
from loomrec.llm.nn_graph import exact_neighbours, greedy_search, neighbour_graphs, recall_of, similar_pairs, valid_vectors
from loomrec.llm.packing import pack_documents, packing_report
from loomrec.llm.set_join import similar_sets
from loomrec.llm.splitting import split_oversized
from loomrec.scratch import stow
from loomrec.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "triplets")
    return cooccurring_items(rows, "user_id", "item_id", min_count=12, min_lift=20.0).select("item_a", "item_b")


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "triplets")
    pairs = cooccurring_items(rows, "user_id", "item_id", min_count=5)
    return pairs.withColumns({"lift": F.round("lift", 6), "pmi": F.round("pmi", 6)})


def p1_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurring_items(table(spark, sf, "triplets"), "user_id", "item_id")
    return pairs.withColumns({"lift": F.round("lift", 6), "pmi": F.round("pmi", 6)})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_values(table(spark, sf, "triplets"), "item_id", min_share=0.005).select(F.col("value").alias("item_id"))


def p2_top(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_values(table(spark, sf, "triplets"), "item_id", k=1_000).select(F.col("value").alias("item_id"), "n")


def _best_items(spark: SparkSession, sf: str) -> DataFrame:
    return top_n_of_sums(table(spark, sf, "triplets"), "user_id", "item_id", "value", 5, same=("rated_at",))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _best_items(spark, sf).select("user_id", "item_id")


def p3_best_items(spark: SparkSession, sf: str) -> DataFrame:
    return _best_items(spark, sf).select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


_SIDES = ("item", "user")


def _factor_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {side: valid_vectors(table(spark, sf, f"{side}_factors"), "id", "factors", 32) for side in _SIDES}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    graph = neighbour_graphs(_factor_tables(spark, sf), 10, least=0.95)
    raw = {side: table(spark, sf, f"{side}_factors") for side in _SIDES}
    return similar_pairs(raw, graph, 0.95, "id", "factors", 32).select(F.col("part").alias("side"), "id_a", "id_b")


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    graph = neighbour_graphs(_factor_tables(spark, sf), 10)
    return graph.select(F.col("part").alias("side"), "id", "neighbour", F.round("similarity", 4).alias("similarity"), "rank")


def _every_20th(key: Column) -> Column:
    return key % 20 == 0


def _reached(recall: DataFrame) -> DataFrame:
    return recall.select(F.col("part").alias("side"), "n_queries", (F.col("recall") >= 0.9).alias("reached"))


def p4_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the graph lists at least 0.9 of the 10 true neighbours of the ids divisible by 20, against all vectors."""
    tables = _factor_tables(spark, sf)
    return _reached(recall_of(neighbour_graphs(tables, 10), exact_neighbours(tables, 10, _every_20th)))


def _searched(tables: dict[str, DataFrame]) -> DataFrame:
    graph, found = stow(neighbour_graphs(tables, 10)), []
    for side, vectors in tables.items():
        asked = vectors.filter(_every_20th(F.col("id")))
        near = greedy_search(graph.filter(F.col("part") == side), vectors, asked, 11).filter("query <> id")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        near = near.select(F.lit(side).alias("part"), F.col("query"), "id", "similarity", rank.alias("rank"))
        found.append(near.filter("rank <= 10").select("part", F.col("query").alias("id"), F.col("id").alias("neighbour"), "similarity", "rank"))
    return reduce(DataFrame.union, found)


def p4_search(spark: SparkSession, sf: str) -> DataFrame:
    found = _searched(_factor_tables(spark, sf))
    return found.select(F.col("part").alias("side"), "id", "neighbour", F.round("similarity", 4).alias("similarity"), "rank")


def p4_search_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether greedy search finds at least 0.9 of the 10 true neighbours of the ids divisible by 20."""
    tables = _factor_tables(spark, sf)
    return _reached(recall_of(_searched(tables), exact_neighbours(tables, 10, _every_20th)))


def _user_sets(spark: SparkSession, sf: str):
    return similar_sets(table(spark, sf, "triplets"), "user_id", "item_id", threshold=0.7, min_size=10)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _user_sets(spark, sf).record_pairs()
    return pairs.select(F.col("a").alias("user_a"), F.col("b").alias("user_b")).distinct()


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _user_sets(spark, sf).record_pairs().withColumn("jaccard", F.round("jaccard", 6))


def p6_members(spark: SparkSession, sf: str) -> DataFrame:
    """The class of users with the very same items that each user belongs to."""
    return _user_sets(spark, sf).members.select("record", "rep", F.col("n_members").cast("long").alias("n_members"))


#: Containers of 4,096 tokens, at most 64 documents and nine tenths of the attention cost that one full document has.
_CONTAINER = {"capacity": 4_096, "max_docs": 64, "attention": 0.9 * 4_096**2}


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), "doc_id", "text", **_CONTAINER)


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing_report(p7_pack(spark, sf), **_CONTAINER)


def _mix(spark: SparkSession, sf: str):
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "source_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return short_sources(_mix(spark, sf))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).rows


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "documents"), "doc_id", "text", with_text=False)
    return pieces.filter("piece = 0").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_pairs, p1_all_pairs, p2_found, p2_top, p3_found, p3_best_items, p4_found, p4_neighbours, p4_recall, p4_search, p4_search_recall, p6_found, p6_pairs, p6_members, p7_pack, p7_report,
            p8_found, p8_report, p8_mix, p9_found, p9_pieces,
        )
    }


_PAIR_COUNTS = """
WITH d AS (SELECT DISTINCT user_id, item_id FROM triplets WHERE user_id IS NOT NULL AND item_id IS NOT NULL),
 i AS (SELECT item_id, count(*) AS n FROM d GROUP BY 1),
 u AS (SELECT count(DISTINCT user_id) AS n FROM d),
 p AS (SELECT x.item_id AS item_a, y.item_id AS item_b, count(*) AS n_ab FROM d x JOIN d y
       ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2),
 l AS (SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b,
       n_ab::DOUBLE * u.n::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE) AS lift
       FROM p JOIN i a ON a.item_id = item_a JOIN i b ON b.item_id = item_b, u)
"""

_SUMS = """
WITH k AS (SELECT DISTINCT user_id, item_id, value, rated_at FROM triplets
           WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND value IS NOT NULL AND isfinite(value)),
 s AS (SELECT user_id, item_id, sum(value) AS score FROM k GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s)
"""

_NEAR = """
SELECT '{side}' AS side, id_a, id_b FROM (
WITH g AS (SELECT id, min(factors) AS v FROM {side}_factors WHERE len(factors) = 32
           AND len(list_filter(factors, lambda e: e IS NOT NULL AND isfinite(e))) = 32
           AND len(list_filter(factors, lambda e: e <> 0)) > 0 GROUP BY id),
 s AS (SELECT x.id AS p, y.id AS q, list_cosine_similarity(x.v, y.v) AS s FROM g x, g y WHERE x.id <> y.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, q) AS k FROM s)
SELECT DISTINCT least(p, q) AS id_a, greatest(p, q) AS id_b FROM r WHERE k <= 10 AND s >= 0.95)
"""

_GOOD = """SELECT '{side}' AS side, count(DISTINCT id) AS n_queries, true AS reached FROM {side}_factors
WHERE id % 20 = 0 AND len(factors) = 32 AND len(list_filter(factors, lambda e: e IS NOT NULL AND isfinite(e))) = 32
AND len(list_filter(factors, lambda e: e <> 0)) > 0"""

_SETS = """
WITH d AS (SELECT DISTINCT user_id, item_id FROM triplets WHERE user_id IS NOT NULL AND item_id IS NOT NULL),
 n AS (SELECT user_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 10),
 o AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS o FROM d x JOIN d y ON x.item_id = y.item_id AND x.user_id < y.user_id
       WHERE x.user_id IN (SELECT user_id FROM n) AND y.user_id IN (SELECT user_id FROM n) GROUP BY 1, 2),
 j AS (SELECT a, b, o::DOUBLE / (p.n + q.n - o) AS jaccard FROM o JOIN n p ON p.user_id = a JOIN n q ON q.user_id = b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_PAIR_COUNTS} SELECT item_a, item_b FROM l WHERE n_ab >= 12 AND lift >= 20",
        "p1_pairs": f"""{_PAIR_COUNTS} SELECT item_a, item_b, n_ab, n_a, n_b, round(lift, 6) AS lift, round(ln(lift), 6) AS pmi
            FROM l WHERE n_ab >= 5""",
        "p1_all_pairs": f"{_PAIR_COUNTS} SELECT item_a, item_b, n_ab, n_a, n_b, round(lift, 6) AS lift, round(ln(lift), 6) AS pmi FROM l",
        "p2_found": """SELECT item_id FROM triplets WHERE item_id IS NOT NULL GROUP BY item_id
            HAVING count(*) >= 0.005 * (SELECT count(*) FROM triplets)""",
        "p2_top": """SELECT item_id, count(*) AS n FROM triplets WHERE item_id IS NOT NULL GROUP BY item_id
            ORDER BY n DESC, item_id LIMIT 1000""",
        "p3_found": f"{_SUMS} SELECT user_id, item_id FROM r WHERE rank <= 5",
        "p3_best_items": f"{_SUMS} SELECT user_id, item_id, score, rank FROM r WHERE rank <= 5",
        "p4_found": " UNION ALL ".join(_NEAR.format(side=side) for side in _SIDES),
        "p4_recall": " UNION ALL ".join(_GOOD.format(side=side) for side in _SIDES),
        "p4_search_recall": " UNION ALL ".join(_GOOD.format(side=side) for side in _SIDES),
        "p6_members": """WITH s AS (SELECT user_id AS record, list_sort(list(DISTINCT item_id)) AS s FROM triplets
            WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT item_id) >= 10)
            SELECT record, min(record) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS n_members FROM s""",
        "p6_found": f"{_SETS} SELECT a AS user_a, b AS user_b FROM j WHERE jaccard >= 0.7 - 1e-12",
        "p6_pairs": f"{_SETS} SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.7 - 1e-12",
    }
