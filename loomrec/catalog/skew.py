"""Queries on skewed keys and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.operators.skew import hot_keys, per_key_results, universe_results
from loomrec.sources.tables import table


def _results(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "heldout")
    return per_key_results(table(spark, sf, "triplets"), ["user_id", "item_id"], "value", {"user_id": held, "item_id": held}, "value")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    universes = {"user_id": table(spark, sf, "users"), "item_id": table(spark, sf, "items")}
    joined = universe_results(table(spark, sf, "triplets"), universes)
    return hot_keys(joined, 0.02, "n_valid").select("key_field", "key_id")


def p5_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).withColumns({"sum_value": F.round("sum_value", 6), "sum_product": F.round("sum_product", 6)})


QUERIES = {f.__name__: f for f in (p5_found, p5_per_key)}

_FINITE = "CASE WHEN isfinite({0}.value) THEN {0}.value END"

_PER_KEY = " UNION ALL ".join(
    f"""SELECT '{k}' AS key_field, l.{k} AS key_id, l.n AS n_rows, l.nv AS n_value, round(coalesce(l.s, 0), 6) AS sum_value,
        coalesce(r.n, 0) AS n_partner, l.n * coalesce(r.n, 0) AS n_pairs,
        round(coalesce(l.s, 0) * coalesce(r.s, 0), 6) AS sum_product
    FROM (SELECT {k}, count(*) AS n, count({_FINITE.format('t')}) AS nv, sum({_FINITE.format('t')}) AS s FROM triplets t GROUP BY 1) l
    LEFT JOIN (SELECT {k}, count(*) AS n, sum({_FINITE.format('h')}) AS s FROM heldout h GROUP BY 1) r ON l.{k} = r.{k}"""
    for k in ("user_id", "item_id")
)

SQL = {
    "p5_found": " UNION ALL ".join(
        f"""SELECT '{k}' AS key_field, {k} AS key_id FROM triplets WHERE {k} IS NOT NULL GROUP BY {k}
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM triplets)"""
        for k in ("user_id", "item_id")
    ),
    "p5_per_key": _PER_KEY,
}
