"""Queries on rejected inputs, stored models and continued training."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomrec.catalog.data import matrix, start
from loomrec.catalog.rating import _WMF, _BOTH, _both
from loomrec.operators.metrics import check_rankings
from loomrec.operators.topk import popular_items
from loomrec.plans.explicit import BaselineOnly
from loomrec.plans.factorization import CachedALS, WeightedMF
from loomrec.plans.itemsim import ItemKNN, ShallowAutoencoder
from loomrec.scratch import shared_dir
from loomrec.sources.models import load_model, save_model
from loomrec.sources.tables import table
from loomrec.sources.triplets import Interactions, ingest_triplets

QUERIES, SQL = {}, {}


def _rejected(call) -> bool:
    try:
        call()
    except (ValueError, MemoryError, RuntimeError, TypeError):
        return True
    return False


def _cases(spark, sf) -> dict:
    """What must be refused, each over the whole tables."""
    m = matrix(spark, sf).settled()
    raw = table(spark, sf, "triplets").select("user_id", "item_id", "value")
    keyed = raw.dropna().filter("abs(value) < double('infinity') AND NOT isnan(value)")

    def ingest(df, **args):
        return lambda: ingest_triplets(df, user_col="user_id", item_col="item_id", value_col="value", **args)

    def with_value(v):
        return Interactions(m.x.withColumn("value", F.when(F.col("value") == F.lit(1.0), F.lit(v)).otherwise(F.col("value"))), m.users, m.items)

    best = popular_items(m, 3)
    return {
        "item beyond the universe": ingest(keyed, n_items=10),
        "user beyond the universe": ingest(keyed, n_users=10),
        "id that is no integer": ingest(keyed.withColumn("item_id", F.col("item_id") + 0.5)),
        "null id": ingest(raw),
        "missing column": ingest(keyed.drop("item_id")),
        "value that is no number": ingest(keyed.withColumn("value", F.lit("x"))),
        "empty table": ingest(keyed.limit(0)),
        "infinite value": lambda: WeightedMF(rank=1, max_iter=1).fit(with_value(float("inf"))),
        "value that is not a number": lambda: BaselineOnly().fit(with_value(float("nan"))),
        "negative value": lambda: CachedALS(rank=1, max_iter=1).fit(with_value(-1.0)),
        "no items": lambda: ItemKNN(k=2).fit(Interactions(m.x.limit(0), m.users, m.items.limit(0))),
        "parameter out of range": lambda: WeightedMF(rank=0),
        "not fitted": lambda: ItemKNN(k=2).recommend(m, 2),
        "k below 1": lambda: popular_items(m, 0),
        "too little memory": lambda: ShallowAutoencoder(max_memory=10).fit(m),
        "item listed twice": lambda: check_rankings(best.withColumn("item_id", F.lit(1).cast("long")), m.users, m.items, 3),
        "unknown item listed": lambda: check_rankings(best.withColumn("item_id", -F.col("item_id")), m.users, m.items, 3),
        "users of another universe": lambda: check_rankings(best.filter("user_id > 1"), m.users, m.items, 3),
        "accepted ranking": lambda: check_rankings(best, m.users, m.items, 3),
        "accepted table": ingest(keyed),
    }


def rejections(spark, sf):
    rows = [(name, _rejected(call)) for name, call in _cases(spark, sf).items()]
    return spark.createDataFrame(rows, "input string, rejected boolean")


QUERIES["rejections"] = rejections
SQL["rejections"] = """SELECT * FROM (VALUES ('item beyond the universe', true), ('user beyond the universe', true),
 ('id that is no integer', true), ('null id', true), ('missing column', true), ('value that is no number', true), ('empty table', true),
 ('infinite value', true), ('value that is not a number', true), ('negative value', true), ('no items', true),
 ('parameter out of range', true), ('not fitted', true), ('k below 1', true), ('too little memory', true), ('item listed twice', true),
 ('unknown item listed', true), ('users of another universe', true), ('accepted ranking', false), ('accepted table', false)) t(input, rejected)"""


def stored_model(spark, sf):
    """The factors that come back from a stored model; a failed refit in between leaves the model as it was."""
    m = matrix(spark, sf).settled()
    model = WeightedMF(rank=1, solver="cholesky", max_iter=2, tol=-1).fit(m, item_init=start(m.items, "item_id", 7))
    bad = Interactions(m.x.withColumn("value", F.lit(float("inf"))), m.users, m.items)
    if not _rejected(lambda: model.fit(bad)):
        raise AssertionError("the refit was to be refused")
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(model, path)
    return _both(load_model(spark, path))


QUERIES["stored_model"] = stored_model
SQL["stored_model"] = _WMF + _BOTH
