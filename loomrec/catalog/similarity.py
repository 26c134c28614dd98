"""Queries on item-item models, recommendation and ranking metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomrec.catalog.data import HELD, X, XP, factor_sql, factors, heldout, matrix, nonnegative
from loomrec.operators import topk
from loomrec.operators.metrics import ranking_metrics
from loomrec.plans.itemsim import (
    GraphRandomWalk,
    ItemKNN,
    ShallowAutoencoder,
    SparseLinearADMM,
    SparseLinearModel,
    dense_gram,
    gathered,
    item_lists,
    item_products,
    products_with,
    rows_against,
)
from loomrec.scratch import stow
from loomrec.sources.triplets import Interactions, require_memory

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PAIRS = {
    "cosine": "s AS (SELECT item_id, sqrt(sum(value * value)) AS s FROM x GROUP BY 1), p AS (SELECT a.item_id AS src, b.item_id AS dst, sum(a.value * b.value) AS d FROM x a JOIN x b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2), e AS (SELECT src, dst, d / nullif(a.s * b.s, 0) AS w FROM p JOIN s a ON a.item_id = src JOIN s b ON b.item_id = dst WHERE d > 0)",
    "jaccard": "s AS (SELECT item_id, count(*) AS s FROM x GROUP BY 1), p AS (SELECT a.item_id AS src, b.item_id AS dst, count(*) AS d FROM x a JOIN x b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2), e AS (SELECT src, dst, d::DOUBLE / (a.s + b.s - d) AS w FROM p JOIN s a ON a.item_id = src JOIN s b ON b.item_id = dst)",
    "asym_cosine": "s AS (SELECT item_id, count(*)::DOUBLE AS s FROM x GROUP BY 1), p AS (SELECT a.item_id AS src, b.item_id AS dst, count(*) AS d FROM x a JOIN x b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2), e AS (SELECT src, dst, d / (pow(a.s, 0.7) * pow(b.s, 0.3)) AS w FROM p JOIN s a ON a.item_id = src JOIN s b ON b.item_id = dst)",
    "bm25": "f AS (SELECT user_id, ln((SELECT count(*) FROM users)) - ln(1 + count(*)) AS idf FROM x GROUP BY 1), y AS (SELECT user_id, item_id, idf FROM x JOIN f USING (user_id)), s AS (SELECT item_id, sqrt(sum(idf)) AS s FROM y GROUP BY 1), p AS (SELECT a.item_id AS src, b.item_id AS dst, sum(a.idf) AS d FROM y a JOIN y b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2), e AS (SELECT src, dst, d / nullif(a.s * b.s, 0) AS w FROM p JOIN s a ON a.item_id = src JOIN s b ON b.item_id = dst)",
}
_BEST = "k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(w, 9) DESC, src) AS r FROM e WHERE w > 0)"
_ROWS = f"{_BEST}, w AS (SELECT src, dst, CASE WHEN sum(w) OVER (PARTITION BY src) > 0 THEN w / sum(w) OVER (PARTITION BY src) ELSE w END AS weight FROM k WHERE r <= 20)"


def _knn(similarity):
    sql = f"WITH {X}, {_PAIRS[similarity]}, {_ROWS} SELECT src, dst, round(weight, 6) AS weight FROM w"

    def run(spark, sf):
        model = ItemKNN(k=20, similarity=similarity, asym_alpha=0.3).fit(matrix(spark, sf))
        return model.weights.withColumn("weight", F.round("weight", 6))

    run.__name__ = f"knn_{similarity}"
    query(sql)(run)


for _s in _PAIRS:
    _knn(_s)


@query(f"WITH {X}, {_PAIRS['cosine']}, {_BEST} SELECT src, dst, round(w, 6) AS weight FROM k WHERE r <= 20")
def knn_not_normalized(spark, sf):
    return ItemKNN(k=20, normalize=False).fit(matrix(spark, sf)).weights.withColumn("weight", F.round("weight", 6))


_WALK = f"""WITH {XP}, du AS (SELECT user_id, sum(value) AS d FROM xp GROUP BY 1), di AS (SELECT item_id, sum(value) AS d FROM xp GROUP BY 1),
 y AS (SELECT user_id, item_id, {{a}} AS a, {{b}} AS b FROM xp JOIN du USING (user_id) JOIN di USING (item_id)),
 p AS (SELECT q.item_id AS src, r.item_id AS dst, sum(q.a * r.b) AS s FROM y q JOIN y r USING (user_id) WHERE q.item_id <> r.item_id GROUP BY 1, 2),
 e AS (SELECT src, dst, coalesce(s / {{c}}, 0) AS w FROM p JOIN di ON di.item_id = dst)"""
_FULL = _WALK.format(a="pow(value / greatest(di.d, 1), 0.8)", b="pow(value / greatest(du.d, 1), 0.8)", c="greatest(pow(di.d, 0.6), 1)")
_TOP = _WALK.format(a="CASE WHEN di.d > 0 THEN pow(value / di.d, 0.8) ELSE 0 END", b="CASE WHEN du.d > 0 THEN pow(value / du.d, 0.8) ELSE 0 END", c="CASE WHEN di.d > 0 THEN pow(di.d, 0.6) END")


@query(f"{_FULL} SELECT src, dst, round(w, 9) AS weight FROM e")
def rp3beta_full(spark, sf):
    return GraphRandomWalk(alpha=0.8).fit(nonnegative(spark, sf)).weights.withColumn("weight", F.round("weight", 9))


@query(f"{_TOP}, {_BEST} SELECT src, dst, round(w, 9) AS weight FROM k WHERE r <= 20")
def rp3beta_topk(spark, sf):
    return GraphRandomWalk(k=20, alpha=0.8).fit(nonnegative(spark, sf)).weights.withColumn("weight", F.round("weight", 9))


@query(f"{_TOP}, {_ROWS} SELECT src, dst, round(weight, 6) AS weight FROM w")
def rp3beta_normalized(spark, sf):
    model = GraphRandomWalk(k=20, alpha=0.8, normalize=True).fit(nonnegative(spark, sf))
    return model.weights.withColumn("weight", F.round("weight", 6))


_SCORED = f"WITH {X}, {_PAIRS['cosine']}, {_ROWS}, sc AS (SELECT user_id, dst AS item_id, sum(value * weight) AS score FROM x JOIN w ON src = item_id GROUP BY 1, 2)"
_RANKED = """, g AS (SELECT u.user_id, i.item_id, CASE WHEN x.value IS NOT NULL THEN NULL ELSE round(coalesce(sc.score, 0), 9) END AS s
   FROM users u CROSS JOIN items i LEFT JOIN sc ON sc.user_id = u.user_id AND sc.item_id = i.item_id
   LEFT JOIN x ON x.user_id = u.user_id AND x.item_id = i.item_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC NULLS LAST, item_id) AS rank FROM g)"""


@query(f"{_SCORED} SELECT user_id, item_id, round(score, 6) AS score FROM sc")
def score_itemknn(spark, sf):
    m = matrix(spark, sf)
    return ItemKNN(k=20).fit(m).score(m).withColumn("score", F.round("score", 6))


@query(f"{_SCORED}{_RANKED} SELECT user_id, rank, item_id FROM r WHERE rank <= 10")
def recommend_itemknn(spark, sf):
    m = matrix(spark, sf).settled()
    recs = ItemKNN(k=20).fit(m).recommend(m, 10)
    return recs.select("user_id", F.col("rank").cast("long").alias("rank"), "item_id")


@query(f"{_SCORED}{_RANKED} SELECT user_id, rank, item_id FROM r WHERE rank <= 10")
def recommend_backfill(spark, sf):
    m = matrix(spark, sf).settled()
    recs = ItemKNN(k=20).fit(m).recommend(m, 10, strategy="join")
    return recs.select("user_id", F.col("rank").cast("long").alias("rank"), "item_id")


@query(f"""WITH {X}, p AS (SELECT i.item_id, coalesce(sum(x.value), 0) AS s FROM items i LEFT JOIN x USING (item_id) GROUP BY 1),
  r AS (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(s, 9) DESC, p.item_id) AS rank
  FROM users u CROSS JOIN p ANTI JOIN x ON x.user_id = u.user_id AND x.item_id = p.item_id)
  SELECT user_id, rank, item_id FROM r WHERE rank <= 20""")
def recommend_popular(spark, sf):
    recs = topk.popular_items(matrix(spark, sf).settled(), 20)
    return recs.select("user_id", F.col("rank").cast("long").alias("rank"), "item_id")


@query(f"""WITH {X}, {factor_sql('user', 'a')}, {factor_sql('item', 'b')},
  g AS (SELECT a.id AS user_id, b.id AS item_id, CASE WHEN x.value IS NULL THEN round(list_inner_product(a.v, b.v), 9) END AS s
  FROM a CROSS JOIN b LEFT JOIN x ON x.user_id = a.id AND x.item_id = b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC NULLS LAST, item_id) AS rank FROM g)
  SELECT user_id, rank, item_id, round(s, 6) AS score FROM r WHERE rank <= 10""")
def recommend_factors(spark, sf):
    recs = topk.recommend_dense(factors(spark, sf, "user"), factors(spark, sf, "item"), matrix(spark, sf).x, 10)
    return recs.select("user_id", F.col("rank").cast("long").alias("rank"), "item_id", F.round("score", 6).alias("score"))


@query(f"""WITH {HELD}, {factor_sql('user', 'a')}, {factor_sql('item', 'b')}
  SELECT user_id, item_id, round(list_inner_product(a.v, b.v), 6) AS score FROM held JOIN a ON a.id = user_id JOIN b ON b.id = item_id""")
def pair_scores(spark, sf):
    u, i = factors(spark, sf, "user"), factors(spark, sf, "item")
    known = heldout(spark, sf).join(u.select(F.col("id").alias("user_id")), "user_id").join(i.select(F.col("id").alias("item_id")), "item_id")
    return topk.pair_scores(known, u, i).withColumn("score", F.round("score", 6))


_COSINE = """n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS l FROM g),
  s AS (SELECT a.id AS query, b.id AS id, round(CASE WHEN b.l > 0 THEN list_inner_product(a.v, b.v) / (a.l * b.l) ELSE 0 END, 9) AS similarity
  FROM n a JOIN n b ON a.id <> b.id WHERE a.l > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s)"""


@query(f"WITH {factor_sql('item', 'g')}, {_COSINE} SELECT query, id, round(similarity, 6) AS similarity FROM r WHERE rank <= 10")
def similar_items_all(spark, sf):
    f = factors(spark, sf, "item")
    return topk.similar_all(f, f, 10).select("query", "id", F.round("similarity", 6).alias("similarity"))


_FIRST = "(SELECT min(id) FROM g WHERE list_inner_product(v, v) > 0)"


@query(f"WITH {factor_sql('item', 'g')}, {_COSINE} SELECT id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10 AND query = {_FIRST}")
def similar_items_one(spark, sf):
    f = factors(spark, sf, "item")
    first = f.filter(F.exists("factors", lambda e: e != 0)).agg(F.min("id")).first()[0]
    return topk.similar_to(f, first, 10).select("id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_EVALUATED = f"""WITH {X}, {HELD}, p AS (SELECT i.item_id, coalesce(sum(x.value), 0) AS s FROM items i LEFT JOIN x USING (item_id) GROUP BY 1),
  c AS (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(s, 9) DESC, p.item_id) AS rank
  FROM users u CROSS JOIN p ANTI JOIN x ON x.user_id = u.user_id AND x.item_id = p.item_id),
  h AS (SELECT c.user_id, rank, value, row_number() OVER (PARTITION BY c.user_id ORDER BY rank) AS hits
  FROM c JOIN held ON held.user_id = c.user_id AND held.item_id = c.item_id WHERE rank <= 10),
  m AS (SELECT user_id, count(*) AS hits, sum(hits / rank) AS ap, sum(value / log2(rank + 1.0)) AS dcg FROM h GROUP BY 1),
  n AS (SELECT user_id, count(*) AS n FROM held GROUP BY 1),
  i AS (SELECT user_id, sum(value / log2(place + 1.0)) AS idcg FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS place FROM held) WHERE place <= 10 GROUP BY 1),
  f AS (SELECT u.user_id, coalesce(ap / least(10, n), 0) AS ap, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg,
  coalesce(m.hits, 0) / 10 AS precision, coalesce(m.hits / n, 0) AS recall
  FROM users u LEFT JOIN m USING (user_id) LEFT JOIN n USING (user_id) LEFT JOIN i USING (user_id))"""


def _evaluated(spark, sf):
    m = matrix(spark, sf).settled()
    return ranking_metrics(topk.popular_items(m, 10), heldout(spark, sf), m.users, 10, width=10)


@query(f"{_EVALUATED} SELECT user_id, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f")
def metrics_per_user(spark, sf):
    names = ("ap", "ndcg", "precision", "recall")
    return _evaluated(spark, sf).select("user_id", *(F.round(n, 6).alias(n) for n in names))


@query(f"{_EVALUATED} SELECT round(avg(ap), 9) AS ap, round(avg(ndcg), 9) AS ndcg, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall FROM f")
def metrics_mean(spark, sf):
    return _evaluated(spark, sf).agg(*(F.round(F.avg(n), 9).alias(n) for n in ("ap", "ndcg", "precision", "recall")))


@query(f"""{_SCORED}{_RANKED}, pp AS (SELECT i.item_id, coalesce(sum(x.value), 0) AS s FROM items i LEFT JOIN x USING (item_id) GROUP BY 1),
  c AS (SELECT u.user_id, pp.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(pp.s, 9) DESC, pp.item_id) AS rank
  FROM users u CROSS JOIN pp ANTI JOIN x ON x.user_id = u.user_id AND x.item_id = pp.item_id),
  o AS (SELECT r.user_id, count(c.item_id) / 10.0 AS o FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.item_id = r.item_id AND c.rank <= 10 WHERE r.rank <= 10 GROUP BY 1)
  SELECT round(avg(o), 9) AS overlap FROM o""")
def overlap_of_lists(spark, sf):
    m = matrix(spark, sf).settled()
    knn, popular = ItemKNN(k=20).fit(m).recommend(m, 10), topk.popular_items(m, 10)
    return topk.mean_overlap(knn, popular, 10).select(F.round("overlap", 9).alias("overlap"))


@query(f"""{_SCORED}, {factor_sql('user', 'a')}, {factor_sql('item', 'b')}
  SELECT round(corr(score, list_inner_product(a.v, b.v)), 6) AS correlation FROM sc JOIN a ON a.id = user_id JOIN b ON b.id = item_id""")
def correlation_of_scores(spark, sf):
    m = matrix(spark, sf).settled()
    scored = ItemKNN(k=20).fit(m).score(m)
    u = factors(spark, sf, "user").select(F.col("id").alias("user_id"), F.col("factors").alias("p"))
    i = factors(spark, sf, "item").select(F.col("id").alias("item_id"), F.col("factors").alias("q"))
    dot = F.aggregate(F.zip_with("p", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    other = scored.join(u, "user_id").join(i, "item_id").select("user_id", "item_id", dot.alias("score"))
    return topk.score_correlation(scored, other).select(F.round("correlation", 6).alias("correlation"))


def _categories(spark, sf) -> Interactions:
    """Users by item category: values summed, the category numbered by name."""
    from loomrec.sources.tables import table

    m, items = matrix(spark, sf), table(spark, sf, "items").select("item_id", F.coalesce("category", F.lit("")).alias("c"))
    names = sorted(r["c"] for r in items.select("c").distinct().collect())
    ids = spark.createDataFrame([(n + 1, c) for n, c in enumerate(names)], "k long, c string")
    x = m.x.join(items, "item_id").join(F.broadcast(ids), "c").groupBy("user_id", F.col("k").alias("item_id")).agg(F.sum("value").alias("value"))
    return Interactions(x, m.users, ids.select(F.col("k").alias("item_id"))).settled()


def _linear(name, model):
    def run(spark, sf):
        m = _categories(spark, sf)
        fitted = model().fit(m)
        gram = stow(fitted.weights)
        return gram.select("src", "dst", F.round("weight", 6).alias("weight"))

    def ranked(spark, sf):
        m = _categories(spark, sf)
        recs = model().fit(m).recommend(m, 3)
        return recs.select("user_id", F.col("rank").cast("long").alias("rank"), "item_id")

    run.__name__, ranked.__name__ = f"{name}_weights", f"{name}_recommend"
    query()(run)
    query()(ranked)


_linear("shallow_autoencoder", lambda: ShallowAutoencoder(l2=50.0))
_linear("sparse_linear", lambda: SparseLinearModel(l1=1.0, l2=10.0))
_linear("sparse_linear_admm", lambda: SparseLinearADMM(l1=0.01))


def _dense(m: Interactions, weights) -> tuple:
    """Item ids, the Gram matrix and the fitted weights as matrices, within the models' own memory guard."""
    ids, g = dense_gram(m, 4, 4 << 30, "conditions")
    got, w = weights.toArrow(), np.zeros_like(g)
    w[np.searchsorted(ids, got["src"].to_numpy()), np.searchsorted(ids, got["dst"].to_numpy())] = got["weight"].to_numpy()
    return ids, g, w


#: Dense matrices of all items that a query lets the driver hold; beyond that a model's columns are checked in the workers.
DENSE = 512 << 20


def _is_dense(m: Interactions, matrices: int) -> bool:
    return m.items.count() ** 2 * matrices * 8 <= DENSE


def _column_products(m: Interactions, columns, share):
    """``src, dst, product`` of the system with a model's columns where X'X isn't 0, each column divided by ``share`` of the inverse's
    diagonal entries; a worker forms the products of the columns that it solves."""

    def pairs(normal, at, w, diagonal):
        g, product = normal.gram(at), normal.times(w) / share(diagonal)
        g[at, np.arange(len(at))] = 0.0
        i, k = np.nonzero(g)
        return normal.ids[i], normal.ids[at[k]], np.round(product[i, k], 3) + 0.0

    return columns(m, pairs, "src long, dst long, product double")


_OTHERS = f"""WITH {X}, g AS (SELECT a.item_id AS src, b.item_id AS dst, sum(a.value * b.value) AS dot FROM x a JOIN x b USING (user_id)
  WHERE a.item_id <> b.item_id GROUP BY 1, 2 HAVING sum(a.value * b.value) <> 0)"""


@query(f"{_OTHERS} SELECT src, dst, round(dot, 3) AS product FROM g")
def shallow_autoencoder_conditions(spark, sf):
    """Over all items: beside the diagonal (X'X + l2 I) B equals X'X, which holds for the minimum alone."""
    m, model = matrix(spark, sf).settled(), ShallowAutoencoder(l2=50.0)
    if not _is_dense(m, 4):
        return _column_products(m, model.columns, np.ones_like)
    ids, g, b = _dense(m, model.fit(m).weights)
    product = (g + 50.0 * np.eye(len(g))) @ b
    i, j = np.nonzero((g != 0) & ~np.eye(len(g), dtype=bool))
    rows = pa.table({"src": ids[i], "dst": ids[j], "product": np.round(product[i, j], 3) + 0.0})
    return spark.createDataFrame(rows, "src long, dst long, product double")


def _subgradients(spark, sf, model, slack: float):
    """A row an item of all: how many others it may draw on (X'X not 0) and how many of them break the conditions of the minimum:
    the gradient equals l1 where the weight is positive and is not above it where it is 0, up to ``slack`` of the diagonal.

    A target without weights has X'X itself for a gradient; those with weights are checked against all items' products with them."""
    m = matrix(spark, sf).settled()
    got, l1, l2 = model.fit(m).weights.toArrow(), model.l1, model.l2
    active = np.unique(np.concatenate([got["src"].to_numpy(), got["dst"].to_numpy()]))
    require_memory(len(active), 2, 4 << 30, "conditions")
    w = np.zeros((len(active), len(active)))
    w[np.searchsorted(active, got["src"].to_numpy()), np.searchsorted(active, got["dst"].to_numpy())] = got["weight"].to_numpy()
    own = m.x.groupBy("item_id").agg(F.sum(F.col("value") * F.col("value")).alias("own")).orderBy("item_id").toArrow()
    held = spark.sparkContext.broadcast((active, w, own["item_id"].to_numpy(), own["own"].to_numpy()))

    def free(batches):
        active, w, ids, own = held.value
        fitted = active[w.any(axis=0)]
        for batch in batches:
            item, other, dot = (batch.column(c).to_numpy() for c in range(3))
            able = (item != other) & (dot != 0)
            broken = able & (dot - l1 > slack * (own[np.searchsorted(ids, other)] + l2)) & ~np.isin(item, fitted)
            items, at = np.unique(item, return_inverse=True)
            counts = [np.bincount(at, x, len(items)).astype(np.int64) for x in (able, broken)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (items, *counts)], names=["item_id", "n_able", "broken"])

    def bound(batches):
        active, w, _, _ = held.value
        fitted = np.flatnonzero(w.any(axis=0))
        row = np.zeros((1, len(active)))
        for ids, own, g in rows_against(batches, active):
            at = np.minimum(np.searchsorted(active, ids), len(active) - 1)
            mine = np.where((active[at] == ids)[:, None], w[at], row)[:, fitted]
            able = (g[:, fitted] != 0) & (ids[:, None] != active[fitted])
            gradient, room = g[:, fitted] - g @ w[:, fitted] - l2 * mine, (slack * (own + l2))[:, None]
            broken = able & np.where(mine > 0, np.abs(gradient - l1) > room, gradient - l1 > room)
            broken |= (mine != 0) & ~able
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (active[fitted], np.zeros(len(fitted), np.int64), broken.sum(axis=0))], names=["item_id", "n_able", "broken"])

    schema = "item_id long, n_able long, broken long"
    lists = item_lists(m)
    counts = item_products(m, lists, within=(free, schema))
    if len(active):
        counts = counts.union(gathered(m, products_with(m, lists, active)).mapInArrow(bound, schema))
    counts = counts.groupBy("item_id").agg(F.sum("n_able").alias("n_able"), F.sum("broken").alias("broken"))
    return m.items.select("item_id").join(counts, "item_id", "left").fillna(0, ["n_able", "broken"])


_CONDITIONS = f"{_OTHERS} SELECT i.item_id, count(g.src) AS n_able, 0::BIGINT AS broken FROM items i LEFT JOIN g ON g.dst = i.item_id GROUP BY 1"


@query(_CONDITIONS)
def sparse_linear_conditions(spark, sf):
    """With a penalty strong enough for coordinate descent to converge within the sweeps; weaker ones need thousands of sweeps."""
    return _subgradients(spark, sf, SparseLinearModel(l1=5_000.0, l2=2_000.0, max_iter=1_000, tol=1e-7), 1e-3)


@query(f"{_OTHERS} SELECT src, dst, round(dot, 3) AS product FROM g")
def sparse_linear_admm_step(spark, sf):
    """The first step over all items without threshold: (X'X + (l2 + rho) I) Z equals X'X beside the diagonal, up to the factor by
    which the zeroed diagonal changes a column.  (The method zeroes the diagonal after solving, so its limit is not that of
    coordinate descent and has no such conditions.)"""
    m = matrix(spark, sf).settled()
    model = SparseLinearADMM(l1=0.0, l2=100.0, rho=100.0, max_iter=1, nonnegative=False)
    if not _is_dense(m, 7):
        return _column_products(m, model.first_columns, lambda diagonal: 200.0 * diagonal)
    ids, g, z = _dense(m, model.fit(m).weights)
    system = g + 200.0 * np.eye(len(g))
    column = 1 - np.diag(np.linalg.solve(system, g))
    product = system @ z / column[None, :]
    i, j = np.nonzero((g != 0) & ~np.eye(len(g), dtype=bool))
    rows = pa.table({"src": ids[i], "dst": ids[j], "product": np.round(product[i, j], 3) + 0.0})
    return spark.createDataFrame(rows, "src long, dst long, product double")
