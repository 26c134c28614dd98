import itertools
import math

import pytest
from conftest import lists, matrix_of

from loomrec.operators.metrics import check_rankings, mean_ap_at_k, ranking_metrics
from loomrec.operators.pairs import pair_sums
from loomrec.operators.skew import eager_join_aggregate, hot_keys, key_states, per_key_results, roll_up, universe_results
from loomrec.operators.splits import random_holdout, temporal_split
from loomrec.operators.topk import popular_items
from loomrec.sources.external import read_ratings_text, sample_cooccurrence, sample_matrix
from loomrec.sources.triplets import index_ids, ingest_triplets, to_triplets


def test_ingest(spark):
    t = spark.createDataFrame([(1, 2, 1), (1, 5, 2), (2, 3, 1), (3, 1, 3), (3, 4, 1)], "user int, item int, value int")
    m = ingest_triplets(t)
    assert m.x.count() == 5 and m.users.count() == 3 and m.items.count() == 5
    assert [(r["item_id"], r["user_id"]) for r in to_triplets(m).collect()] == [(1, 3), (2, 1), (3, 2), (4, 3), (5, 1)]
    twice = spark.createDataFrame([(1.0, 2, 1.0), (1.0, 2, 2.0), (1.0, 2, 3.0)], "user double, item long, value double")
    assert ingest_triplets(twice).x.collect()[0]["value"] == 6.0
    assert ingest_triplets(twice, value_col=None).x.collect()[0]["value"] == 3.0
    assert ingest_triplets(t, n_users=9, n_items=7).users.count() == 9


@pytest.mark.parametrize(
    "rows,schema,args",
    [
        ([(1, 1.0)], "user long, value double", {}),
        ([(1, 1)], "user long, item long", {}),
        ([], "user long, item long, value double", {}),
        ([(1.5, 1, 1.0)], "user double, item long, value double", {}),
        ([(0, 1, 1.0)], "user long, item long, value double", {}),
        ([(3, 1, 1.0)], "user long, item long, value double", {"n_users": 2}),
        ([(1, 1, None)], "user long, item long, value double", {}),
        ([(None, 1, 1.0)], "user long, item long, value double", {}),
        ([(1, 1, "a")], "user long, item long, value string", {}),
        ([("a", 1, 1.0)], "user string, item long, value double", {}),
    ],
)
def test_ingest_rejects(spark, rows, schema, args):
    with pytest.raises(ValueError):
        ingest_triplets(spark.createDataFrame(rows, schema), **args)


def test_index_ids(spark):
    ids = spark.createDataFrame([(v,) for v in (30, 10, 20, 10, 99)], "id long")
    assert sorted((r["id"], r["idx"]) for r in index_ids(ids, "id").collect()) == [(10, 0), (20, 1), (30, 2), (99, 3)]


@pytest.mark.parametrize("tile", [512, 3])
def test_pair_sums(spark, tile):
    rows = [(g, m, float(g + m), float(m)) for g, n in ((1, 10), (2, 4), (3, 1)) for m in range(n)]
    got = {(r["i"], r["j"]): (r["n"], r["ab"], r["ba"]) for r in pair_sums(spark.createDataFrame(rows, "g long, m long, a double, b double"), "g", "m", "a", "b", tile=tile).collect()}
    want = {}
    for g in (1, 2, 3):
        mine = [r for r in rows if r[0] == g]
        for x, y in itertools.combinations(mine, 2):
            n, ab, ba = want.get((x[1], y[1]), (0, 0.0, 0.0))
            want[x[1], y[1]] = (n + 1, ab + x[2] * y[3], ba + y[2] * x[3])
    assert got == want


def recs(spark, *lists_):
    return spark.createDataFrame([(u + 1, r + 1, i) for u, row in enumerate(lists_) for r, i in enumerate(row)], "user_id long, rank int, item_id long")


@pytest.mark.parametrize(
    "truth,row,k,ap,ndcg,p,r",
    [
        ({5: 1, 7: 1, 9: 1}, [5, 7, 9, 2], 4, 1, 1, 0.75, 1),
        ({8: 1, 9: 1}, [1, 2, 3, 4], 4, 0, 0, 0, 0),
        ({1: 1, 2: 1, 3: 1, 4: 1, 5: 1}, [1, 2], 2, 1, 1, 1, 0.4),
        ({1: 3, 2: 2, 3: 1}, [1, 2, 3], 3, 1, 1, 1, 1),
        ({}, [1, 2, 3], 3, 0, 0, 0, 0),
        ({3: 1, 7: 1, 9: 1}, [3, 7, 1, 9], 4, 0.916667, 0.967468, 0.75, 1),
        ({1: 0.0}, [1, 2], 5, 1, 0, 0.5, 1),
    ],
)
def test_ranking_metrics(spark, truth, row, k, ap, ndcg, p, r):
    t = spark.createDataFrame([(1, i, float(v)) for i, v in truth.items()], "user_id long, item_id long, value double")
    (got,) = ranking_metrics(recs(spark, row), t, spark.createDataFrame([(1,)], "user_id long"), k).collect()
    assert [round(got[c], 6) for c in ("ap", "ndcg", "precision", "recall")] == [ap, ndcg, p, r]


def test_ranking_checks(spark):
    users, items = spark.createDataFrame([(1,)], "user_id long"), spark.createDataFrame([(i,) for i in range(1, 10)], "item_id long")
    assert check_rankings(recs(spark, [1, 2]), users, items, 5) == 2
    for bad, k in ((recs(spark, [1, 2]), 0), (recs(spark, [1, 1]), 2), (recs(spark, [1, 12]), 2), (recs(spark, [1], [2]), 1)):
        with pytest.raises(ValueError):
            check_rankings(bad, users, items, k)
    assert check_rankings(recs(spark, [1, 2, 2]), users, items, 2) == 2
    truth = spark.createDataFrame([(1, 1, 1.0)], "user_id long, item_id long, value double")
    twice = recs(spark, [1, 1])
    with pytest.raises(ValueError):
        ranking_metrics(twice, truth, users, 2)
    with pytest.raises(ValueError):
        mean_ap_at_k(recs(spark, [1, 99]), truth, users, 2, items=items)
    assert ranking_metrics(twice, truth, users, 2, check=False).count() == users.count()


def test_holdout(spark, random_matrix):
    train, test = random_holdout(random_matrix.x, 0.3, 1)
    cells = lambda df: {(r["user_id"], r["item_id"]) for r in df.collect()}
    a, b, everything = cells(train), cells(test), cells(random_matrix.x)
    assert a | b == everything and not a & b
    for u in range(1, 41):
        n, t = sum(c[0] == u for c in everything), sum(c[0] == u for c in b)
        assert t == (0 if n <= 1 else max(1, round(n * 0.3)))
    assert cells(random_holdout(random_matrix.x.repartition(7), 0.3, 1)[1]) == b != cells(random_holdout(random_matrix.x, 0.3, 2)[1])
    with pytest.raises(ValueError):
        random_holdout(random_matrix.x, 1.0)


def test_temporal_split(spark):
    x = spark.createDataFrame([(1, i, f"2024-01-{i + 1:02d}") for i in range(10)] + [(2, 5, None)], "user_id long, item_id long, rated_at string")
    train, test = temporal_split(x)
    assert sorted(r["item_id"] for r in test.collect()) == [8, 9] and train.count() == 9


def test_popular_items(spark):
    m = matrix_of(spark, [(1, 1, 5), (1, 2, 1), (2, 1, 1), (2, 3, 2)], [1, 2, 3], [1, 2, 3, 4])
    assert lists(popular_items(m, 2)) == {1: [3, 4], 2: [2, 4], 3: [1, 3]}


def brute_join(left, right, how="inner"):
    out = {}
    for k, a in left:
        matches = [b for q, b in right if q is not None and q == k]
        n, sl, sr, sp = out.get(k, (0, 0.0, 0.0, 0.0))
        fine = lambda v: v if v is not None and math.isfinite(v) else 0.0
        for b in matches:
            n, sl, sr, sp = n + 1, sl + fine(a), sr + fine(b), sp + fine(a) * fine(b)
        if matches or how == "left":
            out[k] = (n, sl, sr, sp)
    return out


@pytest.mark.parametrize("how", ["inner", "left"])
def test_eager_aggregation(spark, how):
    nan, inf = float("nan"), float("inf")
    left = [(1, 1.0), (1, 2.0), (1, nan), (2, None), (None, 4.0), (3, 1.0)] + [(7, 0.5)] * 50
    right = [(1, 3.0), (1, inf), (2, 2.0), (2, 2.0), (None, 1.0), (9, 1.0)] + [(7, 2.0)] * 40
    a, b = (spark.createDataFrame(x, "k long, value double") for x in (left, right))
    got = eager_join_aggregate(a, b, "k", left_value="value", right_value="value", how=how)
    assert {r["k"]: (r["n_pairs"], r["sum_left"], r["sum_right"], r["sum_product"]) for r in got.collect()} == brute_join(left, right, how)
    (total,) = roll_up(got, []).collect()
    assert total["n_pairs"] == sum(v[0] for v in brute_join(left, right).values())
    assert eager_join_aggregate(a.limit(0), b, "k").count() == 0
    with pytest.raises(ValueError):
        eager_join_aggregate(a, b, "k", left_group=("value",), right_group=("value",))


def test_universe_results_need_the_join(spark):
    rows = spark.createDataFrame([(1, 1)] * 8 + [(2, None), (None, 1), (9, 2)], "user_id long, item_id long")
    users, items = spark.createDataFrame([(1,), (2,), (2,), (3,)], "user_id long"), spark.createDataFrame([(1,), (2,)], "item_id long")
    results = universe_results(rows, {"user_id": users, "item_id": items})
    got = {(r["key_field"], r["key_id"], r["n_rows"], r["n_valid"]) for r in results.collect()}
    assert got == {
        ("user_id", 1, 8, 8), ("user_id", 2, 1, 1), ("user_id", None, 1, 0), ("user_id", 9, 1, 0),
        ("item_id", 1, 9, 9), ("item_id", 2, 1, 1), ("item_id", None, 1, 0),
    }
    read = results.select("key_field", "key_id", "n_rows", "n_valid")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    assert {(r[0], r[1]) for r in hot_keys(results, 0.5, "n_valid").collect()} == {("user_id", 1), ("item_id", 1)}
    assert hot_keys(universe_results(rows.limit(0), {"user_id": users}), 0.5, "n_valid").count() == 0


def test_hot_keys(spark):
    rows = [(1, 5, 1.0)] * 60 + [(u, u % 7, None) for u in range(2, 40)] + [(None, None, float("nan"))] * 2
    df = spark.createDataFrame(rows, "user_id long, item_id long, value double")
    held = spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.0)], "user_id long, item_id long, value double")
    results = per_key_results(df, ["user_id", "item_id"], "value", {"user_id": held, "item_id": held}, "value")
    by = {(r["key_field"], r["key_id"]): r for r in results.collect()}
    assert by["user_id", 1]["n_pairs"] == 120 and by["user_id", 1]["sum_product"] == 240.0 and by["user_id", None]["n_rows"] == 2
    got = {(r["key_field"], r["key_id"]) for r in hot_keys(results, 0.05).collect()}
    want = {("user_id", 1)} | {("item_id", i) for i in range(7) if sum(r[1] == i for r in rows) >= 0.05 * len(rows)}
    assert got == want
    assert key_states(df, ["user_id"], "value").filter("user_id IS NULL").first()["n"] == 2


def test_readers_and_generators(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1::10::5::978300760\n2::11::3::978300761\nbroken\n")
    rows = read_ratings_text(spark, str(tmp_path / "r.dat")).orderBy("user_id").collect()
    assert [(r["user_id"], r["item_id"], r["value"]) for r in rows] == [(1, 10, 5.0), (2, 11, 3.0)]
    m = sample_matrix(spark, 50, 30, 0.2, seed=3)
    assert sorted(m.x.collect()) == sorted(sample_matrix(spark, 50, 30, 0.2, seed=3).x.collect())
    assert 150 < m.x.count() < 450
    c = sample_cooccurrence(spark, 20, 0.3)
    cells = {(r["word"], r["context"]): r["count"] for r in c.collect()}
    assert all(cells[b, a] == n and a != b for (a, b), n in cells.items())


def test_mean_over_all_users(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    truth = spark.createDataFrame([(1, 1, 1.0)], "user_id long, item_id long, value double")
    assert mean_ap_at_k(recs(spark, [1], [1]), truth, users, 1) == 0.5
