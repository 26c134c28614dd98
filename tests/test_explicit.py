import pytest
from conftest import matrix_of

from loomrec.operators.metrics import mae, rmse
from loomrec.plans.base import ExplicitModel
from loomrec.plans.explicit import BaselineOnly, PearsonKNN, SlopeOne


def grid(model, matrix):
    return {(r["user_id"], r["item_id"]): r["prediction"] for r in model.predict(model.grid(matrix)).collect()}


def test_slope_one(ratings):
    model = SlopeOne().fit(ratings)
    dev = {(r["src"], r["dst"]): (r["dev"], r["freq"]) for r in model.deviations.collect()}
    assert dev[1, 2] == (-1.0, 1) and dev[2, 1] == (1.0, 1) and dev[1, 3] == (-3.0, 1)
    got = grid(model, ratings)
    rows = [[0.5, 2.5, 4], [-0.5, 2, 5.5], [1, 1, 5]]
    assert all(got[u + 1, i + 1] == pytest.approx(rows[u][i]) for u in range(3) for i in range(3))


def test_slope_one_cold_user(spark):
    m = matrix_of(spark, [(1, 1, 2), (2, 1, 4)], [1, 2, 3], [1])
    assert grid(SlopeOne().fit(m), m)[3, 1] == pytest.approx(3.0)


def test_baseline(ratings):
    model = BaselineOnly().fit(ratings)
    assert model.mean == pytest.approx(2.333333, abs=1e-6)
    u = {r["user_id"]: round(r["b"], 6) for r in model.user_bias.collect()}
    i = {r["item_id"]: round(r["b"], 6) for r in model.item_bias.collect()}
    assert u == {1: -0.010824, 2: 0.002165, 3: 0.008659}
    assert i == {1: -1.315845, 2: -0.328961, 3: 1.644807}


def test_pearson(ratings):
    model = PearsonKNN().fit(ratings)
    s = {(r["user_id"], r["other"]): round(r["similarity"], 6) for r in model.neighbours.collect()}
    assert s == {(1, 2): 0.081349, (2, 1): 0.081349, (2, 3): 0.081349, (3, 2): 0.081349}
    got = grid(model, ratings)
    rows = [[0, 1.5, 3], [2, 2.25, 3.5], [1.5, 3, 4.5]]
    assert all(got[u + 1, i + 1] == pytest.approx(rows[u][i]) for u in range(3) for i in range(3))
    assert not PearsonKNN(min_k=2).fit(ratings).neighbours.filter("user_id <> 2").count()


def test_explicit_models_do_not_recommend():
    for model in (BaselineOnly, SlopeOne, PearsonKNN):
        assert issubclass(model, ExplicitModel) and not hasattr(model, "recommend")


def test_error_metrics(spark):
    truth = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0), (3, 4, 3.0)], "user_id long, item_id long, value double")
    same = truth.selectExpr("user_id", "item_id", "3.0D AS prediction")
    assert rmse(same, truth) == pytest.approx(1.5**0.5) and mae(same, truth) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        rmse(same.limit(1), truth)
    with pytest.raises(ValueError):
        mae(same, truth.limit(0))


def test_pearson_shuffles_no_pairs(spark, random_matrix, monkeypatch):
    """Neighbours and predictions, by brute force, without the pair sums that filled the disk."""
    from loomrec.plans import explicit

    def refuse(*args, **kwargs):
        raise AssertionError("pairs of users are summed after a shuffle")

    monkeypatch.setattr(explicit, "pair_sums", refuse)
    model = explicit.PearsonKNN(k=7).fit(random_matrix)
    by = {}
    for r in random_matrix.x.collect():
        by.setdefault(r["user_id"], {})[r["item_id"]] = r["value"]
    mean = {u: sum(v.values()) / len(v) for u, v in by.items()}
    norm = {u: sum(x * x for x in v.values()) ** 0.5 for u, v in by.items()}
    near = {}
    for u in by:
        s = [(sum((by[u][i] - mean[u]) * (by[o][i] - mean[o]) for i in by[u].keys() & by[o].keys()) / (norm[u] * norm[o]), o) for o in by if o != u]
        near[u] = sorted((-round(x, 9), o, x) for x, o in s if round(x, 12) > 0)[:7]
    got = {(r["user_id"], r["other"]): r["similarity"] for r in model.neighbours.collect()}
    assert set(got) == {(u, o) for u in near for _, o, _ in near[u]}
    assert all(abs(got[u, o] - x) < 1e-12 for u in near for _, o, x in near[u])
    asked = spark.createDataFrame([(u, i) for u in range(1, 41) for i in range(1, 26)], "user_id long, item_id long")
    for r in model.predict(asked).collect():
        u, i = r["user_id"], r["item_id"]
        met = [(x, by[o][i] - mean[o]) for _, o, x in near.get(u, []) if i in by[o]]
        want = mean.get(u, 0.0) + (sum(x * c for x, c in met) / sum(x for x, _ in met) if met else 0.0)
        assert abs(r["prediction"] - want) < 1e-9


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_neighbour_sums_shuffle_no_neighbours(spark, block):
    """Sums over neighbours with the asked item by brute force, repeated and unknown pairs included, in one block and in several."""
    import numpy as np

    from loomrec.operators.pairs import neighbour_sums

    rng = np.random.default_rng(12)
    near = {(u, o): float(rng.integers(1, 9)) for u in range(1, 30) for o in rng.choice(40, 6, replace=False).tolist()}
    rated = {(o, i): float(rng.integers(-3, 4)) for o in range(40) for i in range(25) if rng.random() < 0.3}
    asked = [(u, i) for u in range(0, 35, 2) for i in range(0, 30, 3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    neighbours = frame([(*k, v) for k, v in near.items()], "user_id long, other long, similarity double")
    values = frame([(*k, v) for k, v in rated.items()], "other long, item_id long, c double")
    got = neighbour_sums(neighbours, values, frame(asked + asked[:9], "user_id long, item_id long"), block_bytes=block)
    rows = got.collect()
    want = {}
    for u, i in asked:
        met = [(w, rated[o, i]) for (v, o), w in near.items() if v == u and (o, i) in rated]
        if met:
            want[u, i] = (sum(w * c for w, c in met), sum(w for w, _ in met))
    assert {(r["user_id"], r["item_id"]): (r["wc"], r["w"]) for r in rows} == want and len(rows) == len(want)


def test_pearson_prediction_shuffles_sums_only(spark, random_matrix):
    """What is exchanged is the asked pairs, means and sums: no join carries neighbours or their ratings."""
    model = PearsonKNN(k=7).fit(random_matrix)
    asked = spark.createDataFrame([(u, i) for u in range(1, 45) for i in range(1, 28)], "user_id long, item_id long")
    got = model.predict(asked)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "MapInArrow" in plan
    joined = asked.join(model.neighbours, "user_id").join(model.centred.withColumnRenamed("user_id", "other"), ["other", "item_id"])
    want = {}
    for r in joined.collect():
        s = want.setdefault((r["user_id"], r["item_id"]), [0.0, 0.0])
        s[0] += r["similarity"] * r["c"]
        s[1] += r["similarity"]
    mean = {r["user_id"]: r["mean"] for r in model.user_means.collect()}
    for r in got.collect():
        a, b = want.get((r["user_id"], r["item_id"]), (0.0, 1.0))
        assert abs(r["prediction"] - mean.get(r["user_id"], 0.0) - a / b) < 1e-9
