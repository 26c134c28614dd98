import numpy as np
import pytest
from conftest import lists, matrix_of
from pyspark.sql import functions as F

from loomrec.plans import shards
from loomrec.plans.callbacks import STOP, Callback, Checkpoint, ConvergenceMonitor, EarlyStopping, LearningRate, LossHistory
from loomrec.plans.explicit import BaselineOnly
from loomrec.plans.factorization import CachedALS, ElementwiseALS, WeightedMF
from loomrec.plans.itemsim import ItemKNN
from loomrec.plans.regression import FTRL, FactorizationMachine
from loomrec.plans.search import cross_validate, grid_search, random_search
from loomrec.plans.stochastic import GlobalVectors, LogisticMF, PairwiseRanking, ProbabilisticMF
from loomrec.sources.models import load_model
from loomrec.streaming.updates import extend_matrix_from_stream, learn_from_stream, running_sums


def samples(spark, x, y, weight=None):
    rows = [(s, float(y[s]), float(weight[s]) if weight is not None else 1.0, [int(j) for j in np.flatnonzero(x[s])], [float(v) for v in x[s][np.flatnonzero(x[s])]]) for s in range(len(x))]
    return spark.createDataFrame(rows, "sample_id long, y double, weight double, idx array<int>, val array<double>")


def ftrl_by_hand(x, y, lr, beta, l1, l2, epochs):
    z, n = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weights = lambda: np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / lr + l2))
    for _ in range(epochs):
        for row, t in zip(x, y):
            w = weights()
            g = (1 / (1 + np.exp(-row @ w)) - t) * row
            s = (np.sqrt(n + g * g) - np.sqrt(n)) / lr
            z += np.where(row != 0, g - s * w, 0)
            n += g * g
    return weights()


def test_ftrl_against_hand(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.5)
    y = (x[:, 0] > 0).astype(float)
    model = FTRL(lr=0.3, lr_decay=0.7, reg=0.4, l1_ratio=0.25, max_iter=2).fit(samples(spark, x, y))
    assert model.weights() == pytest.approx(ftrl_by_hand(x, y, 0.3, 0.7, 0.1, 0.3, 2), abs=1e-12)
    got = {r["sample_id"]: r["prediction"] for r in model.predict(samples(spark, x, y)).collect()}
    assert [got[s] for s in range(40)] == pytest.approx(1 / (1 + np.exp(-x @ model.weights())))
    assert model.coef(spark).count() == 6
    with pytest.raises(ValueError):
        model.update(samples(spark, np.ones((1, 9)), [1]))
    with pytest.raises(ValueError):
        FTRL().fit(samples(spark, np.full((1, 2), np.nan), [1]))


def test_ftrl_in_shards_learns(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((600, 20)) < 0.3).astype(float)
    y = (x[:, :3].sum(1) > 0).astype(float)
    model = FTRL(max_iter=4, n_shards=3).fit(samples(spark, x, y))
    p = 1 / (1 + np.exp(-x @ model.weights()))
    assert ((p > 0.5) == (y > 0)).mean() > 0.8


def test_machine_learns_xor(spark):
    x, y = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]]), [0, 1, 1, 0]
    solved = 0
    for seed in range(3):
        model = FactorizationMachine(rank=2, lr_w=10.0, max_iter=200, seed=seed).fit(samples(spark, x, y))
        got = {r["sample_id"]: r["prediction"] for r in model.predict(samples(spark, x, y)).collect()}
        solved += all((got[s] > 0.5) == bool(y[s]) for s in range(4))
    assert solved >= 2


def test_machine_prediction_is_dense_formula(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(10, 5)) * (rng.random((10, 5)) < 0.6)
    model = FactorizationMachine(rank=3, family="gaussian", max_iter=2, lr_w=0.05).fit(samples(spark, x, x[:, 0]))
    w, v = np.array(model.w), np.array(model.v)
    want = model.w0 + x @ w + 0.5 * (((x @ v) ** 2).sum(1) - ((x**2) @ (v**2)).sum(1))
    got = {r["sample_id"]: r["prediction"] for r in model.predict(samples(spark, x, x[:, 0])).collect()}
    assert [got[s] for s in range(10)] == pytest.approx(want)


def blocks(spark):
    cells = [(u, i, 1.0) for u in range(1, 21) for i in range(1, 11) if (u <= 10) == (i <= 5) and (u + i) % 4]
    return matrix_of(spark, cells, range(1, 21), range(1, 11)).settled()


@pytest.mark.parametrize("sampling", ["uniform", "popular", "dynamic"])
def test_pairwise_ranking_separates_blocks(spark, sampling):
    m = blocks(spark)
    h = LossHistory()
    model = PairwiseRanking(rank=4, lr=0.2, max_iter=20, n_samples=2000, sampling=sampling).fit(m, callbacks=[h])
    assert sampling == "dynamic" or h.losses[-1] < h.losses[0]  # dynamic negatives get harder as the model learns
    scores = {(r["user_id"], r["item_id"]): r["score"] for r in model.score().collect()}
    inside = np.mean([s for (u, i), s in scores.items() if (u <= 10) == (i <= 5)])
    assert inside > np.mean([s for (u, i), s in scores.items() if (u <= 10) != (i <= 5)])


def test_pairwise_ranking_degenerate(spark):
    with pytest.raises(ValueError):
        PairwiseRanking().fit(matrix_of(spark, [(1, 1, 1), (1, 2, 1)], [1], [1, 2]))
    PairwiseRanking(rank=2, max_iter=1).fit(matrix_of(spark, [(1, 1, 1), (1, 2, 1), (2, 1, 1)], [1, 2], [1, 2]))


def test_global_vectors(spark):
    pairs = [(i, j, 5.0) for b in (0, 10) for i in range(1 + b, 11 + b) for j in range(1 + b, 11 + b) if i != j]
    table = spark.createDataFrame(pairs, "word long, context long, count double")
    h = LossHistory()
    model = GlobalVectors(rank=6, max_iter=30).fit(table, callbacks=[h])
    assert h.losses[-1] < h.losses[0] and model.embeddings().count() == 20
    recs = lists(model.recommend(k=3, exclude_self=True))
    assert all(set(r).isdisjoint(range(1, 11) if u <= 10 else range(11, 21)) for u, r in recs.items())
    with pytest.raises(ValueError):
        GlobalVectors().fit(spark.createDataFrame([(1, 2, 0.0)], "word long, context long, count double"))


def test_logistic_and_probabilistic(spark):
    m = blocks(spark)
    for optimizer in ("adagrad", "rmsprop"):
        h = LossHistory()
        LogisticMF(rank=3, max_iter=6, lr=0.1, n_negative=3, optimizer=optimizer).fit(m, callbacks=[h])
        assert h.losses[-1] < h.losses[0]
    h = LossHistory()
    model = ProbabilisticMF(rank=3, max_iter=30, lr=0.05).fit(m, callbacks=[h])
    assert h.losses[-1] < h.losses[0]
    assert model.predict(m.x).count() == m.x.count() and not hasattr(model, "recommend")


def spread(spark, n_users=60, n_items=40):
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(n_users, 2)), rng.normal(size=(n_items, 2))
    cells = [(u + 1, i + 1, float(p[u] @ q[i])) for u in range(n_users) for i in range(n_items) if rng.random() < 0.5]
    return matrix_of(spark, cells, range(1, n_users + 1), range(1, n_items + 1)).settled()


def fit_losses(model, data):
    h = LossHistory()
    model.fit(data, callbacks=[h])
    return h.losses


def test_shards_reach_the_loss_of_one(spark):
    m = spread(spark)
    for model in (lambda s: ProbabilisticMF(rank=3, max_iter=5, lr=0.05, n_shards=s), lambda s: PairwiseRanking(rank=3, max_iter=5, lr=0.2, n_samples=4000, n_shards=s)):
        one, four = fit_losses(model(1), m), fit_losses(model(4), m)
        assert one[0] - four[-1] > 0.85 * (one[0] - one[-1]), (one, four)
    pairs = spark.createDataFrame([(i, j, 1.0 + i * j % 50) for i in range(1, 41) for j in range(1, 41) if i != j], "word long, context long, count double")
    one, four = (fit_losses(GlobalVectors(rank=3, max_iter=5, n_shards=s), pairs) for s in (1, 4))
    assert one[0] - four[-1] > 0.85 * (one[0] - one[-1]), (one, four)


def test_cells_train_every_sample_on_rows_of_their_own(spark):
    m = spread(spark)
    params = {"u": np.zeros(61), "v": np.zeros(41)}

    def count(columns, p, shard, turn):
        np.add.at(p["u"], columns["user_id"], 1.0)
        np.add.at(p["v"], columns["item_id"], 1.0)
        return len(columns["user_id"])

    dealt = shards.cells(m.x, 5, "user_id", "item_id")
    assert not dealt.groupBy("_turn", "item_id").agg(F.count_distinct("_shard").alias("n")).filter("n > 1").count()
    got = shards.cell_epoch(dealt, 5, ["user_id", "item_id"], params, count)
    for key, column in (("u", "user_id"), ("v", "item_id")):
        want = {r[column]: r["count"] for r in m.x.groupBy(column).count().collect()}
        assert {k: int(v) for k, v in enumerate(got["params"][key]) if v} == want
    assert got["n"] == m.x.count() == got["loss"]


def test_rows_of_one_shard_take_their_whole_change(spark):
    rows = spark.createDataFrame([(s,) for s in range(40)], "sample_id long")

    def mark(columns, p, shard):
        p["own"][columns["sample_id"]] += 1.0
        p["all"] += 1.0
        return 0.0

    got = shards.epoch(spark, rows, 4, ["sample_id"], "sample_id", {"own": np.zeros(40), "all": np.zeros((2, 3))}, mark)["params"]
    assert (got["own"] == 1).all() and (got["all"] == 1).all()


def test_logistic_segments_follow_the_whole_entity(spark, monkeypatch):
    from loomrec.operators import normal_equations

    m = spread(spark)
    fitted = []
    for size in (8_192, 7):
        monkeypatch.setattr(normal_equations, "SEGMENT", size)
        model = LogisticMF(rank=3, max_iter=2, lr=0.1, n_negative=3).fit(m)
        fitted.append({r["id"]: r["factors"] for r in model.item_factors.collect()})
    assert all(fitted[1][i] == pytest.approx(f, abs=1e-9) for i, f in fitted[0].items())


def test_monitor():
    m = ConvergenceMonitor(0.01, 3)
    assert [m.record(v) for v in (1.0, 1.0, 1.0)] == [False, False, True]
    assert not any(ConvergenceMonitor(-1).record(1.0) for _ in range(5))


def test_callbacks(spark, ladder, tmp_path):
    class Count(Callback):
        calls: list = []

        def on_epoch_end(self, info):
            self.calls.append(info.epoch)
            return STOP if info.epoch == 2 else None

    count, never = Count(), LossHistory()
    model = WeightedMF(rank=2, max_iter=9, tol=-1).fit(ladder, callbacks=[Checkpoint(str(tmp_path), every=2), count, never])
    assert count.calls == [1, 2] and len(never.losses) == 1
    assert load_model(spark, str(tmp_path / "model_epoch_2")).rank == model.rank
    early = EarlyStopping(patience=2, min_delta=1e9)
    h = LossHistory()
    CachedALS(rank=2, max_iter=9, tol=-1).fit(ladder, callbacks=[h, early])
    assert len(h.losses) == 3
    model = PairwiseRanking(rank=2, max_iter=2, lr=0.1)
    model.fit(ladder, callbacks=[LearningRate(decay=0.5)])
    assert model.lr == 0.1


def test_search(ladder):
    got = cross_validate(lambda: ItemKNN(k=3), ladder, n_folds=2, k=3)
    assert len(got["scores"]) == 2 and 0 <= got["mean"] <= 1 and got["std"] >= 0
    best = grid_search(ItemKNN, ladder, {"k": [0, 3], "similarity": ["cosine", "jaccard"]}, k=3)
    assert best.params["k"] == 3 and [s for p, s in best.trials if p["k"] == 0] == [float("-inf")] * 2
    drawn = random_search(ItemKNN, ladder, {"k": lambda rng: int(rng.integers(1, 5))}, n_trials=2, k=3)
    assert drawn.score == max(s for _, s in drawn.trials)


def test_learning_from_a_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    y = (x[:, 0] > 0).astype(float)
    rows = samples(spark, x, y)
    for k in range(3):
        rows.filter(f"sample_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model, seen = FTRL(), []
    learn_from_stream(model, stream, str(tmp_path / "cp"), after=lambda m, b: seen.append(b)).awaitTermination(120)
    assert model.is_fitted and len(seen) == 3


def test_growing_matrix_from_a_stream(spark, ladder, tmp_path):
    rows = spark.createDataFrame([(9, 11, 1.0), (1, 1, 2.0), (None, 1, 1.0), (2, 2, float("nan"))], "user_id long, item_id long, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    model = ElementwiseALS(rank=2, max_iter=1).fit(ladder)
    query = extend_matrix_from_stream(model, ladder, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.matrix[0].x.count() == 25 and model.user_factors.count() == 9 and model.item_factors.count() == 11


def test_running_sums(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1.0, "2024-01-01 10:00:00"), (1, 1, 1.0, "2024-01-01 10:00:00"), (1, 1, 2.0, "2024-01-01 11:00:00"), (1, None, 1.0, None)], "user_id long, item_id long, value double, t string")
    rows = rows.selectExpr("user_id", "item_id", "value", "CAST(t AS TIMESTAMP) AS t")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    sums = running_sums(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t")
    query = sums.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["value"] for r in spark.table("sums").collect()] == [3.0]


def test_non_finite_values_are_rejected(spark):
    m = matrix_of(spark, [(1, 1, float("inf")), (2, 1, 1.0)], [1, 2], [1, 2])
    for model in (WeightedMF(), CachedALS(), ElementwiseALS(), PairwiseRanking(), LogisticMF(), ProbabilisticMF(), BaselineOnly()):
        with pytest.raises(ValueError, match=type(model).__name__):
            model.fit(m)
        assert not model.is_fitted
