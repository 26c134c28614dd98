import numpy as np
import pytest
from conftest import dense, lists, matrix_of

from loomrec.operators.normal_equations import Rules, Table, half_sweep, half_sweep_joined, segments
from loomrec.plans.completion import PureSVD, SoftImpute, SoftSVD
from loomrec.plans.factorization import CachedALS, ElementwiseALS, WeightedMF, unobserved_weights
from loomrec.sources.models import load_model, save_model


def factors(df):
    return np.array([r["factors"] for r in df.orderBy("id").collect()])


def items_start(spark, n, rank=1):
    rows = [(i, [0.1 + 0.01 * ((i * (f + 1)) % 7) for f in range(rank)]) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id long, factors array<double>")


def test_rank_one_ladder(spark, ladder):
    model = WeightedMF(rank=1, solver="cholesky", max_iter=2, tol=-1).fit(ladder, item_init=items_start(spark, 10))
    assert factors(model.user_factors)[:, 0] == pytest.approx([1.721691, 2.067599, 2.197819, 2.202253, 2.187145, 2.165270, 2.023057, 1.688733], abs=1e-6)
    assert factors(model.item_factors)[:, 0] == pytest.approx([0.094598, 0.186319, 0.263137, 0.272947, 0.275040, 0.274495, 0.271292, 0.260802, 0.183840, 0.093074], abs=1e-6)
    assert model.loss(ladder) == pytest.approx(16.446725, abs=1e-6)


def implicit_sweep(x, y, reg, alpha, clamp=True):
    out = np.zeros((len(x), y.shape[1]))
    for u in range(len(x)):
        s = x[u] != 0
        c = 1 + alpha * x[u, s]
        a = y.T @ y + reg * np.eye(y.shape[1]) + (y[s] * (c - 1)[:, None]).T @ y[s]
        out[u] = np.linalg.solve(a, (y[s] * c[:, None]).sum(0)) if s.any() else 0
    return out


@pytest.mark.parametrize("kind", ["weighted", "cached"])
def test_cholesky_against_numpy(spark, random_matrix, kind):
    x, y = dense(random_matrix, 40, 25), factors(items_start(spark, 25, 3))
    for _ in range(3):
        u = implicit_sweep(x, y, 0.1, 2.0)
        y = implicit_sweep(x.T, u, 0.1, 2.0)
    cls = WeightedMF if kind == "weighted" else CachedALS
    model = cls(rank=3, alpha=2.0, reg=0.1, solver="cholesky", max_iter=3, tol=-1).fit(random_matrix, item_init=items_start(spark, 25, 3))
    assert factors(model.user_factors) == pytest.approx(u, abs=1e-8) and factors(model.item_factors) == pytest.approx(y, abs=1e-8)


def test_solvers_agree_at_convergence(random_matrix):
    args = dict(rank=4, max_iter=40, tol=-1, reg=1.0)
    a = WeightedMF(solver="cholesky", **args).fit(random_matrix).loss(random_matrix)
    b = WeightedMF(solver="cg", cg_steps=6, **args).fit(random_matrix).loss(random_matrix)
    assert a == pytest.approx(b, rel=1e-2)
    n = WeightedMF(solver="nonnegative", **args).fit(random_matrix)
    assert factors(n.user_factors).min() >= 0 and factors(n.item_factors).min() >= 0


def test_joined_path_equals_broadcast(spark, random_matrix, monkeypatch):
    for cls in (WeightedMF, CachedALS, ElementwiseALS):
        args = dict(rank=3, max_iter=2, tol=-1)
        start = items_start(spark, 25, 3)
        a = cls(**args).fit(random_matrix, item_init=start, user_init=items_start(spark, 40, 3))
        monkeypatch.setattr(cls, "broadcast_bytes", 10)
        b = cls(**args).fit(random_matrix, item_init=start, user_init=items_start(spark, 40, 3))
        monkeypatch.undo()
        assert factors(a.user_factors) == pytest.approx(factors(b.user_factors), abs=1e-8)
        assert factors(a.item_factors) == pytest.approx(factors(b.item_factors), abs=1e-8)


def test_joined_path_from_the_same_seed_folds_in_and_recommends(spark, random_matrix, monkeypatch):
    for args in (dict(feedback="implicit"), dict(feedback="explicit")):
        a = WeightedMF(rank=3, max_iter=2, tol=-1, seed=5, **args).fit(random_matrix)
        monkeypatch.setattr(WeightedMF, "broadcast_bytes", 10)
        b = WeightedMF(rank=3, max_iter=2, tol=-1, seed=5, **args).fit(random_matrix)
        folded, ranked = b.transform(random_matrix), b.recommend(random_matrix, 5).collect()
        monkeypatch.undo()
        assert factors(a.user_factors) == pytest.approx(factors(b.user_factors), abs=1e-8)
        assert factors(a.transform(random_matrix)) == pytest.approx(factors(folded), abs=1e-8)
        assert {(r["user_id"], r["rank"], r["item_id"]) for r in ranked} == {
            (r["user_id"], r["rank"], r["item_id"]) for r in a.recommend(random_matrix, 5).collect()
        }


def test_hot_entity_in_joined_parts(spark, random_matrix, monkeypatch):
    import loomrec.plans.factorization as fm

    sweep = fm.half_sweep_joined
    monkeypatch.setattr(WeightedMF, "broadcast_bytes", 10)
    a = WeightedMF(rank=2, max_iter=1, tol=-1).fit(random_matrix)
    monkeypatch.setattr(fm, "half_sweep_joined", lambda *args: sweep(*args, segment=3, group=7))
    b = WeightedMF(rank=2, max_iter=1, tol=-1).fit(random_matrix)
    assert factors(a.user_factors) == pytest.approx(factors(b.user_factors), abs=1e-10)


def test_hot_entity_in_segments(spark, random_matrix, monkeypatch):
    import loomrec.operators.normal_equations as ne

    other = Table(np.arange(1, 26), factors(items_start(spark, 25, 2)))
    mine = Table(np.arange(1, 41), np.zeros((40, 2)))
    rules = Rules("weighted", base=other.factors.T @ other.factors)
    whole = half_sweep(spark, segments(random_matrix.x, "user_id", "item_id", random_matrix.users), rules, mine, other)
    monkeypatch.setattr(ne, "SEGMENT", 3)
    parts = half_sweep(spark, segments(random_matrix.x, "user_id", "item_id", random_matrix.users), rules, mine, other)
    assert whole.factors == pytest.approx(parts.factors, abs=1e-10)


def test_biased_rank_one_system(spark, ratings):
    y = np.array([0.1, 0.2, 0.3])
    other = Table(np.array([1, 2, 3]), y[:, None], np.array([0.5, -0.5, 0.25]))
    mine = Table(np.array([1, 2, 3]), np.zeros((3, 1)))
    rules = Rules("biased", reg=0.1, mean=2.0, base=(y[:, None].T @ y[:, None]))
    got = half_sweep(spark, segments(ratings.x, "user_id", "item_id", ratings.users), rules, mine, other)
    for u, (i, r) in enumerate((([0, 1], [1, 2]), ([0, 2], [1, 4]), ([1, 2], [2, 4]))):
        e = np.stack([y[i], np.ones(2)], 1)
        a = e.T @ e + np.diag([(y**2).sum() + 0.1, 0.2])
        b = e.T @ (np.array(r) - 2.0 - other.extra[i])
        assert np.r_[got.factors[u], got.extra[u]] == pytest.approx(np.linalg.solve(a, b))


def test_biased_fits_ratings(spark):
    x = [[1, 2, 3, 4], [5, 6, 1, 8], [9, 2, 11, 12]]
    m = matrix_of(spark, [(u + 1, i + 1, x[u][i]) for u in range(3) for i in range(4)], range(1, 4), range(1, 5))
    model = WeightedMF(rank=2, reg=0.1, max_iter=50, feedback="explicit", solver="cholesky", tol=-1).fit(m)
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in model.predict(m.x).collect()}
    err = [got[u + 1, i + 1] - x[u][i] for u in range(3) for i in range(4)]
    assert np.sqrt(np.mean(np.square(err))) < 1.3
    assert len(lists(model.recommend(m, 2))[1]) == 2
    assert model.score_matrix(m).count() == 12


def test_fold_in_matches_fitted(random_matrix):
    model = WeightedMF(rank=4, solver="cholesky", max_iter=30, tol=-1, reg=1.0).fit(random_matrix)
    again = factors(model.transform(random_matrix))
    assert np.corrcoef(again.ravel(), factors(model.user_factors).ravel())[0, 1] > 0.99


def test_recommend_masks_seen(random_matrix):
    seen = {}
    for r in random_matrix.x.collect():
        seen.setdefault(r["user_id"], set()).add(r["item_id"])
    for model in (WeightedMF(rank=3, max_iter=2), CachedALS(rank=3, max_iter=2), ElementwiseALS(rank=3, max_iter=2)):
        recs = lists(model.fit(random_matrix).recommend(random_matrix, 5))
        assert len(recs) == 40
        assert all(len(set(r)) == 5 and not set(r) & seen.get(u, set()) for u, r in recs.items())


def test_dense_recommendation_in_blocks(random_matrix):
    from loomrec.operators.topk import recommend_dense

    model = WeightedMF(rank=3, max_iter=2).fit(random_matrix)
    one = recommend_dense(model.user_factors, model.item_factors, random_matrix.x, 6)
    many = recommend_dense(model.user_factors, model.item_factors, random_matrix.x, 6, block_bytes=300)
    assert lists(one) == lists(many)


def test_unobserved_weights(ladder):
    w = {r["id"]: round(r["weight"], 6) for r in unobserved_weights(ladder, 1.0, 0.5).collect()}
    assert w[1] == 0.065700 and w[3] == 0.113796


def test_elementwise_against_numpy(spark, random_matrix):
    x, rank = dense(random_matrix, 40, 25), 2
    c = {r["id"]: r["weight"] for r in unobserved_weights(random_matrix, 1.0, 0.5).collect()}
    c = np.array([c[i] for i in range(1, 26)])
    u, v = factors(items_start(spark, 40, rank)), factors(items_start(spark, 25, rank))
    su = (v * c[:, None]).T @ v
    for a in range(40):
        s = np.flatnonzero(x[a])
        for f in range(rank) if len(s) else ():
            y = v[s] @ u[a] - u[a, f] * v[s, f]
            top = (v[s, f] * ((1 + c[s]) - y)).sum() - sum(u[a, g] * su[g, f] for g in range(rank) if g != f)
            u[a, f] = top / (su[f, f] + 0.01 + (v[s, f] ** 2).sum())
    sv = u.T @ u
    for b in range(25):
        s = np.flatnonzero(x[:, b])
        for f in range(rank):
            y = u[s] @ v[b] - v[b, f] * u[s, f]
            top = (u[s, f] * ((1 + c[b]) - y)).sum() - c[b] * sum(v[b, g] * sv[g, f] for g in range(rank) if g != f)
            v[b, f] = top / (c[b] * sv[f, f] + 0.01 + (u[s, f] ** 2).sum())
    model = ElementwiseALS(rank=rank, max_iter=1, tol=-1).fit(random_matrix, items_start(spark, 40, rank), items_start(spark, 25, rank))
    assert factors(model.user_factors) == pytest.approx(u, abs=1e-9) and factors(model.item_factors) == pytest.approx(v, abs=1e-9)


def test_elementwise_update_takes_new_users(spark, ladder):
    model = ElementwiseALS(rank=2, max_iter=2).fit(ladder)
    grown = matrix_of(spark, [(r["user_id"], r["item_id"], r["value"]) for r in ladder.x.collect()] + [(9, 1, 1.0)], range(1, 10), range(1, 12))
    model.update(grown)
    assert model.user_factors.count() == 9 and model.item_factors.count() == 11


def test_losses_fall(random_matrix):
    from loomrec.plans.callbacks import LossHistory

    for model in (WeightedMF(rank=3, max_iter=4, tol=-1, solver="cholesky"), CachedALS(rank=3, max_iter=4, tol=-1), ElementwiseALS(rank=3, max_iter=4, tol=-1)):
        h = LossHistory()
        model.fit(random_matrix, callbacks=[h])
        assert len(h.losses) == 4 and h.losses[-1] <= h.losses[0]


def test_loss_of_the_loop_is_the_objective(random_matrix):
    from loomrec.plans.callbacks import LossHistory

    for model in (
        WeightedMF(rank=3, max_iter=2, tol=-1), WeightedMF(rank=3, max_iter=2, tol=-1, feedback="explicit"),
        CachedALS(rank=3, max_iter=2, tol=-1), ElementwiseALS(rank=3, max_iter=2, tol=-1),
    ):
        h = LossHistory()
        assert model.fit(random_matrix, callbacks=[h]).loss(random_matrix) == pytest.approx(h.losses[-1])


def test_svd_against_numpy(random_matrix):
    x = dense(random_matrix, 40, 25)
    s = np.linalg.svd(x)[1]
    pure = PureSVD(rank=4, max_iter=300, conv=1e-10).fit(random_matrix)
    assert pure.singular == pytest.approx(s[:4], rel=1e-3)
    u = factors(pure.user_factors)
    assert u.T @ u == pytest.approx(np.eye(4), abs=1e-8)
    soft = SoftSVD(rank=4, reg=2.0, max_iter=300, conv=1e-10).fit(random_matrix)
    assert soft.singular == pytest.approx(np.maximum(s[:4] - 2, 0), rel=1e-2)


def test_soft_impute_recovers_low_rank(spark):
    rng = np.random.default_rng(1)
    full = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 20))
    mask = rng.random((30, 20)) < 0.6
    m = matrix_of(spark, [(u + 1, i + 1, full[u, i]) for u, i in zip(*np.nonzero(mask))], range(1, 31), range(1, 21))
    model = SoftImpute(rank=2, max_iter=200, conv=1e-9).fit(m)
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in model.predict(m.users.join(m.items)).collect()}
    err = [got[u + 1, i + 1] - full[u, i] for u, i in zip(*np.nonzero(~mask))]
    assert np.sqrt(np.mean(np.square(err))) < 0.1 * full.std()


def test_save_and_load(spark, random_matrix, tmp_path):
    model = WeightedMF(rank=3, max_iter=2, feedback="explicit").fit(random_matrix)
    save_model(model, str(tmp_path / "m"))
    save_model(model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again == model and again.mean == model.mean
    assert sorted(again.predict(random_matrix.x).collect()) == sorted(model.predict(random_matrix.x).collect())
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError):
        save_model(model, str(tmp_path / "other"))


def test_failed_refit_keeps_the_model(spark, random_matrix):
    model = CachedALS(rank=3, max_iter=1).fit(random_matrix)
    before = factors(model.user_factors)
    with pytest.raises(ValueError):
        model.fit(matrix_of(spark, [(1, 1, -1.0)], [1], [1]))
    assert model.is_fitted and factors(model.user_factors) == pytest.approx(before)


def test_cosine_neighbours(spark):
    from loomrec.operators.topk import similar_all, similar_to

    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0])], "id long, factors array<double>")
    got = [(r["id"], round(r["similarity"], 6)) for r in similar_to(f, 1, 9).orderBy("rank").collect()]
    assert got == [(2, 1.0), (5, 0.707107), (3, 0.0), (4, 0.0)]
    assert similar_to(f, 4, 3).count() == 0
    with pytest.raises(ValueError):
        similar_to(f, 9, 3)
    both = [(r["id"], round(r["similarity"], 6)) for r in similar_all(f, f, 9).filter("query = 1").orderBy("rank").collect()]
    assert both == got
