"""Row products and nearest rows: what no shuffle of pairs may be needed for."""

import numpy as np
import pytest

from conftest import dense
from loomrec.operators.matrix import gram
from loomrec.operators.pairs import row_products


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_user_gram_from_row_products(spark, random_matrix, block):
    a = dense(random_matrix, 40, 25)
    got = row_products(random_matrix.x, "item_id", "user_id", "value", block_bytes=block).collect()
    both = (a != 0).astype(int) @ (a != 0).T
    assert len(got) == (both > 0).sum()
    for r in got:
        i, j = r["src"] - 1, r["dst"] - 1
        assert r["n"] == both[i, j] and np.isclose(r["dot"], (a @ a.T)[i, j])


def test_user_pairs_are_not_shuffled(spark, random_matrix):
    plan = physical(gram(random_matrix, side="user", diagonal=False))
    assert "MapInArrow" in plan and "Exchange" not in plan
    assert not gram(random_matrix, side="user", diagonal=False).filter("src = dst").count()


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_nearest_rows(spark, block):
    from loomrec.operators.pairs import nearest_rows

    rng = np.random.default_rng(3)
    a = np.where(rng.random((60, 12)) < 0.3, rng.integers(-2, 3, (60, 12)), 0).astype(float)
    rows = spark.createDataFrame([(int(u) + 1, int(i), float(a[u, i])) for u, i in zip(*np.nonzero(a))], "u long, g long, v double")
    got = {}
    for r in nearest_rows(rows, "g", "u", "v", 5, 9, block_bytes=block).collect():
        got.setdefault(r["src"], []).append((-r["similarity"], r["dst"]))
    s = a @ a.T
    for u in range(60):  # whole numbers: many ties, which go to the smaller id
        want = sorted((-s[u, o], o + 1) for o in range(60) if o != u and s[u, o] > 0)[:5]
        assert sorted(got.get(u + 1, [])) == want


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_score_totals(spark, block):
    from loomrec.operators.topk import score_totals

    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(30, 3)), rng.normal(size=(300, 3)) * rng.random((300, 1)) ** 4
    u[7] = 0
    v[:200] -= 5  # some users have no score above 0
    frame = lambda a: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "id long, factors array<double>")
    totals = score_totals(frame(u), frame(v), block_bytes=block)
    assert not any(x in physical(totals) for x in ("NestedLoop", "Cartesian"))
    got = {r["user_id"]: r for r in totals.collect()}
    assert len(got) == 30
    for i, s in enumerate(u @ v.T):
        assert got[i]["n"] == 300 and np.isclose(got[i]["total"], s.sum()) and np.isclose(got[i]["best"], s.max())


@pytest.mark.parametrize("biased", [False, True])
def test_dense_kernel_leaves_out_what_cant_reach_the_list(biased):
    """Equal to full scoring, ties, hidden items and users without factors included, and most scores are never computed."""
    import pyarrow as pa

    from loomrec.operators.topk import _dense_kernel

    rng, n, k = np.random.default_rng(6), 3_000, 5
    ids = np.sort(rng.choice(10_000, n, replace=False)).astype(np.int64)
    table = np.round(np.abs(rng.normal(size=(n, 3))), 1) * np.where(rng.random((n, 1)) < 0.05, 1, 0.1)
    table[rng.random(n) < 0.1] = 0
    bias = np.round(rng.normal(size=n), 1) if biased else None
    users = np.round(np.abs(rng.normal(size=(40, 3))), 1)
    users[3] = 0
    users[5] *= -1
    seen = [list(rng.choice(ids, 20, replace=False)) for _ in users]
    seen[9], seen[10] = list(ids[2:]), list(ids)  # fewer unseen items than k
    seen[3] = list(ids[:3]) + [-7]
    batch = pa.record_batch([pa.array(np.arange(40)), pa.array([list(u) for u in users]), pa.array([[int(i) for i in s] for s in seen], pa.list_(pa.int64()))], names=["a", "b", "c"])
    got = {}
    for out in _dense_kernel([batch], ids, table, bias, k):
        for u, i, v, hidden in zip(*(c.to_pylist() for c in out.columns)):
            got.setdefault(u, []).append((hidden, 0.0 if hidden else -v, i))
    for u in range(40):
        s = np.round(users[u] @ table.T + (bias if biased else 0), 9) + 0.0
        own = set(seen[u])
        want = sorted((int(i) in own, 0.0 if int(i) in own else -x, int(i)) for i, x in zip(ids, s))[:k]
        assert sorted(got[u]) == want


def test_dense_kernel_work(monkeypatch):
    import pyarrow as pa

    from loomrec.operators import topk

    rng = np.random.default_rng(8)
    table = np.abs(rng.normal(size=(20_000, 4)))
    table[2_000:] *= 0.01
    ranked = []
    rounded = np.round
    monkeypatch.setattr(topk.np, "round", lambda x, *a: ranked.append(np.size(x)) or rounded(x, *a))
    users = np.abs(rng.normal(size=(200, 4)))
    batch = pa.record_batch([pa.array(np.arange(200)), pa.array(list(users)), pa.array([[]] * 200, pa.list_(pa.int64()))], names=["a", "b", "c"])
    out = list(topk._dense_kernel([batch], np.arange(20_000), table, None, 10))
    assert sum(b.num_rows for b in out) == 2_000
    assert sum(ranked) < 200 * 20_000 / 10  # every score was rounded and ranked before


def test_joined_sweep_ships_no_systems_of_cold_entities(spark, random_matrix, monkeypatch):
    from pyspark.sql import functions as F

    from loomrec.operators import normal_equations as ne

    seen, keep = [], ne.stow
    monkeypatch.setattr(ne, "stow", lambda df, **a: seen.append(df.columns) or keep(df, **a))
    vectors = lambda ids, c: ids.select(F.col(c).alias("id"), F.array(F.lit(0.1), (F.col(c) % 3) / 10).alias("factors"), F.lit(0.0).alias("extra"))
    u, v = vectors(random_matrix.users, "user_id"), vectors(random_matrix.items, "item_id")
    got = ne.half_sweep_joined(random_matrix.x, "user_id", "item_id", random_matrix.users, ne.Rules("cached", base=np.eye(2)), u, v)
    assert got.count() == 40 and hasattr(got, "_stowed_at")
    assert len(seen) == 2  # the hot entities, of which there are none, and the result: no second pass over systems
    path = got._stowed_at
    assert not spark.read.parquet(path).filter("s IS NOT NULL").count()
