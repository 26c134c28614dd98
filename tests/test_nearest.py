"""Nearest rows: hot lists are read in part, neighbours of no block are shuffled, sums need no neighbours at hand."""

import numpy as np
import pytest

from loomrec.operators import nearest


class Shared:
    def __init__(self, value):
        self.value = value


def block_of(a, parts=2):
    """A held block of the entries of ``a`` that are not 0, with shifts and scales, and the values that count."""
    shift, scale = np.arange(len(a)) % 4 / 10, 1 + np.arange(len(a)) % 5 / 7
    table, dealt = np.unique(a[a != 0]), []
    for p in range(parts):
        g, m = np.nonzero(np.where(np.arange(a.shape[1]) % parts == p, a, 0).T)
        keys, counts = np.unique(g, return_counts=True)
        dealt.append(Shared([nearest._packed(x) for x in (keys, counts, m.astype(np.int32), np.searchsorted(table, a[m, g]).astype(np.uint8))]))
    about = [nearest._packed(x) for x in (np.arange(len(a)) * 3, shift, scale, table)]
    return nearest._Block(about, dealt, np.count_nonzero(a)), np.where(a != 0, (a - shift[:, None]) * scale[:, None], 0)


@pytest.mark.parametrize("hot", [5, 60, 10_000])
def test_nearest_of_hot_lists(monkeypatch, hot):
    """Equal to all products where lists are hot, partly hot or short; ties go to the smaller id."""
    monkeypatch.setattr(nearest, "HOT", hot)
    monkeypatch.setattr(nearest, "BUFFER", 300)
    rng = np.random.default_rng(1)
    a = np.where(rng.random((400, 30)) < np.r_[np.full(5, 0.5), np.full(25, 0.05)], rng.integers(-3, 4, (400, 30)), 0).astype(float)
    a[200:260] = a[100:160]  # with the shifts and scales of the rows they copy
    block, values = block_of(a)
    assert len(block.lists) == {5: 30, 60: 5, 10_000: 0}[hot]
    rows = [np.flatnonzero(values[u]) for u in range(400)]
    off = np.r_[0, np.cumsum([len(r) for r in rows])]
    got = list(block.nearest(np.arange(400) * 3, off, np.concatenate(rows), np.concatenate([values[u, r] for u, r in enumerate(rows)]), 7, 9, None))
    s = values @ values.T
    for u in range(400):
        want = sorted((-round(s[u, o], 9), o) for o in range(400) if o != u and round(s[u, o], 12) > 0)[:7]
        assert [int(x) for x in got[u][0]] == [o for _, o in want]
        assert np.allclose(got[u][1], [-x for x, _ in want])


def test_hot_lists_are_read_in_part(monkeypatch):
    """Most products with a hot list's members are never taken."""
    monkeypatch.setattr(nearest, "HOT", 100)
    rng = np.random.default_rng(3)
    a = np.where(rng.random((6_000, 40)) < np.r_[np.full(4, 0.4), np.full(36, 0.01)], rng.integers(1, 11, (6_000, 40)) / 2, 0)
    a *= (rng.random((6_000, 1)) ** 3 * 20).round() / 2 + 0.5
    block, values = block_of(a)
    scored, take = [], block.scores
    block.scores = lambda m: scored.append(len(m)) or take(m)
    some = [np.flatnonzero(values[u]) for u in range(300)]
    off = np.r_[0, np.cumsum([len(r) for r in some])]
    got = list(block.nearest(np.arange(300) * 3, off, np.concatenate(some), np.concatenate([values[u, r] for u, r in enumerate(some)]), 5, 9, None))
    assert len(got) == 300 and sum(scored) < sum((values[:, r] != 0).sum() for r in some) / 10


def test_neighbours_of_blocks_are_not_shuffled(spark):
    """Every block's first k went through a window, which filled the disk at 1 GB; a task takes one block after the other instead."""
    rows = spark.createDataFrame([(u, g, float(1 + (u * g) % 5)) for u in range(30) for g in range(u % 4, 12, 3)], "u long, g long, v double")
    got = nearest.nearest_rows(rows, "g", "u", "v", 4, 9, block_bytes=320)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Window" not in plan
    assert got.count() == 30 * 4


@pytest.mark.parametrize("held", [10**6, 25])
@pytest.mark.parametrize("least", [1, 4])
def test_pearson_sums_in_one_block_and_in_several(spark, random_matrix, monkeypatch, held, least):
    """Predictions by brute force; a centred rating of 0 counts, rows of zeros have no neighbours, unknown ids are asked for."""
    from loomrec.plans.explicit import PearsonKNN
    from loomrec.sources.triplets import Interactions

    monkeypatch.setattr(nearest, "HELD_ENTRIES", held)
    more = spark.createDataFrame([(1, 90, 2.0), (1, 91, 2.0), (41, 1, 0.0), (41, 2, 0.0)], "user_id long, item_id long, value double")
    ids = lambda name, top: spark.range(1, top).withColumnRenamed("id", name)
    m = Interactions(random_matrix.x.union(more), ids("user_id", 43), ids("item_id", 93)).settled()
    model = PearsonKNN(k=6, min_k=least).fit(m)
    asked = spark.createDataFrame([(u, i) for u in range(1, 46) for i in [*range(1, 27), 90, 95]], "user_id long, item_id long")
    by, near = {}, {}
    for r in m.x.collect():
        by.setdefault(r["user_id"], {})[r["item_id"]] = r["value"]
    mean = {u: sum(v.values()) / len(v) for u, v in by.items()}
    for r in model.neighbours.collect():
        near.setdefault(r["user_id"], []).append((r["other"], r["similarity"]))
    assert 41 not in near and all(least <= len(n) <= 6 for n in near.values())
    rows = model.predict(asked).collect()
    assert len(rows) == 45 * 28
    for r in rows:
        u, i = r["user_id"], r["item_id"]
        met = [(s, by[o][i] - mean[o]) for o, s in near.get(u, []) if i in by[o]]
        want = mean.get(u, 0.0) + (sum(s * c for s, c in met) / sum(s for s, _ in met) if met else 0.0)
        assert abs(r["prediction"] - want) < 1e-9
