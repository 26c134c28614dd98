import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomrec.llm.cooccurrence import cooccurring_items
from loomrec.llm.group_topn import top_n_of_sums, top_n_per_group
from loomrec.llm.heavy_hitters import frequent_values


def baskets(seed, n_baskets=40, n_items=30):
    rng = random.Random(seed)
    rows = []
    for b in range(n_baskets):
        for i in rng.sample(range(n_items), rng.randint(1, 12)):
            rows += [(b, i)] * rng.randint(1, 2)
    rows += [(1000, i) for i in range(n_items)] + [(1001, i) for i in range(0, n_items, 2)]
    return rows + [(None, 3), (5, None), (None, None)]


def brute_pairs(rows, min_count, min_lift):
    sets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            sets[b].add(i)
    n_item = Counter(i for s in sets.values() for i in s)
    n_pair = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    n = len(sets)
    return {
        (a, b, c)
        for (a, b), c in n_pair.items()
        if c >= min_count and c * n / (n_item[a] * n_item[b]) >= min_lift
    }


@pytest.mark.parametrize("heavy,tile", [(4096, 512), (8, 512), (4096, 5), (8, 4)])
@pytest.mark.parametrize("min_count,min_lift", [(1, 0.0), (3, 1.1), (5, 0.0)])
def test_pairs_against_brute_force(spark, heavy, tile, min_count, min_lift):
    rows = baskets(7)
    df = spark.createDataFrame(rows, "user long, item long")
    got = cooccurring_items(df, "user", "item", min_count=min_count, min_lift=min_lift, heavy_basket=heavy, tile=tile)
    assert {(r["item_a"], r["item_b"], r["n_ab"]) for r in got.collect()} == brute_pairs(rows, min_count, min_lift)


def test_pairs_of_odd_tables(spark):
    schema = "basket long, item long, n_ab long, size string"
    assert cooccurring_items(spark.createDataFrame([], schema), "basket", "item").count() == 0
    rows = [(1, 5, 9, "x"), (1, 7, 9, "y"), (1, 7, 9, "y"), (2, 5, None, None)]
    (r,) = cooccurring_items(spark.createDataFrame(rows, schema), "basket", "item").collect()
    assert (r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"]) == (5, 7, 1, 2, 1)
    assert r["lift"] == pytest.approx(1.0) and r["pmi"] == pytest.approx(0.0)
    big = [(1, 2**62), (1, -5), (2, 2**62), (2, -5)]
    (r,) = cooccurring_items(spark.createDataFrame(big, "b long, i long"), "b", "i").collect()
    assert (r["item_a"], r["item_b"], r["n_ab"]) == (-5, 2**62, 2)


@pytest.mark.parametrize("node_values", [1 << 20, 7])
def test_frequent_values_against_brute_force(spark, node_values):
    rng = random.Random(3)
    values = [None if rng.random() < 0.1 else int(rng.paretovariate(0.7)) for _ in range(3000)]
    df = spark.createDataFrame([(v, 1) for v in values], "item long, n long").repartition(7)
    counts = Counter(v for v in values if v is not None)
    for k in (1, 5, 50, 10_000):
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
        got = frequent_values(df, "item", k=k, node_values=node_values)
        assert [(r["value"], r["n"]) for r in got.collect()] == want
    for share in (0.3, 0.01, 0.0004):
        got = frequent_values(df, "item", min_share=share, node_values=node_values)
        assert {r["value"]: r["n"] for r in got.collect()} == {v: c for v, c in counts.items() if c >= share * len(values)}


def test_frequent_values_of_odd_tables(spark):
    empty = spark.createDataFrame([], "value string, node long")
    assert frequent_values(empty, "value", k=3).count() == 0 and frequent_values(empty, "value", min_share=0.5).count() == 0
    nulls = spark.createDataFrame([(None, 1)] * 3, "value string, node long")
    assert frequent_values(nulls, "value", k=3).count() == 0
    one = nulls.select("value")
    mixed = one.union(one).union(one.limit(1).select(F.lit("5").alias("value"))).repartition(7)
    share = 1 / mixed.count()
    assert frequent_values(mixed, "value", min_share=share).count() == 1 and frequent_values(mixed, "value", min_share=share * 1.1).count() == 0
    text = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), ("a", 3), ("", 1)], "value string, node long")
    assert [(r["value"], r["n"]) for r in frequent_values(text, "value", k=2).collect()] == [("a", 2), ("b", 2)]
    with pytest.raises(ValueError):
        frequent_values(text, "value")


@pytest.mark.parametrize("state_rows", [1 << 20, 3])
def test_top_n_against_brute_force(spark, state_rows, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([0.5, 1.0, 2.0, None, float("nan"), float("inf")])) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, i long, s double").repartition(5)
    want = defaultdict(list)
    for g, i, s in rows:
        if g is not None and s is not None and s == s:
            want[g].append((-s, i))
    got = top_n_per_group(df, "g", "i", "s", 4, state_rows=state_rows).collect()
    assert {(r["g"], r["rank"], r["i"], r["s"]) for r in got} == {(g, n + 1, i, -s) for g, v in want.items() for n, (s, i) in enumerate(sorted(v)[:4])}


def test_top_n_of_sums(spark):
    rows = [(1, 10, 1.0, "t1"), (1, 10, 1.0, "t1"), (1, 10, 1.0, None), (1, 10, 1.0, None), (1, 11, 2.0, "t"), (1, 12, float("inf"), "t"), (1, 13, None, "t"), (None, 1, 1.0, "t"), (2, 9, -1.0, "t")]
    df = spark.createDataFrame(rows, "group long, item long, score double, rated string")
    got = {(r["group"], r["item"], r["score"], r["rank"]) for r in top_n_of_sums(df, "group", "item", "score", 2, same=("rated",)).collect()}
    assert got == {(1, 10, 2.0, 1), (1, 11, 2.0, 2), (2, 9, -1.0, 1)}
    got = {(r["item"], r["score"]) for r in top_n_of_sums(df, "group", "item", "score", 1).collect()}
    assert got == {(10, 4.0), (9, -1.0)}
    assert top_n_of_sums(df.limit(0), "group", "item", "score", 2).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "group", "item", "score", 0)


def test_registered_query_gives_every_pair(spark):
    from itertools import combinations

    from loomrec.llm.queries import queries

    folder = "/root/testdata/sf0.001"
    baskets = {}
    for r in spark.read.parquet(f"{folder}/triplets.parquet").select("user_id", "item_id").dropna().distinct().collect():
        baskets.setdefault(r[0], []).append(r[1])
    want = {}
    for xs in baskets.values():
        for pair in combinations(sorted(xs), 2):
            want[pair] = want.get(pair, 0) + 1
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in queries()["p1_all_pairs"](spark, folder).collect()}
    assert got == want and min(got.values()) == 1
