import random
from collections import defaultdict

import pytest

from loomrec.llm.set_join import similar_sets


def random_sets(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(15)]
    sets = {}
    for r in range(80):
        tokens = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            tokens.add(rng.randrange(60))
            tokens.discard(rng.choice(sorted(tokens)))
        sets[r] = tokens
    for r in range(80, 90):
        sets[r] = set(sets[rng.randrange(80)])
    sets[90] = set(range(58))
    sets[91] = set(range(60))
    return sets


def frame(spark, sets):
    rows = [(r, t, None) for r, s in sets.items() for t in s]
    return spark.createDataFrame(rows + rows[:20] + [(None, 1, 1), (3, None, 1)], "record long, token long, overlap long")


def brute(sets, t, least):
    ids = sorted(r for r, s in sets.items() if len(s) >= least and s)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both >= t * either - 1e-9:
                out.add((a, b, round(both / either, 9)))
    return out


@pytest.mark.parametrize("huge,tile", [(100_000, 50_000), (100_000, 3), (20, 50_000)])
@pytest.mark.parametrize("threshold,least", [(0.5, 1), (0.7, 10), (0.8, 1), (1.0, 1)])
def test_against_brute_force(spark, threshold, least, huge, tile):
    sets = random_sets(5)
    joined = similar_sets(frame(spark, sets), "record", "token", threshold=threshold, min_size=least, huge_set=huge, list_tile=tile)
    got = {(r["a"], r["b"], round(r["jaccard"], 9)) for r in joined.record_pairs().collect()}
    if huge == 100_000:
        assert got == brute(sets, threshold, least)
    else:  # huge sets form no classes; their copies come out as pairs
        assert got == brute(sets, threshold, least)


def test_large_classes_become_stars(spark):
    sets = {r: {1, 2, 3} for r in range(10)} | {20: {1, 2, 3, 4}}
    joined = similar_sets(frame(spark, sets), "record", "token", threshold=0.7)
    got = {(r["a"], r["b"]) for r in joined.record_pairs(expand_class=4).collect()}
    assert got == {(0, r) for r in range(1, 10)} | {(0, 20)}
    members = defaultdict(set)
    for r in joined.members.collect():
        members[r["rep"]].add(r["record"])
    assert members == {0: set(range(10)), 20: {20}}


def test_large_sets_travel_once(spark):
    big = spark.range(20_000).selectExpr("explode(array(1L, 2L, 3L)) AS record", "id AS token")
    rows = big.filter("record = 1 OR token % 10 > record").union(spark.createDataFrame([(4, 1), (4, 2)], "record long, token long"))
    joined = similar_sets(rows, "record", "token", threshold=0.7)
    assert {(r["a"], r["b"], r["overlap"]) for r in joined.pairs.collect()} == {(1, 2, 14_000), (2, 3, 12_000)}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "record long, token long")
    assert similar_sets(empty, "record", "token", threshold=0.5).record_pairs().count() == 0
    words = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "c")], "record long, token string")
    assert [(r["a"], r["b"]) for r in similar_sets(words, "record", "token", threshold=0.9).record_pairs().collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        similar_sets(words, "record", "token", threshold=0.0)
