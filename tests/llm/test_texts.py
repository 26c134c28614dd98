import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.llm.mixing import mix_sources, short_sources, split_quotas
from loomrec.llm.packing import best_fit, pack_documents, packing_report
from loomrec.llm.splitting import choose_cuts, split_oversized, split_text
from loomrec.llm.tokens import count_tokens, encoder, token_count

WORDS = "the model drops noise after a second pass because nobody asked for larger groups".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (".\n\n" if rng.random() < 0.05 else "\n" if rng.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.choice([3, 40, 90, 200, 700])), rng.choice(["a", "a", "a", "b", "c", None]), 1) for k in range(150)]
    rows += [(200, None, "a", 1), (201, "", "b", 1), (202, "   ", None, 1), (203, "<|endoftext|>", "b", 1), (204, "x" * 5000, "c", 1), (205, "é漢字🙂" * 700, "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int").repartition(6)


def sizes(docs):
    rows = docs.collect()
    return dict(zip((r["doc_id"] for r in rows), count_tokens([r["text"] for r in rows]).tolist()))


def test_special_tokens_are_text():
    assert count_tokens(["<|endoftext|>", None, ""]).tolist() == [len(encoder().encode_ordinary("<|endoftext|>")), 0, 0]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_respects_capacities(score):
    rng = np.random.default_rng(0)
    n = rng.integers(1, 100, 400)
    need = np.stack([n, np.ones(400), n.astype(float) ** 2], 1)
    need = need[np.argsort(-n)]
    cap = np.array([100, 4, 7000.0])
    bins = best_fit(need.astype(float), cap, np.ones(3), score)
    sums = np.zeros((bins.max() + 1, 3))
    np.add.at(sums, bins, need)
    alone = np.bincount(bins) == 1
    assert (sums[~alone] <= cap + 1e-6).all() and (sums[:, :2] <= cap[:2]).all()
    assert set(bins) == set(range(bins.max() + 1))


def test_packing_counts_tokens_once_and_reports(spark, docs):
    packed = pack_documents(docs, "doc_id", "text", capacity=128, max_docs=5, attention=0.5 * 128**2, shard_docs=40)
    rows = packed.collect()
    report = packing_report(packed, 128, 5, 0.5 * 128**2).first()
    by = {}
    for r in rows:
        by.setdefault(r["container"], []).append(r["n_tokens"])
        assert r["over_attention"] == (r["n_tokens"] ** 2 > 0.5 * 128**2)
    assert all(len(n) == 1 or (len(n) <= 5 and sum(n) <= 128 and sum(x * x for x in n) <= 0.5 * 128**2) for n in by.values())
    assert report["broken"] == 0 and report["containers"] == len(by) and report["full_attention"] > 0 and report["full_docs"] > 0
    assert report["over_attention"] == sum(r["over_attention"] for r in rows)
    wrong = packed.withColumn("container", F.lit(1).cast("long"))
    assert packing_report(wrong, 128, 5, 0.5 * 128**2).first()["broken"] == 1
    named = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").select("doc_id", token_count("text").alias("n"))
    assert named._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("capacity,max_docs", [(128, 1024), (128, 2), (4096, 1024)])
def test_packing_is_whole(docs, capacity, max_docs):
    rows = pack_documents(docs, "doc_id", "text", capacity=capacity, max_docs=max_docs, shard_docs=40).collect()
    want, got, loads = sizes(docs), {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start_token"], r["n_tokens"]))
        load = loads.setdefault(r["container"], [0, 0])
        load[0] += r["n_tokens"]
        load[1] += 1
    assert got.keys() == want.keys()
    for k, pieces in got.items():
        pieces.sort()
        assert sum(p[2] for p in pieces) == want[k]
        assert len(pieces) == max(1, -(-want[k] // capacity))
        assert [p[1] for p in pieces] == [n * capacity for n in range(len(pieces))]
    assert all(t <= capacity and n <= max_docs for t, n in loads.values())
    if (capacity, max_docs) == (128, 1024):
        assert sum(want.values()) / (capacity * len(loads)) > 0.9


def test_packing_odd_tables(spark):
    schema = "id long, text string, container long, piece int"
    assert pack_documents(spark.createDataFrame([], schema), "id", "text").count() == 0
    rows = [(1, "a b", 1, 1), (1, "a b", 1, 1), (None, "c", 1, 1), (2, None, 1, 1)]
    assert sorted(r["id"] for r in pack_documents(spark.createDataFrame(rows, schema), "id", "text").collect()) == [1, 1, 2]


def test_splitting_tree_is_exact():
    quotas = np.array([13, 0, 200, 7])
    for shards in (1, 2, 7, 32):
        got = split_quotas(quotas, shards, 3)
        assert (got.sum(0) == quotas).all() and got.min() >= 0
        assert np.ptp(got.sum(1)) <= 6
        assert (got == split_quotas(quotas, shards, 3)).all()


def test_mix_reaches_targets(spark, docs):
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 2), ("c", 0.2, 5), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets, block_tokens=500)
    want = sizes(docs)
    total = sum(want.values())
    by = {}
    for r in docs.collect():
        by.setdefault(r["source"], []).append(r["doc_id"])
    report = {r["source"]: r for r in mix.report.collect()}
    plan = short_sources(mix)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "n_tokens" in plan  # needs the drawn documents
    assert {r["source"] for r in short_sources(mix).collect()} == {s for s, share, cap in [("a", 0.3, 2), ("b", 0.5, 2), ("c", 0.2, 5), ("none", 0.1, 9)] if cap * sum(want[d] for d in by.get(s, [])) < share * total}
    rows = mix.rows.collect()
    drawn, copies = {}, {}
    for r in rows:
        assert r["n_tokens"] == want[r["doc_id"]] and r["doc_id"] in by[r["source"]]
        drawn[r["source"]] = drawn.get(r["source"], 0) + r["n_tokens"]
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(len(c) == len(set(c)) for c in copies.values())
    for s, r in report.items():
        assert r["drawn"] == drawn.get(s, 0)
        assert abs(r["drawn"] - r["quota"]) <= max([want[d] for d in by.get(s, [])] or [0]) / 2 + 1
        assert all(len(copies.get(d, [])) <= r["max_repeats"] for d in by.get(s, []))
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_mix_of_odd_tables(spark, docs):
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mix_sources(docs, none).rows.count() == 0 and mix_sources(docs, none).report.count() == 0
    odd = spark.createDataFrame([(None, 0.5, 2), ("a", None, 2), ("b", 0.1, None)], none.schema)
    report = {r["source"]: r for r in mix_sources(docs, odd).report.collect()}
    assert report.keys() == {"a", "b"} and report["a"]["drawn"] == 0 and report["b"]["max_repeats"] == 1
    empty = mix_sources(docs.limit(0), odd)
    assert empty.rows.count() == 0 and {r["drawn"] for r in empty.report.collect()} == {0}


@pytest.mark.parametrize("limit,overlap", [(64, 8), (100, 0), (300, 40)])
def test_pieces_join_to_the_text(limit, overlap):
    rng = random.Random(4)
    texts = [prose(rng, 900), "x" * 9000, "é漢字🙂" * 400, "\n" * 3000, "a\r\n\r\nb " * 500, '{"cells": [' + '{"cell_type": "code", "source": "a = 1\\nb = 2\\n\\nc"}, ' * 80]
    for text in texts:
        pieces = split_text(text, limit, overlap)
        if pieces is None:
            assert count_tokens([text])[0] <= limit
            continue
        raw, ids = text.encode(), encoder().encode_ordinary(text)
        off = np.r_[0, np.cumsum([len(encoder().decode_single_token_bytes(i)) for i in ids])]
        joined = b""
        for s, e, o, _, part in pieces:
            assert part.encode() == raw[off[s] : off[e]] and count_tokens([part])[0] <= limit and overlap - 3 <= o <= overlap or s == 0
            joined += raw[off[s + o] : off[e]]
        assert joined == raw
        assert all(b[0] + b[2] == a[1] for a, b in zip(pieces, pieces[1:]))


def test_cuts_prefer_boundaries():
    text = "\n\n".join("one two three four five six seven eight." for _ in range(60))
    pieces = split_text(text, 128, 0)
    assert all(p[3] == "paragraph" for p in pieces[:-1])


def test_cuts_are_optimal_on_short_sequences():
    rng = np.random.default_rng(0)
    from loomrec.llm.splitting import CUT_PENALTY, IMBALANCE

    for _ in range(20):
        n, limit, overlap = 40, 16, 3
        kind = rng.integers(0, 6, n + 1).astype(np.int8)
        cuts = choose_cuts(kind, limit, overlap, 1)
        room, even = limit - overlap, (n - overlap) / -(-(n - overlap) // (limit - overlap))

        def cost(c):
            begin = [overlap, *c[1:-1]]
            return sum(CUT_PENALTY[kind[p]] for p in c[1:-1]) + sum(IMBALANCE * ((e - b) / even - 1) ** 2 for b, e in zip(begin, c[1:]))

        best = {0: (0.0, [0])}
        for j in [*range(overlap + 1, n), n]:
            options = [(cost([*c, j]) if False else cost_so_far(c, v, j, kind, overlap, even, n), [*c, j]) for i, (v, c) in best.items() if j - (overlap if i == 0 else i) <= room]
            if options:
                best[j] = min(options)
        assert cost(list(cuts)) == pytest.approx(best[n][0])
        assert all(b - a <= (limit if a == 0 else room) for a, b in zip(cuts, cuts[1:]))


def cuts_cost(kind, cuts, limit, overlap):
    from loomrec.llm.splitting import CUT_PENALTY, IMBALANCE

    n = len(kind) - 1
    even = (n - overlap) / -(-(n - overlap) // (limit - overlap))
    begin = [overlap, *cuts[1:-1]]
    assert all(e - b <= limit - overlap for b, e in zip(begin, cuts[1:])) and all(kind[c] < 6 for c in cuts)
    return sum(CUT_PENALTY[kind[c]] for c in cuts[1:-1]) + sum(IMBALANCE * ((e - b) / even - 1) ** 2 for b, e in zip(begin, cuts[1:]))


@pytest.mark.parametrize("weights", [[1, 3, 10, 20, 60, 5, 1], [0, 0, 0, 0, 0, 8, 2], [0, 0, 0, 1, 30, 0, 69], [40, 0, 0, 0, 1, 1, 0]])
def test_cuts_are_optimal_over_all_positions(weights):
    rng = np.random.default_rng(3)
    for n, limit, overlap in ((3_000, 512, 40), (2_500, 1_000, 0), (1_030, 1_000, 100), (9_000, 2_000, 128)):
        kind = rng.choice(7, n + 1, p=np.array(weights) / sum(weights)).astype(np.int8)
        kind[0] = kind[n] = 0
        ours, all_positions = choose_cuts(kind, limit, overlap), choose_cuts(kind, limit, overlap, 1)
        assert cuts_cost(kind, list(ours), limit, overlap) == pytest.approx(cuts_cost(kind, list(all_positions), limit, overlap), abs=1e-8)


def test_a_text_that_cannot_be_split_is_marked(spark):
    rows = split_oversized(spark.createDataFrame([(1, "🙂" * 40), (2, "word " * 40)], "id long, text string"), "id", "text", limit=3, overlap=0).collect()
    marked = [r for r in rows if r["cut"] == "none"]
    assert {r["id"] for r in rows} == {1, 2} and all(r["n_pieces"] == 1 and r["piece"] == 0 for r in marked)


def cost_so_far(cuts, value, j, kind, overlap, even, n):
    from loomrec.llm.splitting import CUT_PENALTY, IMBALANCE

    begin = overlap if cuts[-1] == 0 else cuts[-1]
    return value + IMBALANCE * ((j - begin) / even - 1) ** 2 + (0 if j == n else CUT_PENALTY[kind[j]])


def test_split_table(spark, docs):
    want = {k for k, n in sizes(docs).items() if n > 300}
    rows = split_oversized(docs, "doc_id", "text", limit=300, overlap=20).collect()
    assert {r["doc_id"] for r in rows} == want
    for d in want:
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(mine[0]["n_pieces"])) and mine[0]["n_pieces"] > 1
    assert split_oversized(docs.limit(0), "doc_id", "text").count() == 0
    assert "text" not in split_oversized(docs, "doc_id", "text", with_text=False).columns
    with pytest.raises(ValueError):
        split_oversized(docs, "doc_id", "text", limit=100, overlap=60)
