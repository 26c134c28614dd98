"""Ranking: top-k, masking of seen items, back-fill, dense scoring, cosine neighbours, popularity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions import dot, norm
from loomrec.scratch import BROADCAST_BYTES, maybe_broadcast, spread, stow
from loomrec.sources.triplets import Interactions, numbered, require_k

#: Scores that agree to so many decimals tie, and the smaller id comes first.
DIGITS = 9
#: Bytes of one dense score buffer in a worker.
SCORE_BUFFER = 64 << 20
#: Scores that are computed and compared at once, few enough for a CPU's cache.
CACHED_SCORES = 1 << 20


def top_k(scores: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The ``k`` first rows a group by score descending, then id, with ``rank`` from 1.

    Spark prunes to ``k`` rows a group before the shuffle (window group limit).
    """
    require_k(k)
    order = Window.partitionBy(group).orderBy(F.desc(F.round(score, DIGITS)), item)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def item_scores(matrix: Interactions, weights: DataFrame) -> DataFrame:
    """``user_id, item_id, score`` with score = sum over a user's items of value x weight; only scored pairs come out."""
    x = matrix.x.select("user_id", F.col("item_id").alias("src"), "value")
    return (
        x.join(weights.select("src", "dst", "weight"), "src")
        .groupBy("user_id", F.col("dst").alias("item_id"))
        .agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    )


def recommend_scored(matrix: Interactions, scores: DataFrame, k: int, *, allow_seen_backfill: bool = True) -> DataFrame:
    """``user_id, rank, item_id, score``: exactly ``min(k, n_items)`` items for every user of the universe.

    Unseen items rank by score; an item without a score counts 0 and so precedes negative ones; ties go to the smaller id.
    Items a user has seen come last, in order of their ids and without a score, if there are fewer than ``k`` others (or not
    at all, with ``allow_seen_backfill=False``).

    Most users have ``k`` positive scores and need no filling.  For the others only the first ``need + scored + seen`` ids of the
    universe can matter, so just that prefix is expanded for each, never all users times all items.
    """
    require_k(k)
    seen = matrix.x.select("user_id", "item_id")
    known = scores.select("user_id", "item_id", "score", F.round("score", DIGITS).alias("r"))
    unseen = stow(known.join(seen, ["user_id", "item_id"], "left_anti"))
    positive = stow(top_k(unseen.filter("r > 0"), "user_id", "item_id", "score", k))
    have = positive.groupBy("user_id").agg(F.count("*").alias("have"))
    short = matrix.users.join(have, "user_id", "left").select("user_id", (F.lit(k) - F.coalesce("have", F.lit(0))).alias("need"))
    short = stow(short.filter("need > 0"))
    taken = unseen.filter("r <> 0").select("user_id", "item_id").union(seen).join(short.select("user_id"), "user_id", "left_semi")
    taken = stow(taken)
    reach = short.join(taken.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left")
    reach = reach.select("user_id", "need", (F.col("need") + F.coalesce("n", F.lit(0))).alias("reach"))
    furthest = reach.agg(F.coalesce(F.max("reach"), F.lit(0))).first()[0]
    prefix = matrix.items.select("item_id").orderBy("item_id").limit(int(furthest)) if furthest else matrix.items.limit(0)
    prefix = numbered(prefix, "place", "item_id").withColumn("place", F.col("place") + 1)
    wanted = reach.select("user_id", "need", F.explode(F.sequence(F.lit(1), F.col("reach").cast("int"))).alias("place"))
    zeros = wanted.join(maybe_broadcast(prefix, int(furthest), 24), "place").join(taken, ["user_id", "item_id"], "left_anti")
    lowest = Window.partitionBy("user_id").orderBy("item_id")
    zeros = zeros.withColumn("n", F.row_number().over(lowest)).filter("n <= need")
    parts = positive.select("user_id", "item_id", "score", "r", F.lit(0).alias("kind")).union(
        zeros.select("user_id", "item_id", F.lit(0.0), F.lit(0.0), F.lit(1))
    )
    negative = unseen.filter("r < 0").join(short, "user_id", "left_semi")
    parts = parts.union(top_k(negative, "user_id", "item_id", "score", k).select("user_id", "item_id", "score", "r", F.lit(2)))
    if allow_seen_backfill:
        tail = seen.join(short, "user_id").withColumn("n", F.row_number().over(lowest)).filter("n <= need")
        parts = parts.union(tail.select("user_id", "item_id", F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(3)))
    order = Window.partitionBy("user_id").orderBy("kind", F.desc("r"), "item_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("user_id", "rank", "item_id", "score")


def _dense_kernel(batches, ids: np.ndarray, table: np.ndarray, bias: np.ndarray | None, k: int):
    """Top ``k`` of a block of items for each user: (user, factors, seen) to (user, item, score, hidden).

    ``ids`` are in order.  Items are scored by falling length; a user is done when no later item can reach the k-th score so far.
    """
    length, extra = np.linalg.norm(table, axis=1), np.zeros(len(ids)) if bias is None else bias
    order = np.argsort(-(length + extra), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    sorted_ids, sorted_table, sorted_bias = ids[order], table[order], extra[order]
    longest = np.r_[np.maximum.accumulate(length[order][::-1])[::-1], 0.0]
    most = np.r_[np.maximum.accumulate(sorted_bias[::-1])[::-1], -np.inf]
    for batch in batches:
        users = batch.column(0).to_numpy()
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(users), -1)
        seen, off = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
        off = off - off[0]
        at = np.minimum(np.searchsorted(ids, seen), len(ids) - 1)
        row = np.repeat(np.arange(len(users)), np.diff(off))
        ok = ids[at] == seen
        row, at = row[ok], at[ok]
        masked = np.bincount(row, minlength=len(users))
        own = np.linalg.norm(flat, axis=1)
        # Without enough unseen items the list ends with seen ones; without any score beyond rounding it goes by ids alone.
        whole = len(ids) - masked < k
        flat_out = ~whole & (own * longest[0] < 4e-10) if bias is None else np.zeros(len(users), bool)
        out = []
        rest = np.flatnonzero(whole)
        step = max(1, SCORE_BUFFER // (8 * len(ids)))
        for lo in range(0, len(rest), step):
            part = rest[lo : lo + step]
            s = np.round(flat[part] @ table.T + extra, DIGITS) + 0.0
            index = np.full(len(users), -1)
            index[part] = np.arange(len(part))
            mine = index[row] >= 0
            s[index[row[mine]], at[mine]] = -np.inf
            r, item, score = _best_unseen(s, ids, k)
            out.append((part[r], item, score))
        first = np.searchsorted(row, np.arange(len(users) + 1))
        for r in np.flatnonzero(flat_out):
            hidden = at[first[r] : first[r + 1]]
            free = np.setdiff1d(np.arange(k + len(hidden)), hidden)[:k]
            out.append((np.full(k, r), ids[free], np.zeros(k)))
        live = np.flatnonzero(~whole & ~flat_out)
        where = place[at]
        by = np.argsort(where, kind="stable")
        row, where = row[by], where[by]
        best, got = np.full((len(users), k), -np.inf), np.zeros((len(users), k), np.int64)  # scores and ids so far, in order
        lo, step = 0, min(len(ids), max(256, 2 * k))
        while len(live) and lo < len(ids):
            hi = min(len(ids), lo + step)
            index = np.full(len(users), -1)
            index[live] = np.arange(len(live))
            part = slice(*np.searchsorted(where, [lo, hi]))
            hide_r, hide_c = index[row[part]], where[part] - lo
            hide_r, hide_c = hide_r[hide_r >= 0], hide_c[hide_r >= 0]
            by = np.argsort(hide_r, kind="stable")
            hide_r, hide_c = hide_r[by], hide_c[by]
            tile = max(1, CACHED_SCORES // (hi - lo))
            for t in range(0, len(live), tile):
                mine = live[t : t + tile]
                s = flat[mine] @ sorted_table[lo:hi].T
                if bias is not None:
                    s += sorted_bias[lo:hi]
                h = slice(*np.searchsorted(hide_r, [t, t + tile]))
                s[hide_r[h] - t, hide_c[h]] = -np.inf
                least = best[mine, k - 1] - 1e-9
                if lo == 0:
                    least = np.partition(s, hi - k, axis=1)[:, hi - k] - 1e-9 if hi > k else np.full(len(mine), -np.inf)
                r, c = np.divmod(np.flatnonzero((s >= np.maximum(least, -1e300)[:, None]).ravel()), hi - lo)
                v = np.round(s[r, c], DIGITS) + 0.0
                old = np.nonzero(best[mine] > -np.inf)
                r, v = np.concatenate([r, old[0]]), np.concatenate([v, best[mine][old]])
                i = np.concatenate([sorted_ids[lo + c], got[mine][old]])
                o = np.lexsort((i, -v, r))
                r, v, i = r[o], v[o], i[o]
                n = np.arange(len(r)) - np.searchsorted(r, r)
                keep = n < k
                best[mine[r[keep]], n[keep]], got[mine[r[keep]], n[keep]] = v[keep], i[keep]
            lo, step = hi, min(2 * step, 8_192)
            live = live[best[live, k - 1] <= own[live] * longest[lo] * (1 + 1e-12) + most[lo] + 6e-10] if lo < len(ids) else live[:0]
        r, c = np.nonzero((best > -np.inf) & ~(whole | flat_out)[:, None])
        out.append((r, got[r, c], best[r, c]))
        r, i, v = (np.concatenate(c) for c in zip(*out))
        if len(r):
            hidden = np.isneginf(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(users[r]), pa.array(i), pa.array(np.where(hidden, 0.0, v), mask=hidden), pa.array(hidden)],
                names=["user_id", "item_id", "score", "hidden"],
            )


def _best_unseen(s: np.ndarray, ids: np.ndarray, k: int):
    """Per row the first ``k`` columns by score, then id: (row, id, score) flattened."""
    c = min(k, len(ids))
    least = np.partition(s, len(ids) - c, axis=1)[:, len(ids) - c]
    rows, at = np.nonzero(s >= least[:, None])
    v = s[rows, at]
    order = np.lexsort((ids[at], -v, rows))
    rows, at, v = rows[order], at[order], v[order]
    start = np.searchsorted(rows, np.arange(len(s)))
    keep = np.arange(len(rows)) - start[rows] < c
    return rows[keep], ids[at[keep]], v[keep]


def expected_share(n_edges: int, n_items: int, n_entries: int, n_users: int) -> float:
    """Share of items a user gets a score for, if entries and weights were spread evenly."""
    if not n_items or not n_users:
        return 0.0
    return 1 - (1 - min(1.0, n_edges / (n_items * n_items))) ** (n_entries / n_users)


def recommend_weighted(matrix: Interactions, weights: DataFrame, k: int) -> DataFrame:
    """:func:`recommend_scored` of :func:`item_scores` in one pass over the users, with the weights broadcast as compressed rows.

    Every user is scored against all items in a buffer of bounded size, so nothing is shuffled but the entries by user; for item
    universes and weights that fit a worker (see :func:`weights_fit`).
    """
    require_k(k)
    spark = matrix.spark
    ids = np.sort(matrix.items.select("item_id").toArrow()["item_id"].to_numpy())
    got = weights.select("src", "dst", "weight").toArrow().sort_by("src")
    src = np.searchsorted(ids, got["src"].to_numpy())
    first = np.searchsorted(src, np.arange(len(ids) + 1))
    held = spark.sparkContext.broadcast((ids, first, np.searchsorted(ids, got["dst"].to_numpy()), got["weight"].to_numpy()))
    entries = matrix.x.groupBy("user_id").agg(F.collect_list("item_id").alias("i"), F.collect_list("value").alias("v"))
    none, no_value = F.expr("CAST(array() AS ARRAY<BIGINT>)"), F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    rows = matrix.users.join(entries, "user_id", "left").select("user_id", F.coalesce("i", none).alias("i"), F.coalesce("v", no_value).alias("v"))

    def kernel(batches):
        ids, first, dst, w = held.value
        n = len(ids)
        step = max(1, SCORE_BUFFER // (8 * max(1, n)))
        for batch in batches:
            users = batch.column(0).to_numpy()
            off = batch.column(1).offsets.to_numpy()
            off = off - off[0]
            items = np.searchsorted(ids, batch.column(1).flatten().to_numpy(zero_copy_only=False))
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            for lo in range(0, len(users), step):
                hi = min(len(users), lo + step)
                part = slice(off[lo], off[hi])
                row, i, v = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1])), items[part], values[part]
                length = first[i + 1] - first[i]
                e = np.repeat(first[i] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                flat = np.repeat(row, length) * n + dst[e]
                s = np.bincount(flat, weights=np.repeat(v, length) * w[e], minlength=(hi - lo) * n).reshape(hi - lo, n)
                s = np.round(s, DIGITS) + 0.0
                s[row, i] = -np.inf
                r, item, score = _best_unseen(s, ids, k)
                hidden = np.isneginf(score)
                rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(users[lo:hi][r]), pa.array(rank.astype(np.int32)), pa.array(item), pa.array(np.where(hidden, 0.0, score), mask=hidden)],
                    names=["user_id", "rank", "item_id", "score"],
                )

    return spread(rows, "user_id").mapInArrow(kernel, "user_id long, rank int, item_id long, score double")


def weights_fit(n_edges: int, n_items: int, n_entries: int, n_users: int) -> bool:
    """Whether the broadcast form pays: weights within the bound, a score row that fits a buffer, and either a small universe
    or more than a tenth of the items scored for a user."""
    if n_edges * 16 > BROADCAST_BYTES or n_items * 8 > SCORE_BUFFER // 8:
        return False
    return n_items <= 50_000 or expected_share(n_edges, n_items, n_entries, n_users) > 0.1


def recommend_dense(
    users: DataFrame, items: DataFrame, seen: DataFrame, k: int, *, item_bias: bool = False, block_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Top ``k`` of all items by inner product for each row of ``users`` (``id, factors``), seen items last.

    ``items`` has ``id, factors`` and, with ``item_bias``, ``bias``.  The items go to the workers in blocks of at most
    ``block_bytes``; every block yields its own first ``k`` a user, of which the final ``k`` are chosen.  Result as of
    :func:`recommend_scored`.
    """
    require_k(k)
    lists = seen.groupBy(F.col("user_id").alias("id")).agg(F.collect_list("item_id").alias("seen"))
    empty = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    rows = users.select("id", "factors").join(lists, "id", "left").select("id", "factors", F.coalesce("seen", empty).alias("seen"))
    rows = spread(rows, "id")
    n = items.count()
    if not n:
        return users.limit(0).select(F.col("id").alias("user_id"), F.lit(1).alias("rank"), F.col("id").alias("item_id"), F.lit(0.0).alias("score"))
    rank = len(items.select("factors").first()[0])
    blocks = max(1, -(-n * (rank + 2) * 8 // block_bytes))
    if blocks > 1:
        rows, items = stow(rows), stow(items.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.col("_block") == b)
        got = part.select("id", "factors", *(["bias"] if item_bias else [])).toArrow().sort_by("id")
        ids = got["id"].to_numpy()
        table = np.asarray(got["factors"].combine_chunks().flatten(), float).reshape(len(ids), -1) if len(ids) else np.zeros((0, rank))
        bias = got["bias"].to_numpy() if item_bias else None
        held = users.sparkSession.sparkContext.broadcast((ids, table, bias))

        def kernel(batches, held=held):
            ids, table, bias = held.value
            return _dense_kernel(batches, ids, table, bias, k) if len(ids) else iter(())

        one = rows.mapInArrow(kernel, "user_id long, item_id long, score double, hidden boolean")
        found = one if found is None else found.union(one)
    order = Window.partitionBy("user_id").orderBy("hidden", F.desc("score"), "item_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("user_id", "rank", "item_id", "score")


def pair_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``user_id, item_id, score`` for given pairs: inner products of ``id, factors`` tables.  Unknown ids raise at run time."""
    a = users.select(F.col("id").alias("user_id"), F.col("factors").alias("_a"))
    b = items.select(F.col("id").alias("item_id"), F.col("factors").alias("_b"))
    joined = pairs.select("user_id", "item_id").join(a, "user_id", "left").join(b, "item_id", "left")
    known = F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit("unknown user or item id"))
    return joined.select("user_id", "item_id", F.when(known.isNull(), dot("_a", "_b")).alias("score"))


def all_scores(users: DataFrame, items: DataFrame) -> DataFrame:
    """Every user-item score as rows.  The result itself has users x items rows; ask for pairs or top-k where that will do."""
    a = users.select(F.col("id").alias("user_id"), F.col("factors").alias("_a"))
    b = items.select(F.col("id").alias("item_id"), F.col("factors").alias("_b"))
    return a.join(b).select("user_id", "item_id", dot("_a", "_b").alias("score"))


def score_totals(users: DataFrame, items: DataFrame, *, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``user_id, n, total, best`` of :func:`all_scores`: number, sum and maximum of every user's scores of all items, without rows
    for the pairs.

    The sum is the product with the sum of the items' factors.  For the maximum the items of a block come by length; a user is
    done when the length of the next item can't reach the maximum so far.
    """
    n = items.count()
    if not n:
        return users.limit(0).select(F.col("id").alias("user_id"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    blocks = max(1, -(-n * (len(items.select("factors").first()[0]) + 2) * 8 // block_bytes))
    if blocks > 1:
        users, items = stow(users.select("id", "factors")), stow(items.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    found = None
    for b in range(blocks):
        part = (items if blocks == 1 else items.filter(F.col("_block") == b)).select("factors").toArrow()["factors"].combine_chunks()
        if not len(part):
            continue
        table = np.asarray(part.flatten(), float).reshape(len(part), -1)
        length = np.linalg.norm(table, axis=1)
        order = np.argsort(-length, kind="stable")
        held = users.sparkSession.sparkContext.broadcast((table[order], length[order], table.sum(axis=0)))

        def kernel(batches, held=held):
            table, length, total = held.value
            for batch in batches:
                f = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                best, own = np.full(len(f), -np.inf), np.linalg.norm(f, axis=1)
                live, lo, step = np.arange(len(f)), 0, 64
                while len(live) and lo < len(table):
                    step = max(1, min(2 * step, SCORE_BUFFER // (8 * len(live))))
                    best[live] = np.maximum(best[live], (f[live] @ table[lo : lo + step].T).max(axis=1))
                    lo += step
                    if lo < len(table):
                        live = live[own[live] * length[lo] * (1 + 1e-12) > best[live]]
                columns = batch.column(0), np.full(len(f), len(table)), f @ total, best
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["user_id", "n", "total", "best"])

        one = users.select("id", "factors").mapInArrow(kernel, "user_id long, n long, total double, best double")
        found = one if found is None else found.union(one)
    if blocks == 1:
        return found
    return found.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))


def similar_to(factors: DataFrame, entity: int, k: int) -> DataFrame:
    """The ``k`` most similar entities by cosine: ``id, similarity, rank``.

    The entity itself is excluded; a candidate of zero length has similarity 0; if the entity's own vector has zero length the
    result is empty; an unknown id raises ``ValueError``.
    """
    require_k(k)
    row = factors.filter(F.col("id") == entity).select("factors").first()
    if row is None:
        raise ValueError(f"unknown id {entity}")
    query = [float(v) for v in row["factors"]]
    length = float(np.linalg.norm(query))
    if length == 0:
        return factors.limit(0).select("id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    q = F.array(*(F.lit(v / length) for v in query))
    n = norm("factors")
    scored = factors.filter(F.col("id") != entity).select("id", F.when(n > 0, dot("factors", q) / n).otherwise(0.0).alias("similarity"))
    best = scored.orderBy(F.desc(F.round("similarity", DIGITS)), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("similarity", DIGITS)), "id")))


def similar_all(queries: DataFrame, factors: DataFrame, k: int) -> DataFrame:
    """:func:`similar_to` for every row of ``queries`` at once: ``query, id, similarity, rank``, by blocked dense products."""
    unit = lambda df: df.select("id", F.transform("factors", lambda e: F.coalesce(F.try_divide(e, norm("factors")), F.lit(0.0))).alias("factors"))
    asked = unit(queries.filter(norm("factors") > 0))
    own = asked.select(F.col("id").alias("user_id"), F.col("id").alias("item_id"))
    ranked = recommend_dense(asked, unit(factors), own, k).filter("score IS NOT NULL")
    return ranked.select(F.col("user_id").alias("query"), F.col("item_id").alias("id"), F.col("score").alias("similarity"), "rank")


def popular_items(matrix: Interactions, k: int) -> DataFrame:
    """Items by their sum of values, seen ones left out, the first ``k`` for every user: ``user_id, rank, item_id, score``.

    No user can have seen more items than their degree, so the first ``k + max degree`` items suffice for all; a user takes as
    many of them as ``k`` plus the own degree.
    """
    require_k(k)
    sums = matrix.items.join(matrix.x.groupBy("item_id").agg(F.sum("value").alias("score")), "item_id", "left")
    sums = sums.select("item_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    degree = matrix.users.join(matrix.x.groupBy("user_id").agg(F.count("*").alias("d")), "user_id", "left")
    degree = stow(degree.select("user_id", F.coalesce("d", F.lit(0)).alias("d")))
    most = int(degree.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]) + k
    first = sums.orderBy(F.desc(F.round("score", DIGITS)), "item_id").limit(most)
    first = numbered(first, "place", F.desc(F.round("score", DIGITS)), F.col("item_id")).withColumn("place", F.col("place") + 1)
    wanted = degree.select("user_id", F.explode(F.sequence(F.lit(1), (F.col("d") + k).cast("int"))).alias("place"))
    offered = wanted.join(maybe_broadcast(first, most, 32), "place").join(matrix.x.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("place")
    ranked = offered.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("user_id", "rank", "item_id", "score")


def mean_overlap(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Mean share of common items in two recommendation tables: one row ``overlap``, over the users of the first."""
    a = first.filter(F.col("rank") <= k).select("user_id", "item_id")
    b = second.filter(F.col("rank") <= k).select("user_id", "item_id").withColumn("_in", F.lit(1))
    per_user = a.join(b, ["user_id", "item_id"], "left").groupBy("user_id").agg((F.count("_in") / F.lit(k)).alias("o"))
    return per_user.agg(F.avg("o").alias("overlap"))


def score_correlation(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pearson correlation of two score tables over common pairs: one row ``correlation``."""
    b = second.select("user_id", "item_id", F.col("score").alias("other"))
    return first.join(b, ["user_id", "item_id"]).agg(F.corr("score", "other").alias("correlation"))
