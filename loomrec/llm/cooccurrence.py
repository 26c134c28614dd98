"""Items that appear together: pair counts and how far they exceed chance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import maybe_broadcast, stow

#: Pairs buffered in a worker before they are combined.
COMBINE_PAIRS = 2_000_000
#: Baskets are cut into tiles of so many items; a pair of tiles is the unit of work.
TILE = 512
#: The largest baskets above this size are matched by bit masks instead of emitting their pairs.
HEAVY_BASKET = 4_096


def combine_pairs(left: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None):
    """Distinct (left, right) with summed weights, by one sort of a packed 64-bit key."""
    names, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    width = np.int64(len(names))
    key = codes[: len(left)].astype(np.int64) * width + codes[len(left) :]
    if weight is None:
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.r_[first, len(key)])
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight[order], first) if len(key) else weight
    key = key[first]
    return names[key // width], names[key % width], total.astype(np.int64)


def emit_pairs(batches):
    """Arrow kernel: (xs, ys, same) tiles to combined ordered pairs with their counts.

    Tiles of equal shape are handled as one matrix.  ``same`` marks the tile paired with itself, where only the upper
    triangle counts.
    """
    out_schema = pa.schema([("item_a", pa.int64()), ("item_b", pa.int64()), ("n", pa.int64())])
    lefts, rights, held = [], [], 0

    def flush():
        a, b, n = combine_pairs(np.concatenate(lefts), np.concatenate(rights))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], schema=out_schema)

    for batch in batches:
        xs, ys, same = batch.column(0), batch.column(1), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        x_flat, x_off = xs.values.to_numpy(zero_copy_only=False), xs.offsets.to_numpy()
        y_flat, y_off = ys.values.to_numpy(zero_copy_only=False), ys.offsets.to_numpy()
        x_len, y_len = np.diff(x_off), np.diff(y_off)
        shapes = np.stack([x_len, y_len, same], axis=1)
        kinds, where = np.unique(shapes, axis=0, return_inverse=True)
        where = where.reshape(-1)
        by_kind = np.split(np.argsort(where, kind="stable"), np.cumsum(np.bincount(where, minlength=len(kinds)))[:-1])
        for (nx, ny, itself), rows in zip(kinds, by_kind):
            if itself:
                i, j = np.triu_indices(nx, 1)
            else:
                i, j = np.divmod(np.arange(nx * ny), max(ny, 1))
            if not len(i):
                continue
            step = max(1, COMBINE_PAIRS // len(i))
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                x = x_flat[x_off[part][:, None] + np.arange(nx)]
                y = x if itself else y_flat[y_off[part][:, None] + np.arange(ny)]
                p, q = x[:, i].ravel(), y[:, j].ravel()
                lefts.append(np.minimum(p, q))
                rights.append(np.maximum(p, q))
                held += len(p)
                if held >= COMBINE_PAIRS:
                    yield flush()
                    lefts, rights, held = [], [], 0
    if held:
        yield flush()


def cooccurring_items(
    rows: DataFrame,
    basket: str,
    item: str,
    *,
    min_count: int = 1,
    min_lift: float = 0.0,
    heavy_basket: int = HEAVY_BASKET,
    tile: int = TILE,
) -> DataFrame:
    """Every pair of items of a common basket: ``item_a < item_b, n_ab, n_a, n_b, lift, pmi``.

    ``n_a``, ``n_b`` count the distinct baskets of an item, ``n_ab`` those of both, over all ``n`` baskets;
    ``lift = n_ab * n / (n_a * n_b)`` and ``pmi = ln(lift)``.  Items are deduplicated per basket, ordered pairs are emitted in
    Arrow batches, combined in the worker and summed after one shuffle.

    Nothing is sampled or capped.  ``min_count`` and ``min_lift`` define the result, and what they imply is used early:
    an item in fewer than ``min_count`` baskets, or in more than ``n / min_lift``, is in no pair of the result.  Of the
    baskets above ``heavy_basket`` items, the ``min_count - 1`` largest (at most 62) emit no pairs at all: a pair of the result
    must also occur in some other basket, so their share is added to the surviving pairs from a bit mask per item.  Larger
    baskets beyond those are cut into tiles, so that no task holds all pairs of one.

    Rows with a null basket or item don't count; repeated rows count once; other columns are ignored.  An empty table
    gives no rows.  Ids must be integers.
    """
    spark = rows.sparkSession
    pairs = stow(
        rows.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item")).dropna().distinct()
    )
    items = stow(pairs.groupBy("item").agg(F.count("*").alias("n")))
    n = pairs.select("basket").distinct().count()
    widest = n / min_lift if min_lift > 0 else float("inf")
    fit = items.filter((F.col("n") >= min_count) & (F.col("n") <= F.lit(widest)))
    n_fit, n_items = fit.count(), items.count()
    kept = pairs
    if n_fit < n_items:
        kept = pairs.join(maybe_broadcast(fit.select("item"), n_fit, 40), "item", "left_semi")
    # Which baskets, if any, are answered by masks: at most 62 ids, so collecting them is bounded.
    sizes = kept.groupBy("basket").agg(F.count("*").alias("size"))
    masked = min(min_count - 1, 62)
    heavy = []
    if masked > 0:
        top = sizes.filter(F.col("size") > heavy_basket).orderBy(F.desc("size"), "basket").limit(masked)
        heavy = [r["basket"] for r in top.collect()]
    light = kept.filter(~F.col("basket").isin(heavy)) if heavy else kept
    # A basket is cut into tiles by a hash of the item; a basket of one tile keeps all its items together.
    n_tiles = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    tiled = light
    if sizes.filter(F.col("size") > tile).limit(1).count():
        large = stow(sizes.filter(F.col("size") > tile).select("basket", n_tiles.alias("tiles")))
        tiled = light.join(large, "basket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("item"), F.col("tiles")).cast("int"))
        groups = tiled.groupBy("basket", "tile", "tiles").agg(F.collect_list("item").alias("xs"))
        single = groups.filter("tiles = 1").select("xs", F.col("xs").alias("ys"), F.lit(True).alias("same"))
        many = groups.filter("tiles > 1")
        # Each tile is sent to the tile pairs it belongs to; the two of a pair then meet by key, never a whole basket.
        sent = many.select(
            "basket", "tile", "xs", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        ).select(
            "basket", "xs", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile"
        )
        met = sent.groupBy("basket", "lo", "hi").agg(
            F.min_by("xs", "tile").alias("xs"), F.max_by("xs", "tile").alias("ys")
        )
        tiles = single.union(met.select("xs", "ys", F.expr("lo = hi").alias("same")))
    else:
        tiles = tiled.groupBy("basket").agg(F.collect_list("item").alias("xs"))
        tiles = tiles.filter(F.size("xs") > 1).select(
            "xs", F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("ys"), F.lit(True).alias("same")
        )
    counted = (
        tiles.mapInArrow(emit_pairs, "item_a long, item_b long, n long")
        .groupBy("item_a", "item_b")
        .agg(F.sum("n").alias("n_light"))
        .filter(F.col("n_light") >= max(1, min_count - len(heavy)))
    )
    stats = items.withColumn("mask", F.lit(0).cast("long"))
    if heavy:
        bits = spark.createDataFrame([(b, 1 << k) for k, b in enumerate(heavy)], "basket long, bit long")
        masks = pairs.join(F.broadcast(bits), "basket").groupBy("item").agg(F.sum("bit").alias("mask"))
        stats = items.join(masks, "item", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    for side in ("a", "b"):
        named = stats.select(
            F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"), F.col("mask").alias(f"mask_{side}")
        )
        counted = counted.join(maybe_broadcast(named, n_items, 56), f"item_{side}")
    n_ab = F.col("n_light") + F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b")))
    lift = F.col("n_ab").cast("double") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        counted.withColumn("n_ab", n_ab)
        .withColumn("lift", lift)
        .filter((F.col("n_ab") >= min_count) & (F.col("lift") >= min_lift))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "lift", F.log("lift").alias("pmi"))
    )
