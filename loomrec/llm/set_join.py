"""All similar pairs between set-valued records: prefix-filtered similarity join with exact verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import maybe_broadcast, stow

#: Sets of more tokens stay in long form throughout and are never gathered into one row.
HUGE_SET = 50_000
#: The index list of a (token, length class) is cut into tiles of about so many rows, which several tasks probe.
LIST_TILE = 50_000
#: Records with the very same set are all paired with each other up to this class size, beyond it linked to the first one.
EXPAND_CLASS = 64


@dataclass
class SetJoin:
    """``pairs`` of class representatives (``a < b, overlap, size_a, size_b, jaccard``) and the ``members`` of each class
    (``record, rep, n_members``).  A class holds the records with exactly the same set; its representative is the smallest id."""

    pairs: DataFrame
    members: DataFrame

    def record_pairs(self, expand_class: int = EXPAND_CLASS) -> DataFrame:
        """Pairs of records ``a < b, jaccard``: every link between different sets, and the links within classes.

        A class of more than ``expand_class`` equal records is given as links from its representative to each member, and
        takes part in links to other sets through its representative; with ``members`` that loses nothing.
        """
        inner = self.members.filter("n_members > 1")
        small = inner.filter(F.col("n_members") <= expand_class)
        within = small.alias("x").join(small.alias("y"), F.expr("x.rep = y.rep AND x.record < y.record"))
        within = within.select(F.col("x.record").alias("a"), F.col("y.record").alias("b"))
        star = inner.filter((F.col("n_members") > expand_class) & (F.col("record") != F.col("rep")))
        copies = within.union(star.select(F.col("rep").alias("a"), F.col("record").alias("b")))
        copies = copies.withColumn("jaccard", F.lit(1.0))
        # Only classes of several members need a join; all other representatives are the record itself.
        stand_in = small.select("rep", "record").groupBy("rep").agg(F.collect_list("record").alias("who"))
        across = self.pairs.select("a", "b", "jaccard")
        for side in ("a", "b"):
            named = stand_in.select(F.col("rep").alias(side), F.col("who").alias(f"who_{side}"))
            across = across.join(named, side, "left").withColumn(
                side, F.explode(F.coalesce(f"who_{side}", F.array(side)))
            ).drop(f"who_{side}")
        across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
        return across.union(copies)


def _least_overlap(size_a: Column, size_b: Column, threshold: float) -> Column:
    # jaccard >= t  <=>  overlap >= t / (1 + t) * (size_a + size_b); the small term guards against rounding up an exact integer
    return F.ceil(F.lit(threshold / (1 + threshold)) * (size_a + size_b) - 1e-9)


def similar_sets(
    rows: DataFrame, record: str, token: str, *, threshold: float, min_size: int = 1, huge_set: int = HUGE_SET, list_tile: int = LIST_TILE
) -> SetJoin:
    """Pairs of records whose token sets have a Jaccard similarity of at least ``threshold`` (0 < threshold <= 1).

    Sets are the distinct non-null tokens of a record; rows with a null record or token don't count, repeated rows count
    once, sets below ``min_size`` and other columns are left out.  An empty table gives no pairs.

    Records with equal sets become one class.  Tokens are ordered by rarity over all records.  The smaller set of a pair is
    indexed by its first ``s - ceil(2t/(1+t) s) + 1`` tokens, the larger probes with ``s - ceil(t s) + 1``; they meet on
    (token, length class), where the length and the positional filter apply.  Only record, size and position travel with a
    token, so the volume grows with the sets' sizes and not with their squares.  Length classes split the list of a frequent
    token, and a list of more than ``list_tile`` rows is cut into tiles that meet the same probes in different tasks.  The distinct
    candidate pairs are then joined with both sets by id and verified exactly.  Sets above ``huge_set`` can only match sets
    nearly as large; those keep their long form and are counted by joins on the token.  No candidate is dropped.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    pairs = stow(rows.select(F.col(record).alias("r"), F.col(token).alias("t")).dropna().distinct())
    counts = pairs.groupBy("t").agg(F.count("*").alias("f"))
    n_tokens = counts.count()
    with_rarity = pairs.join(maybe_broadcast(counts, n_tokens, 48), "t")
    sizes = pairs.groupBy("r").agg(F.count("*").alias("n"))
    n_huge = sizes.filter(F.col("n") > huge_set * threshold).limit(1).count()
    regular = with_rarity
    if n_huge:
        huge_ids = stow(sizes.filter(F.col("n") > huge_set).select("r", "n"))
        regular = with_rarity.join(huge_ids, "r", "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: x["t"])
    sets = regular.groupBy("r").agg(ordered.alias("s")).filter(F.size("s") >= min_size)
    # Equal sets: 128 bits of two independent hashes of the ordered tokens stand for the set.
    keyed = sets.withColumn("k1", F.xxhash64("s")).withColumn("k2", F.xxhash64(F.lit(7), F.col("s"), F.size("s")))
    keyed = stow(keyed)
    classes = keyed.groupBy("k1", "k2").agg(F.min("r").alias("rep"), F.count("*").alias("n_members"))
    several = stow(classes.filter("n_members > 1"))
    copied = keyed.select("r", "k1", "k2").join(several, ["k1", "k2"], "left")
    members = copied.select(
        F.col("r").alias("record"), F.coalesce("rep", "r").alias("rep"), F.coalesce("n_members", F.lit(1)).alias("n_members")
    )
    shadows = members.filter("record <> rep").select(F.col("record").alias("r"))
    firsts = stow(keyed.join(shadows, "r", "left_anti").select("r", "s", F.size("s").alias("n")))

    t = threshold
    width = math.log(1 / t) if t < 1 else 1.0
    length = lambda n: F.floor(F.log(n.cast("double")) / F.lit(width) + 1e-9) if t < 1 else n.cast("long")
    n = F.col("n")
    probe_len = (n - F.ceil(F.lit(t) * n - 1e-9) + 1).cast("int")
    index_len = (n - F.ceil(F.lit(2 * t / (1 + t)) * n - 1e-9) + 1).cast("int")
    probe = firsts.select("r", "n", length(n).alias("b"), F.posexplode(F.slice("s", F.lit(1), probe_len)).alias("p", "t"))
    index = firsts.select("r", "n", length(n).alias("own"), F.posexplode(F.slice("s", F.lit(1), index_len)).alias("p", "t"))
    reach = F.array(F.col("own"), F.col("own") + 1) if t < 1 else F.array("own")
    index = index.withColumn("b", F.explode(reach)).drop("own")
    listed = index.groupBy("t", "b").agg(F.count("*").alias("f")).filter(F.col("f") > list_tile)
    long_lists = stow(listed.select("t", "b", F.ceil(F.col("f") / F.lit(list_tile)).cast("int").alias("tiles")))
    n_long = long_lists.count()
    if n_long:
        tiles = F.coalesce("tiles", F.lit(1))
        long_lists = maybe_broadcast(long_lists, n_long, 40)
        index = index.join(long_lists, ["t", "b"], "left").withColumn("tile", F.pmod(F.xxhash64("r"), tiles).cast("int"))
        probe = probe.join(long_lists, ["t", "b"], "left").withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    else:
        index, probe = index.withColumn("tile", F.lit(0)), probe.withColumn("tile", F.lit(0))
    x, y = probe.alias("x"), index.alias("y")
    need = _least_overlap(F.col("x.n"), F.col("y.n"), t)
    met = x.join(
        y,
        (F.col("x.t") == F.col("y.t"))
        & (F.col("x.b") == F.col("y.b"))
        & (F.col("x.tile") == F.col("y.tile"))
        & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.r") < F.col("x.r"))))
        & (F.col("y.n") >= F.lit(t) * F.col("x.n") - 1e-9)
        & (1 + F.least(F.col("x.n") - F.col("x.p") - 1, F.col("y.n") - F.col("y.p") - 1) >= need),
    )
    found = met.select(F.col("x.r").alias("u"), F.col("y.r").alias("v"), F.col("x.n").alias("nu"), F.col("y.n").alias("nv")).distinct()
    for side in ("u", "v"):
        found = found.join(firsts.select(F.col("r").alias(side), F.col("s").alias(f"s{side}")), side)
    found = found.withColumn("overlap", F.size(F.array_intersect("su", "sv"))).filter(
        F.col("overlap") >= _least_overlap(F.col("nu"), F.col("nv"), t)
    )
    found = found.select("u", "v", "nu", "nv", "overlap")
    if n_huge:
        found = found.union(_huge_pairs(pairs, sizes, t, max(min_size, math.floor(huge_set * t)), huge_set))
    first = F.col("u") < F.col("v")
    result = found.select(
        F.least("u", "v").alias("a"),
        F.greatest("u", "v").alias("b"),
        F.col("overlap").cast("long").alias("overlap"),
        F.when(first, F.col("nu")).otherwise(F.col("nv")).cast("long").alias("size_a"),
        F.when(first, F.col("nv")).otherwise(F.col("nu")).cast("long").alias("size_b"),
        (F.col("overlap") / (F.col("nu") + F.col("nv") - F.col("overlap"))).alias("jaccard"),
    )
    if n_huge:
        alone = huge_ids.filter(F.col("n") >= min_size)
        members = members.union(alone.select(F.col("r"), F.col("r"), F.lit(1)))
    return SetJoin(result, members)


def _huge_pairs(pairs: DataFrame, sizes: DataFrame, t: float, least: int, huge_set: int) -> DataFrame:
    """Exact pairs with at least one set above ``huge_set``: length-compatible pairs first, then overlaps counted in long form."""
    near = stow(sizes.filter(F.col("n") >= least))
    x, y = near.alias("x"), near.alias("y")
    step = math.log(1 / t) if t < 1 else 1.0
    bucket = F.floor(F.log("n") / F.lit(step) + 1e-9) if t < 1 else F.col("n")
    x = near.withColumn("b", bucket).alias("x")
    y = near.withColumn("b", F.explode(F.array(bucket, bucket + 1) if t < 1 else F.array(bucket))).alias("y")
    able = x.join(
        y,
        (F.col("x.b") == F.col("y.b"))
        & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.r") < F.col("x.r"))))
        & (F.col("y.n") >= F.lit(t) * F.col("x.n") - 1e-9)
        & (F.col("x.n") > huge_set),
    ).select(F.col("x.r").alias("u"), F.col("y.r").alias("v"), F.col("x.n").alias("nu"), F.col("y.n").alias("nv"))
    able = stow(able.distinct())
    left = pairs.withColumnRenamed("r", "u").join(able, "u").select("u", "v", "nu", "nv", "t")
    both = left.join(pairs.withColumnRenamed("r", "v"), ["v", "t"])
    counted = both.groupBy("u", "v", "nu", "nv").agg(F.count("*").cast("int").alias("overlap"))
    return counted.filter(F.col("overlap") >= _least_overlap(F.col("nu"), F.col("nv"), t))
