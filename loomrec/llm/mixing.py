"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over source blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.llm.tokens import token_count
from loomrec.scratch import stow

#: Bound on the blocks of all sources together, and with it on what the driver plans with.
MAX_BLOCKS = 1 << 17
#: Tokens a block should have at least.
BLOCK_TOKENS = 1 << 15
#: Blocks of an output shard of the splitting tree, and tokens its parts, which are ordered by one task each, have on average.
SHARD_BLOCKS, SHARD_TOKENS = 64, 1 << 26


@dataclass
class Mix:
    """``report``: one row a target source; ``plan``: the blocks drawn for each output shard; ``rows``: the drawn documents."""

    report: DataFrame
    plan: DataFrame
    rows: DataFrame


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources); columns sum to ``quotas`` exactly.

    Every node of the tree halves its shards and draws the left half's blocks without replacement from its own, seeded by its
    place in the tree, so any subtree can be recomputed on its own.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        take = round(total * (mid - lo) / (hi - lo))
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals")
        stack += [(lo, mid, draw), (mid, hi, have - draw)]
    return out


def _units(blocks: np.ndarray, tokens: np.ndarray, quota: float, max_repeats: int, seed: list[int]):
    """Blocks that make up ``quota`` tokens of one source: whole copies, then a permuted part, the last block cut at a number
    of tokens (-1: whole).  Returns block, copy, take."""
    size = int(tokens.sum())
    if not size or quota <= 0:
        return [np.zeros(0, np.int64)] * 3
    copies = min(max_repeats, int(quota // size))
    out = [(np.tile(blocks, copies), np.repeat(np.arange(copies), len(blocks)), np.full(copies * len(blocks), -1))]
    rest = round(quota - copies * size)
    if rest > 0 and copies < max_repeats:
        order = np.random.default_rng(seed).permutation(len(blocks))
        upto = np.cumsum(tokens[order])
        whole = int(np.searchsorted(upto, rest, side="right"))
        out.append((blocks[order[:whole]], np.full(whole, copies), np.full(whole, -1)))
        cut = rest - (int(upto[whole - 1]) if whole else 0)
        if cut > 0 and whole < len(order):
            out.append((blocks[order[whole : whole + 1]], np.array([copies]), np.array([cut])))
    return [np.concatenate(x).astype(np.int64) for x in zip(*out)]


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: str = "target_share",
    repeats: str = "max_repeats",
    total: int | None = None,
    seed: int = 7,
    max_blocks: int = MAX_BLOCKS,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    vocabulary: str | None = None,
) -> Mix:
    """Draw a mix of ``total`` tokens (default: those of all documents) in which each source has its target share.

    A source gets ``min(share * total, max_repeats * its tokens)``: all its documents as often as that covers them whole, then
    a random part without replacement, exact to within half a document.  A source that can't reach its share falls short and
    is reported; the others keep their shares of ``total`` rather than filling up.  Documents of unlisted or null sources and
    listed sources without documents contribute nothing, though all documents count towards the default ``total``.  A null or
    negative share counts as 0, a null ``max_repeats`` as 1.  Texts that are null or empty have no tokens and still come
    with their block.  Repeated rows are documents of their own; a source listed twice counts with its first row by share.

    Documents fall by a hash into blocks, at most ``max_blocks`` over all sources, each of about ``block_tokens`` or more.  The
    driver sees only the block sizes; it fixes the exact number of blocks a source contributes, splits these quotas over
    the output shards by a tree of multivariate-hypergeometric draws and hands every shard disjoint blocks of a random
    permutation.  A shard of more than ``SHARD_TOKENS`` is dealt by a hash to parts, shards of their own, and each shard then
    orders its documents at random.  No window or task spans a source.

    A source is short if all it may give was drawn, ``max_repeats`` times its tokens, and that is below its share of ``total``.

    ``report``: ``source, target_share, max_repeats, n_docs, size, quota, repeats, drawn, share_of_total, share_of_mix, short``.
    ``rows``: ``shard, position, source, <doc_id>, copy, n_tokens``.
    """
    spark = docs.sparkSession
    sized = stow(
        docs.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), token_count(F.col(text), vocabulary).alias("n_tokens"))
    )
    listed = targets.select(
        F.col(source).alias("source"),
        F.coalesce(F.greatest(F.col(share), F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.coalesce(F.col(repeats), F.lit(1)).alias("repeats"),
    ).dropna(subset=["source"])
    want = {}
    for r in listed.orderBy("source", "share", "repeats").toLocalIterator():
        want.setdefault(r["source"], (float(r["share"]), max(0, int(r["repeats"]))))
    names = sorted(want)
    everything = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    total = int(everything if total is None else total)
    known = sized.join(F.broadcast(spark.createDataFrame([(x,) for x in names], "source string")), "source")
    sums = {r["source"]: (r["n"], r["docs"]) for r in known.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    step = max(block_tokens, -(-sum(n for n, _ in sums.values()) // max(1, max_blocks - len(names))))
    n_blocks = {x: max(1, -(-n // step)) for x, (n, _) in sums.items()}
    if sums:
        small = spark.createDataFrame(sorted(n_blocks.items()), "source string, n_blocks long")
        blocked = known.join(F.broadcast(small), "source")
    else:
        blocked = known.withColumn("n_blocks", F.lit(1).cast("long"))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "n_tokens"), F.col("n_blocks"))).drop("n_blocks")
    table = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).toPandas()  # at most max_blocks rows
    table = table.sort_values(["source", "block"])
    units, report = {k: [] for k in ("source", "block", "copy", "take")}, []
    for k, name in enumerate(names):
        own = table[table["source"] == name]
        part, cap = want[name]
        size, n_docs = sums.get(name, (0, 0))
        quota = min(part * total, cap * size)
        b, c, t = _units(own["block"].to_numpy(np.int64), own["n"].to_numpy(np.int64), quota, cap, [seed, k])
        shuffled = np.random.default_rng([seed, k, 1]).permutation(len(b))
        for key, x in zip(units, (np.full(len(b), k), b[shuffled], c[shuffled], t[shuffled])):
            units[key].append(x)
        report.append((name, part, cap, int(n_docs), int(size), float(quota), quota / size if size else 0.0))
    per_source = np.array([len(x) for x in units["source"]], np.int64)
    shards = max(1, -(-int(per_source.sum()) // SHARD_BLOCKS))
    placed = split_quotas(per_source, shards, seed)
    where = [np.repeat(np.arange(shards), placed[:, k]) for k in range(len(names))]
    flat = {k: np.concatenate(x) if x else np.zeros(0, np.int64) for k, x in units.items()}
    plan = spark.createDataFrame(
        pa.table(
            {
                "source": pa.array(np.array(names, object)[flat["source"]] if names else [], pa.string()),
                "block": pa.array(flat["block"], pa.int64()),
                "copy": pa.array(flat["copy"], pa.int32()),
                "take": pa.array(flat["take"], pa.int64()),
                "shard": pa.array(np.concatenate(where) if where else np.zeros(0), pa.int32()),
            }
        )
    )
    drawn = _draw(blocked, plan, seed)
    reached = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn"))
    head = spark.createDataFrame(
        report,
        "source string, target_share double, max_repeats int, n_docs long, size long, quota double, repeats double",
    )
    got = F.coalesce("drawn", F.lit(0))
    whole = F.sum(got).over(Window.partitionBy(F.lit(1)))  # a row per target source
    short = (got >= F.col("max_repeats") * F.col("size")) & (got < F.col("target_share") * F.lit(total))
    full_report = head.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "size", "quota", "repeats", got.alias("drawn"),
        F.try_divide(got, F.lit(total)).alias("share_of_total"), F.try_divide(got, whole).alias("share_of_mix"), short.alias("short"),
    )
    split = max(1, -(-int(sum(r[5] for r in report)) // (shards * shard_tokens)))
    deal = F.pmod(F.xxhash64(F.lit(seed + 2), "id", "copy"), F.lit(split)).cast("int")
    place = Window.partitionBy("shard").orderBy("key", "id", "copy", "n_tokens")
    rows = (
        drawn.withColumn("shard", F.col("shard") * split + deal)
        .withColumn("key", F.xxhash64(F.lit(seed), "shard", "id", "copy"))
        .withColumn("position", F.row_number().over(place))
        .select("shard", "position", "source", F.col("id").alias(doc_id), "copy", "n_tokens")
    )
    return Mix(full_report, plan, rows)


def _draw(blocked: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents of the planned blocks; of a cut block a random run of documents that comes closest to its tokens."""
    whole = blocked.join(plan.filter("take < 0").drop("take"), ["source", "block"])
    part = blocked.join(F.broadcast(plan.filter("take >= 0")), ["source", "block"])  # at most one block a source
    order = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "n_tokens")
    upto = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("upto", upto).filter(F.col("upto") - F.col("n_tokens") / 2 <= F.col("take"))
    keep = ("source", "id", "n_tokens", "copy", "shard")
    return whole.select(*keep).union(part.select(*keep))


def short_sources(mix: Mix) -> DataFrame:
    """Sources that can't reach their share, from the drawn documents."""
    return mix.report.filter("short").select("source")
