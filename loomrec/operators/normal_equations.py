"""Half-sweeps of alternating least squares: small dense systems for every entity, assembled and solved in Arrow kernels.

The entries of an entity come as one or more segments; a hot entity has several, each summed in a task of its own, and only
its k x k system is shuffled.  The fixed side reaches the kernels as a broadcast array while its counted size permits;
otherwise its factors are joined to the entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import BROADCAST_BYTES, discard, maybe_broadcast, spread, stow

#: Entries of one segment.
SEGMENT = 8_192
#: Numbers in the largest temporary of a kernel.
TEMPORARY = 1 << 22
OUT = "id long, factors array<double>, partial array<double>"


@dataclass
class Rules:
    """What a half-sweep minimises and how it solves.

    ``kind``: ``weighted`` (confidence max(1, 1 + alpha r)), ``cached`` (1 + alpha r), ``biased`` (rating minus mean and the
    other side's bias, factors extended by a 1), ``rows`` and ``columns`` (one coordinate sweep with item weights of the
    unobserved entries).  ``solver``: ``cholesky``, ``cg`` or ``nonnegative``.
    """

    kind: str
    solver: str = "cholesky"
    alpha: float = 1.0
    reg: float = 0.1
    cg_steps: int = 3
    mean: float = 0.0
    base: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def segments(x: DataFrame, entity: str, other: str, universe: DataFrame) -> DataFrame:
    """``id, segs, others, vals``: the entries of every entity of the universe in segments; those without have one empty one."""
    split = x.groupBy(F.col(entity).alias("id")).agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("segs"))
    several = split.filter("segs > 1")
    rows = x.select(F.col(entity).alias("id"), F.col(other).alias("o"), F.col("value").alias("v"))
    if several.limit(1).count():
        rows = rows.join(several, "id", "left").withColumn("segs", F.coalesce("segs", F.lit(1)))
    else:
        rows = rows.withColumn("segs", F.lit(1))
    rows = rows.withColumn("seg", F.pmod(F.xxhash64("o"), F.col("segs")))
    pairs = rows.groupBy("id", "seg", "segs").agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("e"))
    lists = pairs.select("id", "segs", F.col("e.o").alias("others"), F.col("e.v").alias("vals"))
    none, no_value = F.expr("CAST(array() AS ARRAY<BIGINT>)"), F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    full = spread(universe.select(F.col(entity).alias("id")).join(lists, "id", "left"), "id", "segs")
    return stow(full.select("id", F.coalesce("segs", F.lit(1)).alias("segs"), F.coalesce("others", none).alias("others"), F.coalesce("vals", no_value).alias("vals")))


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run gives zeros."""
    out = np.zeros((len(counts), *values.shape[1:]))
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(values, starts, axis=0)
    return out


def assemble(rules: Rules, e: np.ndarray, vals: np.ndarray, extra: np.ndarray, own: np.ndarray, counts: np.ndarray):
    """Weighted outer products and right sides per segment.  ``extra``: weight or bias of each entry's other side; ``own``: weight
    of each segment's entity."""
    if rules.kind == "biased":
        e = np.concatenate([e, np.ones((len(e), 1))], axis=1)
        w, t = np.ones(len(e)), vals - rules.mean - extra
    elif rules.kind == "weighted":
        c = np.maximum(1.0, 1.0 + rules.alpha * vals)
        w, t = c - 1, c
    elif rules.kind == "cached":
        w, t = rules.alpha * vals, 1 + rules.alpha * vals
    elif rules.kind == "rows":
        w, t = np.ones(len(e)), 1 + extra
    else:
        w, t = np.ones(len(e)), 1 + np.repeat(own, counts)
    k = e.shape[1]
    a, b = np.zeros((len(counts), k, k)), sums_by_row(e * t[:, None], counts)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):  # by as many segments as the temporary holds
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + max(1, TEMPORARY // (k * k)), side="right"))
        hi = max(hi, lo + 1)
        part = slice(ends[lo - 1] if lo else 0, ends[hi - 1])
        if hi == lo + 1:
            a[lo] = (e[part] * w[part, None]).T @ e[part]
        else:
            a[lo:hi] = sums_by_row((e[part] * w[part, None])[:, :, None] * e[part][:, None, :], counts[lo:hi])
        lo = hi
    return a, b


def solve_spd(a: np.ndarray, b: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    """Solutions of stacked symmetric systems; a singular one is lifted on its diagonal step by step, else keeps ``fallback``."""
    try:
        out = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        out = np.full_like(b, np.nan)
    for r in np.flatnonzero(~np.isfinite(out).all(1)):
        scale = max(float(np.abs(np.diag(a[r])).max()), 1e-30)
        out[r] = fallback[r]
        for lift in (1e-10, 1e-8, 1e-6, 1e-4, 1e-2):
            try:
                one = np.linalg.solve(a[r] + scale * lift * np.eye(len(b[r])), b[r])
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(one).all():
                out[r] = one
                break
    return out


def conjugate_gradient(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """At most ``steps`` steps from ``x`` for stacked systems; a system stops when its residual or curvature vanishes."""
    x = x.copy()
    r = b - np.einsum("nij,nj->ni", a, x)
    p, rs = r.copy(), (r * r).sum(1)
    tiny = np.finfo(float).eps
    for _ in range(steps):
        ap = np.einsum("nij,nj->ni", a, p)
        curve = (p * ap).sum(1)
        go = (rs >= tiny) & (curve >= tiny)
        if not go.any():
            break
        step = np.where(go, rs / np.where(go, curve, 1.0), 0.0)[:, None]
        x += step * p
        r -= step * ap
        new = (r * r).sum(1)
        p = r + np.where(go, new / np.where(rs > 0, rs, 1.0), 0.0)[:, None] * p
        rs = np.where(go, new, rs)
    return x


def nonnegative(a: np.ndarray, b: np.ndarray, x: np.ndarray, sweeps: int = 50, tol: float = 1e-8) -> np.ndarray:
    """Coordinate descent for stacked systems under x >= 0, from the clipped unconstrained solution."""
    x = np.maximum(x, 0.0)
    d = np.maximum(np.einsum("nii->ni", a), 1e-300)
    for _ in range(sweeps):
        most = 0.0
        for f in range(x.shape[1]):
            new = np.maximum(0.0, x[:, f] + (b[:, f] - np.einsum("ni,ni->n", a[:, f], x)) / d[:, f])
            most = max(most, float(np.abs(new - x[:, f]).max(initial=0.0)))
            x[:, f] = new
        if most < tol:
            break
    return x


def solve(rules: Rules, a: np.ndarray, b: np.ndarray, start: np.ndarray, own: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Add the part all entities share and solve; ``entries`` counts an entity's observations."""
    k = b.shape[1]
    eye = np.eye(k)
    if rules.kind in ("rows", "columns"):
        m = a + (rules.base if rules.kind == "rows" else own[:, None, None] * rules.base)
        x = start.copy()
        for f in range(k):
            others = np.einsum("ni,ni->n", m[:, f], x) - m[:, f, f] * x[:, f]
            x[:, f] = (b[:, f] - others) / (m[:, f, f] + rules.reg)
        return np.where((entries == 0)[:, None], start, x) if rules.kind == "rows" else x
    if rules.kind == "biased":
        shared = np.zeros((k, k))
        shared[:-1, :-1] = rules.base
        shared += rules.reg * eye
        shared[-1, -1] += rules.reg  # the corner is regularized twice
    else:
        shared = rules.base + rules.reg * eye
    a = a + shared
    if rules.solver == "cg":
        x = conjugate_gradient(a, b, start, rules.cg_steps)
    else:
        x = solve_spd(a, b, np.where((entries == 0)[:, None], 0.0, start))
        if rules.solver == "nonnegative":
            x = nonnegative(a, b, x)
    return np.where((entries == 0)[:, None], 0.0, x)


class Table:
    """Factors of one side on the driver, sorted by id: the broadcast form."""

    def __init__(self, ids: np.ndarray, factors: np.ndarray, extra: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.factors = ids[order], factors[order]
        self.extra = np.zeros(len(ids)) if extra is None else extra[order]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids; -1 for unknown ones."""
        at = np.searchsorted(self.ids, ids)
        at = np.minimum(at, max(0, len(self.ids) - 1))
        return np.where(self.ids[at] == ids, at, -1) if len(self.ids) else np.full(len(ids), -1)

    def to_frame(self, spark, extra: str | None = None) -> DataFrame:
        columns = {"id": pa.array(self.ids), "factors": pa.array(list(self.factors), pa.list_(pa.float64()))}
        schema = "id long, factors array<double>"
        if extra:
            columns[extra], schema = pa.array(self.extra), f"{schema}, {extra} double"
        return spark.createDataFrame(pa.table(columns), schema)


def fits_broadcast(n: int, rank: int, limit: int = BROADCAST_BYTES) -> bool:
    return n * (rank + 2) * 8 <= limit


def half_sweep(spark, segs: DataFrame, rules: Rules, mine: Table, other: Table) -> Table:
    """New factors of ``mine`` with ``other`` fixed; both sides in broadcast form."""
    held = spark.sparkContext.broadcast((mine, other, rules))

    def kernel(batches):
        mine, other, rules = held.value
        for batch in batches:
            ids, n_segs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            counts = np.diff(batch.column(2).offsets.to_numpy())
            at = other.rows(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            vals = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            known = at >= 0
            if not known.all():
                counts = sums_by_row(known.astype(float), counts).astype(np.int64)
                at, vals = at[known], vals[known]
            me = mine.rows(ids)
            a, b = assemble(rules, other.factors[at], vals, other.extra[at], mine.extra[me], counts)
            whole = n_segs == 1
            if whole.any():
                start = mine.factors[me[whole]]
                if rules.kind == "biased":
                    start = np.concatenate([start, mine.extra[me[whole], None]], axis=1)
                x = solve(rules, a[whole], b[whole], start, mine.extra[me[whole]], counts[whole])
                yield _batch(ids[whole], x, None)
            if not whole.all():
                flat = np.concatenate([a[~whole].reshape((~whole).sum(), -1), b[~whole], counts[~whole, None]], axis=1)
                yield _batch(ids[~whole], None, flat)

    got = segs.mapInArrow(kernel, OUT).toArrow()
    done = got.filter(pa.compute.is_valid(got["factors"]))
    ids, x = done["id"].to_numpy(), _matrix(done["factors"])
    part = got.filter(pa.compute.is_valid(got["partial"]))
    if len(part):  # a few numbers a segment of a hot entity
        keys, where = np.unique(part["id"].to_numpy(), return_inverse=True)
        flat = np.zeros((len(keys), len(part["partial"][0])))
        np.add.at(flat, where, _matrix(part["partial"]))
        k = int(round((-1 + (1 + 4 * (flat.shape[1] - 1)) ** 0.5) / 2))
        a, b, n = flat[:, : k * k].reshape(-1, k, k), flat[:, k * k : k * k + k], flat[:, -1]
        me = mine.rows(keys)
        start = mine.factors[me]
        if rules.kind == "biased":
            start = np.concatenate([start, mine.extra[me, None]], axis=1)
        solved = solve(rules, a, b, start, mine.extra[me], n)
        ids, x = np.concatenate([ids, keys]), np.concatenate([x, solved]) if len(x) else solved
    held.destroy()
    if rules.kind == "biased":
        return Table(ids, x[:, :-1], x[:, -1])
    return Table(ids, x, mine.extra[mine.rows(ids)])


def observed_loss(spark, segs: DataFrame, rules: Rules, mine: Table, other: Table) -> float:
    """The part of the objective over stored entries, without regularization; both sides in broadcast form."""
    held = spark.sparkContext.broadcast((mine, other, rules))

    def kernel(batches):
        mine, other, rules = held.value
        total = 0.0
        for batch in batches:
            counts = np.diff(batch.column(2).offsets.to_numpy())
            at = other.rows(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            vals = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            me = np.repeat(mine.rows(batch.column(0).to_numpy()), counts)
            y = np.einsum("nk,nk->n", mine.factors[me], other.factors[at])
            if rules.kind == "biased":
                part = (vals - rules.mean - mine.extra[me] - other.extra[at] - y) ** 2
            elif rules.kind == "weighted":
                part = np.maximum(1.0, 1 + rules.alpha * vals) * (1 - y) ** 2
            elif rules.kind == "cached":
                part = (1 + rules.alpha * vals) * (1 - y) ** 2
            else:
                c = other.extra[at]
                part = (1 + c) * (1 - y) ** 2 - c * y * y
            total += float(part.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["loss"])

    out = segs.mapInArrow(kernel, "loss double").agg(F.coalesce(F.sum("loss"), F.lit(0.0))).first()[0]
    held.destroy()
    return float(out)


def _batch(ids, factors, partial):
    kind = pa.list_(pa.float64())
    none = pa.nulls(len(ids), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), none if factors is None else pa.array(list(factors), kind), none if partial is None else pa.array(list(partial), kind)],
        names=["id", "factors", "partial"],
    )


def _matrix(column) -> np.ndarray:
    n = len(column)
    return np.asarray(pa.compute.list_flatten(column)).reshape(n, -1).astype(float) if n else np.zeros((0, 0))


def half_sweep_joined(x: DataFrame, entity: str, other: str, universe: DataFrame, rules: Rules, mine: DataFrame, fixed: DataFrame, segment: int = 4_096, group: int = 2_048) -> DataFrame:
    """:func:`half_sweep` for sides that are too large to broadcast: ``id, factors, extra`` tables, joined by shuffles.

    Entries meet the fixed factors in a join on the other id and are gathered per (entity, part).  An entity has one part for
    every ``segment`` of its entries, so a list of factors stays bounded.  An entity of one part is solved where its entries are;
    only hot entities ship partial systems, and about ``group`` of them are solved together.
    """
    f = fixed.select(F.col("id").alias(other), F.col("factors").alias("f"), F.col("extra").alias("x"))
    degree = x.groupBy(entity).agg(F.count("*").alias("d")).filter(F.col("d") > segment)
    hot = stow(degree.select(entity, F.ceil(F.col("d") / F.lit(segment)).alias("parts")))
    n_hot = hot.count()
    x = x.join(maybe_broadcast(hot, n_hot, 40), entity, "left")
    part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))
    met = x.join(f, other).select(F.col(entity).alias("id"), F.struct("value", "f", "x").alias("e"), part.alias("part"))
    cut = met.groupBy("id", "part").agg(F.collect_list("e").alias("e"))
    all_mine = universe.select(F.col(entity).alias("id")).join(mine, "id")
    parts = maybe_broadcast(hot.select(F.col(entity).alias("id"), "parts"), n_hot, 40)
    none = F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    lists = all_mine.join(cut, "id", "left").join(parts, "id", "left").select(
        "id", F.coalesce(F.flatten(F.col("e.f")), none).alias("f"), F.coalesce("e.value", none).alias("v"), F.coalesce("e.x", none).alias("x"),
        F.col("extra").alias("own"), "factors", F.col("parts").isNull().alias("whole"),
    )
    arrays, biased = pa.list_(pa.float64()), rules.kind == "biased"

    def partial(batches):
        for batch in batches:
            counts = np.diff(batch.column(2).offsets.to_numpy())
            ids, own, start = batch.column(0).to_numpy(), batch.column(4).to_numpy(), _matrix(batch.column(5))
            e = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(int(counts.sum()), start.shape[1])
            vals, extra = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            whole = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
            a, b = assemble(rules, e, vals, extra, own, counts)
            if whole.any():
                first = np.concatenate([start, own[:, None]], axis=1)[whole] if biased else start[whole]
                solved = solve(rules, a[whole], b[whole], first, own[whole], counts[whole])
                factors, rest = (solved[:, :-1], solved[:, -1]) if biased else (solved, own[whole])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[whole]), pa.array(list(factors), arrays), pa.array(rest), pa.nulls(len(rest), arrays)], names=["id", "factors", "extra", "s"]
                )
            if not whole.all():
                part = ~whole
                flat = np.concatenate([a[part].reshape(part.sum(), -1), b[part], counts[part, None]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part]), pa.nulls(len(flat), arrays), pa.nulls(len(flat), pa.float64()), pa.array(list(flat), arrays)], names=["id", "factors", "extra", "s"]
                )

    out = stow(lists.mapInArrow(partial, "id long, factors array<double>, extra double, s array<double>"))
    if not n_hot:
        discard(hot)
        whole = out.drop("s")
        whole._stowed_at = out._stowed_at  # for the caller to discard
        return whole
    rows = all_mine.join(parts.select("id"), "id", "left_semi").withColumn("s", F.expr("CAST(NULL AS ARRAY<DOUBLE>)"))
    rows = rows.unionByName(out.filter("s IS NOT NULL"))

    def finish(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_valid(table["factors"]))
        ids, start, own = head["id"].to_numpy(), _matrix(head["factors"]), head["extra"].to_numpy()
        rank = start.shape[1]
        if biased:
            start = np.concatenate([start, own[:, None]], axis=1)
        k = start.shape[1]
        flat = np.zeros((len(ids), k * k + k + 1))
        tail = table.filter(pa.compute.is_valid(table["s"]))
        if len(tail):
            order = np.argsort(ids)
            at = order[np.searchsorted(ids, tail["id"].to_numpy(), sorter=order)]
            np.add.at(flat, at, _matrix(tail["s"]))
        x = solve(rules, flat[:, : k * k].reshape(-1, k, k), flat[:, k * k : k * k + k], start, own, flat[:, -1])
        return pa.table({"id": ids, "factors": pa.array(list(x[:, :rank]), arrays), "extra": x[:, -1] if biased else own})

    groups = rows.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(max(8, -(-n_hot // group)))))
    solved = groups.groupBy("_g").applyInArrow(lambda t: finish(t), "id long, factors array<double>, extra double")
    whole = stow(out.filter("s IS NULL").drop("s").unionByName(solved))
    discard(hot)
    discard(out)
    return whole
