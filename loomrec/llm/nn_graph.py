"""Most similar vectors for every vector: NN-descent over blocks of vectors, and greedy search on the graph.

Vectors live in blocks.  A neighbour is named by a code (block, place in the block), so every task knows where a neighbour's
home is.  A round of NN-descent consists of two Spark joins on the block:

* join: every vector has been sent to the blocks of its neighbours (each block once), so a block sees, for each of its
  members, the vectors that have it as neighbour.  Any two of those are neighbours of a neighbour of each other; their
  similarity is computed and, where it beats the worst kept neighbour of either, sent to that one's home.
* update: a block merges what was found for its members and sends each vector to the homes of its neighbours again.

Rounds alternate with random projection trees in other partitions of the vectors, until the recall measured on a sample of
vectors is as high as asked for.

Blocks travel as packed arrays, so the JVM moves a few large rows instead of a row per candidate.
"""

from __future__ import annotations

import gc
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions import dot, norm
from loomrec.scratch import discard, maybe_broadcast, stow

BLOCK_ROWS = 50_000
#: Rows the coarse partition is fitted on, by order of a hash of the id: so many, or so many a block if that is more.
SAMPLE_ROWS, SAMPLE_PER_BLOCK = 16_384, 64
#: Similarities are kept in steps of 1 / STEPS.
STEPS = 32_767.0
ROW = "kind string, dest int, src int, moved long, hits long, sought long, payload binary"
SCHEMA = pa.schema(
    [("kind", pa.string()), ("dest", pa.int32()), ("src", pa.int32()), ("moved", pa.int64()), ("hits", pa.int64()), ("sought", pa.int64()), ("payload", pa.binary())]
)


def packed(**arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def rows_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(SCHEMA)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def unpacked(table: pa.Table) -> list[dict]:
    return [pickle.loads(x.as_buffer()) for x in table["payload"]]


def fit_partition(sample: np.ndarray, leaves: int, seed) -> list[tuple]:
    """A tree of hyperplanes between random pairs of sample vectors that cuts the sample into ``leaves`` equal parts."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, lo: int, hi: int) -> int:
        at = len(nodes)
        nodes.append((None, 0.0, lo, lo))
        if hi - lo > 1:
            way = rng.standard_normal(sample.shape[1])
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                if np.abs(a - b).max() > 1e-6:
                    way = a - b
            mid = (lo + hi) // 2
            value = sample[rows] @ way
            cut = float(np.quantile(value, (mid - lo) / (hi - lo))) if len(rows) else 0.0
            left, right = grow(rows[value < cut], lo, mid), grow(rows[value >= cut], mid, hi)
            nodes[at] = (way.astype(np.float32), cut, left, right)
        return at

    grow(np.arange(len(sample)), 0, leaves)
    return nodes


def leaf_of(nodes: list[tuple], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), np.int32)
    stack = [(0, np.arange(len(vectors)))]
    while stack:
        at, rows = stack.pop()
        way, cut, left, right = nodes[at]
        if way is None:
            out[rows] = left
        elif len(rows):
            low = vectors[rows] @ way < cut
            stack += [(left, rows[low]), (right, rows[~low])]
    return out


u64 = np.uint64
#: Owners whose lists are merged by one sort: 15 bits of owner, 32 of code, 16 of similarity and a flag fill a key.
OWNERS = 1 << 15
NONE = np.zeros(0, u64)


def quantized(sims: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((sims + 1) * STEPS), 1, 65_535).astype(np.uint16)


def above(q: np.ndarray) -> np.ndarray:
    """The similarity that rounds to the next step above ``q``."""
    return ((q.astype(np.float32) + 0.5) / STEPS - 1).astype(np.float32)


def without_repeats(key: np.ndarray, shift: int = 0) -> np.ndarray:
    """Of sorted keys the first of each run with equal bits from ``shift``."""
    if len(key) < 2:
        return key
    name = key >> u64(shift) if shift else key
    first = np.empty(len(key), bool)
    first[0] = True
    np.not_equal(name[1:], name[:-1], out=first[1:])
    return key[first]


def best_of_owners(key: np.ndarray, n: int, shift: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` keys of each owner 0..n-1 (the bits from ``shift``) of sorted keys as an array (n, k), and which exist."""
    edge = np.searchsorted(key, np.arange(n + 1, dtype=u64) << u64(shift))
    at = edge[:-1, None] + np.arange(k)
    there = at < edge[1:, None]
    return (key.take(at, mode="clip") if len(key) else np.zeros((n, k), u64)), there


class Candidates:
    """The ``k`` best candidates of each of ``n`` owners among what is held, as packed keys (owner, falling similarity, other)
    that one sort puts in order.

    ``bar`` is the similarity above which a candidate is of use to its owner; it rises to the owner's k-th best.
    """

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None):
        self.n, self.k = n, k
        self.bar = np.full(n, -2.0, np.float32) if worst is None else above(worst)
        self.bits = max(1, int(n - 1).bit_length())  # of owner and of other
        if 2 * self.bits + 16 > 64:
            raise ValueError("at most 2**24 vectors can meet in one block; use smaller blocks")
        self.best, self.waiting, self.held = NONE, [], 0

    def hold(self, owner: np.ndarray, other: np.ndarray, sims: np.ndarray) -> None:
        fall = u64(65_535) - quantized(sims).astype(u64)
        self.waiting.append((owner.astype(u64) << u64(self.bits + 16)) | (fall << u64(self.bits)) | other.astype(u64))
        self.held += len(owner)
        if self.held > max(1 << 20, self.k * self.n):
            self.settle()

    def settle(self) -> None:
        """Merge what waits into the best of each owner and raise the bars."""
        if not self.waiting:
            return
        key = np.concatenate([self.best, *self.waiting])
        self.waiting, self.held = [], 0
        key.sort()
        best, there = best_of_owners(without_repeats(key), self.n, self.bits + 16, self.k)
        last = self.steps(best[:, -1])
        self.bar[: self.n] = np.where(there[:, -1], np.maximum(self.bar[: self.n], above(last)), self.bar[: self.n])
        self.best = best[there]

    def steps(self, key: np.ndarray) -> np.ndarray:
        return (u64(65_535) - ((key >> u64(self.bits)) & u64(65_535))).astype(np.uint16)

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, other and step of similarity, by owner."""
        self.settle()
        owner, other = self.best >> u64(self.bits + 16), self.best & u64((1 << self.bits) - 1)
        return owner.astype(np.int64), other.astype(np.int64), self.steps(self.best)


def ranks(names: np.ndarray) -> np.ndarray:
    """Place of each entry of a sorted array within its run of equal entries."""
    start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
    return np.arange(len(names)) - np.repeat(start, np.diff(np.r_[start, len(names)]))


def random_leaves(x: np.ndarray, size: int, rng) -> list[np.ndarray]:
    """Rows in groups of at most ``size`` by median cuts along random directions; equal vectors are cut apart as well."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        a, b = x[rng.choice(rows, 2, replace=False)]
        way = a - b if np.abs(a - b).max() > 1e-6 else rng.standard_normal(x.shape[1]).astype(np.float32)
        half = len(rows) // 2
        order = np.argpartition(x.take(rows, axis=0, mode="clip") @ way, half)
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


def forest(x: np.ndarray, k: int, leaf: int, trees: int, rng, worst: np.ndarray | None = None) -> Candidates:
    """For each row the ``k`` best other rows above its ``worst`` step (if given) in the leaves of random projection trees."""
    found = Candidates(len(x), k, worst)
    rows_at_once = max(1, (1 << 18) // leaf)  # products stay in the cache
    product, over = np.empty(rows_at_once * leaf, np.float32), np.empty(rows_at_once * leaf, bool)
    for t in range(trees):
        for rows in random_leaves(x, leaf, rng):
            m = len(rows)
            y = x.take(rows, axis=0, mode="clip")
            across, bars = np.ascontiguousarray(y.T), found.bar[rows]
            for lo in range(0, m, rows_at_once):
                b = min(rows_at_once, m - lo)
                s, hit = product[: b * m].reshape(b, m), over[: b * m].reshape(b, m)
                np.matmul(y[lo : lo + b], across, out=s)
                s[np.arange(b), np.arange(lo, lo + b)] = -3.0
                bar = bars[lo : lo + b]
                if not t and worst is None and m > k + 1:  # no list yet: the leaf's own k best
                    bar = np.partition(s, m - k, axis=1)[:, m - k] - np.float32(1e-6)
                np.greater(s, bar[:, None], out=hit)
                at = np.flatnonzero(hit.reshape(-1))
                i, j = np.divmod(at, m)
                found.hold(rows[i + lo], rows[j], product[at])
        if not t:
            found.settle()
    return found


def best_lists(owner, other, q, new, n: int, k: int):
    """The ``k`` best distinct ``other`` of each owner 0..n-1 as arrays (n, k): codes, steps of similarity (0: empty) and flags.

    Best is the larger step, then the smaller code; a code that came several times is new only if all its copies are.  Copies
    whose steps differ are rare and can cost a list its last entry.
    """
    kind = other.dtype
    empty = np.iinfo(kind).max
    names = None
    if kind != np.uint32:  # 64-bit codes are sorted by their place among the distinct ones
        names, other = np.unique(other, return_inverse=True)
    codes, steps, flags = np.full((n, k), empty, kind), np.zeros((n, k), np.uint16), np.zeros((n, k), bool)
    part = owner >> 15
    for c in range(-(-n // OWNERS)):
        at = slice(None) if n <= OWNERS else np.flatnonzero(part == c)
        key = ((owner[at].astype(u64) & u64(OWNERS - 1)) << u64(49)) | (other[at].astype(u64) << u64(1)) | new[at].astype(u64)
        key |= (u64(65_535) - q[at].astype(u64)) << u64(33)
        key.sort()
        rows = slice(c * OWNERS, min(n, (c + 1) * OWNERS))
        best, there = best_of_owners(without_repeats(key, 1), rows.stop - rows.start, 49, k)
        code = (best >> u64(1)) & u64(0xFFFFFFFF)
        codes[rows] = np.where(there, code.astype(kind) if names is None else names.take(code.astype(np.int64), mode="clip"), empty)
        steps[rows] = np.where(there, u64(65_535) - ((best >> u64(33)) & u64(65_535)), u64(0)).astype(np.uint16)
        flags[rows] = there & (best & u64(1)).astype(bool)
    # Copies whose similarities were computed in different batches can differ by a step: few lists, mended apart.
    line = np.sort(codes, axis=1)
    odd = np.flatnonzero(((line[:, 1:] == line[:, :-1]) & (line[:, 1:] != empty)).any(axis=1))
    if len(odd):
        order = np.argsort(codes[odd], axis=1, kind="stable")
        a, s, f = (np.take_along_axis(v[odd], order, 1) for v in (codes, steps, flags))
        again = (a[:, 1:] == a[:, :-1]) & (a[:, 1:] != empty)
        f[:, :-1] &= ~again | f[:, 1:]
        a[:, 1:][again], s[:, 1:][again], f[:, 1:][again] = empty, 0, False
        order = np.argsort(65_535 - s, axis=1, kind="stable")
        codes[odd], steps[odd], flags[odd] = (np.take_along_axis(v, order, 1) for v in (a, s, f))
    return codes, steps, flags


class Descent:
    """Parameters and kernels of the rounds; one instance is shipped to the workers.

    ``bits`` of a code name the place in a block, the higher ones the block; codes are 32 bits wide while that suffices.
    ``probes`` maps sampled ids to the step of their true k-th similarity: with it an update counts how many of their
    true neighbours are listed.
    """

    def __init__(self, k, keep, sample, leaf, trees, seed, bits, wide):
        self.k, self.keep, self.sample, self.leaf, self.trees, self.seed = k, keep, sample, leaf, trees, seed
        self.bits, self.kind = bits, np.uint64 if wide else np.uint32
        self.empty = np.iinfo(self.kind).max
        self.probes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.resting: set[int] = set()  # blocks whose lists need no further round
        self.send = True  # whether an update is followed by a round of descent

    def codes(self, block: int, n: int) -> np.ndarray:
        return (np.arange(n, dtype=u64) + u64(block << self.bits)).astype(self.kind)

    def homes(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> self.kind(self.bits)).astype(np.int32)

    def places(self, codes: np.ndarray) -> np.ndarray:
        return (codes & self.kind((1 << self.bits) - 1)).astype(np.int64)

    def found(self, owner, other, q, src: int) -> tuple[list, tuple]:
        """Messages with candidates to the owners' homes; those of ``src`` itself come back as (place, other, q)."""
        rows, own = [], (np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.uint16))
        home = self.homes(owner)
        for h in np.unique(home):
            at = np.flatnonzero(home == h)
            place, who, steps = self.places(owner[at]), other[at], q[at]
            if h == src:
                own = (place, who, steps)
            else:
                rows.append(("found", int(h), src, 0, 0, 0, packed(place=place.astype(np.uint32), other=who, q=steps)))
        return rows, own

    def begin(self, block: int, ids: np.ndarray, half: np.ndarray) -> pa.Table:
        """First lists within a block."""
        rng = np.random.default_rng([self.seed, block])
        i, j, q = forest(half.astype(np.float32), self.keep, self.leaf, self.trees, rng).listed()
        graph, q, new = best_lists(i, self.codes(block, len(ids))[j], q, np.ones(len(i), bool), len(ids), self.keep)
        return rows_table([("state", block, block, 0, 0, 0, packed(ids=ids, x=half, graph=graph, q=q, new=np.packbits(new)))])

    def turned(self, state_row: dict, block: int, to: np.ndarray) -> list[tuple]:
        """The vectors of a block on their way to their blocks ``to`` of a turned partition."""
        own, half, worst = self.codes(block, len(to)), state_row["x"], state_row["q"][:, -1]
        rows = []
        for h in np.unique(to):
            at = to == h
            rows.append(("turn", int(h), block, 0, 0, 0, packed(codes=own[at], x=half[at], worst=worst[at])))
        return rows

    def turn(self, table: pa.Table, turn: int) -> pa.Table:
        """Candidates among the vectors that share a block of a turned partition."""
        got = sorted(unpacked(table), key=lambda m: m["codes"][0])
        codes, worst, x = (np.concatenate([m[c] for m in got]) for c in ("codes", "worst", "x"))
        rng = np.random.default_rng([self.seed, table["dest"][0].as_py(), turn])
        i, j, q = forest(x.astype(np.float32), self.keep, self.leaf, self.trees, rng, worst).listed()
        return rows_table(self.found(codes[i], codes[j], q, -1)[0])

    def hits(self, block: int, ids: np.ndarray, q: np.ndarray) -> tuple[int, int]:
        """Listed and sought true neighbours of the sampled ids of this block."""
        known, bar = self.probes.get(block, (np.zeros(0, np.int64), np.zeros((0, 2), np.int64)))
        at = np.flatnonzero(np.isin(ids, known))
        bar = bar[np.searchsorted(known, ids[at])]
        reached = (q[at, : self.k] + 1 >= bar[:, :1]).sum(axis=1)  # equal vectors may differ by a step
        return int(np.minimum(reached, bar[:, 1]).sum()), int(bar[:, 1].sum())

    def update(self, state_row: pa.Table, messages: pa.Table) -> pa.Table:
        """Merge candidates into a block's lists and send its vectors to the homes of their neighbours."""
        block = state_row["dest"][0].as_py()
        st = unpacked(state_row)[0]
        graph, q = st["graph"], st["q"]
        n, k = graph.shape
        new = np.unpackbits(st["new"], count=n * k).astype(bool).reshape(n, k)
        own = self.codes(block, n)
        got = unpacked(messages)
        if got:
            i, j = np.nonzero(q > 0)
            # Entries that wait for their first round keep their flag, though they were counted when they came.
            owner = np.concatenate([i, *(m["place"].astype(np.int64) for m in got)])
            other = np.concatenate([graph[i, j], *(m["other"] for m in got)])
            steps = np.concatenate([q[i, j], *(m["q"] for m in got)])
            fresh = np.concatenate([new[i, j], *(np.ones(len(m["q"]), bool) for m in got)])
            graph, q, new = best_lists(owner, other, steps, fresh, n, k)
        half, worst = st["x"], q[:, -1]
        state = {"ids": st["ids"], "x": half, "graph": graph, "q": q, "new": np.packbits(new)}
        rows = [("state", block, block, int(new.sum()), *self.hits(block, st["ids"], q), packed(**state))]
        if block in self.resting or not self.send:
            return rows_table(rows)
        # Forward edges go out with their flag; backward ones so that both ends see each other.
        edges, flags = [graph], [new]
        if "back" in st:
            edges.append(st["back"])
            flags.append(np.unpackbits(st["back_new"], count=st["back"].size).astype(bool).reshape(st["back"].shape))
        edges, flags = np.concatenate(edges, 1), np.concatenate(flags, 1)
        flat = np.flatnonzero(edges != self.empty)
        home, who = self.homes(edges.ravel()[flat]), flat // edges.shape[1]
        for h in np.unique(home):
            at = home == h
            names, to = who[at], flat[at]
            many = np.bincount(names, minlength=n)
            sent = np.flatnonzero(many)
            place = self.places(edges.ravel()[to]).astype(np.uint16 if self.bits <= 16 else np.uint32)
            body = {"who": sent.astype(np.uint32)} if h == block else {"codes": own[sent], "x": half[sent], "worst": worst[sent]}
            mail = packed(many=many[sent].astype(np.uint8), place=place, flag=np.packbits(flags.ravel()[to]), **body)
            rows.append(("push", int(h), block, 0, 0, 0, mail))
        return rows_table(rows)

    def join(self, state_row: pa.Table, messages: pa.Table) -> pa.Table:
        """Neighbours of neighbours that meet at the members of a block."""
        block = state_row["dest"][0].as_py()
        st = unpacked(state_row)[0]
        graph, q = st["graph"], st["q"]
        n, k = graph.shape
        codes, worst, x = [self.codes(block, n)], [q[:, -1]], [st["x"]]
        at, place, flag, base = [], [], [], n
        for m in sorted(unpacked(messages), key=lambda m: "who" in m or m["codes"][0]):
            if "who" in m:
                names = m["who"].astype(np.int32)
            else:
                names = np.arange(base, base + len(m["codes"]), dtype=np.int32)
                base += len(names)
                codes.append(m["codes"])
                worst.append(m["worst"])
                x.append(m["x"])
            at.append(np.repeat(names, m["many"]))
            place.append(m["place"].astype(np.int64))
            flag.append(np.unpackbits(m["flag"], count=len(m["place"])).astype(bool))
        codes, worst, at, place, flag = map(np.concatenate, (codes, worst, at, place, flag)) if at else (codes[0], worst[0], *[np.zeros(0, int)] * 3)
        # The entry after the last stands for no vector.
        x = np.concatenate([*x, np.zeros_like(x[0][:1])]).astype(np.float32)
        # Of each member's list: new ones first, the rest in random order.
        rng = np.random.default_rng([self.seed, block, int(q.sum()) & 0xFFFFFFF])
        key = (place.astype(u64) << u64(40)) | ((flag == 0).astype(u64) << u64(39)) | (rng.integers(0, 1 << 14, len(place)).astype(u64) << u64(25))
        key = np.sort(key | at.astype(u64)) if base < 1 << 24 else key[:0]
        place, flag, at = (key >> u64(40)).astype(np.int64), (key >> u64(39)) & u64(1) == 0, (key & u64((1 << 24) - 1)).astype(np.int32)
        rank = ranks(place)
        width = 2 * self.sample
        few = rank < width
        at, place, flag, rank = at[few], place[few], flag[few], rank[few]
        size = width + 1
        meet, fresh = np.full((n, size), base, np.int32), np.zeros((n, size), bool)
        meet[:, 0] = np.arange(n)
        meet[place, rank + 1], fresh[place, rank + 1] = at, flag
        found = Candidates(base, self.keep, worst)
        found.bar = np.append(found.bar, np.float32(9.0))  # nothing is of use to no vector
        busy = np.flatnonzero(fresh.any(1))
        step = 64  # members a time: their products stay in the cache
        z, turned = np.empty((step, size, x.shape[1]), np.float32), np.empty((step, x.shape[1], size), np.float32)
        product, over, either = np.empty((step, size, size), np.float32), np.empty((step, size, size), bool), np.empty((step, size, size), bool)
        diagonal = np.arange(size)
        for lo in range(0, len(busy), step):
            part = busy[lo : lo + step]
            b = len(part)
            m, f = meet[part], fresh[part]
            s, hit, able = product[:b], over[:b], either[:b]
            x.take(m, axis=0, out=z[:b], mode="clip")
            np.copyto(turned[:b], z[:b].transpose(0, 2, 1))
            np.matmul(z[:b], turned[:b], out=s)
            s[:, diagonal, diagonal] = -3.0
            np.greater(s, found.bar.take(m)[:, :, None], out=hit)
            np.logical_or(f[:, :, None], f[:, None, :], out=able)
            hit &= able
            flat = np.flatnonzero(hit.reshape(-1))
            row, j = np.divmod(flat, size)
            owner, other = m.reshape(-1)[row], m[row // size, j]
            good = (other != base) & (owner != other)
            found.hold(owner[good], other[good], s.reshape(-1)[flat[good]])
        seen = meet[:, 1 : self.sample + 1]
        back = np.append(codes, self.kind(self.empty))[seen]
        for lo in range(0, n, 4096):
            part = slice(lo, lo + 4096)
            back[part][(back[part][:, :, None] == graph[part][:, None, :]).any(2)] = self.empty
        back_new = fresh[:, 1 : self.sample + 1] & (back != self.empty)
        owner, other, steps = found.listed()
        rows, own = self.found(codes[owner], codes[other], steps, block)
        i, j = np.nonzero(q > 0)
        graph, q, new = best_lists(
            np.concatenate([i, own[0]]), np.concatenate([graph[i, j], own[1]]), np.concatenate([q[i, j], own[2]]),
            np.concatenate([np.zeros(len(i), bool), np.ones(len(own[0]), bool)]), n, k,
        )
        state = packed(ids=st["ids"], x=st["x"], graph=graph, q=q, new=np.packbits(new), back=back, back_new=np.packbits(back_new))
        return rows_table([("state", block, block, 0, 0, 0, state), *rows])


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, dimension: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """``id, v``: one vector an id, with only finite entries, not all zero and of the given length (if given).

    Of several valid vectors of one id the smallest array by order of its entries is taken.  Null ids, null arrays and null
    entries don't count.  ``among`` (a column ``id``) limits the ids.
    """
    v = F.col(vector_col).cast("array<double>")
    least, most = F.array_min("v"), F.array_max("v")  # NaN is above infinity in Spark's order
    good = (least > float("-inf")) & (most < float("inf")) & ((least != 0) | (most != 0)) & ~F.exists("v", lambda e: e.isNull())
    if dimension:
        good = good & (F.size("v") == dimension)
    named = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull())
    if among is not None:
        named = stow(named.join(among, "id", "left_semi"))
    kept = named.filter(good)
    # Only ids that come several times are compared, so that the others' vectors aren't shuffled.
    several = stow(named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    repeats = maybe_broadcast(several, several.count(), 40)
    once = kept.join(repeats, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return kept.join(repeats, "id", "left_anti").union(once)


def unit_batches(batches):
    """Arrow kernel: unit vectors in half precision and two hashes of the direction, equal for copies, also for scaled ones."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        off = batch.column("v").offsets.to_numpy()
        flat, width = batch.column("v").flatten().to_numpy(), np.diff(off)
        raw, h1, h2 = [None] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            x = flat[(off[rows] - off[0])[:, None] + np.arange(w)]
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no square under- or overflows
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            whole = np.rint(x * 1e9).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                for h, salt in ((h1, 0x9E3779B97F4A7C15), (h2, 0xC2B2AE3D27D4EB4F)):
                    z = (whole + np.arange(1, w + 1, dtype=np.uint64) * np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    h[rows] = (z ^ (z >> np.uint64(32))).sum(axis=1).view(np.int64)
            data, size = x.astype(np.float16).tobytes(), 2 * int(w)
            for at, row in enumerate(rows):
                raw[row] = data[at * size : (at + 1) * size]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("id"), pa.array(raw, pa.binary()), pa.array(h1), pa.array(h2)], names=["part", "id", "x", "h1", "h2"]
        )


def _release() -> None:
    from pyspark.sql import SparkSession

    gc.collect()
    SparkSession.getActiveSession().sparkContext._jvm.System.gc()  # lets Spark delete shuffle files of finished rounds


def true_bars(points: DataFrame, parts: list[int], k: int, probes: int, seed: int) -> dict[int, dict[int, tuple[int, int]]]:
    """For up to ``probes`` sampled ids a part (by order of a hash), the step of the true k-th similarity and the number of true
    neighbours (k, or all others of a smaller table), from one scan of all vectors against the sample."""
    sampled = {}
    for p in parts:
        rows = points.filter(F.col("part") == p).orderBy(F.xxhash64(F.lit(seed + 11), "id"), "id").limit(probes).select("id", "x").collect()
        if rows:
            ids = np.array([r["id"] for r in rows])
            sampled[p] = ids, np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)

    def nearest(batches):
        best = {p: np.zeros((len(ids), 0), np.uint16) for p, (ids, _) in sampled.items()}
        for batch in batches:
            part, own, raw = batch.column("part").to_numpy(), batch.column("id").to_numpy(), batch.column("x").to_pylist()
            for p in np.unique(part):
                ids, y = sampled[p]
                rows = np.flatnonzero(part == p)
                x = np.frombuffer(b"".join(raw[r] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
                s = quantized(y @ x.T)
                s[ids[:, None] == own[rows][None, :]] = 0
                s = np.concatenate([best[p], s], axis=1)
                best[p] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :] if s.shape[1] > k else s
        for p, (ids, _) in sampled.items():
            i, j = np.nonzero(best[p])
            columns = [np.full(len(i), p, np.int32), ids[i], best[p][i, j].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "id", "q"])

    found = points.select("part", "id", "x").mapInArrow(nearest, "part int, id long, q int").toPandas()  # probes x k rows a task
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for (p, i), own in found.groupby(["part", "id"])["q"]:
        top = np.sort(own.to_numpy())[::-1][:k]
        out.setdefault(int(p), {})[int(i)] = int(top[-1]), len(top)
    return out


def neighbour_graphs(
    tables: dict[str, DataFrame],
    k: int = 10,
    *,
    target: float = 0.93,
    probes: int = 256,
    keep: int = 20,
    sample: int = 12,
    leaf: int = 512,
    trees: int = 10,
    steps: int = 40,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 3,
    least: float | None = None,
    log: list | None = None,
) -> DataFrame:
    """Approximately the ``k`` most similar vectors (cosine) of every vector, for several tables at once.

    ``tables`` maps a name to a DataFrame ``id, v`` as :func:`valid_vectors` gives it; vectors of one table must have one
    length.  Result: ``part, id, neighbour, similarity, rank`` (rank from 1; similarity descending, then the smaller id).  No
    vector is its own neighbour.  Similarities are those of half-precision copies in steps of 3e-5 (error about 1e-4).  A table
    with one vector, or none, gives no rows for it.

    Lists of ``keep`` neighbours start from ``trees`` random projection trees with leaves of ``leaf`` vectors, inside blocks of
    about ``block_rows`` vectors of a coarse partition fitted on a bounded sample (``sample_rows``, or 64 a block).  Then steps
    of two kinds follow: a round of NN-descent (at each vector up to ``2 * sample`` of those that list it or that it lists meet,
    new ones first), or trees in the blocks of another, turned partition.  After every step the recall of each table is
    measured on ``probes`` sampled vectors whose true neighbours are known from one scan of all vectors.  Steps go on until
    it reaches ``target`` in every table, by whichever kind gained more the last time; a table that has reached it rests.  So the
    effort grows with the difficulty and the number of the vectors.  At least one round of NN-descent is run.  The loop also
    ends after ``steps`` steps or when neither kind gains 0.001; ``log``, if given, receives a dict a step (``step, kind, part,
    recall, new``), so that a caller sees whether the target was reached.

    Of more than ``k + 1`` copies of one direction, only those of the ``k + 1`` smallest ids enter the graph: no other can be
    among anyone's first ``k``.  The others get the ``k`` smallest ids of their own copies.  With ``least``, only neighbours of
    about that similarity or more are listed.
    """
    keep = max(keep, k)
    parts = [df.select(F.lit(p).alias("part"), "id", "v") for p, df in enumerate(tables.values())]
    units = reduce(DataFrame.union, parts).mapInArrow(unit_batches, "part int, id long, x binary, h1 long, h2 long")
    points = stow(units, compression="uncompressed")
    copied = stow(points.groupBy("part", "h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).drop("n"))
    shadows, core = None, points
    if copied.limit(1).count():
        order = Window.partitionBy("part", "h1", "h2").orderBy("id")
        among = points.select("part", "h1", "h2", "id").join(copied, ["part", "h1", "h2"], "left_semi")
        firsts = stow(among.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1))
        shadows = stow(among.join(firsts.select("part", "id"), ["part", "id"], "left_anti"))
        core = points.join(shadows.select("part", "id"), ["part", "id"], "left_anti")
    counts = {r["part"]: r["n"] for r in core.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first_block, blocks_of, samples, total = {}, {}, {}, 0
    for p in sorted(counts):
        blocks_of[p] = -(-counts[p] // block_rows)
        chosen = core.filter(F.col("part") == p).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        chosen = chosen.limit(max(sample_rows, SAMPLE_PER_BLOCK * blocks_of[p]) if blocks_of[p] > 1 else 1)
        samples[p] = np.stack([np.frombuffer(r["x"], np.float16) for r in chosen.select("x").collect()]).astype(np.float64)
        first_block[p], total = total, total + blocks_of[p]
    part_of = np.repeat(sorted(counts), [blocks_of[p] for p in sorted(counts)])

    def partitions(turn: int) -> dict[int, list[tuple]]:
        return {p: fit_partition(samples[p], blocks_of[p], [seed, p, turn]) for p in counts}

    home = partitions(0)

    def place(batches):
        """Home block of each vector."""
        for batch in batches:
            part = batch.column("part").to_numpy()
            if not len(part):
                continue
            raw = batch.column("x").to_pylist()
            at = np.zeros(len(part), np.int32)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                x = np.frombuffer(b"".join(raw[r] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
                at[rows] = first_block[p] + leaf_of(home[p], x)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("id"), batch.column("x")], names=["block", "id", "x"])

    placed = stow(core.select("part", "id", "x").mapInArrow(place, "block int, id long, x binary"), compression="uncompressed")
    bars = true_bars(core, sorted(counts), k, probes, seed)
    if shadows is None:
        discard(points)
    largest = placed.groupBy("block").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    bits = max(1, int(largest - 1).bit_length())
    descent = Descent(k, keep, sample, leaf, trees, seed, bits, total << bits > 1 << 32)
    for b, p in enumerate(part_of):
        known = sorted(bars.get(p, {}))
        descent.probes[b] = np.array(known, np.int64), np.array([bars[p][i] for i in known], np.int64).reshape(-1, 2)

    def begin(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table["id"].to_numpy()
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(len(ids), -1)
        return descent.begin(table["block"][0].as_py(), ids, x)

    def keep_blocks(df: DataFrame) -> DataFrame:
        if total > 256:  # one file a bucket; with few blocks the files are few anyway and the shuffle is saved
            df = df.repartition(total, "dest")
        return stow(df, compression="uncompressed", buckets=(max(1, total), "dest"))

    def apart(kernel):
        """A block's state meets the messages to it: both are read in place from the block's bucket."""

        def together(table: pa.Table) -> pa.Table:
            state = np.asarray(table["kind"].to_pylist()) == "state"
            return kernel(table.filter(pa.array(state)), table.filter(pa.array(~state)))

        return together

    def met(key, state: pa.Table, mail: pa.Table) -> pa.Table:
        return descent.update(state, mail if mail.num_columns else rows_table([]))

    def turn_round(held: DataFrame, turn: int) -> DataFrame:
        trees_of = partitions(turn)

        def send(batches):
            for batch in batches:
                for raw, block in zip(batch.column("payload"), batch.column("dest").to_pylist()):
                    if block not in descent.resting:
                        p = part_of[block]
                        st = pickle.loads(raw.as_buffer())
                        to = first_block[p] + leaf_of(trees_of[p], st["x"].astype(np.float32))
                        yield from rows_table(descent.turned(st, block, to)).to_batches()

        mail = held.filter("kind = 'state'").select("dest", "payload").mapInArrow(send, ROW)
        wide = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        mail = mail.repartition(min(3 * total, max(wide, total)), "dest")  # a block a task, nearly: each is heavy for its bytes
        sent = stow(mail.groupBy("dest").applyInArrow(lambda t: descent.turn(t, turn), ROW), compression="uncompressed")
        pairs = held.filter("kind = 'state'").groupBy("dest").cogroup(sent.groupBy("dest"))
        out = keep_blocks(pairs.applyInArrow(met, ROW))
        discard(sent)
        return out

    def join_round(held: DataFrame) -> DataFrame:
        def kernel(state: pa.Table, mail: pa.Table) -> pa.Table:
            return state if state["dest"][0].as_py() in descent.resting else descent.join(state, mail)

        joined = keep_blocks(held.groupBy("dest").applyInArrow(apart(kernel), ROW))
        out = keep_blocks(joined.groupBy("dest").applyInArrow(apart(descent.update), ROW))
        discard(joined)
        return out

    held = keep_blocks(placed.groupBy("block").applyInArrow(begin, ROW))
    discard(placed)
    recall = dict.fromkeys(counts, 0.0)
    # The kind of a step is settled a step ahead: only before a round of descent an update sends vectors to their neighbours.
    gain, kind, after, joins, turns = {"turn": 1.0, "join": 1.0}, "turn", "join", 0, 0
    for step in range(steps if total else 0):
        below = {p for p, x in recall.items() if x < target}
        if joins and (not below or max(gain.values()) < 1e-3):
            break
        resting = set(recall) - below if below else set()
        descent.resting, descent.send = {b for b, p in enumerate(part_of) if p in resting}, after == "join"
        turns, joins = turns + (kind == "turn"), joins + (kind == "join")
        advanced = turn_round(held, turns) if kind == "turn" else join_round(held)
        discard(held)
        held = advanced
        _release()
        shown = held.filter("kind = 'state'").groupBy("dest").agg(F.sum("hits").alias("h"), F.sum("sought").alias("s"), F.sum("moved").alias("m"))
        got = {p: np.zeros(3) for p in counts}
        for r in shown.collect():  # a row a block
            got[part_of[r["dest"]]] += [r["h"], r["s"], r["m"]]
        before = dict(recall)
        recall = {p: float(x[0] / x[1]) if x[1] else 1.0 for p, x in got.items()}
        if step:
            gain[kind] = max((recall[p] - before[p] for p in below), default=0.0)
        done, kind = kind, after
        after = "turn" if gain["turn"] >= gain["join"] else "join"
        if log is not None:
            names = list(tables)
            log += [{"step": step, "kind": done, "part": names[p], "recall": recall[p], "new": int(got[p][2])} for p in sorted(counts)]

    lowest = np.uint16(0) if least is None else quantized(np.array([least - 1e-3]))[0]

    def listed(batches):
        for batch in batches:
            for raw, block in zip(batch.column("payload"), batch.column("dest").to_pylist()):
                st = pickle.loads(raw.as_buffer())
                # The first k and what ties with the last of them; of a least similarity, only what reaches it.
                bar = np.maximum(st["q"][:, k - 1 : k], lowest)
                i, j = np.nonzero((st["q"] > 0) & (st["q"] >= bar))
                sims = st["q"][i, j].astype(np.float64) / STEPS - 1
                columns = [st["ids"][i], st["graph"][i, j].astype(np.int64), sims, np.full(len(i), block, np.int32)]
                for lo in range(0, len(i), 1 << 18):
                    cut = slice(lo, lo + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in columns], names=["id", "code", "similarity", "block"])

    def named(batches):
        for batch in batches:
            for raw, block in zip(batch.column("payload"), batch.column("dest").to_pylist()):
                ids = pickle.loads(raw.as_buffer())["ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(descent.codes(block, len(ids)).astype(np.int64)), pa.array(ids)], names=["code", "neighbour"]
                )

    states = held.filter("kind = 'state'").select("dest", "payload")
    edges = states.mapInArrow(listed, "id long, code long, similarity double, block int")
    names = states.mapInArrow(named, "code long, neighbour long")
    part = F.lit(None).cast("string")
    for p, name in enumerate(tables):
        if p in counts:
            part = F.when(F.col("block") >= first_block[p], F.lit(name)).otherwise(part)
    graph = edges.join(names, "code").select(part.alias("part"), "id", "neighbour", "similarity")
    if shadows is not None:
        label = F.element_at(F.array(*(F.lit(x) for x in tables)), F.col("part") + 1)
        own = shadows.join(firsts.select("part", "h1", "h2", F.col("id").alias("neighbour"), "r"), ["part", "h1", "h2"])
        own = own.filter(F.col("r") <= k)
        graph = graph.union(own.select(label, "id", "neighbour", F.lit(1.0)))
    order = Window.partitionBy("part", "id").orderBy(F.desc("similarity"), "neighbour")
    return graph.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_pairs(tables: dict[str, DataFrame], graph: DataFrame, least: float, id_col: str, vector_col: str, dimension: int | None = None) -> DataFrame:
    """Pairs ``part, id_a < id_b, similarity`` of the graph whose exact cosine similarity is at least ``least``.

    ``tables`` are the raw tables; only the vectors of ids in some pair are read from them, as by :func:`valid_vectors`.
    """
    near = graph.filter(F.col("similarity") >= least - 1e-3)
    pairs = stow(near.select("part", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct())
    n = pairs.count()
    found = []
    for part, rows in tables.items():
        own = pairs.filter(F.col("part") == part)
        ids = maybe_broadcast(own.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), 2 * n, 24)
        vectors = stow(valid_vectors(rows, id_col, vector_col, dimension, ids))
        for side in ("a", "b"):
            own = own.join(vectors.select(F.col("id").alias(f"id_{side}"), F.col("v").alias(f"v_{side}")), f"id_{side}")
        cosine = dot("v_a", "v_b") / F.sqrt(dot("v_a", "v_a") * dot("v_b", "v_b"))
        found.append(own.select("part", "id_a", "id_b", cosine.alias("similarity")).filter(F.col("similarity") >= least))
    return reduce(DataFrame.union, found)


def exact_neighbours(tables: dict[str, DataFrame], k: int, asked, *, query_block: int = 4_096, block: int = 65_536) -> DataFrame:
    """The true ``k`` most similar other vectors of the ``asked`` ids (a function of the id column), against all vectors.

    A yardstick for recall: every block of queries meets every block of vectors, which is quadratic if the queries grow with the
    table.  Result: ``part, id, neighbour, similarity, rank``, ordered as in :func:`neighbour_graphs`.
    """
    parts = [df.select(F.lit(p).alias("part"), "id", "v") for p, df in enumerate(tables.values())]
    points = stow(reduce(DataFrame.union, parts).mapInArrow(unit_batches, "part int, id long, x binary, h1 long, h2 long"))

    def pack(table: pa.Table) -> pa.Table:
        x = b"".join(table["x"].to_pylist())
        return pa.table({"part": table["part"][:1], "ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()), "x": pa.array([x], pa.binary())})

    def packs(df: DataFrame, rows: int) -> DataFrame:
        n = max(1, -(-df.count() // rows))
        spot = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(n))
        return stow(df.groupBy("part", spot.alias("spot")).applyInArrow(pack, "part int, ids binary, x binary"))

    asking, held = packs(points.filter(asked(F.col("id"))), query_block), packs(points, block)
    met = asking.select("part", F.col("ids").alias("a"), F.col("x").alias("y")).join(held, "part")
    met = met.repartition(max(1, asking.count() * held.count()))

    def nearest(batches):
        for batch in batches:
            for part, a, y, ids, x in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "y", "ids", "x"))):
                a, ids = np.frombuffer(a, np.int64), np.frombuffer(ids, np.int64)
                y = np.frombuffer(y, np.float16).reshape(len(a), -1).astype(np.float32)
                across = np.ascontiguousarray(np.frombuffer(x, np.float16).reshape(len(ids), -1).astype(np.float32).T)
                for lo in range(0, len(a), 256):
                    s = y[lo : lo + 256] @ across
                    s[a[lo : lo + 256, None] == ids[None, :]] = -3.0
                    c = min(k + 1, s.shape[1])
                    bar = np.partition(s, s.shape[1] - c, axis=1)[:, s.shape[1] - c]
                    i, j = np.nonzero((s >= bar[:, None]) & (s > -2))  # with whatever ties
                    columns = [np.full(len(i), part, np.int32), a[lo + i], ids[j], quantized(s[i, j]).astype(np.float64) / STEPS - 1]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "id", "neighbour", "similarity"])

    found = met.mapInArrow(nearest, "part int, id long, neighbour long, similarity double")
    order = Window.partitionBy("part", "id").orderBy(F.desc("similarity"), "neighbour")
    label = F.element_at(F.array(*(F.lit(x) for x in tables)), F.col("part") + 1)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("part", label)


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``part, n_queries, recall``: the share of the pairs (id, neighbour) of ``truth`` that are in ``found``."""
    both = truth.join(found.select("part", "id", "neighbour", F.lit(1).alias("hit")), ["part", "id", "neighbour"], "left")
    return both.groupBy("part").agg(F.countDistinct("id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def greedy_search(
    graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, *, beam: int = 48, fan: int = 12, steps: int = 12, entries: int = 64, seed: int = 5
) -> DataFrame:
    """The ``k`` most similar indexed vectors of each query vector by greedy search on a neighbour graph.

    ``graph`` has ``id, neighbour``; ``vectors`` and ``queries`` have ``id, v``.  Every query starts from the same ``entries``
    vectors (by order of a hash).  In each of ``steps`` steps the neighbours of the ``fan`` best vectors of its ``beam`` that were
    not followed yet are joined in; both directions of an edge are followed, and a query whose beam was followed whole is done.
    All queries advance in one join per step.  Result: ``query, id, similarity, rank``; null-free inputs as from
    :func:`valid_vectors`.  Empty inputs give no rows.
    """
    unit = lambda v: F.transform(v, lambda e: e / norm(v))
    index = stow(vectors.select("id", unit(F.col("v")).alias("x")))
    asked = stow(queries.select(F.col("id").alias("query"), unit(F.col("v")).alias("y")))
    links = stow(graph.select("id", "neighbour").union(graph.select(F.col("neighbour"), F.col("id"))).distinct())
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    waiting = Window.partitionBy("query", "followed").orderBy(F.desc("similarity"), "id")

    def advance(rows: DataFrame) -> DataFrame:
        """The beam of each query, its next vectors to follow marked."""
        kept = rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).drop("r")
        go = (~F.col("followed")) & (F.row_number().over(waiting) <= fan)
        return stow(kept.withColumn("go", go))

    start = index.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(entries)
    scored = asked.join(F.broadcast(start)).select("query", "id", dot(F.col("x"), F.col("y")).alias("similarity"))  # a fixed few rows
    held = advance(scored.withColumn("followed", F.lit(False)))
    for _ in range(steps):
        going = held.filter("go")
        if not going.limit(1).count():
            break
        near = going.join(links, "id").select("query", F.col("neighbour").alias("id")).distinct()
        fresh = near.join(held.select("query", "id"), ["query", "id"], "left_anti").join(index, "id").join(asked, "query")
        fresh = fresh.select("query", "id", dot(F.col("x"), F.col("y")).alias("similarity"), F.lit(False).alias("followed"))
        both = held.select("query", "id", "similarity", (F.col("followed") | F.col("go")).alias("followed")).union(fresh)
        advanced = advance(both)
        discard(held)
        held = advanced
    return held.select("query", "id", "similarity", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)
