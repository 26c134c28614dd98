"""Nearest rows of a sparse matrix, and sums over them, with all products taken in the worker."""

from __future__ import annotations

import uuid
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import BROADCAST_BYTES

#: A longer list of members is a hot one, of which only the part that can reach a row's first ``k`` is read.
HOT = 1024
#: Entries a worker holds at once: 5 to 12 bytes each, 22 more in hot lists.  Beyond that members come in several blocks.
HELD_ENTRIES = 16_000_000
#: Products taken at once.
BUFFER = 200_000
#: First members of each hot list that give a row its first bound.
SEEDS = 2
#: The one block a worker holds, by its token.
_held: dict[str, _Block] = {}


def _packed(a):
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True), a.dtype.str, len(a)


def _unpacked(packed):
    data, kind, n = packed
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _ranges(lo, n):
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _bit(h, u):
    return 1 << (h % 32 * 2 + (u < 0))


def _rest(squares, v):
    """Lengths without the entries ``v``, rounded up by more than float32 and the difference may lose."""
    return np.sqrt(np.maximum(squares - v * v, 0.0)) + 1e-6 * np.sqrt(squares)


class _Block:
    """Members by group.  A value is (raw - shift of the member) * scale of the member."""

    def __init__(self, about, parts, size):
        self.members, self.shift, self.scale, table = (_unpacked(a) for a in about)
        self.table = table if len(table) else None
        n = len(self.members)
        keys, counts, done = [], [], 0
        for i, part in enumerate(parts):  # one after the other, so that entries are held once
            packed = part.value
            vars(part).pop("_value", None)  # the worker has no more use for it
            if not i:
                self.at, self.raw = np.empty(size, np.int32), np.empty(size, packed[3][1])
            keys.append(_unpacked(packed[0]))
            counts.append(_unpacked(packed[1]))
            where = slice(done, done + packed[2][2])
            self.at[where], self.raw[where] = _unpacked(packed[2]), _unpacked(packed[3])
            done = where.stop
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order, lo = np.argsort(keys), np.cumsum(counts) - counts
        self.keys, self.lo, self.n = keys[order], lo[order], counts[order]
        # Hot lists by falling value, their entries by member, and of a member the lengths of those above and below 0 and a
        # bit for each list and sign; two lists may share a bit.
        self.hot, self.lists, self.signs = np.full(len(keys), -1), [], np.zeros(n, np.uint64)
        self.above, self.below = np.zeros(n), np.zeros(n)
        held = ([np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0)])
        for p in np.flatnonzero(self.n > HOT):
            where = slice(self.lo[p], self.lo[p] + self.n[p])
            a, v = self.at[where], self.values(where)
            self.hot[p] = len(held[0]) - 1
            for column, x in zip(held, (a, np.full(len(a), len(held[0]) - 1, np.int32), v)):
                column.append(x)
            self.above[a] += np.maximum(v, 0.0) ** 2
            self.below[a] += np.minimum(v, 0.0) ** 2
            self.signs[a] |= np.where(v > 0, np.uint64(_bit(len(held[0]) - 2, 1)), np.uint64(_bit(len(held[0]) - 2, -1)))
        for a, v in zip(held[0][1:], held[2][1:]):  # with the lengths of the member's other hot entries, rounded up
            order = np.argsort(-v, kind="stable")
            a, v = a[order], v[order]
            rests = _rest(self.above[a], np.maximum(v, 0.0)), _rest(self.below[a], np.minimum(v, 0.0))
            signs = np.count_nonzero(v > 0), np.count_nonzero(v >= 0)
            self.lists.append((a, -v, *(r.astype(np.float32) for r in rests), *signs))
        self.above, self.below = np.sqrt(self.above), np.sqrt(self.below)
        a, h, v = (np.concatenate(c) for c in held)
        del held
        order = np.argsort(a, kind="stable")
        self.hot_first = np.r_[0, np.cumsum(np.bincount(a, minlength=n))].astype(np.int32)
        self.hot_list, self.hot_value = h[order], v[order]
        self.sums, self.stamp, self.row = np.zeros(n), np.zeros(n, np.int64), np.zeros(len(self.lists))

    def centred(self, where):
        raw = self.raw[where] if self.table is None else self.table[self.raw[where]]
        return raw - self.shift[self.at[where]]

    def values(self, where):
        return self.centred(where) * self.scale[self.at[where]]

    def once(self, a):
        """Every member of ``a`` once."""
        i = np.arange(len(a))
        self.stamp[a] = i
        return a[self.stamp[a] == i]

    def scores(self, a):
        """Products of the present row with members ``a``: those of short lists are in ``sums``."""
        if not len(self.lists):
            return self.sums[a]
        lo = self.hot_first.take(a)
        n = self.hot_first.take(a + 1) - lo
        of = np.repeat(np.arange(len(a)), n)
        e = (lo - (np.cumsum(n) - n)).take(of) + np.arange(len(of))
        return self.sums[a] + np.bincount(of, self.row.take(self.hot_list.take(e)) * self.hot_value.take(e), len(a))

    def reaching(self, h, u, above, below, signs, bound, least):
        """Members of hot list ``h`` whose value has the sign of ``u`` and a size of ``least`` or more, if their product can reach
        ``bound`` with the row's other hot entries: ``above`` and ``below`` 0 of these lengths and in the lists of ``signs``."""
        a, negative, over, under, positives, below_0 = self.lists[h]
        if u > 0:
            reach = slice(0, min(int(negative.searchsorted(-least, side="right")), positives))
        else:
            reach = slice(max(int(negative.searchsorted(least)), below_0), len(a))
        a, own = a[reach], negative[reach] * -u
        rest = over[reach] * above
        rest += under[reach] * below
        kept = (own + rest >= bound).nonzero()[0]
        a, own = a.take(kept), own.take(kept)
        return a[(own >= bound) | (self.signs.take(a) & signs != 0)]

    def seeds(self, h, u, k):
        a = self.lists[h][0]
        return a[:k] if u > 0 else a[-k:]

    def best(self, own, touched, products, hot, u, k, digits, bound):
        """Members with the first ``k`` scores above 0, and their scores; ``bound`` is one that ``k`` members are known to reach."""
        margin = 2 * 10.0**-digits
        np.add.at(self.sums, touched, products)
        mine = touched = self.once(touched)
        if len(hot):
            at = list(zip(hot.tolist(), u.tolist()))
            self.row[hot] = u
            first = touched
            if len(first) > 2 * k:
                s = self.sums[first]
                first = first[np.argpartition(s, len(s) - 2 * k)[-2 * k :]]
            first = self.once(np.concatenate([first, *(self.seeds(h, x, SEEDS * k) for h, x in at)]))
            first = first[first != own]
            s = self.scores(first)
            if len(s) >= k:
                bound = max(bound, float(np.partition(s, len(s) - k)[len(s) - k]))
            safe = bound * (1 - 1e-12) - margin
            above, below = sum(x * x for _, x in at if x > 0), sum(x * x for _, x in at if x < 0)
            long, deep = sqrt(above), sqrt(below)
            kept = [touched[self.sums[touched] + self.above.take(touched) * long + self.below.take(touched) * deep >= safe]]
            # Who shares only hot groups needs a value of this size in one of them.
            least = max(safe / sum(abs(x) for _, x in at), 0.0)
            bits = [_bit(h, x) for h, x in at]
            for i, (h, x) in enumerate(at):
                signs = 0
                for bit in bits[:i] + bits[i + 1 :]:
                    signs |= bit
                over = sqrt(max(above - x * x, 0.0)) + 1e-6 * long if x > 0 else long
                under = sqrt(max(below - x * x, 0.0)) + 1e-6 * deep if x < 0 else deep
                kept.append(self.reaching(h, x, over, under, np.uint64(signs), safe, least))
            touched = self.once(np.concatenate(kept))
        touched = touched[touched != own]
        s = self.scores(touched) if len(hot) else self.sums[touched]
        self.sums[mine] = 0.0
        self.row[hot] = 0.0
        if len(s) > k:
            bound = max(bound, float(np.partition(s, len(s) - k)[len(s) - k]))
        # Sums that cancel to nothing are no positive similarity.
        found = (s >= max(bound * (1 - 1e-12) - margin, 4e-13)).nonzero()[0]
        return touched[found], s[found]

    def nearest(self, ids, off, groups, v, k, digits, before):
        """For every row members and scores of the first ``k``; ``before`` are those of earlier blocks, if any."""
        place = np.minimum(np.searchsorted(self.keys, groups), max(len(self.keys) - 1, 0))
        kept = (self.keys[place] == groups) & (v != 0) if len(self.keys) else np.zeros(len(groups), bool)
        row = np.repeat(np.arange(len(ids)), np.diff(off))[kept]
        place, v = place[kept], v[kept]
        hot, own = self.hot[place], np.searchsorted(self.members, ids)
        own = np.where(self.members[np.minimum(own, len(self.members) - 1)] == ids, own, -1)
        short = hot < 0
        hot_row, hot_list, hot_u = row[~short], hot[~short], v[~short]
        hot_at = np.searchsorted(hot_row, np.arange(len(ids) + 1))
        row, place, v = row[short], place[short], v[short]
        n = self.n[place]
        ends, begin = np.r_[0, np.cumsum(n)], np.searchsorted(row, np.arange(len(ids) + 1))
        r = 0
        while r < len(ids):  # as many rows as the buffer takes
            to = max(r + 1, int(np.searchsorted(ends[begin], ends[begin[r]] + BUFFER, side="right")) - 1)
            e = slice(begin[r], begin[to])
            where = _ranges(self.lo[place[e]], n[e])
            touched, products = self.at[where], np.repeat(v[e], n[e]) * self.values(where)
            for x in range(r, to):
                t = slice(ends[begin[x]] - ends[begin[r]], ends[begin[x + 1]] - ends[begin[r]])
                h = slice(hot_at[x], hot_at[x + 1])
                old = before[x] if before else None
                bound = old[1].min() if old is not None and len(old[1]) >= k else 0.0
                a, s = self.best(own[x], touched[t], products[t], hot_list[h], hot_u[h], k, digits, bound)
                if old is not None:
                    a, s = np.concatenate([old[0], a]), np.concatenate([old[1], s])
                if len(s) and s.min() < 1e-9:
                    positive = np.round(s, 12) > 0
                    a, s = a[positive], s[positive]
                best = np.lexsort((a, -np.round(s, digits)))[:k]  # members are in the order of their ids
                yield a[best], s[best]
            r = to

    def lookups(self, a, s, wanted):
        """Of members ``a`` with weights ``s`` who have a wanted group: the group, the sum of weight * centred value, of weight."""
        order = np.argsort(a)
        a, s = a[order], s[order]
        for g in wanted:
            p = np.searchsorted(self.keys, g)
            if p == len(self.keys) or self.keys[p] != g:
                continue
            of = self.at[self.lo[p] : self.lo[p] + self.n[p]]
            q = np.minimum(np.searchsorted(of, a), len(of) - 1)
            met = of[q] == a
            if met.any():
                w = s[met]
                yield g, float(w @ self.centred(self.lo[p] + q[met])), float(w.sum())


def _block(token, about, parts, size):
    if token not in _held:
        _held.clear()
        _held[token] = _Block(about.value, parts, size)
    return _held[token]


def _near(batches, about, blocks, k, digits, least, asked, summed):
    """Arrow kernel over ``m, shift, scale, e``: neighbours, or sums over them for the asked pairs."""
    if asked is not None:
        users, begins, wanted = asked.value

    def rows(batch):
        if asked is not None:
            m = batch.column(0).to_numpy()
            p = np.minimum(np.searchsorted(users, m), len(users) - 1)
            batch = batch.filter(pa.array(users[p] == m))
        m, shift, scale = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        groups, raw = (f.to_numpy(zero_copy_only=False) for f in batch.column(3).flatten().flatten())
        off = batch.column(3).offsets.to_numpy()
        off = off - off[0]
        n = np.diff(off)
        return m, off, groups, (raw - np.repeat(shift, n)) * np.repeat(scale, n)

    # Several blocks take the rows one after the other, so a task's rows and their neighbours so far are held.
    for part in (rows(b) for b in batches) if len(blocks) == 1 else [[rows(b) for b in batches]]:
        parts = [part] if len(blocks) == 1 else part
        near = [None] * len(parts)
        for token, held, size in blocks:
            block = _block(token, about, held, size)
            for i, (m, off, groups, v) in enumerate(parts):
                near[i] = list(block.nearest(m, off, groups, v, k, digits, near[i])) if len(m) else []
        for (m, *_), found in zip(parts, near):
            if not summed:
                found = [(u, a, s) for u, (a, s) in zip(m, found) if len(a) >= max(least, 1)]
                if found:
                    u, a, s = zip(*found)
                    columns = np.repeat(u, [len(x) for x in a]), block.members[np.concatenate(a)], np.concatenate(s)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "similarity"])
                continue
            out = []
            for u, (a, s) in zip(m, found):
                if len(a) >= max(least, 1):
                    p = np.searchsorted(users, u)
                    out += [(u, *x) for x in block.lookups(a, s, wanted[begins[p] : begins[p + 1]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*out)], names=["user_id", "item_id", "wc", "w"])


class NearRows:
    """The ``k`` others of every row with the largest positive inner products; products that agree to ``digits`` decimals tie and
    the smaller id comes first; none if they are fewer than ``least``.

    ``rows`` is a stowed table ``m, shift, scale, e`` with ``e`` the entries ``g, v`` of a row; an entry counts as
    (v - shift) * scale.  Entries go to the workers by group, in broadcasts of about ``part_bytes`` each, of which a worker holds
    a block of ``held`` entries; a row and its neighbours stay in one task, and nothing is shuffled or written.

    Members of short lists are summed up.  Hot lists, which would make the work quadratic, are sorted by value: once ``k``
    members with a known product are found, only those of hot lists are read whose value is large enough to reach it (exact).
    """

    def __init__(self, rows: DataFrame, k: int, digits: int, *, least: int = 1, held: int | None = None, part_bytes: int = BROADCAST_BYTES):
        self.rows, self.rule, self.blocks = rows, (k, digits, least), []
        share = rows.sparkSession.sparkContext.broadcast
        got = rows.select("m", "shift", "scale").toArrow()
        m, shift, scale = (got[c].to_numpy() for c in ("m", "shift", "scale"))
        order = np.argsort(m)
        members = m[order]
        entries = rows.select("m", F.inline("e"))
        total = rows.agg(F.sum(F.size("e"))).first()[0] or 0
        # Few values, as ratings are, go as one byte or two.
        table = np.sort(np.array([r[0] for r in entries.select("v").distinct().limit(65_537).collect()], float))
        table = table if len(table) <= 65_536 else table[:0]
        self.about = share([_packed(a) for a in (members, shift[order], scale[order], table)])
        del got, m, shift, scale, order
        blocks = -(-total // (held or HELD_ENTRIES))
        parts = -(-total * 16 // (max(blocks, 1) * part_bytes))
        for b in range(blocks):
            block, size = [], 0
            for p in range(parts):
                at = F.pmod(F.xxhash64("m"), F.lit(blocks)) == b, F.pmod(F.xxhash64("g"), F.lit(parts)) == p
                part = self._part(entries.filter(at[0] & at[1]), members, table)
                if part:
                    block.append(share(part))
                    size += part[2][2]
            if block:
                self.blocks.append((uuid.uuid4().hex, block, size))

    @staticmethod
    def _part(entries, members, table):
        got = entries.toArrow()
        g, v = got["g"].to_numpy(), got["v"].to_numpy()
        at = np.searchsorted(members, got["m"].to_numpy()).astype(np.int32)
        del got  # the driver holds no copy it is done with
        order = np.lexsort((at, g))
        at, v = at[order], v[order]
        keys, counts = np.unique(g, return_counts=True)
        if len(table):
            v = np.searchsorted(table, v).astype(np.uint8 if len(table) <= 256 else np.uint16)
        return [_packed(a) for a in (keys, counts, at, v)] if len(keys) else None

    def _run(self, schema, asked=None, summed=False) -> DataFrame:
        if not self.blocks:
            return self.rows.sparkSession.createDataFrame([], schema)
        about, blocks, rule = self.about, self.blocks, self.rule
        return self.rows.mapInArrow(lambda batches: _near(batches, about, blocks, *rule, asked, summed), schema)

    def neighbours(self, asked=None) -> DataFrame:
        """``src, dst, similarity``; with ``asked`` of the asked users alone.  Computed whenever it is read."""
        return self._run("src long, dst long, similarity double", asked)

    def asking(self, asked: DataFrame):
        """The pairs ``user_id, item_id`` as a broadcast: users, where their items begin, items; None without pairs."""
        got = asked.select(F.col("user_id").cast("long"), F.col("item_id").cast("long")).dropna().distinct().orderBy("user_id", "item_id").toArrow()
        user, item = (got[c].to_numpy() for c in ("user_id", "item_id"))
        if len(user):
            users, counts = np.unique(user, return_counts=True)
            return self.rows.sparkSession.sparkContext.broadcast((users, np.r_[0, np.cumsum(counts)], item))

    def sums(self, asked) -> DataFrame:
        """``user_id, item_id, wc, w``: for the pairs of :meth:`asking` the sums of similarity * (v - shift) and of similarity over
        the user's neighbours with the item.  Needs one block: the neighbours are known where what they have is held."""
        return self._run("user_id long, item_id long, wc double, w double", asked, True)


def nearest_rows(rows: DataFrame, group: str, member: str, value: str, k: int, digits: int, *, block_bytes: int = HELD_ENTRIES * 16) -> DataFrame:
    """``src, dst, similarity`` of :class:`NearRows` over ``value`` by common groups."""
    from loomrec.operators.pairs import listed

    lists = listed(rows, group, member, value).select("m", F.lit(0.0).alias("shift"), F.lit(1.0).alias("scale"), "e")
    return NearRows(lists, k, digits, held=max(1, block_bytes // 16)).neighbours()
