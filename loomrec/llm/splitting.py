"""Splitting oversized texts at natural boundaries by dynamic programming over cut positions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.tokens import _worker_cache, encoder

# What a cut costs, by the boundary it falls on.
CUT_KINDS = ("cell", "paragraph", "line", "sentence", "word", "token")
CUT_PENALTY = (0.0, 0.3, 0.6, 1.0, 2.0, 4.0)
#: Weight of the squared deviation of a piece from an even share.
IMBALANCE = 2.0
#: Runs of ``limit // GRAIN_SHARE`` tokens bound what a cut in them can cost at least.
GRAIN_SHARE = 128

# Lines that open a cell in the usual ways of writing a notebook out, and cells of one-line JSON.
CELL = re.compile(rb'(?m)^(?:# ?%%|In \[[ \d*]*\]:|```\w|\s*\{\s*"cell_type"|\s*"cell_type"\s*:)|\{"cell_type"')
FENCE_END = re.compile(rb"(?m)^```[ \t]*\r?\n")
ESCAPED = re.compile(rb"(?:\\r)?\\n((?:\\r)?\\n)?")


def token_traits(path: str | None):
    """By token id: byte length, newlines in a blank token, blankness, end of sentence, leading blank, start of a character."""
    cache = _worker_cache()
    if ("traits", path) not in cache:
        enc = encoder(path)
        n = enc.max_token_value + 1
        traits = {k: np.zeros(n, kind) for k, kind in (("length", np.int64), ("newlines", np.int32), ("blank", bool), ("ends", bool), ("spaced", bool), ("starts", bool))}
        for token in enc.token_byte_values():
            k = enc.encode_single_token(token)
            blank = not token.strip()
            traits["length"][k] = len(token)
            traits["blank"][k] = blank
            traits["newlines"][k] = token.count(b"\n") if blank else 0
            traits["ends"][k] = token.rstrip(b"\"')]*_")[-1:] in (b".", b"!", b"?") and not blank
            traits["spaced"][k] = token[:1].isspace()
            traits["starts"][k] = (token[0] & 0xC0) != 0x80
        cache[("traits", path)] = traits
    return cache[("traits", path)]


def cut_penalties(ids: np.ndarray, raw: bytes, traits: dict) -> tuple[np.ndarray, np.ndarray]:
    """Kind of boundary before each token (index in CUT_KINDS, 6 where no cut is possible) and the byte offsets of tokens."""
    n = len(ids)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(traits["length"][ids], out=offsets[1:])
    kind = np.full(n + 1, 5, np.int8)
    blank, spaced = traits["blank"][ids], traits["spaced"][ids]
    kind[1:n][spaced[1:] | blank[:-1]] = 4
    kind[1:n][traits["ends"][ids][:-1] & spaced[1:]] = 3
    # Newlines in the run of blank tokens that ends just before a token.
    total = np.zeros(n + 1, np.int64)
    np.cumsum(traits["newlines"][ids], out=total[1:])
    last_text = np.maximum.accumulate(np.where(blank, 0, np.arange(1, n + 1)))
    run = total[1:] - total[last_text]
    ended = run[:-1]
    goes_on = traits["newlines"][ids][1:] > 0
    kind[1:n][(ended >= 1) & ~goes_on] = 2
    kind[1:n][(ended >= 2) & ~goes_on] = 1
    before = np.arange(n + 1)

    def at(places, value, after=False):
        if places:
            spot = np.searchsorted(offsets, np.asarray(places, np.int64), side="left" if after else "right") - (not after)
            spot = spot[(spot > 0) & (spot < n)]
            kind[spot] = np.minimum(kind[spot], value)

    escaped = [(m.end(), 1 if m.group(1) else 2) for m in ESCAPED.finditer(raw)]
    at([p for p, v in escaped if v == 2], 2, after=True)
    at([p for p, v in escaped if v == 1], 1, after=True)
    at([m.start() for m in CELL.finditer(raw)], 0)
    at([m.end() for m in FENCE_END.finditer(raw)], 0, after=True)
    impossible = before[:n][~traits["starts"][ids]]
    kind[impossible] = 6
    kind[0] = kind[n] = 0
    return kind, offsets


def _programme(at: np.ndarray, begin: np.ndarray, cost: np.ndarray, room: int, even: float) -> tuple[np.ndarray, float]:
    """The cheapest way over candidate positions ``at`` (the first is the start, the last the end): places of the cuts, cost."""
    total, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    total[0] = 0.0
    first = np.searchsorted(begin, at - room, side="left")
    scaled, shifted = begin / even, at / even - 1
    for j in range(1, len(at)):
        i = first[j]
        if i >= j:
            continue
        gap = shifted[j] - scaled[i:j]
        way = total[i:j] + IMBALANCE * gap * gap
        k = int(way.argmin())
        total[j], back[j] = way[k] + cost[j], i + k
    places, j = [], len(at) - 1
    while j:
        places.append(j)
        j = back[j]
    return np.asarray([0, *places[::-1]]), float(total[-1])


def _least_costs(cost: np.ndarray, n: int, overlap: int, room: int, even: float, grain: int) -> np.ndarray:
    """For every run of ``grain`` positions a lower bound of the cost of any way through it, without the cut in the run itself.

    A run costs its cheapest cut, and the distance between two runs counts as the most convenient one between any of their
    positions, for the imbalance and for the limit.
    """
    runs = len(cost)
    lo = 1 + np.arange(runs) * grain
    hi = np.minimum(lo + grain - 1, n - 1)
    reach = room // grain + 2

    def apart(near, far):
        gap = np.maximum(0.0, np.maximum(near / even - 1, 1 - far / even))
        return np.where((near <= room) & (far > 0), IMBALANCE * gap * gap, np.inf)

    steps = np.arange(1, reach + 1)
    between = apart(steps * grain - (grain - 1), steps * grain + (grain - 1))
    start, end = apart(lo - overlap, hi - overlap), apart(n - hi, n - lo)
    forth, back = start.copy(), end.copy()
    for c in range(runs):
        d = min(c, reach)
        if d:
            forth[c] = min(forth[c], (forth[c - d : c] + cost[c - d : c] + between[:d][::-1]).min())
    for c in range(runs - 1, -1, -1):
        d = min(runs - 1 - c, reach)
        if d:
            back[c] = min(back[c], (back[c + 1 : c + 1 + d] + cost[c + 1 : c + 1 + d] + between[:d]).min())
    return forth + back


def choose_cuts(kind: np.ndarray, limit: int, overlap: int, grain: int | None = None) -> np.ndarray:
    """Cut positions from 0 to the number of tokens, of least total penalty plus imbalance.

    The first piece covers at most ``limit`` tokens, each later one ``limit - overlap`` new ones.  The minimum is over all
    boundary positions: a first programme over the best boundary of every run of tokens gives a way and with it a bound; a
    position through which every way costs more, by a lower bound over runs, can't be in the best one; the second programme
    takes all others.  With ``grain`` only the best boundary of every ``grain`` tokens takes part, which is faster.
    """
    n = len(kind) - 1
    penalty = np.append(np.asarray(CUT_PENALTY), np.inf)[np.minimum(kind, 6)]
    size = grain or max(1, limit // GRAIN_SHARE)
    inner = kind[1:n]
    blocks = np.concatenate([inner, np.full(-len(inner) % size, 7, np.int8)]).reshape(-1, size)
    # Among equals the last of a run is taken: an arbitrary but fixed rule.
    best = size - 1 - blocks[:, ::-1].argmin(axis=1)
    chosen = 1 + np.arange(len(blocks)) * size + best
    chosen = chosen[blocks[np.arange(len(blocks)), best] < 6]
    room = limit - overlap
    even = (n - overlap) / max(1, -(-(n - overlap) // room))

    def solve(inside: np.ndarray) -> tuple[np.ndarray, float]:
        at = np.concatenate([[0], inside[inside > overlap], [n]])
        begin, cost = at.copy(), penalty[at]
        begin[0] = overlap  # nothing precedes the first piece: it may be longer, as if it began that much later
        cost[-1] = 0.0
        places, total = _programme(at, begin, cost, room, even)
        return at[places], total

    cuts, bound = solve(chosen)
    if grain is None and size > 1:
        least = np.minimum.reduceat(penalty[1:n], np.arange(0, n - 1, size))
        through = _least_costs(least, n, overlap, room, even, size)
        able = 1 + np.flatnonzero(np.repeat(through, size)[: n - 1] + penalty[1:n] <= bound + 1e-9)
        exact, total = solve(able)
        if total <= bound:
            cuts = exact
    return cuts


def split_text(text: str, limit: int, overlap: int, path: str | None = None, grain: int | None = None):
    """Pieces of one text as (start_token, end_token, overlap_tokens, cut, text), or None if it is within the limit.

    Every piece is a run of whole tokens on character boundaries and has at most ``limit`` tokens also when it is tokenized
    by itself; for that a tighter limit is tried where needed.  A text for which none is found comes back in one piece
    whose cut is ``none``.
    """
    enc = encoder(path)
    ids = np.asarray(enc.encode_ordinary(text), np.int64)
    n = len(ids)
    if n <= limit:
        return None
    raw = text.encode("utf-8")
    traits = token_traits(path)
    kind, offsets = cut_penalties(ids, raw, traits)
    tight = limit
    while True:
        cuts = choose_cuts(kind, tight, overlap, grain)
        starts = np.maximum(cuts[:-1] - overlap, 0)
        starts[0] = 0
        for k in range(1, len(starts)):  # an overlap also starts on a character
            while kind[starts[k]] == 6:
                starts[k] += 1
        out = [
            (int(s), int(e), int(c - s), CUT_KINDS[min(kind[e], 5)] if e < n else "end", raw[offsets[s] : offsets[e]].decode("utf-8"))
            for s, e, c in zip(starts, cuts[1:], cuts[:-1])
        ]
        over = max(len(x) for x in map(enc.encode_ordinary, (p[4] for p in out))) - limit
        if over <= 0:
            return out
        tight -= over + 4
        if tight <= 2 * overlap:
            return [(0, n, 0, "none", text)]


OUT = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("overlap_tokens", pa.int32()), ("cut", pa.string()), ("text", pa.string())]
)


def split_batches(batches, limit: int, overlap: int, path: str | None, with_text: bool, grain: int | None = None):
    """Arrow kernel over (id, text)."""
    for batch in batches:
        rows = []
        held = 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            pieces = split_text(text.as_py(), limit, overlap, path, grain)
            if pieces is None:
                continue
            for k, (s, e, o, cut, piece) in enumerate(pieces):
                rows.append((key, k, len(pieces), s, e, o, cut, piece if with_text else None))
                held += len(piece) if with_text else 32
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


def split_oversized(
    docs: DataFrame,
    doc_id: str,
    text: str,
    *,
    limit: int = 4_096,
    overlap: int = 128,
    vocabulary: str | None = None,
    with_text: bool = True,
    grain: int | None = None,
) -> DataFrame:
    """Ordered pieces of every text above ``limit`` tokens.

    Columns: ``<doc_id>, piece`` (from 0), ``n_pieces, start_token, end_token, overlap_tokens, cut`` and, unless
    ``with_text`` is false, ``text``.  A piece holds at most ``limit`` tokens, its first ``overlap_tokens`` repeat the end of the
    piece before it (``overlap``; up to 3 fewer where the run would begin inside a character); without these repeats the
    pieces join to the whole text.  ``cut`` names the boundary at its end: cell, paragraph, line, sentence, word, token or end; ``none`` marks a text that no cuts bring below the limit.

    Cuts minimise penalties by kind of boundary plus squared deviation from an even size over all boundary positions, or over
    the best of every ``grain`` tokens.  Texts of at most ``limit``
    bytes can't have more tokens and never reach Python.  Null and empty texts and texts within the limit give no rows, nor
    does a null id; repeated rows are split each.  An empty table gives no rows.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    long = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(
        F.col("id").isNotNull() & (F.octet_length("text") > limit)
    )

    def kernel(batches):
        return split_batches(batches, limit, overlap, vocabulary, with_text, grain)

    schema = "id long, piece int, n_pieces int, start_token long, end_token long, overlap_tokens int, cut string, text string"
    out = long.mapInArrow(kernel, schema).withColumnRenamed("id", doc_id)
    return out if with_text else out.drop("text")
