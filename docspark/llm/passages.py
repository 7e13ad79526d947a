"""Substring dedup by compact windows of token min-hashes.

Tokens are runs of five words. Under one hash function, the root of the Cartesian
tree of a subsequence's token hashes is its smallest token, the min-hash.
Neighbouring subsequences of ``LEAST_TOKENS`` tokens with the same root form a
compact window, from the first token of the first to the last of the last, which
stands for all of them. Their roots are the nodes of the text's tree that are
high enough to be the root of such a subsequence, about two per ``LEAST_TOKENS``
tokens; they are found as the runs of equal values of a sliding minimum, so the
lower nodes are never built. Texts that share windows under enough hash
functions, with overlapping intervals, are candidates; their tokens are compared.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import LOWER_ASCII, components, id_bitmap, mapped, mixed, text_bytes, window_hashes, written
from docspark.session import write_and_read

SHINGLE = 5
LEAST_WORDS = 50
LEAST_TOKENS = LEAST_WORDS - SHINGLE + 1
HASHES = 6
AGREE = 2  # hash functions that a candidate's windows must share; all are verified
SIMILARITY = 0.8
CROWD = 6  # windows of a min-hash that are all paired with each other; more are split
SPLITS = 8  # further hash functions that split the windows of a crowded min-hash
RUN, RUN_ROOM = 10, 9  # tokens of a run by which classes meet, and neighbours of which one is taken
REACH = 5 * LEAST_TOKENS // 2  # tokens on each side of a run by which its rows are compared
BLOCK = 1024  # rows of a run that meet in one task; more are cut to blocks that meet two by two
_BITS = 28
_SEEDS = (mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_SLICE = 1 << 18  # tokens whose windows are found at once


_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_LETTER = np.ones(256, bool)
_LETTER[[32, *range(9, 14)]] = False
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15
_PIECE = 1 << 19  # bytes whose words are hashed at once


def _powers(step: int, n: int) -> np.ndarray:
    steps = np.full(n, step, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Hasher:
    """64-bit hashes of words and of their runs, for many texts in a few array steps."""

    def __init__(self):
        self.up, self.down = _powers(_STEP, 1), _powers(_STEP, 1)

    def sums(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of some stretches of numbers."""
        n = len(numbers) + 1
        if n > len(self.up):
            self.up, self.down = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(numbers * self.up[: n - 1], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def _words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of a piece of text, and where they start.

        A word's hash is the sum of its bytes' numbers times powers by place in the word: a
        difference of two running sums over the piece, over the power of the word's start.
        """
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _LETTER[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        return self.sums(_BYTE[data], starts, ends), starts

    def all_tokens(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the five-word runs of some texts, one after another, and how many each has."""
        raw = b" ".join(raws).translate(LOWER_ASCII)
        begins = np.cumsum([0, *(len(r) + 1 for r in raws[:-1])])
        hashes, texts, at = [], [], 0
        while at < len(raw):
            blank = _BLANK.search(raw, at + _PIECE)
            end = blank.start() if blank else len(raw)
            own, starts = self._words(raw[at:end])
            hashes.append(own)
            texts.append(np.searchsorted(begins, starts + at, "right") - 1)
            at = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
        text = np.concatenate(texts)
        inside = text[: 1 - SHINGLE] == text[SHINGLE - 1 :]
        tokens = window_hashes(np.concatenate(hashes), SHINGLE)[inside]
        return tokens, np.bincount(text[: 1 - SHINGLE][inside], minlength=len(raws))

    def tokens(self, text: str | None) -> np.ndarray:
        """Hashes of the five-word runs of a whole text, A-Z in small letters."""
        return self.all_tokens([text_bytes(text)])[0]


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Minima of all runs of ``size`` along the last axis, by doubling."""
    low, width = values, 1
    while 2 * width <= size:
        low = np.minimum(low[..., :-width], low[..., width:])
        width *= 2
    rest = size - width
    return np.minimum(low[..., : low.shape[-1] - rest], low[..., rest:]) if rest else low


def compact_windows(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, function, min-hash, first token, last token)`` of windows of 46 tokens or more.

    ``tokens`` are those of texts of some ``sizes``, one after another. Every subsequence of 46
    tokens of a text lies in one window per function, that of its min-hash.
    """
    empty = np.zeros(0, np.int64)
    if len(tokens) < LEAST_TOKENS:
        return empty, empty, empty.astype(np.uint32), empty, empty
    hashes = tokens[None, :] * _SEEDS[:HASHES, None]
    low = sliding_minimum(hashes, LEAST_TOKENS)
    n = low.shape[1]
    text = np.repeat(np.arange(len(sizes)), sizes)
    # where the next window begins, and where none does as it would reach into another text
    inside = text[:n] == text[LEAST_TOKENS - 1 :]
    cut = np.ones(low.shape, bool)
    cut[:, 1:] = (low[:, 1:] != low[:, :-1]) | (text[1:n] != text[: n - 1]) | ~inside[1:]
    at = np.flatnonzero(cut.ravel())
    ends = np.append(at[1:], low.size) - 1
    real = inside[at % n]
    at, ends = at[real], ends[real]
    place = at % n
    own = text[place]
    first = place - (np.cumsum(sizes) - sizes)[own]
    return own, at // n, low.ravel()[at], first, first + (ends - at) + LEAST_TOKENS - 1


def _spans(function: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return function << (2 * _BITS) | first << _BITS | last


def _unpacked(span: int) -> tuple[int, int, int]:
    mask = (1 << _BITS) - 1
    return span >> 2 * _BITS, span >> _BITS & mask, span & mask


_WINDOW_ROW = "key long, doc long, span long, doc2 long, span2 long"


def _token_rows(frames):
    """Tokens of whole texts, four bytes each, for texts that may hold a passage."""
    hasher = Hasher()

    def record(docs, raws):
        tokens, sizes = hasher.all_tokens(raws)
        tokens = (tokens >> np.uint64(32)).astype("<u4")
        ends = np.cumsum(sizes)
        long = np.flatnonzero(sizes >= LEAST_TOKENS).tolist()
        data = [tokens[ends[i] - sizes[i] : ends[i]].tobytes() for i in long]
        return _record(doc=pa.array([docs[i] for i in long], pa.int64()), tokens=pa.array(data, pa.binary()))

    for frame in frames:
        docs, raws, size = [], [], 0
        for i, doc in enumerate(frame.column(0).to_pylist()):
            docs.append(doc)
            raws.append(text_bytes(frame.column(1)[i].as_py()))
            size += len(raws[-1])
            if size >= _PIECE:
                yield record(docs, raws)
                docs, raws, size = [], [], 0
        if docs:
            yield record(docs, raws)


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _texts(frames):
    """Ids, tokens one after another and sizes of some texts of a batch at a time."""
    for frame in frames:
        docs, column = frame.column(0).to_numpy(zero_copy_only=False), frame.column(1)
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        part = (np.cumsum(sizes) - sizes) // _SLICE
        starts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(docs)] if len(docs) else []
        for a, b in zip(starts, starts[1:]):
            data = b"".join(column.slice(a, b - a).to_pylist())
            yield docs[a:b], np.frombuffer(data, "<u4"), sizes[a:b]


def _keyed(docs, tokens, sizes):
    """Keys, documents and spans of all compact windows of some texts, whose they are and where."""
    which, function, value, first, last = compact_windows(tokens, sizes)
    key = mixed(value.astype(np.uint64) | function.astype(np.uint64) << np.uint64(32))
    return key, docs[which], _spans(function, first, last), which, first, last


def _by_key(key: np.ndarray, doc: np.ndarray, span: np.ndarray):
    """Order of rows by key, document and span, and how many of a key stand before each."""
    order = np.lexsort((span, doc, key))
    same = key[order]
    head = np.ones(len(same), bool)
    head[1:] = same[1:] != same[:-1]
    row = np.arange(len(same))
    leader = np.maximum.accumulate(np.where(head, row, 0))
    return order, leader, row - leader


def _rows(key, doc, span, doc2=None, span2=None):
    none = pa.nulls(len(key), pa.int64())
    whole = _record(
        key=pa.array(key.view(np.int64)),
        doc=pa.array(doc),
        span=pa.array(span),
        doc2=none if doc2 is None else pa.array(doc2),
        span2=none if span2 is None else pa.array(span2),
    )
    for at in range(0, whole.num_rows, 1 << 18):
        yield whole.slice(at, 1 << 18)


def _windows(frames):
    """Rows of compact windows; of a key that is crowded in a batch, just enough to show it."""
    for texts in _texts(frames):
        key, doc, span, *_ = _keyed(*texts)
        order, _, nth = _by_key(key, doc, span)
        keep = order[nth <= CROWD]
        yield from _rows(key[keep], doc[keep], span[keep])


def _split_windows(bitmap, bits):
    """Rows of the windows whose min-hash is crowded, by this and one of further min-hashes of theirs.

    Of rows that share all this in a batch, those past a few are paired at once with the
    first, under a key of their own, so that a passage in every document is no hot key.
    """
    seeds = _SEEDS[HASHES : HASHES + SPLITS]

    def batches(frames):
        filled = np.frombuffer(bitmap.value, np.uint8)
        for docs, tokens, sizes in _texts(frames):
            found = _keyed(docs, tokens, sizes)
            at = mixed(found[0]) >> np.uint64(64 - bits)
            crowded = np.flatnonzero((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            if not len(crowded):
                continue
            key, doc, span, which, first, last = (x[crowded] for x in found)
            begin = (np.cumsum(sizes) - sizes)[which]
            ends = np.stack((begin + first, begin + last + 1), axis=1).ravel()
            padded = np.append(tokens, np.uint32(0))
            lows = np.stack([np.minimum.reduceat(padded * seed, ends)[::2] for seed in seeds])
            numbered = lows.astype(np.uint64) | np.arange(SPLITS, dtype=np.uint64)[:, None] << np.uint64(32)
            finer = mixed(key[None, :] ^ mixed(numbered)).ravel()
            doc, span = np.tile(doc, SPLITS), np.tile(span, SPLITS)
            order, leader, nth = _by_key(finer, doc, span)
            key, doc, span = finer[order], doc[order], span[order]
            kept = np.flatnonzero(nth <= CROWD)
            yield from _rows(key[kept], doc[kept], span[kept])
            rest = np.flatnonzero((nth > CROWD) & (doc != doc[leader]))
            # a document that comes again under a key needs no second row
            again = (doc[rest] == doc[rest - 1]) & (key[rest] == key[rest - 1])
            rest = rest[~again]
            apart = mixed(key[rest] ^ mixed(doc[rest].astype(np.uint64)) ^ span[rest].astype(np.uint64))
            yield from _rows(apart, doc[rest], span[rest], doc[leader[rest]], span[leader[rest]])

    return batches


def _marked_runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of RUN tokens, and which of them are the least of RUN_ROOM neighbours.

    Of any RUN_ROOM neighbouring runs one is marked, by its tokens alone: two texts that have
    RUN + RUN_ROOM - 1 tokens in a row in common have a marked run in common.
    """
    hashes = window_hashes(tokens.astype(np.uint64), RUN)
    if len(hashes) < RUN_ROOM:
        return hashes, np.ones(len(hashes), bool)
    end = np.full(RUN_ROOM - 1, 0, np.uint64)
    least = np.concatenate((end, sliding_minimum(hashes, RUN_ROOM), end))
    return hashes, ~sliding_minimum(~least, RUN_ROOM) == hashes


def _crowded_runs(bitmap, bits):
    """Marked runs in the windows whose min-hash is crowded, with a hash of the region around each."""

    def batches(frames):
        filled = np.frombuffer(bitmap.value, np.uint8)
        hasher = Hasher()
        for docs, tokens, sizes in _texts(frames):
            key, _, _, which, first, last = _keyed(docs, tokens, sizes)
            at = mixed(key) >> np.uint64(64 - bits)
            crowded = np.flatnonzero((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            if not len(crowded):
                continue
            begin = np.cumsum(sizes) - sizes
            text = which[crowded]
            cover = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(cover, begin[text] + first[crowded], 1)
            np.add.at(cover, begin[text] + last[crowded] + 1, -1)
            hashes, marked = _marked_runs(tokens)
            inside = np.cumsum(cover)[: len(hashes)] > 0
            place = np.flatnonzero(marked & inside)
            own = np.repeat(np.arange(len(sizes)), sizes)
            place = place[own[place] == own[place + RUN - 1]]
            run, own = hashes[place], own[place]
            place = place - begin[own]
            # a run that comes again so near lies in the region of the one before
            order = np.lexsort((place, own, run))
            near = np.zeros(len(order), bool)
            a, b = order[:-1], order[1:]
            near[1:] = (run[a] == run[b]) & (own[a] == own[b]) & (place[b] - place[a] < LEAST_TOKENS)
            kept = np.sort(order[~near])
            run, own, place = run[kept], own[kept], place[kept]
            span = _spans(np.zeros_like(place), place, np.minimum(place + LEAST_TOKENS, sizes[own]) - 1)
            low = begin[own] + np.maximum(place - LEAST_TOKENS, 0)
            high = begin[own] + np.minimum(place + 2 * LEAST_TOKENS, sizes[own])
            around = hasher.sums(mixed(tokens.astype(np.uint64)), low, high)
            whole = _record(
                key=pa.array(run.view(np.int64)),
                doc=pa.array(docs[own]),
                span=pa.array(span),
                place=pa.array(place),
                around=pa.array(around.view(np.int64)),
            )
            for at in range(0, whole.num_rows, 1 << 18):
                yield whole.slice(at, 1 << 18)

    return batches


def _regions(frames, least: int = AGREE):
    """Intervals of each pair of documents in which enough hash functions agree."""
    for frame in frames:
        spans = pa.array(frame["spans"].tolist(), pa.list_(pa.struct({"sa": pa.int64(), "sb": pa.int64()})))
        given = _record(a=pa.array(frame["a"], pa.int64()), b=pa.array(frame["b"], pa.int64()), spans=spans)
        yield from (found.to_pandas() for found in _region_records([given], least))


def _region_records(frames, least: int):
    """``_regions`` of record batches."""
    mask = (1 << _BITS) - 1
    for frame in frames:
        sizes = pc.list_value_length(frame.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        sa, sb = (x.to_numpy(zero_copy_only=False) for x in frame.column(2).flatten().flatten())
        la, ra, lb, rb = sa >> _BITS & mask, sa & mask, sb >> _BITS & mask, sb & mask
        f = sb >> 2 * _BITS
        ends = np.cumsum(sizes)
        # pairs with too few functions are left out at once, and those with one row need no groups
        flags = np.bitwise_or.reduceat(1 << f, ends - sizes) if len(ends) else ends
        agree = sum(flags >> i & 1 for i in range(HASHES)) >= least
        one = np.flatnonzero(agree & (sizes == 1))
        first = (ends - sizes)[one]
        rows = [one, la[first], ra[first], lb[first], rb[first]]
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rb, lb, f, ra, la, row))
        found = list(zip(*(x[order].tolist() for x in (la, ra, f, lb, rb))))
        more: list[tuple[int, ...]] = []
        for i in np.flatnonzero(agree & (sizes > 1)).tolist():
            more += [(i, *g[:4]) for g in _groups(found[ends[i] - sizes[i] : ends[i]]) if len(g[4]) >= least]
        if more:
            rows = [np.concatenate((x, y)) for x, y in zip(rows, np.array(more, np.int64).T)]
        # a window may end inside a passage: look as far as one passage beyond each
        low, high = lambda x: pa.array(np.maximum(x - LEAST_TOKENS, 0), pa.int32()), lambda x: pa.array(x + LEAST_TOKENS, pa.int32())
        yield _record(
            a=frame.column(0).take(pa.array(rows[0])),
            b=frame.column(1).take(pa.array(rows[0])),
            a0=low(rows[1]),
            a1=high(rows[2]),
            b0=low(rows[3]),
            b1=high(rows[4]),
        )


def _groups(found: list[tuple[int, ...]]) -> list[list]:
    """Groups ``[first in a, last in a, first in b, last in b, functions]`` of windows that overlap in both."""
    groups, reached = [], {}  # groups by the parts of b that they reach
    for la, ra, f, lb, rb in found:
        parts = range(lb // LEAST_TOKENS, rb // LEAST_TOKENS + 1)
        own = -1
        for p in parts:
            # windows come in the order of a, so groups that ended before this one are done
            reached[p] = live = [i for i in reached.get(p, ()) if groups[i][1] >= la]
            own = max([own, *(i for i in live if lb <= groups[i][3] and rb >= groups[i][2])])
        if own < 0:
            own = len(groups)
            groups.append([la, ra, lb, rb, {f}])
        else:
            g = groups[own]
            g[1], g[2], g[3] = max(g[1], ra), min(g[2], lb), max(g[3], rb)
            g[4].add(f)
        for p in parts:
            if own not in reached[p]:
                reached[p].append(own)
    return groups


def _distinct(values: np.ndarray, kinds: int) -> np.ndarray:
    seen = np.zeros(kinds, bool)
    seen[values] = True
    return seen


def _least_distinct(values: np.ndarray, counted: np.ndarray) -> int:
    """The smallest number of different tokens, of those counted, in any LEAST_TOKENS neighbouring ones."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    before = np.full(n, -1)
    same = values[order[1:]] == values[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # a place counts in the stretches that begin after its token's last place before it
    at = np.arange(n)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(before + 1, at - LEAST_TOKENS + 1).clip(0), counted)
    change[1:] -= counted
    return int(np.cumsum(change)[: n - LEAST_TOKENS + 1].min())


def _chains(x, y, kinds: int):
    """Intervals of x and of y that hold each other's tokens at their ends, without too large gaps.

    Tokens are numbers below ``kinds``. With each come its shared tokens and all its tokens. A
    similar stretch may hold at most a quarter as many other tokens as shared
    ones, so it cannot reach over a gap with more.
    """
    pending = [(0, len(x) - 1, 0, len(y) - 1)]
    while pending:
        lo, hi, left, right = pending.pop()
        if min(hi - lo, right - left) + 1 < LEAST_TOKENS:
            continue
        own, other = x[lo : hi + 1], y[left : right + 1]
        of_x, of_y = _distinct(own, kinds), _distinct(other, kinds)
        in_x, in_y = np.flatnonzero(of_y[own]), np.flatnonzero(of_x[other])
        if not len(in_x):
            continue
        shared = np.count_nonzero(of_x & of_y)
        kinds_in = np.count_nonzero(of_x), np.count_nonzero(of_y)
        most = shared * (1 / SIMILARITY - 1)
        if kinds_in == (len(own), len(other)):
            # 46 tokens on both sides ask for so many in common
            if shared * (1 + SIMILARITY) < 2 * SIMILARITY * LEAST_TOKENS:
                continue
        # in texts that repeat themselves, any 46 tokens hold at least so many that the other text lacks
        elif _least_distinct(own, ~of_y[own]) + _least_distinct(other, ~of_x[other]) > most:
            continue

        def parts(values, inside, at):
            wide = [
                i + 1
                for i in np.flatnonzero(np.diff(inside) - 1 > most)
                if len(np.unique(values[inside[i] + 1 : inside[i + 1]])) > most
            ]
            ends = [0, *wide, len(inside)]
            return [(at + int(inside[i]), at + int(inside[j - 1])) for i, j in zip(ends, ends[1:])]

        first, second = parts(own, in_x, lo), parts(other, in_y, left)
        if first == [(lo, hi)] and second == [(left, right)]:
            yield (lo, hi, left, right), shared, sum(kinds_in)
        else:
            pending += [(*p, *q) for p in first for q in second]


def _equal_runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``(first in x, last in x, first in y, last in y)`` of the longest runs of equal tokens."""
    order = np.argsort(y, kind="stable")
    placed = y[order]
    begin, end = np.searchsorted(placed, x), np.searchsorted(placed, x, "right")
    size = end - begin
    found: tuple[list, list] = [], []
    step = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 1, 1 << 20)[1:], "right")
    for part in np.split(np.arange(len(x)), step):
        n = size[part]
        p = np.repeat(part, n)
        q = order[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        first = (p == 0) | (q == 0)
        first[~first] = x[p[~first] - 1] != y[q[~first] - 1]
        last = (p == len(x) - 1) | (q == len(y) - 1)
        last[~last] = x[p[~last] + 1] != y[q[~last] + 1]
        found[0].append(np.stack((p[first], q[first])))
        found[1].append(np.stack((p[last], q[last])))
    starts, ends = (np.concatenate(f, axis=1) for f in found)
    starts, ends = (f[:, np.lexsort((f[0], f[1] - f[0]))] for f in (starts, ends))
    return np.stack((starts[0], ends[0], starts[1], ends[1]))


def _firsts(values: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each token stands first, or past the end, and how many there are up to each place."""
    n = len(values)
    first = np.full(kinds, n)
    first[values[::-1]] = np.arange(n - 1, -1, -1)
    return first, np.cumsum(first[values] == np.arange(n))


def _within(seen: np.ndarray, met: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many tokens stand first at or before both ends, for each pair of ends."""
    if len(seen) * len(ends) <= 1 << 18:
        return np.count_nonzero((seen <= ends[:, None]) & (met <= others[:, None]), axis=1)
    # tokens join a sorted list in the order of one side, and are counted by the other
    order, asked = np.argsort(seen, kind="stable"), np.argsort(ends, kind="stable")
    upto = np.searchsorted(seen[order], ends[asked], "right")
    placed, held, at, out = met[order].tolist(), [], 0, np.zeros(len(ends), np.int64)
    for k, n, other in zip(asked.tolist(), upto.tolist(), others[asked].tolist()):
        while at < n:
            insort(held, placed[at])
            at += 1
        out[k] = bisect_right(held, other)
    return out


def _single_runs(x: np.ndarray, y: np.ndarray, kinds: int) -> tuple[np.ndarray, ...]:
    """``_equal_runs`` of texts whose tokens all stand once."""
    place = np.full(kinds, -2)
    place[y] = np.arange(len(y))
    met = place[x]
    p = np.flatnonzero(met >= 0)
    q = met[p]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    order = np.lexsort((p[first], q[first] - p[first]))
    return p[first][order], p[last][order], q[first][order], q[last][order]


_FEW_RUNS = 256


def _of_single_tokens(p, e, q, f) -> list[tuple[int, int, int, int]]:
    """As ``_sub_stretches``, for texts whose tokens all stand once.

    Then a run lies in a stretch or outside of it, and what two texts share from one run to
    another is a sum of the lengths of runs: one product of matrices for all ends at once.
    """
    runs, here = e - p + 1, lambda a, b: a[None, :] - b[:, None] + 1
    after = (p[None, :] >= p[:, None]) & (q[None, :] >= q[:, None])
    before = (e[:, None] <= e[None, :]) & (f[:, None] <= f[None, :])
    shared = (after * runs) @ before.astype(np.int64)
    own, other = here(e, p), here(f, q)
    good = (np.minimum(own, other) >= LEAST_TOKENS) & (shared >= SIMILARITY * (own + other - shared))
    longest = np.argsort(-(e + f), kind="stable")
    out: list[tuple[int, int, int, int]] = []
    for i in np.flatnonzero(good.any(axis=1)).tolist():
        s, t = int(p[i]), int(q[i])
        ends = longest[good[i][longest]]
        for o in out:
            if o[0] <= s and o[2] <= t and len(ends):
                ends = ends[(e[ends] > o[1]) | (f[ends] > o[3])]
        if len(ends):
            out.append((s, int(e[ends[0]]), t, int(f[ends[0]])))
    return out


def _sub_stretches(x: np.ndarray, y: np.ndarray, kinds: int, single: bool) -> list[tuple[int, int, int, int]]:
    """The longest similar stretches from the start of an equal run to the end of an equal run.

    Each run is tried as the first and as the last, as a similar stretch may
    always be drawn out to them. Tokens are counted for many ends at once, and only for ends
    whose tokens in the whole of the other text would be enough. ``single`` says that no token
    stands twice in a text.
    """
    p, e, q, f = _single_runs(x, y, kinds) if single else _equal_runs(x, y)
    if single and len(p) <= _FEW_RUNS:
        return _outermost(_of_single_tokens(p, e, q, f))
    out: list[tuple[int, int, int, int]] = []
    links = _Linked()
    for s, end, t, last in zip(p.tolist(), e.tolist(), q.tolist(), f.tolist()):
        far = (e - s + 1 >= LEAST_TOKENS) & (f - t + 1 >= LEAST_TOKENS)
        held = links.ends(s, end, t, last)
        if held:  # within passages that are linked: only ends that lead out of them add anything
            far &= (e > held[0]) | (f > held[1])
        else:
            for o in out:
                if o[0] <= s and o[2] <= t:
                    far &= (e > o[1]) | (f > o[3])
        ends, others = e[far], f[far]
        if not len(ends):
            continue
        at, own = _firsts(x[s : int(ends.max()) + 1], kinds)
        place, other = _firsts(y[t : int(others.max()) + 1], kinds)
        both = np.flatnonzero((at < len(own)) & (place < len(other)))
        seen, met = at[both], place[both]
        size = own[ends - s] + other[others - t]
        enough = size * (SIMILARITY / (1 + SIMILARITY)) - 1e-9
        upto = lambda first, n: np.cumsum(np.bincount(first, minlength=n))
        most = np.minimum(upto(seen, len(own))[ends - s], upto(met, len(other))[others - t])
        tried = np.flatnonzero(most >= enough)
        tried = tried[np.argsort(-(ends + others)[tried], kind="stable")]
        for some in np.split(tried, [8, 64]):
            shared = _within(seen, met, ends[some] - s, others[some] - t)
            good = np.flatnonzero(shared >= SIMILARITY * (size[some] - shared))
            if len(good):
                k = some[good[0]]
                out.append((s, int(ends[k]), t, int(others[k])))
                links.add(out[-1])
                break
    return _outermost(out)


class _Linked:
    """Passages that overlapping stretches make on both sides, and which of them are linked."""

    def __init__(self):
        self.stretches: list[tuple[int, int, int, int]] = []
        self.sides: tuple[list, list] = [], []
        self.pairs: set[tuple[int, int]] = set()

    @staticmethod
    def _merged(intervals) -> list[list[int]]:
        out: list[list[int]] = []
        for lo, hi in sorted(intervals):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return out

    @staticmethod
    def _holder(side: list[list[int]], lo: int, hi: int) -> int:
        at = bisect_right(side, [lo, 1 << 62]) - 1
        return at if at >= 0 and hi <= side[at][1] else -1

    def add(self, stretch: tuple[int, int, int, int]) -> None:
        self.stretches.append(stretch)
        self.sides = self._merged(s[:2] for s in self.stretches), self._merged(s[2:] for s in self.stretches)
        self.pairs = {(self._holder(self.sides[0], *s[:2]), self._holder(self.sides[1], *s[2:])) for s in self.stretches}

    def ends(self, s: int, e: int, t: int, f: int) -> tuple[int, int] | None:
        """Where the linked passages that hold a run end, if there are such."""
        a, b = self._holder(self.sides[0], s, e), self._holder(self.sides[1], t, f)
        return (self.sides[0][a][1], self.sides[1][b][1]) if (a, b) in self.pairs else None


def _outermost(out: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    inside = lambda s, o: s != o and o[0] <= s[0] and s[1] <= o[1] and o[2] <= s[2] and s[3] <= o[3]
    return [s for s in dict.fromkeys(out) if not any(inside(s, o) for o in out)]


def similar_stretches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(first, last)`` in a and in b of passages with Jaccard similarity 0.8 or more.

    Both sides begin and end with tokens of the other and have 46 or more. Each
    chain is taken whole if it is similar enough; if not, its sub-stretches are
    tried, from the start of every equal run to the end of every other.
    """
    if len(a) >= LEAST_TOKENS and np.array_equal(a, b):
        return [(0, len(a) - 1, 0, len(a) - 1)]
    # small numbers for tokens, so that sets of them are arrays of flags
    known, numbers = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, kinds = numbers[: len(a)], numbers[len(a) :], len(known)
    out: dict[tuple[int, int, int, int], None] = {}
    for (lo, hi, left, right), shared, size in _chains(x, y, kinds):
        if shared >= SIMILARITY * (size - shared):
            out[lo, hi, left, right] = None
            continue
        single = size == hi - lo + right - left + 2
        for p, e, q, f in _sub_stretches(x[lo : hi + 1], y[left : right + 1], kinds, single):
            out[lo + p, lo + e, left + q, left + f] = None
    return list(out)


_NEVER = 1 << 20


def _dense(gain: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts have LEAST_TOKENS neighbouring tokens or more whose gains add up to 0 or more.

    If any have, some that are fewer than 2 * LEAST_TOKENS have: a longer stretch has such a half.
    """
    starts = np.cumsum(sizes + 1) - sizes - 1
    # a place before each text that no stretch can make up for keeps stretches within texts
    weights = np.full(len(gain) + len(sizes), -_NEVER)
    inside = np.ones(len(weights), bool)
    inside[starts] = False
    weights[inside] = gain
    sums = np.concatenate((np.full(LEAST_TOKENS - 1, 1 << 62), [0], np.cumsum(weights)))
    ended = np.zeros(len(weights), bool)
    if len(weights) >= LEAST_TOKENS:
        least = sliding_minimum(sums, LEAST_TOKENS)[: len(weights) - LEAST_TOKENS + 1]
        ended[LEAST_TOKENS - 1 :] = least <= sums[2 * LEAST_TOKENS - 1 :]
    return np.logical_or.reduceat(ended, starts)


def may_be_similar(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Which pairs of texts may have similar stretches; the others have none.

    Tokens are those of all texts of a side, one after another. Stretches of m and n different
    tokens have at least 4/9 (m + n) in common: 8/9 of those of one side, 4/5 of the other's. So
    in some 46 neighbouring tokens or more of both texts, different tokens that the other text
    lacks are a quarter or less of those it holds, and on one side an eighth. A token
    that stands often counts each time if the other text holds it, and once if not. Texts
    with fewer than four different tokens in common may lack none there.
    """
    n, rows = len(a), np.arange(len(sizes_a), dtype=np.uint64) << np.uint64(33)
    side = np.concatenate((np.zeros(n, np.uint64), np.ones(len(b), np.uint64)))
    keys = np.concatenate((np.repeat(rows, sizes_a), np.repeat(rows, sizes_b)))
    keys |= np.concatenate((a, b)).astype(np.uint64) << np.uint64(1) | side
    order = np.argsort(keys)
    kept = keys[order]
    one = np.ones(len(keys), bool)
    one[1:] = kept[1:] != kept[:-1]
    both = kept[one] >> np.uint64(1)
    met = np.zeros(len(both), bool)
    met[1:] = both[1:] == both[:-1]
    met[:-1] |= met[1:]
    shared, counted = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    shared[order] = met[np.cumsum(one) - 1]
    counted[order] = one
    few = np.bincount((both[met] >> np.uint64(32)).astype(np.int64), minlength=len(rows)) < 2 * 4
    strict = np.concatenate((np.repeat(few, sizes_a), np.repeat(few, sizes_b)))

    def dense(part):
        gain = np.where(shared, 1, np.where(strict, -_NEVER, np.where(counted, -part, 0)))
        return _dense(gain[:n], sizes_a), _dense(gain[n:], sizes_b)

    return np.logical_and(*dense(4)) & np.logical_or(*dense(8))


def _verified(frames):
    for frame in frames:
        given = {name: frame.column(i) for i, name in enumerate(frame.schema.names)}
        sizes = {k: pc.binary_length(given[k]).to_numpy(zero_copy_only=False).astype(np.int64) // 4 for k in ("sa", "sb")}
        total = sizes["sa"] + sizes["sb"]
        part = (np.cumsum(total) - total) // _SLICE
        starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(total)] if len(total) else []
        rows: list[tuple[int, ...]] = []
        for at, end in zip(starts, starts[1:]):
            raw = {k: given[k].slice(at, end - at).to_pylist() for k in sizes}
            tokens = {k: np.frombuffer(b"".join(raw[k]), "<u4") for k in sizes}
            asked = np.flatnonzero(may_be_similar(tokens["sa"], sizes["sa"][at:end], tokens["sb"], sizes["sb"][at:end]))
            own = [given[k].slice(at, end - at).take(pa.array(asked)).to_pylist() for k in ("a", "a0", "b", "b0")]
            for i, a, a0, b, b0 in zip(asked.tolist(), *own):
                found = similar_stretches(np.frombuffer(raw["sa"][i], "<u4"), np.frombuffer(raw["sb"][i], "<u4"))
                rows += [(a, a0 + p, a0 + q, b, b0 + s, b0 + t) for p, q, s, t in found]
        columns = zip(*rows) if rows else [()] * 6
        kinds = {"a": pa.int64(), "a0": pa.int32(), "a1": pa.int32(), "b": pa.int64(), "b0": pa.int32(), "b1": pa.int32()}
        yield _record(**{k: pa.array(c, kind) for c, (k, kind) in zip(columns, kinds.items())})


def _fewest(around: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The smallest number of different tokens in any LEAST_TOKENS neighbouring ones, for each row."""
    n, width = around.shape
    row, at = np.nonzero(around >= 0)
    # a place counts in the stretches that begin after its token's last place before it
    change = np.zeros((n, width + 1), np.int64)
    np.add.at(change, (row, np.maximum(before[row, at] + 1, at - LEAST_TOKENS + 1).clip(0)), 1)
    np.add.at(change, (row, at + 1), -1)
    kinds = np.cumsum(change, axis=1)[:, : width - LEAST_TOKENS + 1]
    whole = (around[:, : kinds.shape[1]] >= 0) & (around[:, LEAST_TOKENS - 1 :] >= 0)
    return np.where(whole, kinds, LEAST_TOKENS).min(axis=1, initial=LEAST_TOKENS)


def _room(alone: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of LEAST_TOKENS or more around the run: the most of four times the tokens
    that may lack on both sides that are left to the other side, and the fewest tokens that are ``alone``."""
    absent = around < 0
    gain = np.where(absent, -_NEVER, np.where(alone, -4, 1)).astype(np.int32)
    lacks = np.where(absent, _NEVER, alone).astype(np.int32)
    zero = np.zeros((len(around), 1), np.int32)
    left, right = slice(REACH - 1, None, -1), slice(REACH + RUN, None)

    def sums(values, side):
        return np.concatenate((zero, np.cumsum(values[:, side], axis=1, dtype=np.int32)), axis=1)

    need = LEAST_TOKENS - RUN
    a, b = sums(gain, left), sums(gain, right)
    best = np.maximum.accumulate(b[:, ::-1], axis=1)[:, ::-1]
    most = (a + best[:, np.maximum(need - np.arange(REACH + 1), 0)]).max(axis=1) + RUN
    a, b = sums(lacks, left), sums(lacks, right)
    return most, (a[:, : need + 1] + b[:, need::-1]).min(axis=1)


_OFTEN = 16  # rows that hold a token from which on it is counted by a product of matrices


def _in_common(row: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """How many kinds each two of n rows have in common, given each row's kinds once, in order of kinds."""
    new = np.flatnonzero(np.diff(kind, prepend=-1))
    often = np.diff(np.append(new, len(kind)))
    out = np.zeros(n * n, np.float32)
    for size in range(2, min(_OFTEN, often.max(initial=0) + 1)):
        rows = row[new[often == size][:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        out += np.bincount((rows[:, i] * n + rows[:, j]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    many = np.flatnonzero(often >= _OFTEN)
    for part in np.array_split(many, len(many) * n // (1 << 22) + 1) if len(many) else ():
        held = np.zeros((n, len(part)), np.float32)
        size = often[part]
        column = np.repeat(np.arange(len(part)), size)
        at = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size) + new[part][column]
        held[row[at], column] = 1
        out += held @ held.T
    return out


class _Meeting:
    """Some texts that all hold a run of tokens, and which two of them may be similar around it.

    ``found`` are the tokens of all texts, one after another, and ``before`` how many of a text stand before the run.
    Similar stretches have 4/9 of the different tokens of both in common, and those that one lacks are a quarter
    of these or less. So two texts may only be similar around the run if they have enough tokens in common,
    and if enough are left by what no other text holds, or not the other one, counted once. Where a token
    comes again, the run may too, and all stretches count.
    """

    def __init__(self, found: np.ndarray, sizes: np.ndarray, before: np.ndarray):
        self.found, self.sizes, self.before = found, sizes, before
        self.ends = np.cumsum(sizes)
        n, width = len(sizes), 2 * REACH + RUN
        row = np.repeat(np.arange(n), sizes)
        # the run stands in the middle columns
        column = np.arange(len(found)) - np.repeat(self.ends - sizes, sizes) + REACH - before[row]
        order = np.argsort(found, kind="stable")
        kept, row, column = found[order], row[order], column[order]
        new = np.ones(len(kept), bool)
        new[1:] = kept[1:] != kept[:-1]
        once = new.copy()
        once[1:] |= row[1:] != row[:-1]
        kind = np.cumsum(new) - 1
        self.around = np.full((n, width), -1, np.int32)
        self.around[row, column] = kind
        self.first = np.zeros((n, width), bool)
        self.first[row[once], column[once]] = True
        self.kinds = row[once], column[once], kind[once]
        twice = np.flatnonzero(~once)
        self.again = np.zeros(n, bool)
        self.again[row[twice]] = True
        self.fewest = np.full(n, LEAST_TOKENS)
        if len(twice):
            earlier = np.full((n, width), -1)
            earlier[row[twice], column[twice]] = column[twice - 1]
            self.fewest[self.again] = _fewest(self.around[self.again], earlier[self.again])

    def _rooms(self, alone: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
        most, lacks = _room(alone, self.around[rows])
        return np.where(self.again[rows], _NEVER, most), np.where(self.again[rows], 0, lacks)

    def common(self) -> np.ndarray:
        """What each two that may be similar have in common, or 0."""
        n = len(self.sizes)
        row, column, kind = self.kinds
        live = np.ones(n, bool)
        while True:
            kept = live[row]
            often = np.bincount(kind[kept], minlength=len(self.found))
            alone = np.zeros(self.around.shape, bool)
            alone[row, column] = often[kind] < 2
            most, lacks = self._rooms(alone, slice(None))
            left = live & (most >= 4 * lacks[live].min(initial=_NEVER))
            if left.sum() == live.sum():
                break
            live = left
        own = np.flatnonzero(live)
        place = np.cumsum(live) - 1
        kept &= often[kind] > 1
        shared = _in_common(place[row[kept]], kind[kept], len(own))
        fewest, most, lacks = self.fewest[own], most[own], 4 * lacks[own]
        enough = shared >= (fewest[:, None] + fewest) * (SIMILARITY / (1 + SIMILARITY)) - 1e-3
        enough &= (most[:, None] >= lacks) & (most >= lacks[:, None])
        out = np.zeros((n, n), np.float32)
        out[np.ix_(own, own)] = np.where(enough, shared, 0)
        return out

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs may be similar around the run by the tokens that one holds and not the other."""
        kinds = int(self.around.max()) + 1
        held = self.kinds[0] * kinds + self.kinds[2]
        if len(self.sizes) * kinds <= 1 << 26:
            flags = np.zeros(len(self.sizes) * kinds, bool)
            flags[held] = True
            holds = lambda rows, tokens: flags[rows[:, None] * kinds + tokens]
        else:
            held.sort()
            holds = lambda rows, tokens: np.append(held, -1)[np.searchsorted(held, k := rows[:, None] * kinds + tokens)] == k
        most_x, lacks_x = self._rooms(self.first[x] & ~holds(y, self.around[x]), x)
        most_y, lacks_y = self._rooms(self.first[y] & ~holds(x, self.around[y]), y)
        return (most_x >= 4 * lacks_y) & (most_y >= 4 * lacks_x)

    def link(self, i: int, j: int) -> tuple[bool, bool]:
        """Whether two texts have similar stretches, and whether some hold the run."""
        (a, b), (p, q) = (self.found[self.ends[k] - self.sizes[k] : self.ends[k]] for k in (i, j)), self.before[[i, j]]
        found = similar_stretches(a, b)
        holds = any(s[0] < p + RUN and p <= s[1] and s[2] < q + RUN and q <= s[3] for s in found)
        return holds or bool(found) and bool(self.again[i] | self.again[j]), holds


def _linking(texts: _Meeting, classes: np.ndarray, common: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of texts that are similar around their run and bring all classes together that any pair does there.

    ``common`` is what each two to be compared have in common: those with most come
    first, and classes that a link around the run has made one need no more.
    """
    classes = np.unique(classes, return_inverse=True)[1]
    x, y = np.nonzero(np.triu(common, 1))
    order = np.argsort(-common[x, y], kind="stable")
    x, y, out = x[order], y[order], []
    while len(x):
        i, j = x[:4096], y[:4096]
        x, y = x[4096:], y[4096:]
        may = texts.may_link(i, j)
        for a, b in zip(i[may].tolist(), j[may].tolist()):
            if classes[a] == classes[b]:
                continue
            linked, holds = texts.link(a, b)
            if linked:
                out.append((a, b))
            if holds:
                classes[classes == classes[b]] = classes[a]
        apart = classes[x] != classes[y]
        x, y = x[apart], y[apart]
    return out


_AT_ONCE = 256  # rows of several runs that are looked at together


def _met(frames):
    """Pairs of rows of one run that are similar around it and link the classes that meet there."""

    def pairs(rows: pa.Table):
        key, one, two, block, kind, doc, span, before = (
            rows[c].to_numpy() for c in ("key", "one", "two", "block", "class", "doc", "span", "before")
        )
        raw = rows["tokens"].to_pylist()
        sizes = np.array([len(x) // 4 for x in raw], np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        meeting = np.cumsum(new)
        ends = [*np.flatnonzero(new)[1:].tolist(), len(key)]
        lo = 0
        for hi in ends:
            if hi - lo < _AT_ONCE and hi < len(key):
                continue
            # meetings of few rows are looked at together, their tokens numbered apart
            own, kinds = meeting[lo:hi], kind[lo:hi]
            met = (own[:, None] == own) & (kinds[:, None] != kinds) & (doc[lo:hi, None] != doc[lo:hi])
            met &= ((one == two)[lo:hi, None]) | (block[lo:hi, None] != block[lo:hi])
            tokens = np.frombuffer(b"".join(raw[lo:hi]), "<u4") | np.repeat(own, sizes[lo:hi]).astype(np.uint64) << np.uint64(32)
            texts = _Meeting(tokens, sizes[lo:hi], before[lo:hi])
            classes = mixed(own.astype(np.uint64)) ^ kinds.view(np.uint64)
            pair = np.array(_linking(texts, classes, np.where(met, texts.common(), 0)), np.int64).reshape(-1, 2)
            x, y = lo + pair.T
            lo = hi
            x, y = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
            for at in range(0, len(x), 1 << 18):
                i, j = x[at : at + (1 << 18)], y[at : at + (1 << 18)]
                yield _record(a=pa.array(doc[i]), b=pa.array(doc[j]), sa=pa.array(span[i]), sb=pa.array(span[j]))

    rest = None
    for frame in frames:
        table = pa.Table.from_batches([frame])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        ids = [table[c].to_numpy() for c in ("key", "one", "two")]
        last = np.logical_and.reduce([x == x[-1] for x in ids])
        cut = int(np.argmax(last))  # rows are in order, so those of the last block stand at the end
        if cut:
            yield from pairs(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield from pairs(rest)


def _asked_tokens(bitmap, bits):
    """Token rows of the documents in a filter of ids."""

    def batches(frames):
        filled = np.frombuffer(bitmap.value, np.uint8)
        for frame in frames:
            at = mixed(frame.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)
            asked = (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            yield frame.filter(pa.array(asked.astype(bool)))

    return batches


def _one_text_per_id(tokens: DataFrame) -> DataFrame:
    """Of several texts of one id the longest counts, of those the last by its tokens' bytes."""
    many = tokens.groupBy("doc").count().where("count > 1").select("doc")
    if many.isEmpty():
        return tokens
    longest = (
        tokens.join(many, "doc", "left_semi")
        .groupBy("doc")
        .agg(F.max(F.struct(F.octet_length("tokens").alias("n"), "tokens"))["tokens"].alias("tokens"))
    )
    return written(tokens.join(many, "doc", "left_anti").unionByName(longest), "passage-one-text")


def _paired(windows: DataFrame, crowded: bool) -> DataFrame:
    """All pairs ``doc, span, o`` of a key's rows, if there are few; ``o`` is null on one row of a key with more.

    With ``crowded``, rows of such a key are paired with its first and the one before.
    """
    by = Window.partitionBy("key").orderBy("doc", "span")
    row = F.struct("doc", "span")
    # most keys have one row: these go before anything is made of the others
    windows = windows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key")))
    windows = windows.where((F.col("size") > 1) | F.col("doc2").isNotNull())
    all_before = F.array(*[F.lag(row, n).over(by) for n in range(1, CROWD)])
    two = F.array(F.first(row).over(by), F.lag(row).over(by))
    beyond = two if crowded else F.when(F.row_number().over(by) == 1, F.array(F.lit(None).cast("struct<doc:long,span:long>")))
    near = F.when(F.col("size") <= CROWD, F.filter(all_before, lambda o: o.isNotNull())).otherwise(beyond)
    given = F.when(F.col("doc2").isNotNull(), F.array(F.struct(F.col("doc2").alias("doc"), F.col("span2").alias("span"))))
    return windows.select("key", "doc", "span", F.coalesce(given, near).alias("near")).select(
        "key", "doc", "span", F.explode(F.array_distinct("near")).alias("o")
    )


def _oriented(found: DataFrame) -> DataFrame:
    """Pairs ``a, b, sa, sb`` of rows ``doc, span, o``, with a < b."""
    return found.select(
        F.least("doc", "o.doc").alias("a"),
        F.greatest("doc", "o.doc").alias("b"),
        F.when(F.col("doc") < F.col("o.doc"), F.col("span")).otherwise(F.col("o.span")).alias("sa"),
        F.when(F.col("doc") < F.col("o.doc"), F.col("o.span")).otherwise(F.col("span")).alias("sb"),
    )


def _compared(pairs: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """Verified pairs of passages of candidates ``a, b, sa, sb`` that ``least`` functions give."""
    grouped = pairs.groupBy("a", "b").agg(F.collect_set(F.struct("sa", "sb")).alias("spans"))
    enough = grouped.where(F.size("spans") >= least)
    asked = written(
        mapped(enough, lambda frames: _region_records(frames, least), "a long, b long, a0 int, a1 int, b0 int, b1 int", arrow=True),
        "passage-regions",
    )
    wanted = asked.select(F.col("a").alias("id")).union(asked.select("b"))
    held_ids, bits = id_bitmap(wanted)
    tokens = mapped(tokens, _asked_tokens(held_ids, bits), "doc long, tokens binary", arrow=True)

    def part(lo, hi):
        return F.expr(f"substring(tokens, 4 * {lo} + 1, 4 * ({hi} - {lo} + 1))")

    held = (
        asked.join(tokens, F.col("a") == F.col("doc"))
        .select(*asked.columns, part("a0", "a1").alias("sa"))
        .join(tokens, F.col("b") == F.col("doc"))
        .select(*asked.columns, "sa", part("b0", "b1").alias("sb"))
    )
    return mapped(held, _verified, "a long, a0 int, a1 int, b long, b0 int, b1 int", arrow=True)


def _apart(runs: DataFrame, links: DataFrame, tokens: DataFrame) -> DataFrame:
    """Candidates ``a, b, sa, sb`` that share a run and whose passages there are in no common class.

    Members of a class with the same tokens all around the run stand for each other. All
    others of a run meet within tasks, in blocks, and only those that are similar around it
    become rows, and of two classes no more once they are linked there. So neither
    large classes nor a line in otherwise different texts make many.
    """
    spans, edges = _spans_and_edges(links)
    classes = spans.join(components(edges, "near-passages"), "node").select(
        F.col("doc").alias("d"), "first", "last", "component"
    )
    # a stretch with the run in it overlaps the passages that the run overlaps, and so is one with them
    here = (F.col("doc") == F.col("d")) & F.col("place").between(F.col("first") - (RUN - 1), F.col("last"))
    alone = F.xxhash64("doc", F.lit("alone"))
    rows = written(
        runs.join(classes, here, "left")
        .groupBy("key", F.coalesce("component", alone).alias("class"), "around")
        .agg(F.min(F.struct("doc", "span", "place")).alias("r"))
        .select("key", "class", "r.*"),
        "passage-runs",
    )
    shared = rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n")).where("x <> y")
    blocks = shared.select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, F.col("key") == F.col("k")).drop("k")
    rows = written(rows.withColumn("block", F.expr("cast(pmod(xxhash64(doc, span), blocks) as int)")), "passage-shared-runs")
    held_ids, bits = id_bitmap(rows.select("doc"))
    texts = mapped(tokens, _asked_tokens(held_ids, bits), "doc long, tokens binary", arrow=True)
    low = f"greatest(place - {REACH}, 0)"
    around = rows.join(texts, "doc").select(
        "key",
        "block",
        "class",
        "doc",
        "span",
        F.expr(f"cast(place - {low} as int)").alias("before"),
        F.expr(f"substring(tokens, cast(4 * {low} + 1 as int), cast(4 * (place - {low} + {RUN + REACH}) as int))").alias("tokens"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    meeting = around.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    # few rows make many pairs, so their tasks are not to be put together by their bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meeting = meeting.drop("other").repartition(parts, "key", "one", "two").sortWithinPartitions("key", "one", "two")
    return mapped(meeting, _met, "a long, b long, sa long, sb long", arrow=True)


def similar_passages(docs: DataFrame) -> DataFrame:
    """Verified pairs ``(a, a0, a1, b, b0, b1)`` of passages, in tokens, a < b.

    Windows of a min-hash are all paired with each other. Where it is crowded, its windows
    are split by further min-hashes of their own tokens, and all are paired that share one
    of these; those that share it with many others as well, as copies of one passage
    do, are paired with the first of them and the one before. What these pairs do not bring
    into one class is then compared whole: in windows of crowded min-hashes, all documents
    that share runs of tokens, as similar passages must, and whose passages there are in
    different classes or in none.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = written(mapped(rows, _token_rows, "doc long, tokens binary", arrow=True), "passage-tokens")
    tokens = _one_text_per_id(tokens)
    first = _paired(mapped(tokens, _windows, _WINDOW_ROW, arrow=True), False)
    first = write_and_read(first.withColumn("crowded", F.col("o").isNull()), "llm-passage-pairs", "crowded")
    crowded = first.where("crowded").select("key")
    bitmap, bits = id_bitmap(crowded)
    split = mapped(tokens, _split_windows(bitmap, bits), _WINDOW_ROW, arrow=True)
    found = first.where("not crowded").select("doc", "span", "o").unionByName(_paired(split, True).select("doc", "span", "o"))
    near = _compared(_oriented(found.where("o.doc is not null and o.doc <> doc")), tokens, AGREE)
    if crowded.isEmpty():
        return near
    near = written(near, "passage-near-links")
    runs = mapped(tokens, _crowded_runs(bitmap, bits), "key long, doc long, span long, place long, around long", arrow=True)
    return near.unionByName(_compared(_apart(runs, near, tokens), tokens, 1))


def _spans_and_edges(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages ``doc, first, last, node`` that overlapping sides of links make, and links ``a, b`` of nodes."""
    sides = links.select(F.col("a").alias("doc"), F.col("a0").alias("lo"), F.col("a1").alias("hi")).union(
        links.select("b", "b0", "b1")
    )
    by = Window.partitionBy("doc").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before >= F.col("lo"), 0).otherwise(1)
    merged = (
        sides.distinct()
        .withColumn("new", starts)
        .withColumn("nth", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    )
    whole = merged.groupBy("doc", "nth").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    whole = written(whole.withColumn("node", F.xxhash64("doc", "first")), "passage-spans")

    def node(doc, lo):
        spans = whole.select(F.col("doc").alias("d"), "first", "last", "node")
        return (F.col(doc) == F.col("d")) & F.col(lo).between(F.col("first"), F.col("last")), spans

    on_a, spans = node("a", "a0")
    edges = links.join(spans, on_a).select("b", "b0", F.col("node").alias("x"))
    on_b, spans = node("b", "b0")
    edges = written(edges.join(spans, on_b).select(F.col("x").alias("a"), F.col("node").alias("b")), "passage-edges")
    return whole, edges


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_word, n_words, class_id, n_links)`` of passages that repeat.

    A passage has 50 words or more and a five-word Jaccard similarity of 0.8 or
    more to a passage of another document. Overlapping passages of a document
    are one. ``class_id`` is the same for all that are linked, directly or by
    others: the smallest id of a document among them, with its first word.
    Documents without such a passage have no row. Null, empty and short texts
    and rows with a null id have none; rows of one id are one document, of several texts the
    longest. Texts of any length are read whole, four bytes a token; pairs of long texts that
    repeat themselves with changes take the longest. Empty tables give an empty result, and
    other columns are not read.
    """
    links = written(similar_passages(docs), "passage-links")
    whole, edges = _spans_and_edges(links)
    groups = components(edges, "passages")
    degree = edges.select("a", "b").union(edges.select("b", "a")).distinct().groupBy("a").agg(F.count("*").alias("n_links"))
    named = whole.join(groups, "node").join(degree, whole.node == degree.a)
    # written, so that Spark may split the rows of a large class in the join
    first = written(named.groupBy("component").agg(F.min(F.struct("doc", "first")).alias("f")), "passage-classes")
    return named.join(first, "component").select(
        F.col("doc").alias("doc_id"),
        F.col("first").cast("long").alias("first_word"),
        (F.col("last") - F.col("first") + SHINGLE).cast("long").alias("n_words"),
        F.concat_ws(":", "f.doc", "f.first").alias("class_id"),
        "n_links",
    )
