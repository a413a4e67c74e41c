"""Removal of repeated substrings: every byte that a 100-byte string covers which also starts earlier.

1. Anchors. A hash of every 32-byte string is taken from prefix polynomial hashes; the least ones of each 100-byte
   string's 32-byte strings are its anchors. Equal strings have equal anchors at equal places, so only anchors move
   between tasks, some 3 % of the places. The context of an anchor is all bytes that a 100-byte string around it can
   cover. Inside a batch of texts, of equal contexts only the earliest moves on, once the bytes are found to be equal;
   the others are covered wholly. Anchors whose hash no other place has can't be in a repeated string.
2. All other anchors bring the bytes of their contexts. Of contexts with equal bytes the earliest stays. Different ones
   of one anchor go through a suffix sort: the bytes right and left of the anchors are sorted by a mergesort whose
   comparisons find the common extension by binary search over prefix polynomial hashes, verified on the bytes. Depths of
   common extension give classes: two strings around an anchor are equal if both their left and their right parts are in
   one class. Of each pair of classes the earliest stays.
3. An anchor of very many places (``MAX_PLACES``, or ``CROWD`` different contexts in one batch of texts) would be one
   task's work. Its 100-byte strings go to the tasks of their own hashes instead, the earliest of a batch only, and there
   the earliest of all strings with equal bytes stays. Both ways give the same result.

Hashes only bring candidates together: no byte is removed before bytes were compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.llm.memory import released
from lexaline.llm.storage import materialize

LENGTH = 100
ANCHOR = 32
SIDE = LENGTH - ANCHOR
#: Bytes of text that are hashed together; longer texts are cut with an overlap of two strings.
BATCH_BYTES = 1 << 20
#: Places of one anchor hash up to which one task compares them, and different contexts of one in a batch of texts.
MAX_PLACES = 1 << 12
CROWD = 64
#: Tasks that share the places of a crowded anchor.
SPREAD = 1021
#: Ids with several rows up to which their table is broadcast.
BROADCAST_IDS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a place's ``meta``: offset, bytes left and right of the anchor that its context has.
_AT, _LEFT = 14, 7


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones
    up[1:], down[1:] = _BASE, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_cached: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cached or len(_cached[0]) < n:
        _cached[:] = _powers(max(n, 2 * BATCH_BYTES + 4096))
    return _cached[0], _cached[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power up to each place; differences give the polynomial hash of any part."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def part_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop] for arrays of places."""
    _, down = powers(len(sums))
    return (sums[stop] - sums[start]) * down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, reduce: np.ufunc, fill: int) -> np.ndarray:
    """reduce over values[i : i + width] for every i that has a full window."""
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = reduce.accumulate(blocks, axis=1).ravel()
    back = reduce.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """(place, hash, context hash, left, right) of the anchors of data's texts, which stand at first:last."""
    n = len(data)
    if n < LENGTH:
        return None
    sums = prefix_hashes(data)
    _, down = powers(n + 1)
    grams = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1]) | np.uint64(1)
    least = _sliding(grams, SIDE + 1, np.minimum, 0xFFFFFFFFFFFFFFFF)  # of the string that starts here
    valid = np.zeros(n + 1, np.int32)
    long = last - first >= LENGTH
    np.add.at(valid, first[long], 1)
    np.add.at(valid, last[long] - LENGTH + 1, -1)
    least[np.cumsum(valid[: len(least)]) == 0] = 0
    around = np.concatenate((np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)))
    at = np.flatnonzero(_sliding(around, SIDE + 1, np.maximum, 0) == grams)
    text = np.searchsorted(first, at, side="right") - 1
    left = np.minimum(SIDE, at - first[text])
    right = np.minimum(SIDE, last[text] - at - ANCHOR)
    context = mixed(part_hashes(sums, at - left, at + ANCHOR + right) + (left * 128 + right).astype(np.uint64) * _MIX)
    return at, text, grams[at], context, left, right


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, stop) of a batch's texts, which Arrow holds in UTF-8 already; nothing is copied."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def _pieces(starts: np.ndarray, stops: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Batches of (row, offset, start, stop); a piece of a long text starts two strings before the end of the one before."""
    batch, size = [], 0
    step = BATCH_BYTES - 2 * LENGTH
    for row, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist())):
        for at in range(0, max(1, stop - start - 2 * LENGTH), step):
            piece = (row, at, start + at, min(start + at + BATCH_BYTES, stop))
            if size and size + piece[3] - piece[2] > BATCH_BYTES:
                yield batch
                batch, size = [], 0
            batch.append(piece)
            size += piece[3] - piece[2]
    if batch:
        yield batch


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the parts data[start : start + size], one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], np.concatenate(([0], ends))


def _runs(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of equal keys merged where they touch: (key, start, stop). ``key`` is ascending, ``start`` within it too."""
    if not len(key):
        return key, start, stop
    shift = key.astype(np.int64) << np.int64(33)
    reach = np.maximum.accumulate(stop + shift)
    fresh = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    where = np.flatnonzero(fresh)
    return key[where], start[where], np.maximum.reduceat(stop, where)


def _differs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns; the first one does."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            out[1:] |= c[1:] != c[:-1]
    return out


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal, for arrays of places."""
    same = np.ones(len(a), bool)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        same[at] &= data[a[at] + k] == data[b[at] + k]
    return same


#: ``id``, ``t1`` and ``t2`` name a document. ``stop`` is 0 for an anchor, the end of a covered run, or -1 for the note that
#: an anchor hash is crowded; crowded anchors have a positive ``spread``.
_PLACES = pa.schema([("h", pa.int64()), ("spread", pa.int32()), ("c", pa.int64()), ("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("meta", pa.int64()), ("stop", pa.int32())])
PLACES = "h bigint, spread int, c bigint, id bigint, t1 bigint, t2 bigint, meta bigint, stop int"
PLACE_ORDER = ("h", "spread", "stop", "c", "id", "t1", "t2", "meta")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, t1, t2, text): their anchors, and the runs that are covered inside a batch of texts."""
    for table in batches:
        names = [table.column(k).to_numpy() for k in range(3)]
        raw, starts, stops = _text_bytes(table.column(3))
        for batch in _pieces(starts, stops):
            piece = np.array(batch, np.int64)
            lengths = piece[:, 3] - piece[:, 2]
            last = np.cumsum(lengths)
            first = last - lengths
            data = np.concatenate([raw[p[2] : p[3]] for p in batch])
            got = anchors(data, first, last)
            if got is None or not len(got[0]):
                continue
            at, text, h, c, left, right = got
            row = piece[text, 0]
            doc, t1, t2 = (n[row] for n in names)
            place = piece[text, 1] + at - first[text]
            meta = place << _AT | left << _LEFT | right
            h, c = h.view(np.int64), c.view(np.int64)
            order = np.lexsort((meta, t2, t1, doc, c, h))
            # pieces of a text overlap and rows may be repeated: a place counts once
            order = order[_differs(h[order], doc[order], t1[order], t2[order], meta[order])]
            alike = ~_differs(h[order], c[order], left[order], right[order])
            later = np.flatnonzero(alike)
            a, b = order[later - 1], order[later]
            alike[later] = _equal_bytes(data, at[a] - left[a], at[b] - left[b], left[b] + ANCHOR + right[b])
            keep, gone = order[~alike], order[alike]
            # anchors of very many contexts
            opens = np.flatnonzero(_differs(h[keep]))
            many = np.diff(np.append(opens, len(keep))) >= CROWD
            spread = np.where(np.repeat(many, np.diff(np.append(opens, len(keep)))), 1 + c[keep] % SPREAD, 0).astype(np.int32)
            yield pa.record_batch([h[keep], spread, c[keep], doc[keep], t1[keep], t2[keep], meta[keep], np.zeros(len(keep), np.int32)], schema=_PLACES)
            if many.any():
                note = keep[opens[many]]
                zero = np.zeros(len(note), np.int64)
                yield pa.record_batch([h[note], zero.astype(np.int32), zero, zero, zero, zero, zero, zero.astype(np.int32) - 1], schema=_PLACES)
            if len(gone):
                gone = gone[np.lexsort((meta[gone], row[gone]))]
                key, start, stop = _runs(row[gone], place[gone] - left[gone], place[gone] + ANCHOR + right[gone])
                anywhere = mixed(key.astype(np.uint64) ^ start.astype(np.uint64) << np.uint64(20)).view(np.int64)
                yield pa.record_batch([anywhere, np.zeros(len(key), np.int32), np.zeros(len(key), np.int64), names[0][key], names[1][key], names[2][key], start << _AT, stop.astype(np.int32)], schema=_PLACES)


#: Covered runs (h null), and anchors whose contexts are to be compared (h set; start is the anchor, stop the bytes at
#: its left and right).
_FOUND = pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("h", pa.int64()), ("many", pa.bool_())])
FOUND = "id bigint, t1 bigint, t2 bigint, start int, stop int, h bigint, many boolean"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From places in PLACE_ORDER: the anchors whose hash is not alone. One hash's first MAX_PLACES places are held."""
    held: list[np.ndarray] = []  # the places of the last hash, while it may still be alone or become crowded
    last: tuple | None = None  # its hash and spread
    crowded = False
    before: tuple = ()

    def out(h, doc, t1, t2, meta, many) -> pa.RecordBatch:
        sides = (meta & ((1 << _AT) - 1)).astype(np.int32)
        return pa.record_batch([doc, t1, t2, (meta >> _AT).astype(np.int32), sides, h, many], schema=_FOUND)

    def settled() -> Iterator[pa.RecordBatch]:
        if held and (crowded or len(held[0]) > 1):
            yield out(*held, np.full(len(held[0]), crowded))

    for table in batches:
        h, spread, _, doc, t1, t2, meta, stop = (table.column(k).to_numpy() for k in range(8))
        ready = np.flatnonzero(stop > 0)
        if len(ready):
            yield pa.record_batch([doc[ready], t1[ready], t2[ready], (meta[ready] >> _AT).astype(np.int32), stop[ready], pa.nulls(len(ready), pa.int64()), np.zeros(len(ready), bool)], schema=_FOUND)
        rest = np.flatnonzero(stop <= 0)
        if not len(rest):
            continue
        h, spread, doc, t1, t2, meta, stop = (x[rest] for x in (h, spread, doc, t1, t2, meta, stop))
        twice = ~_differs(h, doc, t1, t2, meta, stop)  # repeated rows of the input
        row = (int(h[0]), int(doc[0]), int(t1[0]), int(t2[0]), int(meta[0]), int(stop[0]))
        twice[0] = row == before
        before = (int(h[-1]), int(doc[-1]), int(t1[-1]), int(t2[-1]), int(meta[-1]), int(stop[-1]))
        starts = np.flatnonzero(_differs(h, spread))
        ends = np.append(starts[1:], len(h))
        if len(starts) > 2:  # the groups that are whole in this batch, all together
            inner = slice(starts[1], starts[-1])
            sizes = np.diff(starts[1:])
            noted = np.add.reduceat(stop[inner] < 0, starts[1:-1] - starts[1]) > 0
            real = (stop[inner] == 0) & ~twice[inner]
            count = np.add.reduceat(real.astype(np.int64), starts[1:-1] - starts[1])
            many = np.repeat(noted | (spread[starts[1:-1]] > 0) | (count > MAX_PLACES), sizes)
            take = np.flatnonzero(real & (many | (np.repeat(count, sizes) > 1)))
            if len(take):
                yield out(*(x[inner][take] for x in (h, doc, t1, t2, meta)), many[take])
        for lo, hi in dict.fromkeys(((starts[0], ends[0]), (starts[-1], ends[-1]))):
            key = (int(h[lo]), int(spread[lo]))
            if key != last:
                yield from settled()
                held, last, crowded = [], key, key[1] > 0
            crowded = crowded or bool((stop[lo:hi] < 0).any())
            real = lo + np.flatnonzero((stop[lo:hi] == 0) & ~twice[lo:hi])
            new = [x[real] for x in (h, doc, t1, t2, meta)]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            crowded = crowded or len(held[0]) > MAX_PLACES
            if crowded:
                yield from settled()
                held = []
    yield from settled()


#: Contexts of anchors, and single strings of crowded anchors (left -1); covered runs have no context.
_CONTEXTS = pa.schema([("h", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int32())])
CONTEXTS = "h bigint, left int, context binary, id bigint, t1 bigint, t2 bigint, at int"
CONTEXT_ORDER = ("h", "left", "context", "id", "t1", "t2", "at")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with their wanted anchors: a row with the context's bytes; of crowded anchors one row for each string
    around them, the earliest of the batch only, and covered runs for the rest."""
    for table in batches:
        names = [table.column(k).to_numpy() for k in range(3)]
        data, starts, _ = _text_bytes(table.column(3))
        wanted = table.column(4)
        row = np.repeat(np.arange(table.num_rows), np.diff(wanted.offsets.to_numpy()))
        flat = wanted.flatten()
        at, sides, h, many = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        left, right = sides >> _LEFT & 127, sides & 127
        some = np.flatnonzero(~many)
        for cut in range(0, len(some), 20_000):
            i = some[cut : cut + 20_000]
            context, offsets = _gathered(data, starts[row[i]] + at[i] - left[i], (left[i] + ANCHOR + right[i]).astype(np.int64))
            blob = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(context)])
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(left[i].astype(np.int32)), blob, *[pa.array(n[row[i]]) for n in names], pa.array(at[i].astype(np.int32))], schema=_CONTEXTS)
        strings: dict[bytes, tuple] = {}
        rows: list[tuple] = []
        for i in np.flatnonzero(many).tolist():
            doc, t1, t2 = (int(n[row[i]]) for n in names)
            base, place_at, before = int(starts[row[i]]), int(at[i]), int(left[i])
            around = data[base + place_at - before : base + place_at + ANCHOR + int(right[i])].tobytes()
            for a in range(max(0, SIDE - int(right[i])), before + 1):
                place, key = (doc, t1, t2, place_at - a), around[before - a : before - a + LENGTH]
                first = strings.setdefault(key, place)
                if place != first:
                    strings[key] = min(first, place)
                    rows.append((mixed_place(place), 0, None, *max(first, place)))
        rows += [(xxhash.xxh64_intdigest(key) - (1 << 63), -1, key, *place) for key, place in strings.items()]
        for cut in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows[cut : cut + 10_000]), _CONTEXTS)], schema=_CONTEXTS)


def mixed_place(place: tuple) -> int:
    """Any task will do for a covered run; this deals them out evenly."""
    return hash(place) >> 1


def common_extension(sums: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Bytes that data[a:] and data[b:] have in common, ``limit`` at most: binary search over prefix hashes, then the
    bytes themselves are compared; where a hash collided, byte by byte from the start."""
    low, high = np.zeros(len(a), np.int64), limit.astype(np.int64).copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = part_hashes(sums, a, a + mid) == part_hashes(sums, b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    wrong = np.zeros(len(a), bool)
    for k in range(int(low.max(initial=0))):
        at = np.flatnonzero(low > k)
        wrong[at] |= data[a[at] + k] != data[b[at] + k]
    for i in np.flatnonzero(wrong):
        k = 0
        while k < limit[i] and data[a[i] + k] == data[b[i] + k]:
            k += 1
        low[i] = k
    return low


def sort_suffixes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[start:stop] within their groups (ascending, contiguous), and the common extension of each
    with the one before it in that order, -1 at the first of a group.

    Bottom-up mergesort: in each round every element finds its rank in the neighbouring run by binary search, whose
    comparisons take the logarithm of the length through the prefix hashes. All elements of all groups advance together.
    """
    n = len(start)
    sums = prefix_hashes(data)
    size = stop - start
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.diff(np.append(first, n))
    base, members = np.repeat(first, count), np.repeat(count, count)
    order = np.arange(n)
    inside = np.arange(n) - base

    def less(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        limit = np.minimum(size[x], size[y])
        common = common_extension(sums, data, start[x], start[y], limit)
        ended = common == limit
        at = np.where(ended, 0, common)
        byte = data[np.minimum(start[x] + at, len(data) - 1)].astype(int) - data[np.minimum(start[y] + at, len(data) - 1)]
        difference = np.where(ended, size[x] - size[y], byte)
        return (difference < 0) | (ties & (difference == 0))

    width = 1
    while width < count.max(initial=0):
        run = inside // width
        other = np.minimum((run ^ 1) * width, members)
        low, high = other.copy(), np.minimum(other + width, members)
        live = np.flatnonzero(low < high)
        own_first = run % 2 == 0
        while len(live):
            mid = (low[live] + high[live]) // 2
            x, y = order[live], order[base[live] + mid]
            # elements of the right run go after equal ones of the left
            before = less(y, x, ~own_first[live])
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
            live = live[low[live] < high[live]]
        place = base + np.minimum(run, run ^ 1) * width + (inside - run * width) + (low - other)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    shared = np.full(n, -1, np.int64)
    later = np.flatnonzero(inside > 0)
    if len(later):
        x, y = order[later - 1], order[later]
        shared[later] = common_extension(sums, data, start[x], start[y], np.minimum(size[x], size[y]))
    return order, shared


def covered_strings(contexts: list[bytes], left: np.ndarray, group: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, offset before the anchor) of the strings around anchors that an earlier context of the group has too.

    ``group`` is ascending; ``rank`` orders the places, least first, and is the same for the same place.
    """
    lengths = np.array([len(c) for c in contexts])
    right = lengths - left - ANCHOR
    ends = np.cumsum(lengths)
    begin = ends - lengths
    data = np.frombuffer(b"".join(contexts), np.uint8)
    back = data[::-1].copy()
    # right parts start at the anchor; left parts are read backwards from it
    order_r, shared_r = sort_suffixes(data, begin + left, ends, group)
    order_l, shared_l = sort_suffixes(back, len(data) - begin - left, len(data) - begin, group)
    for a in range(SIDE + 1):
        fits = np.flatnonzero((left >= a) & (right >= SIDE - a))
        if len(fits) < 2:
            continue
        class_l, class_r = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
        class_l[order_l] = np.cumsum(shared_l < a)
        class_r[order_r] = np.cumsum(shared_r < LENGTH - a)
        by = fits[np.lexsort((rank[fits], class_r[fits], class_l[fits], group[fits]))]
        same = (group[by][1:] == group[by][:-1]) & (class_l[by][1:] == class_l[by][:-1]) & (class_r[by][1:] == class_r[by][:-1])
        opens = np.concatenate(([True], ~same))
        earliest = rank[by][np.flatnonzero(opens)][np.cumsum(opens) - 1]
        gone = by[rank[by] > earliest]
        if len(gone):
            yield gone, np.full(len(gone), a)


_COVERED = pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
#: Contexts that are sorted together.
SORTED_TOGETHER = 1 << 15


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs, from contexts and single strings in CONTEXT_ORDER."""
    held: list[pa.RecordBatch] = []  # different contexts of anchors
    size = 0
    before: tuple = ()

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, left, doc, t1, t2, at = (table.column(k).to_numpy() for k in (0, 1, 3, 4, 5, 6))
        opens = _differs(h)
        sizes = np.diff(np.append(np.flatnonzero(opens), len(h)))
        several = np.repeat(sizes > 1, sizes)  # an anchor whose contexts were all equal needs no sort
        if not several.any():
            return
        h, left, doc, t1, t2, at = (x[several] for x in (h, left, doc, t1, t2, at))
        order = np.lexsort((at, t2, t1, doc))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.cumsum(_differs(doc[order], t1[order], t2[order], at[order]))
        group = np.cumsum(_differs(h))
        found = list(covered_strings(table.column(2).filter(pa.array(several)).to_pylist(), left.astype(np.int64), group, rank))
        if found:
            index = np.concatenate([f[0] for f in found])
            start = at[index].astype(np.int64) - np.concatenate([f[1] for f in found])
            by = np.lexsort((start, index))
            key, start, stop = _runs(index[by], start[by], start[by] + LENGTH)
            yield pa.record_batch([doc[key], t1[key], t2[key], start.astype(np.int32), stop.astype(np.int32)], schema=_COVERED)

    for batch in batches:
        none = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        if none.any():
            over = batch.filter(pa.array(none))
            start = over.column(6).to_numpy()
            yield pa.record_batch([over.column(3), over.column(4), over.column(5), start, start + np.int32(LENGTH)], schema=_COVERED)
            batch = batch.filter(pa.array(~none))
        if not batch.num_rows:
            continue
        h, left, doc, t1, t2, at = (batch.column(k).to_numpy() for k in (0, 1, 3, 4, 5, 6))
        context = batch.column(2).to_pylist()
        bytes_differ = np.array([True, *(x != y for x, y in zip(context[1:], context))])
        fresh = _differs(h, left) | bytes_differ
        fresh[0] = before[:3] != (h[0], left[0], context[0])
        twice = ~(fresh | _differs(doc, t1, t2, at))  # repeated rows of the input
        twice[0] = before == (h[0], left[0], context[0], doc[0], t1[0], t2[0], at[0])
        before = (h[-1], left[-1], context[-1], doc[-1], t1[-1], t2[-1], at[-1])
        gone = np.flatnonzero(~fresh & ~twice)
        if len(gone):
            start = np.where(left[gone] < 0, at[gone], at[gone] - left[gone]).astype(np.int32)
            stop = start + np.array([len(context[i]) for i in gone.tolist()], np.int32)
            yield pa.record_batch([doc[gone], t1[gone], t2[gone], start, stop], schema=_COVERED)
        whole = batch.filter(pa.array(fresh & (left >= 0)))
        if whole.num_rows:
            held.append(whole)
            size += whole.num_rows
            if size >= SORTED_TOGETHER:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column(0).to_numpy()
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
                if cut:
                    yield from solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
    if held:
        yield from solve(pa.Table.from_batches(held).combine_chunks())


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, n_bytes, digest, text, runs); those without runs have their digest, the others a text."""
    for table in batches:
        data, starts, stops = _text_bytes(table.column(3))
        n, digests, listed = table.num_rows, table.column(2).to_pylist(), table.column(4)
        flat = listed.flatten()
        row = np.repeat(np.arange(n), np.diff(listed.offsets.to_numpy()))
        left, right = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
        order = np.lexsort((left, row))
        row, left, right = _runs(row[order], left[order], right[order])
        bounds = np.searchsorted(row, np.arange(n + 1))
        removed, spans_of = np.bincount(row, right - left, n).astype(np.int64), np.diff(bounds)
        for i in np.flatnonzero(spans_of).tolist():
            raw, digest, at = memoryview(data[starts[i] : stops[i]]), hashlib.sha256(), 0
            for start, stop in zip(left[bounds[i] : bounds[i + 1]].tolist(), right[bounds[i] : bounds[i + 1]].tolist()):
                digest.update(raw[at:start])
                at = stop
            digest.update(raw[at:])
            digests[i] = digest.hexdigest()
        yield pa.RecordBatch.from_arrays([table.column(0), table.column(1), pa.array(removed, pa.int64()), pa.array(spans_of, pa.int64()), pa.array(digests, pa.string())], schema=_RESULT)


def _tie(text: Column) -> tuple[Column, Column]:
    """The two halves of the text's MD5 as longs."""
    digest = F.md5(text.cast("binary"))
    half = lambda k: (F.conv(F.substring(digest, k, 16), 16, 10).cast("decimal(20,0)") - F.expr(f"{1 << 63}").cast("decimal(20,0)")).cast("long")
    return half(1), half(17)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, t1, t2, text): ids with one row have ties of 0, all others a 128-bit digest of their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    several = materialize(rows.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("key"), F.lit(True).alias("several")), "substrings-ids")
    n = several.limit(BROADCAST_IDS + 1).count()
    if n:
        # null ids are dealt out by their texts, and tied in any case
        keyed = rows.withColumn("key", F.coalesce("id", F.xxhash64("text")))
        rows = keyed.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "key", "left")
    tied = F.col("id").isNull() | (F.coalesce(F.col("several"), F.lit(False)) if n else F.lit(False))
    t1, t2 = (F.when(tied, t).otherwise(F.lit(0).cast("long")) for t in _tie(F.col("text")))
    return rows.select(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), t1.alias("t1"), t2.alias("t2"), "text")


def covered_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, runs): rows (id, t1, t2, text) of ``docs``, and rows (id, t1, t2, start, stop) of bytes to remove, which
    overlap. ``t1`` and ``t2`` tell the texts of one id apart and order them."""
    names = ["id", "t1", "t2"]
    texts = named(docs, id_col, text_col)
    places = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(released(_places), PLACES)
    sorted_places = places.repartition("h", "spread").sortWithinPartitions(*PLACE_ORDER)
    found = materialize(sorted_places.mapInArrow(released(_repeated), FOUND), "substrings-found")
    wanted = found.where("h is not null").groupBy(*names).agg(F.collect_list(F.struct("start", "stop", "h", "many")).alias("wanted"))
    contexts = texts.join(wanted, names).select(*names, "text", "wanted").mapInArrow(released(_contexts), CONTEXTS)
    spread = contexts.repartition("h").sortWithinPartitions(*CONTEXT_ORDER)
    compared = materialize(spread.mapInArrow(released(_compare), "id bigint, t1 bigint, t2 bigint, start int, stop int"), "substrings-compared")
    return texts, found.where("h is null").select(*names, "start", "stop").unionByName(compared)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of ``docs``.

    Texts of one id count as different documents, in the order of a 128-bit digest of their text; repeated rows (equal
    id and text) count as one document and have equal results. Null texts count as empty, null ids come last and are told
    apart by their texts; other columns are ignored. An empty table gives an empty result.
    """
    names = ["id", "t1", "t2"]
    texts, runs = covered_runs(docs, id_col, text_col)
    by_text = runs.groupBy(*names).agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    kept_whole = F.col("runs").isNull()
    joined = texts.join(by_text, names, "left").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(kept_whole, F.sha2("text", 256)).alias("digest"), F.when(~kept_whole, F.col("text")).alias("text"), "runs")
    result = joined.mapInArrow(released(_summaries), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return result.select(F.nullif(F.col("id"), F.lit((1 << 63) - 1)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
