"""Removal of byte strings that repeat across documents.

A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller id.  The
work goes through a sample of positions that covers every such string, as in difference-cover suffix
sorting, but chosen by content: in every window of LENGTH bytes the sample holds the position of the
smallest gram of GRAM bytes, so equal windows hold equal grams at equal offsets and only sampled
positions ever meet in a shuffle.

1. Sampled grams are named (hashed), sorted by name, and names found in two documents or more go back.
2. For those names the positions' contexts are sorted by the windows they stand for; equal neighbours are
   one string (found by hash, compared by bytes), and all but the smallest id's windows are covered.  Every task first does this among its
   own contexts and passes on only windows that it could not cover, so that crowded names shrink before
   the shuffle; then the rest meets by name.  Names that CROWDED documents share meet by more bytes than the gram's: for every
   STEP offsets a context goes to the place of the bytes that all windows with these offsets hold.
3. Covered windows go back to their documents.

Rows between the steps are packed arrays: a task writes one for each name bucket and chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_sized, remove, shared_dir, shuffle_width, staged, text_slices

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # bytes that a window may hold before its gram
SPAN = LENGTH + REACH  # bytes that the windows over one gram can touch
#: Starts that are worked on at once (positions take 24 bits), sampled grams that a task holds before it
#: writes them, contexts that are resolved together on the way, open ones that a task holds.
BLOCK, GRAMS, CONTEXTS, OPEN = 1 << 21, 500_000, 30_000, 200_000
#: Bytes of texts that are taken apart at once, so that many short ones share the calls and the arrays stay in the cache.
TEXTS = 1 << 17
LEAST_BUCKETS = 64
#: Documents from which on a name is crowded, and offsets that a crowded name's contexts meet for together: windows with STEP
#: neighbouring offsets have all but STEP - 1 of their bytes in common.
CROWDED, STEP = 20_000, 8
_FLAG, _NAME = np.uint64(1 << 63), np.uint64((1 << 40) - 1)

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base))])


_POWER = [_powers(b, LENGTH) for b in _BASES]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings or binaries of an array, one after the other, and where each begins (and the last ends)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, "<i8" if wide else "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _words(raw: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes at every place as one number."""
    return np.lib.stride_tricks.as_strided(raw[:width].view(f"<u{width}"), (len(raw) - width + 1,), (1,)).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _BASES[1]
    return h


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all grams, whose upper 40 bits are their names."""
    raw = np.ascontiguousarray(raw)
    eight, n = _words(raw, 8), len(raw) - GRAM + 1
    h = eight[:n] * _POWER[0][1]
    h += eight[8 : 8 + n] * _POWER[0][2]
    h += _words(raw[GRAM - 4 :], 4) * _POWER[0][3]
    return _mixed(h)


def sampled(raw: np.ndarray, starts: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, position, first, last) of sampled grams: windows that start at first..last are the position's.

    Further texts begin at `starts`; no window lies in two texts.
    """
    out, low = [], np.uint64(0xFFFFFF)
    for at in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        block = raw[at : at + BLOCK + LENGTH - 1]
        key = _gram_hashes(block)
        key &= ~low
        key |= np.arange(len(key), dtype=np.uint64)  # leftmost of equal grams
        width, least = 1, key
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := REACH + 1 - width:
            least = np.minimum(least[:-rest], least[rest:])
        inside = np.ones(len(least), bool)
        for start in starts:
            if start > at:
                inside[max(0, start - LENGTH + 1 - at) : start - at] = False
        begin = np.flatnonzero(inside)
        if not len(begin):
            continue
        least = least[begin]
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        mine = least[first]
        out.append((mine >> np.uint64(24), (mine & low).astype(np.int64) + at, begin[first] + at, begin[last] + at))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))


def _sampled_texts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(row, rows, bytes, where texts begin, text of each sample, `sampled`) for every few rows."""
    for at, n in text_slices(texts, TEXTS):
        raw, starts = _bytes(texts.slice(at, n))
        found = sampled(raw, starts[1:-1])
        yield at, n, raw, starts, np.searchsorted(starts, found[1], "right") - 1, found


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(payload: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize * m for k, m in kinds), 0, []
    for k, m in kinds:
        size = np.dtype(k).itemsize * m * n
        a = np.frombuffer(raw, k, n * m, at)
        out.append(a.reshape(n, m) if m > 1 else a)
        at += size
    return out


def _by_bucket(names: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (names % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # 16 bits sort by radix
    order = np.argsort(bucket, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


# --- step 1: names that two documents share ---------------------------------------------------------

_NAMES = (("<u4", 1), ("<u1", 1), ("<i8", 1))


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols)


def _binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary value for every run of `data`, each from its start to the next one's, the last to the end."""
    ends = (np.append(starts, len(data)) * data.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _of_text(text: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Text and name in one number."""
    return text.astype(np.uint64) << np.uint64(40) | name


def _write_names(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            g, d = np.concatenate(names), np.concatenate(ids)
            for b, rows in _by_bucket(g, buckets):
                low, high = (g[rows] & np.uint64(0xFFFFFFFF)).astype("<u4"), (g[rows] >> np.uint64(32)).astype("<u1")
                yield _batch(bucket=pa.array([b], pa.int32()), payload=pa.array([_pack(low, high, np.diff(d[rows], prepend=0))], pa.binary()))

        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, _, _, text, (name, *_) in _sampled_texts(batch.column(1)):
                own = np.sort(_of_text(text, name))
                own = own[np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]])]
                names.append(own & _NAME)
                ids.append(docs[at + (own >> np.uint64(40)).astype(np.int64)])
                held += len(own)
                if held >= GRAMS:
                    yield from flush()
                    names, ids, held = [], [], 0
        if held:
            yield from flush()

    return run


def _shared_names(crowded: int):
    """A row for each document of the partition with the names that it shares with another one; crowded ones are flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(p.as_py(), *_NAMES) for batch in batches for p in batch.column(1)]
        if not parts:
            return
        low, high, step = (list(x) for x in zip(*parts))
        g = np.concatenate(high).astype(np.uint64) << np.uint64(32) | np.concatenate(low)
        d = np.concatenate([np.cumsum(s) for s in step])
        order = np.argsort(g)
        g, d = g[order], d[order]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        shared = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        count = np.diff(np.concatenate([start, [len(g)]]))
        g = g | np.repeat(np.where(count >= crowded, _FLAG, np.uint64(0)), count)
        rows = np.repeat(shared, count)
        g, d = g[rows], d[rows]
        order = np.argsort(d, kind="stable")
        g, d = g[order], d[order]
        at = np.flatnonzero(np.concatenate([d[:1] == d[:1], d[1:] != d[:-1]]))
        for k in range(0, len(at), 4096):
            some, end = at[k : k + 4096], at[k + 4096] if k + 4096 < len(at) else len(g)
            yield _batch(doc=pa.array(d[some], pa.int64()), names=_binaries(g[some[0] : end].astype("<u8"), some - some[0]))

    return run


# --- step 2: windows that a smaller id holds --------------------------------------------------------

_CONTEXT = (("<i8", 1), ("<i8", 1), ("<i4", 1), ("<u4", 1), ("<u1", SPAN))


def _window_hashes(ctx: np.ndarray, row: np.ndarray, start: np.ndarray, base: int) -> np.ndarray:
    power = _POWER[base]
    prefix, columns = np.zeros((SPAN + 1, len(ctx)), np.uint64), np.ascontiguousarray(ctx.T)
    for j in range(SPAN):
        np.multiply(prefix[j], power[1], out=prefix[j + 1])
        prefix[j + 1] += columns[j]
    return prefix[start + LENGTH, row] - prefix[start, row] * power[LENGTH]


def _differ(ctx: np.ndarray, which: np.ndarray, off: np.ndarray, order: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether neighbours in `order` that are said to be equal differ in a byte."""
    pairs, out = np.flatnonzero(equal), []
    windows = np.lib.stride_tricks.sliding_window_view(ctx, LENGTH, axis=1)
    for k in range(0, len(pairs), 65536):
        i, j = order[pairs[k : k + 65536]], order[pairs[k : k + 65536] + 1]
        one, two = windows[which[i], REACH - off[i]], windows[which[j], REACH - off[j]]
        out.append((one.view(f"V{LENGTH}") != two.view(f"V{LENGTH}")).ravel())
    return np.concatenate(out) if out else np.zeros(0, bool)


def _gram_keys(ctx: np.ndarray) -> np.ndarray:
    """Hashes of the contexts' grams, from their bytes."""
    words = np.ascontiguousarray(ctx[:, REACH : REACH + GRAM]).view("<u4")
    h = np.zeros(len(ctx), np.uint64)
    for j in range(words.shape[1]):
        h = h * _BASES[0] + words[:, j] + np.uint64(1)
    return _mixed(h) >> np.uint64(24)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether another row has the row's key."""
    order = np.argsort(keys)
    same, out = keys[order[1:]] == keys[order[:-1]], np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def resolve(doc: np.ndarray, open_: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of covered windows for each context, and bits that stay open (the smallest id's own).

    Bit o stands for the window that starts o bytes before the gram; open_ has those of the position that
    are not yet covered.  Contexts whose gram no other one has are not looked at, and of contexts that agree in all bytes and
    bits only the smallest id's.
    """
    bits, gram = np.zeros(len(doc), np.uint32), _gram_keys(ctx)
    rows = np.flatnonzero(_repeated(gram))
    if len(rows):
        own, whole = ctx[rows], open_[rows].astype(np.uint64)
        words = own.view("<u8")
        for j in range(words.shape[1]):
            whole = whole * _BASES[0] + words[:, j]
        order = np.argsort(_mixed(whole))
        rows, own = rows[order], own[order].view(f"V{SPAN}").ravel()
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (open_[rows[1:]] != open_[rows[:-1]])])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        one, least = rows[start], np.minimum.reduceat(doc[rows], start)
        some, found = _repeated(gram[one]), np.zeros(len(one), np.uint32)
        found[some] = _covered(least[some], open_[one[some]], ctx[one[some]])
        bits[rows] = np.where(doc[rows] > least[group], open_[rows], found[group])
    return bits, open_ & ~bits


def _covered(doc: np.ndarray, open_: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Bits of windows that a smaller id's context also holds, all windows compared."""
    o = np.arange(REACH + 1)
    which, off = np.nonzero((open_[:, None] >> o.astype(np.uint32)) & np.uint32(1))
    h = np.zeros(len(which), np.uint64)
    for k in range(0, len(ctx), 4096):
        i, j = np.searchsorted(which, [k, k + 4096])
        h[i:j] = _window_hashes(ctx[k : k + 4096], which[i:j] - k, REACH - off[i:j], 0)
    order = np.argsort(h)
    new = h[order[1:]] != h[order[:-1]]
    if _differ(ctx, which, off, order, ~new).any():  # hashes that agree by chance: sorted by their bytes instead
        whole = ctx[which[:, None], REACH - off[:, None] + np.arange(LENGTH)].view(f"V{LENGTH}").ravel()
        order = np.argsort(whole, kind="stable")
        new = whole[order][1:] != whole[order][:-1]
    d = doc[which[order]]
    covered = np.zeros(len(which), bool)
    if len(which):
        start = np.flatnonzero(np.concatenate([[True], new]))
        least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.concatenate([start, [len(d)]])))
        covered[order] = d > least
    return np.bincount(which[covered], 2.0 ** off[covered], minlength=len(doc)).astype(np.uint32)


def _covers(doc, row, at, bits) -> Iterator[pa.RecordBatch]:
    """Covered windows, a row for each document row of the chunk."""
    rows = np.flatnonzero(bits)
    if not len(rows):
        return
    order = rows[np.lexsort((row[rows], doc[rows]))]
    d, r = doc[order], row[order]
    edges = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])]))
    first, second = _halves(edges, len(order))
    pairs = np.empty(2 * len(order), "<u4")
    pairs[first], pairs[second] = at[order].astype("<i4").view("<u4"), bits[order]
    for k in range(0, len(edges), 4096):
        some, end = edges[k : k + 4096], edges[k + 4096] if k + 4096 < len(edges) else len(order)
        yield _batch(
            kind=pa.array(np.zeros(len(some), np.int32)), doc=pa.array(d[some], pa.int64()), row=pa.array(r[some], pa.int64()),
            payload=_binaries(pairs[2 * some[0] : 2 * end], 2 * (some - some[0])),
        )


def _halves(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the positions and the bits of n pairs lie, whose runs from `starts` on hold all positions before all bits."""
    size = np.diff(np.append(starts, n))
    first = np.arange(n) + np.repeat(starts, size)
    return first, first + np.repeat(size, size)


def _segments(ctx: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bits, key) for every STEP offsets: the contexts with open windows there, those windows, and a hash of what all of them hold."""
    for low in range(0, REACH + 1, STEP):
        high = min(low + STEP - 1, REACH)
        bits = open_ & np.uint32((2 << high) - (1 << low))
        rows = np.flatnonzero(bits)
        h = np.full(len(rows), low, np.uint64)
        for j in range(REACH - low, REACH + LENGTH - high):
            h = h * _BASES[0] + ctx[rows, j] + np.uint64(1)
        yield rows, bits[rows], (h ^ h >> np.uint64(29)) * _BASES[1] >> np.uint64(24)


#: Bytes of a context that windows from `low` to `high` bytes before the gram hold: 1, others 0.
_HELD = np.array([[(np.arange(SPAN) >= REACH - high) & (np.arange(SPAN) < REACH - low + LENGTH) for high in range(REACH + 1)] for low in range(REACH + 1)], np.uint8)


def _contexts(buckets: int):
    """Documents with their shared names -> covers (kind 0) and packed open contexts (kind 1, doc: the bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, open_held, open_count = [], 0, [], 0

        def write() -> Iterator[pa.RecordBatch]:
            name, full, *cols = (np.concatenate(x) for x in zip(*open_held))
            plain, crowd = np.flatnonzero(~full), np.flatnonzero(full)
            yield from send(name[plain], *(c[plain] for c in cols))
            doc, row, at, open_, ctx = (c[crowd] for c in cols)
            for rows, bits, key in _segments(ctx, open_):
                yield from send(key, doc[rows], row[rows], at[rows], bits.astype("<u4"), ctx[rows])

        def send(key: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
            for b, rows in _by_bucket(key, buckets):
                load = _pack(*(c[rows] for c in cols))
                yield _batch(kind=pa.array([1], pa.int32()), doc=pa.array([b], pa.int64()), row=pa.array([0], pa.int64()), payload=pa.array([load], pa.binary()))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal open_held, open_count
            name, full, doc, row, at, open_, ctx = (np.concatenate(x) for x in zip(*held))
            bits, rest = resolve(doc, open_, ctx)
            yield from _covers(doc, row, at, bits)
            left = np.flatnonzero(rest)
            open_held.append((name[left], full[left], doc[left], row[left], at[left].astype("<i4"), rest[left].astype("<u4"), ctx[left]))
            open_count += len(left)
            if open_count >= OPEN:
                yield from write()
                open_held, open_count = [], 0

        for batch in batches:
            docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for row, n, raw, starts, text, (name, at, first, last) in _sampled_texts(batch.column(2)):
                lists = batch.column(3).slice(row, n)
                known, ends = _bytes(lists.flatten())
                known = np.frombuffer(known, "<u8")
                held_by = np.repeat(np.arange(n), np.diff(ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]) // 8)
                of_text = _of_text(held_by, known & ~_FLAG)
                order = np.argsort(of_text)
                of_text, own = of_text[order], _of_text(text, name)
                there = np.searchsorted(of_text, own)
                there[there == len(of_text)] = 0
                rows = np.flatnonzero(of_text[there] == own) if len(of_text) else np.zeros(0, np.int64)
                full = (known >= _FLAG)[order][there[rows]]
                name, at, first, last, text = name[rows], at[rows], first[rows], last[rows], row + text[rows]
                windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(REACH, np.uint8), raw, np.zeros(SPAN, np.uint8)]), SPAN)
                for k in range(0, len(name), CONTEXTS):
                    g, f, p, a, e, t = (x[k : k + CONTEXTS] for x in (name, full, at, first, last, text))
                    low, high = p - e, p - a
                    ctx = windows[p] * _HELD[low, high]
                    open_ = ((np.uint64(2) << high.astype(np.uint64)) - (np.uint64(1) << low.astype(np.uint64))).astype(np.uint32)
                    held.append((g, f, docs[t], keys[t], p - starts[t - row], open_, ctx))
                    count += len(g)
                    if count >= CONTEXTS:
                        yield from flush()
                        held, count = [], 0
        if count:
            yield from flush()
        if open_count:
            yield from write()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes covers on and resolves the open contexts of the partition, a few whole names, or parts of a crowded one, at a time."""
    parts = []
    for batch in batches:
        open_ = pa.compute.equal(batch.column(0), 1)
        parts += [_unpack(p.as_py(), *_CONTEXT) for p in batch.filter(open_).column(3)]
        yield batch.filter(pa.compute.invert(open_))
    if not parts:
        return
    cols = [np.concatenate([p[k] for p in parts]) for k in range(len(_CONTEXT))]
    del parts
    doc, row, pos, open_, ctx = cols
    for rows in _runs(_gram_keys(ctx)):
        if len(rows) <= CONTEXTS:
            yield from _covers(doc[rows], row[rows], pos[rows], resolve(doc[rows], open_[rows], ctx[rows])[0])
            continue
        for some, bits, key in _segments(ctx[rows], open_[rows]):
            for part in _runs(key):
                own = rows[some[part]]
                yield from _covers(doc[own], row[own], pos[own], resolve(doc[own], bits[part], ctx[own])[0])


def _runs(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in runs of whole keys, CONTEXTS or fewer unless one key alone has more."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else order
    ends = np.append(starts[1:], len(order)) if len(order) else order
    k = 0
    while k < len(starts):
        last = max(k, int(np.searchsorted(ends, starts[k] + CONTEXTS, "right")) - 1)
        yield order[starts[k] : ends[last]]
        k = last + 1


# --- step 3: what is left of each document ----------------------------------------------------------


def removed_bytes(starts: np.ndarray, text: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of texts that begin at `starts` covered windows remove.  A context's windows all hold its gram, so they leave no gap."""
    end = int(starts[-1])
    first = starts[text] + at - (np.frexp(bits.astype(np.float64))[1] - 1)
    last = starts[text] + at - (np.frexp((bits & (~bits + np.uint32(1))).astype(np.float64))[1] - 1) + LENGTH
    return np.cumsum(np.bincount(first, minlength=end + 1) - np.bincount(last, minlength=end + 1))[:end] > 0


def _cover_pairs(covers: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, bits) of all covered windows; covers of other rows with the same id are left out."""
    size, each = covers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), covers.flatten()
    row = np.repeat(np.arange(len(covers)), size)
    loads, ends = _bytes(each.field("payload"))
    loads, starts = np.frombuffer(loads, "<u4"), ends // 8
    first, second = _halves(starts[:-1], int(starts[-1]))
    mine = np.repeat(each.field("row").to_numpy(zero_copy_only=False) == keys[row], np.diff(starts))
    return np.repeat(row, np.diff(starts))[mine], loads[first[mine]].view("<i4").astype(np.int64), loads[second[mine]]


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, keys = [], batch.column(1).to_numpy(zero_copy_only=False)
        for row, n in text_slices(batch.column(2), TEXTS):
            raw, starts = _bytes(batch.column(2).slice(row, n))
            gone = removed_bytes(starts, *_cover_pairs(batch.column(3).slice(row, n), keys[row : row + n]))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begin = starts[:-1][starts[:-1] < len(raw)]
            opens[begin] = gone[begin]
            before, spans = (np.concatenate([[0], np.cumsum(x)])[starts] for x in (gone, opens))
            kept, at = raw[~gone], starts - before
            out.append((np.diff(starts), np.diff(before), np.diff(spans), [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(at, at[1:])]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (long), n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs`.

    Null texts are empty; documents shorter than LENGTH lose nothing.  Rows with null ids neither lose
    bytes nor take any; rows that repeat an id do not take from each other; ids must be integers, or strings of
    digits; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    width = max(LEAST_BUCKETS, shuffle_width(spark))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = arrow_sized(docs).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text"))
    # the texts once more, bucketed by id: two joins by id then move no text
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tallyfold/{name}"
    try:
        rows.write.option("compression", "zstd").option("path", path).bucketBy(width, "doc").format("parquet").saveAsTable(name)
        return _dedup(rows, spark.table(name), width)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, [path])


def _dedup(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    buckets = 4 * width
    long = F.octet_length("text") >= LENGTH
    names = rows.where(long & F.col("doc").isNotNull()).select("doc", "text").mapInArrow(_write_names(buckets), "bucket int, payload binary")
    shared = names.repartition(buckets, "bucket").mapInArrow(_shared_names(CROWDED), "doc long, names binary")
    hits = shared.groupBy("doc").agg(F.collect_list("names").alias("names"))
    with_names = texts.join(hits.hint("shuffle_hash"), "doc").where(long).select("doc", "row", "text", "names")
    met = with_names.mapInArrow(_contexts(buckets), "kind int, doc long, row long, payload binary")
    # covers travel along by id, open contexts by the bucket of their name
    covered = met.repartition(buckets, "doc").mapInArrow(_meet, met.schema).select("doc", "row", "payload")
    covers = covered.groupBy("doc").agg(F.collect_list(F.struct("row", "payload")).alias("covers"))
    left = texts.join(covers.hint("shuffle_hash"), "doc", "left").select("doc", "row", "text", "covers")
    return staged(left.mapInArrow(_left, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "substrings-left")
