"""Removal of repeated byte strings: many texts share a call, copies are compared once, and both give what plain loops give."""

import numpy as np
import pyarrow as pa
import pytest

from tallyfold.llm import substrings as S


def made_contexts(seed, n, grams=3):
    """Contexts of a few grams with a few sides, so that many agree in part and some as a whole."""
    rng = np.random.default_rng(seed)
    ctx = np.empty((n, S.SPAN), np.uint8)
    left, right, gram = (rng.integers(97, 123, (k, w)) for k, w in ((4, S.REACH), (4, S.REACH), (grams, S.GRAM)))
    ctx[:, : S.REACH], ctx[:, S.REACH : S.REACH + S.GRAM], ctx[:, S.REACH + S.GRAM :] = (side[rng.integers(0, len(side), n)] for side in (left, gram, right))
    near, far = rng.integers(0, 20, n), rng.integers(0, 20, n)
    ctx[np.arange(S.SPAN) < near[:, None]] = 46
    ctx[np.arange(S.SPAN) >= S.SPAN - far[:, None]] = 46
    low, high = rng.integers(0, 4, n) * 3, 20 + rng.integers(0, 4, n) * 3
    open_ = np.array([(2 << int(h)) - (1 << int(lo)) for lo, h in zip(low, high)], np.uint32)
    return rng.integers(0, n // 2, n), open_, ctx


def plain_bits(doc, open_, ctx):
    windows = [{o: bytes(c[S.REACH - o : S.REACH - o + S.LENGTH]) for o in range(S.REACH + 1) if b >> o & 1} for b, c in zip(open_.tolist(), ctx)]
    least = {}
    for d, own in zip(doc, windows):
        for w in own.values():
            least[w] = min(d, least.get(w, d))
    return np.array([sum(1 << o for o, w in own.items() if least[w] < d) for d, own in zip(doc, windows)], np.uint32)


@pytest.mark.parametrize("seed", range(4))
def test_resolve_against_loops(seed, monkeypatch):
    doc, open_, ctx = made_contexts(seed, 400)
    want = plain_bits(doc, open_, ctx)
    bits, rest = S.resolve(doc, open_, ctx)
    assert (bits == want).all() and (rest == open_ & ~want).all() and want.any() and (want != open_).any()
    monkeypatch.setattr(S, "_window_hashes", lambda ctx, row, start, base: np.zeros(len(row), np.uint64))  # bytes decide
    assert (S.resolve(doc, open_, ctx)[0] == want).all()
    monkeypatch.setattr(S, "_mixed", lambda h: np.zeros(len(h), np.uint64))  # all grams and contexts meet
    assert (S.resolve(doc, open_, ctx)[0] == want).all()


def test_copies_and_lone_grams_are_not_compared_by_windows(monkeypatch):
    rng, rows, hashes = np.random.default_rng(1), [], S._window_hashes
    monkeypatch.setattr(S, "_window_hashes", lambda ctx, *a: rows.append(len(ctx)) or hashes(ctx, *a))
    ctx = rng.integers(97, 123, (500, S.SPAN)).astype(np.uint8)
    ctx[:400] = ctx[0]  # 400 copies, 100 of other grams
    ctx[398:400, 0] = 46  # two of them differ in a byte that some windows hold
    doc, open_ = rng.permutation(500), np.full(500, (1 << 31) - 1, np.uint32)
    bits, _ = S.resolve(doc, open_, ctx)
    assert (bits == plain_bits(doc, open_, ctx)).all() and sum(rows) <= 2


def made_texts(seed, n):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([0, 1, 49, 50, 51, 80, 200, 3000], n)
    return ["".join(rng.choice(list("abé"), k)) if i % 3 else "z" * int(k) for i, k in enumerate(sizes)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_samples_of_many_texts_are_those_of_each(kind, monkeypatch):
    texts = made_texts(2, 120)
    want = [(i, *row) for i, t in enumerate(texts) for row in zip(*(x.tolist() for x in S.sampled(np.frombuffer(t.encode(), np.uint8))))]
    for size in (1, 5000, 1 << 17):
        monkeypatch.setattr(S, "TEXTS", size)
        got = []
        for at, n, raw, starts, text, (name, *places) in S._sampled_texts(pa.array(["no", *texts, "no"], kind).slice(1, len(texts))):
            assert [raw[i:j].tobytes().decode() for i, j in zip(starts, starts[1:])] == texts[at : at + n]
            got += zip((at + text).tolist(), name.tolist(), *((x - starts[text]).tolist() for x in places))
        assert got == want and len({i for i, *_ in want}) > 50


def test_samples_cover_every_window_once_across_blocks(monkeypatch):
    texts = [t.encode() for t in made_texts(3, 60)]
    raw, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    windows = [s for s, t in zip(starts.tolist(), texts) for s in range(s, s + len(t) - S.LENGTH + 1)]
    whole = {}
    for block in (1 << 21, 70, 1000):
        monkeypatch.setattr(S, "BLOCK", block)
        name, at, first, last = S.sampled(raw, starts[1:-1])
        owned = {w: (n, p) for n, p, a, e in zip(name.tolist(), at.tolist(), first.tolist(), last.tolist()) for w in range(a, e + 1)}
        assert sorted(owned) == windows and len(owned) == int((last - first + 1).sum())
        assert all(w <= p <= w + S.REACH for w, (_, p) in owned.items())
        whole = whole or owned
        assert owned == whole


def test_short_texts_share_the_calls(monkeypatch):
    calls, hashes = [], S._gram_hashes
    monkeypatch.setattr(S, "_gram_hashes", lambda raw: calls.append(len(raw)) or hashes(raw))
    texts = [f"{i:03d} " * 20 for i in range(300)]
    docs = pa.RecordBatch.from_pydict({"doc": pa.array(range(300), pa.int64()), "text": texts})
    list(S._write_names(4)(iter([docs])))
    assert len(calls) == 1
    names = pa.array([[S.sampled(np.frombuffer(t.encode(), np.uint8))[0].astype("<u8").tobytes()] for t in texts], pa.list_(pa.binary()))
    calls.clear()
    list(S._contexts(4)(iter([pa.RecordBatch.from_arrays([docs[0], docs[0], docs[1], names], names=["doc", "row", "text", "names"])])))
    assert len(calls) == 1


def test_removed_bytes_and_rows_that_repeat_an_id():
    rng = np.random.default_rng(4)
    texts = ["x" * 300, "", "y" * 120, "y" * 120, "", "z" * 60]
    docs, keys = [1, 2, 3, 3, None, 5], [10, 20, 30, 31, 40, 50]
    covers, want = [], []
    for doc, key, text in zip(docs, keys, texts):
        own, gone = [], np.zeros(len(text), bool)
        for row in ([30, 31] if doc == 3 else [key]) if len(text) else []:
            at = np.sort(rng.integers(30, len(text) - 50 + 1, 3)) if len(text) >= 80 else np.array([5])
            bits = np.array([1 << int(o) for o in rng.integers(0, 31 if len(text) >= 80 else 5, len(at))], np.uint32)
            bits[0] |= np.uint32(1 << 2)
            own.append({"row": row, "payload": at.astype("<i4").tobytes() + bits.tobytes()})
            if row == key:
                for p, b in zip(at, bits):
                    for o in range(31):
                        if b >> o & 1:
                            gone[p - o : p - o + S.LENGTH] = True
        covers.append(own or None)
        want.append((doc, len(text), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())))
    kind = pa.list_(pa.struct([("row", pa.int64()), ("payload", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(texts), pa.array(covers, kind)], names=["doc", "row", "text", "covers"])
    for piece in ([batch], [batch.slice(0, 3), batch.slice(3)], [batch.slice(0, 0), batch]):
        out = pa.Table.from_batches(list(S._left(iter(piece)))).to_pylist()
        assert [(r["id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out] == want
    assert any(w[2] for w in want)
