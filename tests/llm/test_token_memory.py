"""What a worker keeps and works on at once while texts become ids."""

import numpy as np
import pyarrow as pa

from tallyfold.llm import token_store
from tallyfold.llm.queries import tokenizer_path

from .test_contracts import plain_ids


def texts(n: int, words: int) -> list[str]:
    drawn = np.random.default_rng(5)
    return [" ".join(f"w{x:x}," for x in drawn.integers(0, 1 << 40, words)) for _ in range(n)]


def test_long_chunks_are_not_kept():
    encoder = token_store.Encoder(tokenizer_path())
    whole = [t.replace(" ", "") for t in texts(8, 2000)] + ["", "one two", "漢字" * 5000]
    ids, counts = encoder.encode(pa.array(whole))
    assert sum(map(len, encoder.known)) + sum(map(len, encoder.known.values())) < 1 << 20
    assert max(map(len, encoder.known)) <= 64
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [list(x)[:-1] for x in plain_ids(whole)]


def test_worker_keeps_to_its_room(monkeypatch):
    monkeypatch.setattr(token_store, "_workers", {})
    rows = texts(40, 5000)
    batch, seen = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"]), []
    encode = token_store.Encoder.encode

    def noted(self, part, *args):
        out = encode(self, part, *args)
        seen.append((sum(len(x) for x in part.to_pylist()), len(self.known) + len(self.before)))
        return out

    monkeypatch.setattr(token_store.Encoder, "encode", noted)
    got = {}
    for room in ((20_000, 1 << 17), token_store.ROOM):
        seen.clear()
        got[room] = [x for _, ids in token_store.document_ids(iter([batch, batch]), tokenizer_path(), 0, room) for x in ids]
        if room != token_store.ROOM:
            # a generation outgrows its half by what one call brings, each chunk with its parts at most
            assert max(n for n, _ in seen) <= 1 << 17 and max(k for _, k in seen) < 150_000
    assert got[20_000, 1 << 17] == got[token_store.ROOM]
    assert [np.frombuffer(x, "<u2").tolist() for x in got[token_store.ROOM][: len(rows)]] == [list(x) for x in plain_ids(rows)]
