"""The search against scores of all documents, and how much of its lists it reads."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfold.llm import lexical

from .conftest import ODD_TEXTS, SF


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=10):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = set()
    for item, query in asked.items():
        scored = []
        for i, w, c in held:
            m = 10 + 90 * len(w) * n_docs // n_terms
            scored.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in query if t in c), i))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]
        out |= {(item, r, i, s) for r, (s, i) in enumerate(best, 1)}
    return out


def found(df):
    return {(r.item_id, r["rank"], r.id, r.score) for r in df.collect()}


def test_small_parts_several_passes_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, 30) if x < 200)) for i in range(400)]
    docs += [(1000 + i, "w1 w2 w3 w4") for i in range(30)]
    items = [(i, " ".join(f"w{k}" for k in rng.integers(1, 60, 8))) for i in range(12)] + [(None, "w1 w2"), (99, "nothing"), (98, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert found(lexical.search(d, q)) == want
    monkeypatch.setattr(lexical, "PART_POSTINGS", 300)
    assert found(lexical.search(d, q, pass_terms=25)) == want
    assert found(lexical.search(d, q, k=3)) == plain(docs, items, 3)


def test_odd(spark, odd, empty):
    items = [(1, "one two word"), (2, ""), (3, None), (4, "été NAÏVE Éa"), (None, "no id here"), (1, "stop")]
    table = spark.createDataFrame([(*x, 0, 1, "x") for x in items], "item_id long, text string, id int, rank int, term string")
    docs = [(i, t) for i, t, _, _ in ODD_TEXTS]
    got = sorted(((r.item_id, r["rank"], r.id, r.score) for r in lexical.search(odd, table).collect()), key=str)
    assert got == sorted(plain(docs, items), key=str)
    assert lexical.search(empty, table).count() == 0
    assert lexical.search(odd, table.where("false")).count() == 0
    assert lexical.search(odd, table.where("item_id = 2")).columns == ["item_id", "rank", "id", "score"]


def part(rng, size=4000, n_terms=5):
    ends, term, tf = [0], [], []
    for _ in range(size):
        own = np.flatnonzero(rng.random(n_terms) < 0.3)
        term.append(own)
        tf.append(np.minimum(rng.zipf(1.6, len(own)), 500))
        ends.append(ends[-1] + len(own))
    return lexical.Part(rng.integers(10, 300, size), np.array(ends), np.concatenate(term), np.concatenate(tf))


@pytest.mark.parametrize("seed", range(3))
def test_reading_stops_early_and_exactly(seed):
    index = part(np.random.default_rng(seed))
    query = [(0, 900), (1, 1400), (2, 300), (4, 0), (77, 5)]
    docs, scores, seen = index.best(query, 10)
    whole = np.zeros(index.size, np.int64)
    for t, w in query[:3]:
        a, b = index.start[index.at[t]], index.end[index.at[t]]
        whole[index.doc[a:b]] += w * index.impact[a:b]
    order = np.lexsort((np.arange(index.size), -whole))[:10]
    assert (docs == order).all() and (scores == whole[order]).all()
    assert seen < np.count_nonzero(whole) / 2
    floor = int(scores[4])
    again, _, fewer = index.best(query, 10, floor)
    assert (again[:5] == docs[:5]).all() and fewer <= seen
    assert index.best([], 10)[2] == 0


def test_best_positions_run_ahead_of_the_last_read():
    # four documents that all three lists hold on top, in different orders: marked by direct access before they are read
    index = lexical.Part(np.full(3000, 50), np.arange(0, 9001, 3), np.tile([0, 1, 2], 3000), np.concatenate([[[900, 800, 700], [800, 700, 900], [700, 900, 800]], np.ones((2997, 3), int)]).ravel())
    docs, _, seen = index.best([(0, 10), (1, 10), (2, 10)], 3)
    assert sorted(docs) == [0, 1, 2] and seen <= 3 * lexical.STEP


def test_query_on_the_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical.search(docs, items)) == want
