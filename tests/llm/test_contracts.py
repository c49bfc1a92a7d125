"""The thin queries and their operators against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import lines, near_copies, quality, queries, sharding, simhash, substrings, token_store

from .conftest import ODD_TEXTS, SF

SPACE = " \t\n\v\f\r"


def texts(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


# --- sharding ---


def check_shards(rows, docs, shards):
    assert Counter((r.id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert all(0 <= s < shards for s in sizes)
    share, largest = sum(sizes.values()) / shards, max(r.size for r in rows)
    assert all(abs(sizes[s] - share) <= 1.5 * largest for s in range(shards))


def test_op1(spark):
    rows = [r.asDict() for r in queries.op1_sharding(spark, SF).collect()]
    docs = texts(spark)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert len(rows) == len(docs)


def test_sharding_law(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_shards(sharding.assign_shards(docs, 16).collect(), texts(spark), 16)


def test_sharding_hot_key_is_subdivided(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    rows = sharding.assign_shards(docs, 16).collect()
    check_shards(rows, [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], 16)


def test_sharding_odd(odd, empty):
    rows = sharding.assign_shards(odd, 2).collect()
    check_shards(rows, [(i, t) for i, t, _, _ in ODD_TEXTS], 2)
    assert sharding.assign_shards(empty, 4).count() == 0


def test_write_shards(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
    more = odd.withColumns({"shard": F.lit(3), "slot": F.lit("x")})
    sharding.write_shards(more, str(tmp_path / "odd"), 2)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert sorted(back.columns) == sorted([*more.columns, "_shard"])
    assert Counter(map(tuple, back.select(more.columns).collect())) == Counter(map(tuple, more.collect()))


# --- quality ---


def base_counts(t):
    words = [w for w in re.split(f"[{SPACE}]+", t or "") if w]
    lines = [x for x in (t or "").split("\n") if re.search(f"[^{SPACE}]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)


def test_op3_base(spark):
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, SF).collect()}
    for i, t in texts(spark):
        r = rows[i]
        n, chars, symbols, dup, rep = base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rows = quality.judge(odd, labels).collect()
    got = Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *base_counts(t)) for i, t, _, _ in ODD_TEXTS)
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(odd, labels.where("false")).count() == len(ODD_TEXTS)


def test_quality_learns_a_certified_cutoff(spark):
    rows = [(i, " ".join((f"w{i}x{k}" + ("###" if i % 10 == 0 else "")) for k in range(25)), "en") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(8000)], "doc_id long, quality int")
    judged = {r.id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(judged[i] == (i % 10 != 0) for i in judged)


@pytest.mark.parametrize("k,n,risk", [(0, 50, 0.05), (3, 100, 0.1), (7, 9, 0.5)])
def test_binomial_tail(k, n, risk):
    from math import comb

    assert quality.binomial_tail(k, n, risk) == pytest.approx(sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)))


# --- simhash ---


def plain_fingerprint(t):
    words = [w for w in re.split(f"[{SPACE}]+", lower(t or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    u = sorted(parent)
    for i, a in enumerate(u):
        for b in u[:i]:
            if bin(a ^ b).count("1") <= 3:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    return find, links


def check_groups(rows, docs):
    want = [(i, plain_fingerprint(t)) for i, t in docs]
    assert Counter((r.id, r.fp % 2**64) for r in rows) == Counter(want)
    find, links = plain_components({f for _, f in want})
    smallest = {}
    for i, f in want:
        if i is not None:
            smallest[find(f)] = min(i, smallest.get(find(f), i))
    for r in rows:
        assert (r.component_id, r.n_links) == (smallest.get(find(r.fp % 2**64)), links[r.fp % 2**64])


def test_op9(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_groups(simhash.simhash_groups(docs).collect(), texts(spark))
    r = queries.op9_simhash_near_dedup(spark, SF).first()
    assert re.fullmatch("[0-9a-f]{16}", r.fingerprint)


def test_simhash_odd(odd, empty):
    check_groups(simhash.simhash_groups(odd).collect(), [(i, t) for i, t, _, _ in ODD_TEXTS])
    assert simhash.simhash_groups(empty).count() == 0
    kept = [r.doc_id for r in near_copies.keep_first(odd).collect()]
    assert len(kept) == len(set(kept)) and None in kept and 1 in kept and 2 not in kept and 5 not in kept


def test_links_find_every_pair_in_a_dense_ball(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 2**63, 200)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}


# --- token store ---


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_tokens(rows, docs):
    start, want = 0, Counter()
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for (i, _), ids in zip(docs, plain_ids([t for _, t in docs])):
        want[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter((r.id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_op10(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = str(tmp_path / "store")
    check_tokens(token_store.token_files(docs, queries.tokenizer_path(), store=store).collect(), texts(spark))
    i, t = texts(spark)[17]
    assert token_store.read_document(spark, store, i).tolist() == plain_ids([t])[0]
    assert token_store.read_document(spark, store, 10**9) is None
    head = spark.read.parquet(f"{store}/dictionary").first()
    assert hashlib.sha256(head.dictionary).hexdigest() == head.sha256


def test_tokens_odd(odd, empty):
    check_tokens(token_store.token_files(odd, queries.tokenizer_path()).collect(), [(i, t) for i, t, _, _ in ODD_TEXTS])
    assert token_store.token_files(empty, queries.tokenizer_path()).count() == 0


# --- substrings ---


def plain_removal(docs):
    docs = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, raw in docs:
        if i is not None:
            for s in range(len(raw) - 49):
                w = raw[s : s + 50]
                first[w] = min(i, first.get(w, i))
    out = Counter()
    for i, raw in docs:
        gone = np.zeros(len(raw), bool)
        if i is not None:
            for s in range(len(raw) - 49):
                if first[raw[s : s + 50]] < i:
                    gone[s : s + 50] = True
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_op5(spark):
    rows = queries.op5_suffix_dedup(spark, SF).collect()
    assert Counter(tuple(r) for r in rows) == plain_removal(texts(spark))
    assert any(r.n_removed for r in rows)


def test_substrings_odd(spark, odd, empty):
    assert Counter(tuple(r) for r in substrings.dedup_substrings(odd).collect()) == plain_removal([(i, t) for i, t, _, _ in ODD_TEXTS])
    assert substrings.dedup_substrings(empty).count() == 0


def test_substrings_planted(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcd"), 6))
    passage = " ".join(word() for _ in range(30))
    docs = []
    for i in range(120):
        own = [word() for _ in range(40)]
        piece = passage[int(rng.integers(0, 80)) : int(rng.integers(100, 200))]
        own.insert(int(rng.integers(0, 40)), piece)
        docs.append((i % 100, " ".join(own) + "z" * int(rng.integers(0, 90))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in substrings.dedup_substrings(df).collect()) == plain_removal(docs)


def test_substrings_crowded(spark, monkeypatch):
    """Names in many documents, with the same, partly the same and other surroundings, meet by parts of their contexts."""
    monkeypatch.setattr(substrings, "CROWDED", 2)
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    crowd, sides = "!" * 5 + word(15), [word(40) for _ in range(3)]
    docs = []
    for i in range(150):
        left, right = (sides[int(rng.integers(0, 3))][-int(rng.integers(1, 40)) :], sides[int(rng.integers(0, 3))][: int(rng.integers(1, 40))])
        docs.append((i % 140, word(60) + left + crowd + right + word(60)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_removal(docs)
    assert Counter(tuple(r) for r in substrings.dedup_substrings(df).collect()) == want and sum(r[2] > 0 for r in want) > 20
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_contexts_of_one_name_are_resolved_in_parts(monkeypatch):
    rng = np.random.default_rng(11)
    ctx = rng.integers(97, 99, (4000, substrings.SPAN)).astype(np.uint8)
    ctx[:, substrings.REACH : substrings.REACH + substrings.GRAM] = 120
    ctx[:, : substrings.REACH] = ctx[rng.integers(0, 40, 4000), : substrings.REACH]
    ctx[:, substrings.REACH + substrings.GRAM :] = ctx[rng.integers(0, 40, 4000), substrings.REACH + substrings.GRAM :]
    doc, open_ = rng.integers(0, 3000, 4000), rng.integers(1, 1 << 31, 4000).astype(np.uint32)
    want, calls, resolve = substrings.resolve(doc, open_, ctx)[0], [], substrings.resolve
    cols = (doc, np.arange(4000), np.zeros(4000, "<i4"), open_, ctx)
    batch = substrings._batch(kind=pa.array([1], pa.int32()), doc=pa.array([0]), row=pa.array([0]), payload=pa.array([substrings._pack(*cols)], pa.binary()))
    monkeypatch.setattr(substrings, "CONTEXTS", 500)
    monkeypatch.setattr(substrings, "resolve", lambda *a: calls.append(len(a[0])) or resolve(*a))
    got = np.zeros(4000, np.uint32)
    for out in substrings._meet(iter([batch])):
        for row, load in zip(out.column("row").to_pylist(), out.column("payload").to_pylist()):
            n = len(load) // 8
            for bits in np.frombuffer(load, "<u4", n, 4 * n):
                got[row] |= bits
    assert (got == want).all() and want.any() and max(calls) < 1000


# --- lines ---


def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def test_edit_distance_against_the_table():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        a = "".join(rng.choice(list("abc"), rng.integers(0, 14)))
        b = list(a)
        for _ in range(rng.integers(0, 6)):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abc"), rng.integers(0, 2)))
        b = "".join(b)
        for most in (1, 2, 3):
            d = plain_distance(a, b)
            assert lines.edit_distance(a, b, most) == (d if d <= most else None), (a, b, most)


def plain_lines(docs):
    first, copies = {}, Counter()
    rank = lambda i, k: (i is not None, i or 0, k)
    for i, t in docs:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip():
                copies[x] += 1
                if x not in first or rank(i, k) < rank(*first[x]):
                    first[x] = (i, k)
    u = sorted(first)
    parent, links = {x: x for x in u}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_len = defaultdict(list)
    for x in u:
        by_len[len(x)].append(x)
    for n in by_len:
        for a in by_len[n]:
            for g in range(3):
                most = 2 if n - g >= 24 else 1 if n - g >= 12 else 0  # by the shorter line
                for b in by_len.get(n - g, ()) if most and g <= most else ():
                    if (g or a < b) and lines.edit_distance(a, b, most) is not None:
                        links[a] += 1
                        links[b] += 1
                        parent[find(a)] = find(b)
    home = {}
    for x in u:
        home[find(x)] = min(home.get(find(x), first[x]), first[x], key=lambda f: rank(*f))
    return Counter((*first[x], copies[x], links[x], *home[find(x)]) for x in u)


def test_op2(spark):
    assert Counter(tuple(r) for r in queries.op2_line_dedup(spark, SF).collect()) == plain_lines(texts(spark))


def test_lines_planted(spark, odd, empty):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh "), rng.integers(20, 60))) for _ in range(12)]
    docs = []
    for i in range(60):
        out = []
        for x in base:
            y = list(x)
            for _ in range(rng.integers(0, 4)):
                k = int(rng.integers(0, len(y)))
                y[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abcdefgh"), rng.integers(0, 2)))
            out.append("".join(y))
        docs.append((i, "\n".join(out)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in lines.line_classes(df).collect()) == plain_lines(docs)
    assert Counter(tuple(r) for r in lines.line_classes(odd).collect()) == plain_lines([(i, t) for i, t, _, _ in ODD_TEXTS])
    assert lines.line_classes(empty).count() == 0
