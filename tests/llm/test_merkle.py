"""The manifest against loops over whole trees."""

import hashlib
import zlib
from collections import Counter

import pytest

from tallyfold.llm import merkle

from .conftest import ODD_TEXTS


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    """(id, leaf, subroot, root, proof, folded root, verified) of (id, source, lang, n_chars, text) rows."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*map(told, (*r[:4], text)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources}
    trees = {s: tree([leaf(r, r[4]) for r in own[s]]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for p, r in enumerate(own[s]):
            text = r[4].replace("\n", "") if None not in (r[0], r[4]) and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            now, siblings = leaf(r, text), []
            for levels, q in ((trees[s], p), (top, k)):
                for nodes in levels[:-1]:
                    left, right = nodes[q - q % 3 : q], nodes[q + 1 : q - q % 3 + 3]
                    siblings += left + right
                    now, q = digest(*left, now, *right), q // 3
            out.append((r[0], trees[s][0][p], trees[s][-1][0], top[-1][0], digest(*siblings), now, now == top[-1][0]))
    return Counter(out)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [243, 4, 1], [244, 730, 0, 2]])
def test_sizes(spark, sizes):
    rows = [(i, None if s == 2 else f"s{s}", "en", i, f"a\nb{i}") for s, n in enumerate(sizes) for i in range(1000 * s, 1000 * s + n)]
    out = merkle.verified_documents(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, out.collect())) == plain(rows)


def test_equal_rows_fill_equal_subtrees_and_many_sources_a_deep_top(spark):
    rows = [(None, "s", "en", 1, "same\n")] * 800 + [(7, "s", "en", 1, "x\ny")] * 2 + [(i, f"s{i % 250}", None, None, None) for i in range(300)]
    out = Counter(map(tuple, merkle.verified_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()))
    want = plain(rows)
    assert out == want and sum(want.values()) == 1102


def test_odd(odd, empty):
    fields = ("doc_id", "source", "lang", "size", "text")
    out = merkle.verified_documents(odd, fields=fields).collect()
    assert Counter(map(tuple, out)) == plain([(i, s, la, 1, t) for i, t, la, s in ODD_TEXTS])
    assert merkle.verified_documents(empty, fields=fields).count() == 0


def test_some_leaves_of_a_stored_manifest(spark, tmp_path):
    rows = [(i, f"s{i % 3}", str(i)) for i in range(900)]
    leaves = spark.createDataFrame(rows, "id long, tree string, leaf string")
    made = merkle.build_manifest(leaves, str(tmp_path / "m"))
    again = merkle.load_manifest(spark, str(tmp_path / "m"))
    assert again == made
    some = merkle.proofs(again, spark.createDataFrame([(5,), (5,), (700,), (-1,)], "id long"))
    got = some.select("id", merkle.folded(some.leaf, some.path).alias("root"), "leaf").collect()
    assert sorted(map(tuple, got)) == [(5, made.root, "5"), (700, made.root, "700")]
    records = made.records("trees", 0).collect()
    assert all(tree(r.children)[-1] == [r.digest] for r in records if r.n > 243 and len(r.children) == 243)
