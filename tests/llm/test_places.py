"""Decontamination looks at every place of a document that may hold an item."""

import re
from collections import defaultdict

import regex

from tallyfold.llm import decontaminate, queries

from .conftest import SF
from .test_scans import ITEM


def test_a_contradicting_place_hides_no_other(spark):
    clash = ITEM.replace("60", "72").replace("45", "72")
    changed = ITEM.replace("60", "72").replace("45", "38").replace("Boston", "Paris").replace("Chicago", "Lyon")
    words = ITEM.split()
    gap = " ".join(words[:12] + ["which", "is", "red"] + words[12:])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = [
        (1, clash + " . " + "filler words here " * 20 + ITEM), (2, clash + " ; " + "and more " * 9 + changed), (3, clash + " . " + clash),
        (4, "first " + gap), (5, ITEM + " or " + changed), (6, "so " + clash + " x " + clash + " y " + changed + " z " + clash),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.id: r for r in decontaminate.contaminated(df, bench).collect()}
    assert {i: r.kind for i, r in rows.items()} == {1: "exact", 2: "reparameterised", 4: "partial", 5: "exact", 6: "reparameterised"}
    n = len(ITEM.replace(";", "").split())
    assert (rows[1].at, rows[5].at, rows[4].at) == (n + 60, 0, 1)
    assert [r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()] == [3]


SHOP = "A shop run by Anna Smith sells 12 apples for 60 cents each and 9 pears for 80 cents each; how much does Anna Smith earn in 5 days"


def test_names_numbers_and_capitals_in_other_forms(spark):
    start = "Alice has 12 red apples in her basket. Bob has 30 green pears in his bag."
    bench = spark.createDataFrame([(1, SHOP), (2, start)], "item_id long, text string")
    docs = {
        1: SHOP, 2: SHOP.replace("Anna Smith", "Bob"), 3: SHOP.replace("Anna Smith", "Maria del Carmen Lopez"), 4: SHOP.replace("60 cents", "sixty cents"), 5: SHOP.lower(),
        6: "And then Anna Smith said. " + SHOP.replace("12", "fourteen").replace("80", "thirty-five"), 7: start.replace("Alice", "Zoe").replace("Bob", "Liam Jones"), 8: "Question " + start,
        9: start.lower(), 10: SHOP.replace("60", "80"), 11: "A shop that sells pears",
    }
    rows = decontaminate.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()
    assert {(r.id, r.item_id): r.kind for r in rows} == {
        (1, 1): "exact", (2, 1): "reparameterised", (3, 1): "reparameterised", (4, 1): "exact", (5, 1): "exact",
        (6, 1): "reparameterised", (7, 2): "reparameterised", (8, 2): "partial", (9, 2): "exact",
    }


# --- a matcher by plain loops ---


def plain_template(text, names):
    """(kinds, values) of the template tokens of a text."""
    d = decontaminate
    words = regex.findall(r"\p{N}+(?:[.,:/]\p{N}+)*|[\p{L}\p{M}]+", text or "")
    starters = {x.lower() for x in d.STARTERS}
    raw = ["<number>" if w[0].isdigit() or w.lower() in d.NUMBERS else "<name>" if w != w.lower() and w.lower() not in starters or w.lower() in names else w.lower() for w in words]
    is_name = lambda k: 0 <= k < len(raw) and raw[k] == "<name>"
    flat = []
    for k, x in enumerate(raw):
        if x in d.UNITS and k and raw[k - 1] == "<number>":
            x = "<unit>"
        elif x in d.PARTICLES and (is_name(k - 1) or is_name(k - 2)) and (is_name(k + 1) or is_name(k + 2)):
            x = "<name>"
        flat.append(x)
    out = []
    for k, (w, x) in enumerate(zip(words, flat)):
        told = str(d.NUMBERS[w.lower()]) if w.lower() in d.NUMBERS else w.replace(",", "") if re.fullmatch("[0-9]{1,3}(,[0-9]{3})+", w) else w.lower()
        if k and x == flat[k - 1] and (x == "<name>" or x == "<number>" and not w[0].isdigit() and not words[k - 1][0].isdigit()):
            out[-1][1].append(told)
        else:
            out.append((x, [told]))
    return [x for x, _ in out], [str(said(v)) if x == "<number>" and len(v) > 1 else " ".join(v) for x, v in out]


def said(words):
    """The number that number words make."""
    for scale in (1_000_000, 1000, 100):
        if str(scale) in words:
            at = len(words) - 1 - words[::-1].index(str(scale))
            return max(1, said(words[:at])) * scale + said(words[at + 1 :])
    return sum(map(int, words))


def test_windows_that_match_against_plain_loops(spark):
    """Every pair that the op finds has the share or the run by plain loops, and every item that stands whole in a document is found as exact."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r for r in queries.op4_benchmark_decontamination(spark, SF).collect()}
    names = set(decontaminate.name_words(spark.read.parquet(f"{SF}/benchmark.parquet"), "text"))
    index, of, may, must = defaultdict(set), {}, set(), set()
    for k, t in items:
        of[k] = kinds, _ = plain_template(t, names)
        for j in range(len(kinds) - 7):
            index[tuple(kinds[j : j + 8])].add((k, j))
    for i, t in docs:
        kinds, told = plain_template(t, names)
        seen, diagonals = defaultdict(set), defaultdict(set)
        for p in range(len(kinds) - 7):
            for k, j in index.get(tuple(kinds[p : p + 8]), ()):
                seen[k].add(j)
                diagonals[k, p - j].add(j)
        for k, found in seen.items():
            n = len(of[k][0]) - 7
            if len(found) >= 0.5 * n or max(len(x) for (a, _), x in diagonals.items() if a == k) >= 6:
                may.add((i, k))
            if any(a == k and len(x) == n and told[d : d + n + 7] == of[k][1] for (a, d), x in diagonals.items()):
                must.add((i, k))
    assert must and must <= set(got) <= may
    assert {x for x in got if got[x].kind == "exact"} == must


NUMBERS = [
    # item, document, kind (None: not found)
    ("two hundred pens and one hundred one books", "750 pens and 320 books", "reparameterised"),
    ("two hundred pens and one hundred one books", "200 pens and 101 books", "exact"),
    ("two hundred pens and one hundred one books", "two hundred pens and one hundred one books", "exact"),
    ("two hundred pens and one hundred one books", "320 pens and 320 books", None),
    ("3,000 pens and 45 books", "3000 pens and forty five books", "exact"),
    ("3,000 pens and 45 books", "３０００ pens and ٤٥ books", "exact"),
    ("3,000 pens and 45 books", "two thousand five hundred pens and one million two hundred thousand books", "reparameterised"),
    ("2500 pens and 1200000 books", "two thousand five hundred pens and one million two hundred thousand books", "exact"),
    ("60 pens and 45 books", "72 pens and 72 books", None),
]


def test_numbers_in_words_separators_and_other_scripts(spark):
    frame = lambda x: f"a seller stacks {x} on his wooden table before noon and then counts them all again"
    for item in dict.fromkeys(x for x, _, _ in NUMBERS):
        cases = [(k, d, kind) for k, (x, d, kind) in enumerate(NUMBERS) if x == item]
        docs = spark.createDataFrame([(k, "other words come first . " + frame(d)) for k, d, _ in cases], "doc_id long, text string")
        bench = spark.createDataFrame([(1, frame(item))], "item_id long, text string")
        got = {r.id: r.kind for r in decontaminate.contaminated(docs, bench).collect()}
        assert got == {k: kind for k, _, kind in cases if kind}
