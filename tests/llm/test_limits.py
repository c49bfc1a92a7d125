"""Both sides of the limits at which a plan changes, and the quality verdict, against plain versions."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyfold.llm import common, decontaminate, lines, near_copies, quality, queries, substrings

from .conftest import SF


def test_small_and_large_sides_give_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")

    def results():
        kept = sorted(r.doc_id for r in near_copies.keep_first(docs).collect())
        return kept, Counter(map(tuple, decontaminate.contaminated(docs, bench).collect())), Counter(map(tuple, lines.line_classes(docs).collect()))

    small = results()
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert results() == small


def test_bytes_tell_windows_with_equal_hashes_apart(monkeypatch):
    rng = np.random.default_rng(3)
    ctx = rng.integers(0, 2, (300, substrings.SPAN)).astype(np.uint8)
    ctx[150:] = ctx[:150]
    doc, open_ = rng.integers(0, 40, 300), np.full(300, (1 << 31) - 1, np.uint32)
    want = substrings.resolve(doc, open_, ctx)
    monkeypatch.setattr(substrings, "_window_hashes", lambda ctx, row, start, base: np.zeros(len(row), np.uint64))
    got = substrings.resolve(doc, open_, ctx)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and want[0].any()


def plain_kept(docs, labels, half):
    """The ids that stay, by loops over every step, stage and document, and whole binomial sums."""
    steps, base, good = {}, {}, dict(labels)
    for i, text, lang in docs:
        n, _, _, _, repeats, *rules = quality.measure(text)
        base[i] = n >= 20 and 100 * repeats <= 30 * n
        steps[i] = (lang or "", [int(min(x * 512, 512)) for x in rules])
    strata = sorted({steps[i][0] for i in good if i in steps and base[i]})
    cuts = {}
    for s in strata:
        own = [i for i in good if i in steps and base[i] and steps[i][0] == s]
        kind = {i: 2 if not good[i] else half[i] for i in own}
        share = lambda k, away: sum(away(i) for i in own if kind[i] == k) / max(1, sum(kind[i] == k for i in own))
        targets = []
        for rule in range(6):
            best, target = 0.0, None
            for step in range(1, 513):
                g, b = (share(k, lambda i: steps[i][1][rule] >= step) for k in (0, 2))
                if g <= 0.03 / 6 and b - g > 0 and b - g >= best:
                    best, target = b - g, step
            targets.append(target)

        def turned(i, stage):
            return any(t is not None and steps[i][1][r] >= 513 - stage * (513 - t) // 512 for r, t in enumerate(targets))

        first = {i: next((k for k in range(1, 513) if turned(i, k)), 513) for i in own}
        best, target = 0.0, None
        for stage in range(1, 513):
            g, b = (share(k, lambda i: first[i] <= stage) for k in (0, 2))
            if g <= 0.03 and b - g > best:
                best, target = b - g, stage
        n, certified = sum(kind[i] == 1 for i in own), None
        for stage in range(1, (target or 0) + 1):
            k = sum(kind[i] == 1 and first[i] <= stage for i in own)
            if sum(math.comb(n, j) * 0.03**j * 0.97 ** (n - j) for j in range(k + 1)) > 0.05 / len(strata):
                break
            certified = stage
        cuts[s] = [None if certified is None or t is None else 513 - certified * (513 - t) // 512 for t in targets]
    return {i for i, (s, x) in steps.items() if base[i] and all(c is None or v < c for c, v in zip(cuts.get(s, [None] * 6), x))}


def test_op3_verdict(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = [(r.doc_id, r.quality == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    # so many labels that all strata's holdouts certify cut-offs: every document twenty times over, under other ids
    docs = [(r.doc_id * 50 + k, r.text, r.lang) for r in rows for k in range(20)]
    told = dict(labels)
    more = [(r.doc_id * 50 + k, told[r.doc_id]) for r in rows if r.doc_id in told for k in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    named = spark.createDataFrame([(i, int(q)) for i, q in more], "doc_id long, quality int")
    half = {r.doc_id: r.h for r in named.select("doc_id", F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(2)).alias("h")).collect()}
    got = {r.id for r in quality.judge(table, named).where("kept").collect()}
    want = plain_kept(docs, more, half)
    assert got == want and len(want) < len(docs)
    assert {r.doc_id for r in queries.op3_quality_rules(spark, SF).where("kept").collect()} == plain_kept([(r.doc_id, r.text, r.lang) for r in rows], labels, {r.doc_id: r.h for r in spark.createDataFrame(labels, "doc_id long, q boolean").select("doc_id", F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(2)).alias("h")).collect()})
    assert {r.doc_id for r in quality.keep_good(table, named).collect()} == want


def test_op3_certifies_on_a_given_table(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op3_quality_rules(spark, sf).join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    away = [r for r in rows if not r.base_failed and not r.kept]
    assert away and all(r.failed_rules for r in away)
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in good) <= 0.03 * len(good)
    assert sum(r.quality == 0 for r in away) > 5 * sum(r.quality == 1 for r in away)


def test_the_risk_holds_in_nineteen_of_twenty_draws():
    rng, broken, draws = np.random.default_rng(9), 0, 400
    stages = np.arange(quality.STAGES + 1)
    # a good document's first stage is even over three times the stages: the true share at stage k is known
    for _ in range(draws):
        first = rng.integers(0, 12 * quality.STAGES, (2, 400)).clip(max=quality.STAGES)
        good, holdout = (np.bincount(x, minlength=quality.STAGES + 1) for x in first)
        bad = np.bincount(rng.integers(0, quality.STAGES, 200), minlength=quality.STAGES + 1)
        stage = quality.certified_stage(good, holdout, bad, 0.03, 0.05)
        broken += stage is not None and (stages[stage] + 1) / (12 * quality.STAGES) > 0.03
    assert broken <= 0.05 * draws + 3 * (0.05 * 0.95 * draws) ** 0.5
