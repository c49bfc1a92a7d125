"""Model queries without SQL against figures worked out from their collected frames."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import distributions, models
from tallyfold.plans import further, modelled

SF = "/root/testdata/sf0.001"


def plain_auc(y, p):
    y, p = np.array(y), np.array(p)
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]))


def plain_scores(y, p):
    y, p = np.array(y, float), np.array(p)
    brier = np.mean((p - y) ** 2)
    return plain_auc(y, p), brier, 1 - brier / (y.mean() * (1 - y.mean()))


@pytest.fixture(scope="module")
def split(spark):
    return modelled.split_frame(modelled.form_frame(spark, SF))


def test_split_is_by_time(split):
    rows = [[(r.number, r.unit, r.entity) for r in part.collect()] for part in split]
    n = sum(map(len, rows))
    assert max(rows[0]) < min(rows[1]) and max(rows[1]) < min(rows[2])
    assert [len(x) for x in rows] == [int(0.6 * n), int(0.75 * n) - int(0.6 * n), n - int(0.75 * n)]


def test_a_stored_bundle_predicts_the_same(spark, split, tmp_path):
    train, check, test = split
    fitted = models.fit_calibrated(train, check, modelled.FORM, "got", ["number", "unit", "entity"], None)
    fitted.save(spark, str(tmp_path / "bundle"))
    loaded = models.Calibrated.load(spark, str(tmp_path / "bundle"))
    one, two = ({(r.unit, r.entity): r.p for r in m.predict(test).collect()} for m in (fitted, loaded))
    assert one == pytest.approx(two) and loaded.kind == fitted.kind and loaded.features == modelled.FORM
    row = further.m12_calibrated(spark, SF).first()
    rows = loaded.predict(test).select("got", "p").collect()
    auc, brier, skill = plain_scores([r.got for r in rows], [r.p for r in rows])
    assert (row.auc, row.brier, row.skill, row.calibrator) == (pytest.approx(auc, abs=1e-5), pytest.approx(brier, abs=1e-5), pytest.approx(skill, abs=1e-5), loaded.kind)
    empty = models.fit_calibrated(train, check.where("false"), modelled.FORM, "got", ["number", "unit", "entity"])
    assert empty.kind == "none" and empty.predict(test).count() == test.count()


def test_m2_and_e15_from_their_predictions(spark, split):
    train, _, test = split
    rows = models.predicted(models.logistic(train, modelled.FORM, "got", 0.1), test).select("got", "p").collect()
    auc, brier, skill = plain_scores([r.got for r in rows], [r.p for r in rows])
    row = modelled.m2_logistic(spark, SF).first()
    assert (row.n, row.auc, row.brier, row.skill) == (len(rows), pytest.approx(auc, abs=1e-5), pytest.approx(brier, abs=1e-5), pytest.approx(skill, abs=1e-5))
    rungs = {r.rung: r for r in modelled.e15_ladder(spark, SF).collect()}
    first = models.predicted(models.logistic(train, modelled.FORM[:1], "got", 0.1), test).select("got", "p").collect()
    assert rungs["form"].auc == pytest.approx(plain_auc([r.got for r in first], [r.p for r in first]), abs=1e-5)
    assert [r.rung for r in rungs.values() if r.best] == [max(rungs, key=lambda k: rungs[k].skill)]


def test_compounded_chance_from_sizes(spark, split):
    train, _, test = split
    sizes = defaultdict(Counter)
    for r in train.collect():
        sizes[r.entity][r.n] += 1
    y, p = [], []
    for r in test.collect():
        if r.entity in sizes:
            rate = min(max(r.own_hit / max(r.own_n, 1.0), 0.0), 1.0)
            w = sizes[r.entity]
            y.append(r.got)
            p.append(sum(c * (1 - (1 - rate) ** n) for n, c in w.items()) / sum(w.values()))
    auc, brier, skill = plain_scores(y, p)
    row = {r.label: r for r in further.m18_compound_or_direct(spark, SF).collect()}
    assert (row["compound"].n, row["compound"].brier, row["compound"].brier_skill) == (len(y), pytest.approx(brier, abs=1e-5), pytest.approx(skill, abs=1e-5))
    assert row["compound"].auc == pytest.approx(auc, abs=2e-3) and row["direct"].n == len(y)


def test_sizes_without_a_slot_are_the_own_histogram(spark):
    rows = further.c18_project_sizes(spark, SF).collect()
    from tallyfold.plans.bindings import units

    seen = defaultdict(list)
    for r in units(spark, SF).select("entity", "n").collect():
        seen[r.entity].append(min(max(r.n, 1), 6))
    everyone = [n for x in seen.values() for n in x]
    by = defaultdict(dict)
    for r in rows:
        by[r.entity, r.slot][r["at"]] = r.p
    assert {e for e, _ in by} == set(seen)
    for (e, slot), told in by.items():
        assert sum(told.values()) == pytest.approx(1, abs=1e-4)
        if slot is None:
            own = seen[e] if len(seen[e]) >= 8 else everyone
            assert told == pytest.approx({k: own.count(k + 1) / len(own) for k in range(6)}, abs=1e-5)


def test_scaling_is_chosen_by_measured_gaps(spark):
    games = spark.createDataFrame(further._tilt_games(spark, SF).where("g = 0 and hand = 'L' and n <= 2").toPandas())
    row = distributions.method_scores(games, "unit", "base", "mean", "n", "total", 0.359, (0.5, 1.5, 2.5), 50).first()
    rows, over = games.collect(), {}
    cases = games.select("base", "mean", "n").distinct()
    for method in distributions.METHODS:
        scaled = cases.withColumn("d", distributions.scaled_to(F.col("base"), F.col("mean"), method))
        c = distributions.compounded_overdispersed(scaled, ["base", "mean", "n"], "d", "n", 0.359, "c", method=method)
        over |= {(method, r["mean"], r.n): [sum(r.c[int(x) + 1 :]) for x in (0.5, 1.5, 2.5)] for r in c.collect()}
        said = np.mean([over[method, r["mean"], r.n] for r in rows], axis=0)
        did = np.mean([[r.total > x for x in (0.5, 1.5, 2.5)] for r in rows], axis=0)
        assert row[f"{method}_gap"] == pytest.approx(np.mean(np.abs(said - did)), abs=1e-9)
    told = spark.range(1).select(*(distributions.chosen_method(F.lit(x)).alias(k) for k, x in (("a", 0.2), ("b", 0.25), ("c", 0.9)))).first()
    assert tuple(told) == ("tilt", "frequency", "frequency") and 0 <= row.frequency_wins <= 1
