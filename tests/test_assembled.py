"""Strengths of many values, sizes held to an order, guarded scores, and the frames of models and grading, on small known cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import distributions as dist
from tallyfold.operators import evaluation, joins, models, rates


def test_strengths_of_many_values_are_those_of_each_alone(spark):
    rows = [(e, int((e * 7 + i * i) % 11 < e % 5 + 2), None if i % 6 == 0 else int(i % 4 == 0)) for e in range(12) for i in range(30)]
    df = spark.createDataFrame(rows, "entity int, a int, b int")
    both = rates.strengths(df, "entity", ["a", "b"], 20).first()
    for v in ("a", "b"):
        seen = [(e, r[v]) for r in df.collect() for e in [r.entity] if r[v] is not None]
        own = {e: [y for x, y in seen if x == e] for e in range(12)}
        assert both[f"{v}_league"] == pytest.approx(sum(y for _, y in seen) / len(seen))
        r = [sum(y) / len(y) for y in own.values()]
        p, mean = sum(y for _, y in seen) / len(seen), sum(r) / 12
        spread = sum((x - mean) ** 2 for x in r) / 11 - p * (1 - p) * sum(1 / len(y) for y in own.values()) / 12
        want = rates.NO_SPREAD if spread <= 1e-9 else min(max(p * (1 - p) / spread - 1, rates.WEAKEST), rates.STRONGEST)
        assert both[f"{v}_k"] == pytest.approx(want)
        assert tuple(rates.strength(df, "entity", v, 20).first()) == pytest.approx((both[f"{v}_league"], both[f"{v}_k"]))
    few = rates.strengths(df.where("entity < 2"), "entity", ["a"], 20).first()
    assert few.a_k == rates.FEW and rates.strengths(df.limit(0), "entity", ["a"], 20).first().a_league is None


def test_sizes_are_held_to_the_order_of_four_slots_or_more(spark):
    flat = lambda m: [0.0, 0.5 - (m - 2) / 2, 0.0, 0.5 + (m - 2) / 2] + [0.0] * 4
    means = {"a": [(1, 2.2), (2, 1.8), (3, 2.0), (4, 1.6), (None, 2.9)], "b": [(1, 1.5), (2, 2.5), (3, 2.6)]}
    rows = [(u, k, s, flat(m)) for u, xs in means.items() for k, (s, m) in enumerate(xs)]
    out = dist.monotone_sizes(spark.createDataFrame(rows, "unit string, row int, slot int, sizes array<double>"), ["unit"], "slot", "sizes")
    got = {(r.unit, r.row): (r.fit, r.mean, sum(r.new_sizes)) for r in out.withColumn("mean", dist.mean_of(F.col("new_sizes"))).collect()}
    want = {"a": [2.2, 1.9, 1.9, 1.6, 2.9], "b": [1.5, 2.5, 2.6]}
    assert got == {(u, k): pytest.approx((m, m, 1.0), abs=1e-6) for u, ms in want.items() for k, m in enumerate(ms)}


def test_scores_need_thirty_rows_and_both_outcomes(spark):
    rows = [("whole", k % 2, 0.4) for k in range(30)] + [("few", k % 2, 0.4) for k in range(29)] + [("one", 1, 0.4) for _ in range(60)] + [("few", None, 0.4), ("few", 1, None)]
    df = spark.createDataFrame(rows, "key string, y int, p double")
    assert [(r.key, r.n) for r in evaluation.enough_scores(df, ["key"]).collect()] == [("whole", 30)]
    assert evaluation.enough_scores(df.limit(0), ["key"]).count() == 0


def test_size_frames_hold_starters_with_history_and_teach_the_slot(spark):
    day = dt.date(2020, 1, 1)
    rows = [(e, e % 2, day + dt.timedelta(u), u, 6 - e // 2 if (u + e) % 5 else 1, e + 1 if e < 9 else None, int((u + e) % 5 > 0), u % 2) for u in range(40) for e in range(10)]
    df = spark.createDataFrame(rows, "entity int, team int, day date, unit int, n int, at int, starts int, home int")
    f = models.size_frame(df, "entity", "team", "day", "unit", "n", "at", "starts", "home")
    got = {(r.entity, r.unit): r for r in f.collect()}
    assert set(got) == {(e, u) for u in range(3, 40) for e in range(9) if (u + e) % 5}
    r = got[4, 30]
    last = [x[4] for x in rows if x[0] == 4 and 10 <= x[3] < 30]
    team = [x[4] for x in rows if x[1] == 0 and x[3] < 30][-50:]
    assert (r.own_mean, r.team_mean, r.slot, r.slot_sq, r["size"]) == pytest.approx((sum(last) / 20, sum(team) / 50, 5.0, 25.0, 4))
    model = models.counts_model(f.withColumn("n", F.col("size")), models.SIZE_FEATURES, "n", models.LARGEST_SIZE)
    told = models.predicted_counts(model, f).withColumn("m", F.aggregate(F.transform("dist", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x))
    by_slot = [r.m for r in told.groupBy("slot").agg(F.avg("m").alias("m")).orderBy("slot").collect()]
    assert by_slot[0] > by_slot[4] > by_slot[8]


def test_the_season_before_is_all_that_an_opponent_shows(spark):
    rows = spark.createDataFrame([(1, dt.date(2021, 5, 1)), (2, dt.date(2022, 5, 1)), (3, dt.date(2022, 6, 1)), (4, dt.date(2022, 7, 1))], "unit int, day date")
    meta = spark.createDataFrame([(1, 7, "x"), (2, 7, "y"), (3, 8, "x")], "unit int, opponent int, venue string")
    seasons = spark.createDataFrame([(7, 2021, 0.3), (7, 2022, 0.9), (8, 2021, None)], "opponent int, season int, rate double")
    factor = F.when(F.col("venue") == "x", 1.2).otherwise(1.0)
    out = joins.with_prior_season(rows, meta, seasons, "unit", "day", "opponent", "season", factor, ["rate"]).collect()
    assert [(r.unit, r.rate, r.venue_factor) for r in out] == [(2, 0.3, 1.0)]


def test_lines_stored_under_way_are_never_graded(spark):
    totals = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "entity int, unit int")
    store = spark.createDataFrame([(1, 10, 0), (2, 10, 0), (1, 11, 5), (1, 9, 4)], "entity int, unit int, hits int")
    fetched = spark.createDataFrame([(3, 1, 10), (9, 1, 8)], "hits int, entity int, unit int")
    graded, after = joins.actuals(totals, store, fetched, ["entity", "unit"], "unit")
    assert sorted((r.entity, r.unit, r.hits) for r in graded.collect() if r.hits is not None) == [(1, 10, 3)] and graded.count() == 3
    assert sorted((r.entity, r.unit, r.hits) for r in after.collect()) == [(1, 9, 4), (1, 10, 3)]
