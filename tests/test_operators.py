"""Operators on small fixtures with known answers: parsing, JSON, models against closed forms, invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import text
from tallyfold.operators import distributions as dist
from tallyfold.operators import joins, models, windows
from tallyfold.sources import landed, tables


def test_wind_text(spark):
    rows = ["11 mph, R To L", "8 mph, Out To CF", "14 mph, In From CF", "Calm", None, ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, t string")
    speed, out, left = text.wind_parts(F.col("t"))
    got = [(r[0], r[1], r[2]) for r in df.orderBy("k").select(speed, out, left).collect()]
    assert got == [(11.0, 0.0, 11.0), (8.0, 8.0, 0.0), (14.0, -14.0, -0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_schedule_text(spark):
    df = spark.createDataFrame([("Thursday, Mar 30 (2)",), ("Friday, Apr 1",), ("rain",), (None,)], "t string")
    got = [(str(r[0]), r[1]) for r in df.select(text.season_date(F.col("t"), F.lit(2023)), text.game_of_day(F.col("t"))).collect()]
    assert got == [("2023-03-30", 2), ("2023-04-01", 1), ("None", 1), ("None", 1)]


def test_landed_lines(spark):
    j = '{"teams":{"home":{"players":{"a":{"person":{"id":1},"battingOrder":"300","stats":{"pa":"4","hits":null}},"b":{"person":{},"stats":{"pa":"3"}}}},"away":{"players":{"c":{"person":{"id":2},"battingOrder":"x01","stats":{"pa":"0"}},"d":{"person":{"id":3},"battingOrder":"901","stats":{"pa":"1","hits":"1"}}}}}}'
    df = spark.createDataFrame([(7, j), (8, None), (9, "{broken")], "unit long, json string")
    assert sorted(map(tuple, landed.unit_lines(df, "unit", "json", ["pa", "hits"]).collect())) == [(7, 1, 4, 0), (7, 3, 1, 1)]
    assert sorted(map(tuple, landed.slots(df, "unit", "json").collect())) == [(7, 1, 3, 1), (7, 3, 9, 0)]


def test_no_lookahead(spark):
    rng = random.Random(1)
    rows = [(e, d, float(rng.random())) for e in range(3) for d in range(30)]
    df = spark.createDataFrame(rows, "e int, d int, v double")
    got = {(r.e, r.d): r.v_avg_10 for r in windows.rolling_means(df, ["e"], ["d"], ["v"]).collect()}
    for e, d, _ in rows:
        past = [v for a, b, v in rows if a == e and d - 10 <= b < d]
        assert (got[e, d] is None) if len(past) < 3 else math.isclose(got[e, d], sum(past) / len(past))


def test_fatigue_counts_only_earlier_rows_of_a_day(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-01-02", 1), (1, "2024-01-03", 1), (1, "2024-01-03", 2), (1, "2024-01-08", 1)], "e int, day string, k int").withColumn("day", F.to_date("day"))
    rows = windows.fatigue(df, "e", "day", ["k"]).orderBy("day", "k").collect()
    assert [r.recent for r in rows] == [0, 1, 2, 3, 3] and [r.rest_days for r in rows] == [None, 1, 1, 0, 5]


def test_tiers_follow_quantile_edges(spark):
    df = spark.createDataFrame([(k, k) for k in range(11)], "k int, v int")
    tiers = [r.tier for r in windows.quantile_tiers(df, "v", "k", 3).orderBy("k").collect()]
    assert [tiers.count(t) for t in (1, 2, 3)] == [4, 3, 4]


def test_circle_wraps(spark):
    df = spark.createDataFrame([(1, s, s / 10) for s in range(1, 10)] + [(1, None, 0.0)], "u int, slot int, m double")
    rows = {r.slot: r.neighbours for r in joins.circular_neighbours(df, ["u"], "slot", "m", F.lit(0.5), ahead=False).collect()}
    assert rows[9] == pytest.approx(0.2) and rows[8] == pytest.approx((0.9 + 0.1 + 0.2) / 3) and rows[None] == 0.5


def test_guarded_join_raises_on_a_taken_name(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x_off int")
    with pytest.raises(ValueError):
        joins.guarded_join(a, spark.createDataFrame([(1, 2)], "k int, x int"), ["k"], "_off")
    with pytest.raises(ValueError):
        tables.require_columns(a, ["y"])


def test_compounding_matches_the_binomial(spark):
    p, n = 0.27, 5
    row = spark.range(1).select(dist.compounded(F.array(F.lit(1 - p), F.lit(p)), F.lit(n)).alias("d")).first().d
    assert all(abs(row[k] - math.comb(n, k) * p**k * (1 - p) ** (n - k)) < 1e-12 for k in range(n + 1)) and abs(sum(row) - 1) < 1e-12


def test_scaling_keeps_mass_and_reaches_the_mean(spark):
    base = spark.createDataFrame([([0.6, 0.25, 0.1, 0.05],)], "d array<double>").withColumn("m", dist.mean_of(F.col("d")))
    for factor in (0.7, 1.2, 2.8):
        out = base.withColumn("t", F.col("m") * factor).withColumn("s", dist.frequency_scaled(F.col("d"), F.col("t"))).first()
        assert abs(sum(out.s) - 1) < 1e-9 and abs(sum(k * x for k, x in enumerate(out.s)) - out.t) < 1e-6 and min(out.s) >= 0


def test_non_increasing_is_the_least_squares_fit(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([4.0, 5.0, 3.0, 3.5, 1.0])], "g int, k int, v double")
    got = [r.fit for r in dist.non_increasing(df, ["g"], "k", "v", "fit").orderBy("k").collect()]
    assert got == pytest.approx([4.5, 4.5, 3.25, 3.25, 1.0])


def _points(spark):
    rng = random.Random(5)
    rows = []
    for k in range(600):
        x, z = rng.gauss(0, 1), rng.gauss(0, 2)
        rows.append((k, x, z, 1.5 * x - 0.5 * z + rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-(0.3 + x))))))
    return rows, spark.createDataFrame(rows, "k int, x double, z double, v double, y int")


def test_ridge_solves_the_normal_equations(spark):
    import numpy as np

    rows, df = _points(spark)
    m = models.ridge(df, ["x", "z"], "v", alpha=40.0)
    a, v = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    s = a.std(axis=0, ddof=1)
    c = (a - a.mean(axis=0)) / s
    want = np.linalg.solve(c.T @ c + 40.0 * np.eye(2), c.T @ (v - v.mean())) / s
    assert m.stages[1].coefficients.toArray() == pytest.approx(want, rel=2e-3)


def test_logistic_is_at_the_optimum(spark):
    import numpy as np

    rows, df = _points(spark)
    m = models.logistic(df, ["x", "z"], "y", c=0.1, standardised=False).stages[1]
    a, y, b = np.array([r[1:3] for r in rows]), np.array([r[4] for r in rows]), m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(a @ b + m.intercept)))
    assert np.abs(a.T @ (p - y) + b / 0.1).max() < 1e-2 * len(rows) ** 0.5 and abs((p - y).sum()) < 0.5


def test_calibrators(spark):
    rows, df = _points(spark)
    p = df.withColumn("p", F.lit(0.2) + 0.6 / (1 + F.exp(-F.col("x"))))
    chosen, table = models.choose_calibrator(p, ["k"])
    assert chosen in ("none", "platt", "isotonic") and table.count() == 3
    for few in (p.where("k < 50"), p.where("y = 1")):  # too few rows, and one class
        chosen, table = models.choose_calibrator(few, ["k"])
        assert chosen == "none" and [r.calibrator for r in table.where("chosen").collect()] == ["none"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
