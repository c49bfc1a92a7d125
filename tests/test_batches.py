"""Work on many fits, lines, splits and loads at once, against the same work done one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import distributions as dist
from tallyfold.operators import evaluation, models, scoring, windows
from tallyfold.plans import composed, compounded, windowed
from tallyfold.streaming import jobs

SF = "/root/testdata/sf0.001"


# --- permuted refits ---


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3)) * [1, 4, 0.5]
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.9 * x[:, 0] - 0.4)))).astype(int)
    df = spark.createDataFrame([(k, *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y))], "k int, real double, idle double, flat double, y int").repartition(3)
    return df.where("k < 2000").drop("k"), df.where("k >= 2000").drop("k")


def test_batched_fits_are_the_single_ones(spark, frames, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_ROWS", 700)
    features, c = ["real", "idle", "flat"], 0.3
    packed = models.packed_blocks(frames[0], [*features, "y"])
    blocks = {r.block: np.frombuffer(r.rows).reshape(4, -1).T for r in packed.collect()}
    assert len(blocks) > 1 and sum(map(len, blocks.values())) == frames[0].count()
    got = models.permuted_fits(packed, 4, [0, 2], 3, c)
    for r in range(3):
        rows = [[*map(float, x), int(y)] for b, m in blocks.items() for x, y in zip(models.dealt_anew(m[:, :3], [0, 2], b, r, 0), m[:, 3])]
        one = models.logistic(spark.createDataFrame(rows, "real double, idle double, flat double, y int"), features, "y", c).stages[1]
        assert got[r] == pytest.approx([*one.coefficients.toArray(), one.intercept], abs=2e-4)
    assert abs(got[0][0]) > 5 * abs(got[1][0])


def test_a_real_column_stands_out_and_idle_ones_do_not(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 6))
    y = rng.random(1200) < 1 / (1 + np.exp(-(0.9 * x[:, 0] - 0.4)))
    columns = ["real", *(f"idle{k}" for k in range(5))]
    df = spark.createDataFrame([(k, *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y))], ["k", *columns, "y"])
    p = {c: models.permutation_test(df.where("k < 800"), df.where("k >= 800"), columns, [c], "y", rounds=39).first() for c in columns}
    assert p["real"].p == 1 / 40 and p["real"].skill > p["real"].shuffled
    # chances of idle columns are even between 0 and 1: the mean of five has a deviation of 0.13
    assert 0.2 < sum(p[c].p for c in columns[1:]) / 5 < 0.8


# --- lines of a batch ---


def test_the_scoring_batch_is_monotone_in_the_line(spark):
    over = {}
    for r in composed.c9_batch_lines(spark, SF).collect():
        over.setdefault((r.entity, r.target), []).append((r.line, r.over))
    assert all(0 <= p <= 1 for x in over.values() for _, p in x)
    falling = [[p for _, p in sorted(x)] for x in over.values()]
    assert all(a >= b for x in falling for a, b in zip(x, x[1:]))
    # the same chance by another route, without the dispersion, which only lowers it; means are rounded to 4 digits
    assert all(dict(x)[0.5] <= over[e, "any_is_hit"][0][1] + 4e-4 for (e, t), x in over.items() if t == "hits")


def test_without_dispersion_two_routes_agree(spark):
    rows = spark.createDataFrame([(1, "t", 0.3, [0.2, 0.3, 0.5])], "k int, target string, mean double, sizes array<double>")
    shapes = spark.createDataFrame([("t", [0.75, 0.25], 0.0, [0.5])], "target string, shape array<double>, sd double, lines array<double>")
    got = dist.batch_over_lines(rows, ["k"], "mean", "sizes", shapes, 3).first().over
    assert got == pytest.approx(sum(w * (1 - 0.7**n) for n, w in ((1, 0.2), (2, 0.3), (3, 0.5))))


@pytest.mark.parametrize("method", dist.METHODS)
def test_batch_lines_are_the_single_mixtures(spark, method):
    shape, lines = [0.7, 0.2, 0.06, 0.04], (0.5, 2.5)
    means, sizes = (0.3, 0.5, 1.1), [0.1, 0.0, 0.6, 0.3]
    rows = spark.createDataFrame([(k, "t", m, sizes) for k, m in enumerate(means)] + [(9, "t", None, sizes), (8, "other", 0.3, sizes)], "k int, target string, mean double, sizes array<double>")
    shapes = spark.createDataFrame([("t", shape, 0.4, list(lines))], "target string, shape array<double>, sd double, lines array<double>")
    got = {(r.k, r.line): r.over for r in dist.batch_over_lines(rows, ["k"], "mean", "sizes", shapes, 4, method=method).collect()}
    cases = spark.createDataFrame([(k, m, n, shape) for k, m in enumerate(means) for n in (1, 3, 4)], "k int, m double, n int, d array<double>")
    each = dist.compounded_overdispersed(cases.withColumn("d", dist.scaled_to(F.col("d"), F.col("m"), method)), ["k", "n"], "d", "n", 0.4, "c", method=method)
    p = {(r.k, r.n): r.o for r in each.select("k", "n", F.array(*(dist.over_line(F.col("c"), F.lit(x)) for x in lines)).alias("o")).collect()}
    want = {(k, x): sum(w * p[k, n][i] for n, w in ((1, 0.1), (3, 0.6), (4, 0.3))) for k in range(3) for i, x in enumerate(lines)}
    assert got == pytest.approx(want, abs=1e-9)


# --- resampling ---


def test_resampled_sums_are_those_of_single_draws(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "_DRAWS", 100)
    import hashlib

    rows = [(k, k / 7) for k in range(50)]
    df = spark.createDataFrame(rows, "key long, v double").repartition(4)
    got = {r.replicate: (r.w, r.x) for r in evaluation.resampled_sums(df, "key", 20, {"x": F.col("v")}).collect()}
    for b in range(1, 21):
        w = []
        for key, _ in rows:
            seed = int(hashlib.md5(str(key).encode()).hexdigest()[:7], 16)
            x = (seed * (b * 1103515 + 12345) + b * 69069 + 1) % evaluation.PRIME
            u = ((x ^ (x >> 15)) * 48271 + b) % evaluation.PRIME
            w.append(sum(u >= e for e in evaluation.poisson_edges()))
        assert got[b] == (sum(w), pytest.approx(sum(a * v for a, (_, v) in zip(w, rows))))
    assert evaluation.resampled_sums(df.where("false"), "key", 20, {"x": F.col("v")}).count() == 0


# --- splits and histories ---


def test_four_splits_take_one_exchange_and_see_no_later_row(spark):
    rows = [(k % 3, k, f"v{k % 5 % 3}", k % 2, int(k * 7 % 11 < 4)) for k in range(90)]
    df = spark.createDataFrame(rows, "e int, at int, venue string, home int, y int")
    out = windows.split_edges(df, "e", "y", ["at"], {"venue": "venue", "home": "home"}, {"home": [0, 1]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for r in out.collect():
        before = [x for x in rows if x[0] == r.e and x[1] < r.at]
        for name, k, v in (("venue", 2, r.venue), ("home", 3, r.home)):
            same = [x for x in before if x[k] == v]
            base = sum(x[4] for x in before) / len(before) if before else None
            want = 0.0 if base is None else (sum(x[4] for x in same) + 30 * base) / (len(same) + 30) - base
            assert (r[f"{name}_edge"], r[f"{name}_edge_n"]) == (pytest.approx(want), len(same))
    with pytest.raises(Exception, match="home is not listed"):
        windows.split_edges(df, "e", "y", ["at"], {"home": "home"}, {"home": [0]}).collect()


def test_context_features_tolerate_missing_columns(spark):
    frame = spark.createDataFrame([(1, k, f"2024-01-{k + 1:02d}", k % 2) for k in range(5)], "e int, u int, day string, y int").withColumn("day", F.to_date("day"))
    meta = spark.createDataFrame([(1, 0, "L", 1, 2), (1, 0, "R", 0, 3)], "e int, u int, stand string, home int, seq int")
    rows = windows.context_features(frame, meta, "e", "u", "day", "y", ["day"], ["seq"], []).orderBy("u").collect()
    assert [(r.stand, r.is_home, r.day_night, r.temp, r.wind_pull) for r in rows[:2]] == [("L", 1, "unknown", None, 0.0), ("R", 0, "unknown", None, 0.0)]


def test_a_team_history_sees_no_row_of_its_own_day(spark):
    rows = [(0, day, k, float(100 * day + k)) for day in range(6) for k in range(4)]
    df = spark.createDataFrame(rows, "team int, day int, k int, v double")
    for r in windows.last_rows_before(df, ["team"], ["day"], ["k"], "v", 7, 5, "m").collect():
        before = [x[3] for x in rows if x[1] < r.day][-7:]
        assert r.m == (pytest.approx(sum(before) / len(before)) if len(before) >= 5 else None)
    assert windowed.w12_history(spark, SF).count() > 0


# --- score tables ---


def test_scores_fit_on_one_part_hold_on_another(spark, tmp_path):
    rng, rows = np.random.default_rng(6), []
    for e in range(80):
        for u in range(500):
            slot, tob = int(rng.integers(1, 10)), int(rng.integers(0, 4))
            q = min(0.55, scoring.LEAGUE * scoring.SLOT_FACTORS[slot] * (1.25 if e % 2 else 0.8))
            rows.append((e, u, slot, int(rng.binomial(tob, q)), 0, tob, 0.32 + 0.01 * (u % 3), q * tob))
    df = spark.createDataFrame(rows, "e int, u int, slot int, runs int, top int, tob int, behind double, true double").repartition(4)
    fitted = scoring.fit_scores(df.where("u < 250"), "e", "slot", "runs", "top", "tob", "behind").save(str(tmp_path / "s"))
    out = scoring.score_chance(df.where("u >= 250"), fitted, "e", "slot", "behind")
    # against the chances that the runs were drawn from: some 1,100 runs a slot were fitted on, so a deviation is 3 %
    bias = out.groupBy("slot").agg((F.sum(F.col("share") * F.col("tob")) / F.sum("true")).alias("b")).collect()
    assert len(bias) == 9 and all(abs(r.b - 1) < 0.1 for r in bias)
    assert sum(abs(r.b - 1) for r in bias) / 9 < 0.05
    assert out.agg(F.sum(F.col("share") * F.col("tob")) / F.sum("true")).first()[0] == pytest.approx(1, abs=0.03)
    own = {r.entity: r.factor for r in fitted.entities.collect()}
    assert min(v for e, v in own.items() if e % 2) > max(v for e, v in own.items() if not e % 2)
    # each term falls back alone
    odd = spark.createDataFrame([(999, 4, None), (1, None, 0.4), (999, None, None)], "e int, slot int, behind double")
    got = {(r.e, r.slot): r.share for r in scoring.score_chance(odd, fitted, "e", "slot", "behind").collect()}
    q = fitted.league.first()["q"]
    slots = {r.slot: r for r in fitted.slots.collect()}
    assert got[999, 4] == pytest.approx(q * slots[4].factor) and got[999, None] == pytest.approx(q)
    assert got[1, None] == pytest.approx(q * (1 + scoring.SLOPE * (0.4 - 0.32) / q) * own[1])
    few = scoring.fit_scores(df.limit(50), "e", "slot", "runs", "top", "tob", "behind")
    got = [r.share for r in scoring.score_chance(odd.where("slot = 4"), few, "e", "slot", "behind").collect()]
    assert got == pytest.approx([scoring.LEAGUE * scoring.SLOT_FACTORS[4]])
    assert compounded.c16_scoring_share(spark, SF).count() > 0


# --- loads ---


def test_late_rows_are_counted_and_kept_apart(spark, tmp_path):
    schema, land = "id long, at timestamp", str(tmp_path / "land")

    def load(rows):
        spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(land)
        return jobs.ingest_counted(spark.readStream.schema(schema).parquet(land), ["id"], "at", 1, str(tmp_path / "out"))

    load([(1, "2024-05-10 12:00:00"), (2, "2024-05-09 00:00:00"), (2, "2024-05-09 00:00:00")])
    load([(3, "2024-05-09 12:00:00"), (4, "2024-05-09 11:59:59"), (1, "2024-05-10 12:00:00"), (5, None), (6, "2024-05-12 00:00:00")])
    accepted, rejected, counts = load([(7, "2024-05-10 23:00:00"), (8, "2024-05-11 00:00:00")])
    assert sorted(r.id for r in accepted.collect()) == [1, 2, 3, 5, 6, 8] and sorted((r.id, r.batch) for r in rejected.collect()) == [(4, 1), (7, 2)]
    assert sorted(map(tuple, counts.collect())) == [(0, 2, 1, 0), (1, 3, 1, 1), (2, 1, 0, 1)]


def test_the_gate_sends_a_unit_once_over_two_runs(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "gate")

    def load(rows):
        spark.createDataFrame(rows, "u long, v double").coalesce(1).write.mode("append").parquet(land)
        return sorted(map(tuple, jobs.gate(spark.readStream.schema("u long, v double").parquet(land), ["u"], "v", 10.0, out).collect()))

    assert load([(1, 6.0), (1, 5.0), (2, 4.0), (3, 1.0)]) == [(1, 11.0)]
    assert load([(1, 7.0), (2, 7.0), (3, 1.0)]) == [(1, 11.0), (2, 11.0)]


# --- cross-fitted calibration ---


def test_cross_fitted_chances_are_calibrated(spark):
    from pyspark.ml.classification import GBTClassifier

    rng = np.random.default_rng(8)
    x = rng.random(1500)
    rows = models.assembled(spark.createDataFrame([(k, float(v), float(rng.random() < v)) for k, v in enumerate(x)], "k int, x double, label double"), ["x"]).cache()
    out = models.cross_fitted(GBTClassifier(maxIter=3, maxDepth=2, seed=1), rows.where("k % 2 = 0"), rows.where("k % 2 = 1"), "k").collect()
    assert len(out) == 750 and all(0 <= r.p <= 1 for r in out)
    assert np.mean([(r.p - r.label) ** 2 for r in out]) < 0.2 and abs(np.mean([r.p - r.label for r in out])) < 0.05
