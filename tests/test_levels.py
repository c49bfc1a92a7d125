"""Rates by level, fixed figures where too little was measured, candidates, and loads with broken parts."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import joins, rates
from tallyfold.sources import tables
from tallyfold.sources.shared import new_path


def test_opponent_rates_take_the_first_level_there_is(spark):
    own = spark.createDataFrame([(1, 0.2, 0.3, None), (4, None, None, None)], "opponent int, x_rate double, x_rate_L double, x_rate_R double")
    pooled = spark.createDataFrame([(1, 0.9), (2, 0.4)], "opponent int, x_pool double")
    rows = spark.createDataFrame([("a", 1, "L"), ("b", 1, "R"), ("c", 2, "L"), ("d", 3, "L"), ("e", None, "L"), ("f", 4, "L")], "row string, opponent int, stand string")
    for residual, others in ((0.1, 0.1), (None, 0.5)):
        facts = spark.createDataFrame([(0.5, 0.6, residual)], "x_league double, primary_share double, x_residual double")
        got = {r.row: (r.x_origin, r.x_allowed) for r in rates.opponent_rates(rows, own, pooled, facts, "opponent", "stand", ["L", "R"], ["x"]).collect()}
        mix = lambda x: pytest.approx(0.6 * x + 0.4 * others)  # noqa: E731, B023
        assert got == {"a": ("split", mix(0.3)), "b": ("own", mix(0.2)), "c": ("pool", mix(0.4)), "d": ("league", 0.5), "e": ("league", 0.5), "f": ("league", 0.5)}


def _trials(spark, sides, per, same):
    """`per` trials a side, the first `same` of them against its first opponent; the opening period is seq 1."""
    rows = [(u, u % 2, s, u if s <= same else -s, int(s > same)) for u in range(sides) for s in range(1, per + 1)]
    return spark.createDataFrame(rows, "unit int, side int, seq int, opponent int, is_hit int")


@pytest.mark.parametrize("sides, same, measured", [(600, 5, True), (400, 5, False), (600, 1, False), (600, 10, False)])
def test_residual_opponents_fall_back_to_fixed_figures(spark, sides, same, measured):
    got = rates.residual_opponent(_trials(spark, sides, 10, same), "unit", "side", "opponent", F.col("seq") == 1, ["seq"], ["is_hit"]).first()
    want = (same / 10, 1.0) if measured else (rates.PRIMARY_SHARE, rates.RESIDUAL_RATES["is_hit"])
    assert (got.measured, got.primary_share, got.is_hit_residual) == (measured, *want) and got.n == 10 * sides


def test_sides_without_an_opening_trial_do_not_count(spark):
    t = _trials(spark, 600, 10, 5).where("unit >= 50 or seq > 1")
    assert rates.residual_opponent(t, "unit", "side", "opponent", F.col("seq") == 1, ["seq"], ["is_hit"]).first().n == 5500
    assert not rates.residual_opponent(t.limit(0), "unit", "side", "opponent", F.col("seq") == 1, ["seq"], ["is_hit"]).first().measured


def test_few_hits_have_the_fixed_bases(spark):
    df = spark.range(1500).select((F.col("id") % 10).alias("e"), F.lit(1).alias("hit"), F.lit(0).alias("top"), (1 + F.col("id") % 2).alias("bases"))
    assert {r.bases_per_hit for r in rates.bases_per_hit(df, "e", "bases", "hit", "top").collect()} == {rates.BASES_PER_HIT}
    assert rates.BASES_PER_HIT not in {r.bases_per_hit for r in rates.bases_per_hit(df, "e", "bases", "hit", "top", few=1500).collect()}


def test_candidates_by_status(spark):
    sides = spark.createDataFrame([("g1", "A", list(range(12, 0, -1))), ("g1", "B", []), ("g2", "C", None), ("g2", "D", None)], "game string, team string, list array<bigint>")
    projected = spark.createDataFrame([("A", 99, 1), ("B", 22, 2), ("B", 21, 1)], "team string, id bigint, slot int")
    roster = spark.createDataFrame([("A", 12, "twelve"), ("B", 21, "x"), ("B", 20, "y")] + [("C", 40 - i, f"c{i}") for i in range(11)], "team string, id bigint, name string")
    got = joins.candidates(sides, projected, roster, "team", "list", "id", "slot", "name").collect()
    by = {t: sorted(((r.slot, r.id, r.status, r.name) for r in got if r.team == t), key=lambda x: (x[0] or 0, x[1])) for t in "ABCD"}
    assert by["A"] == [(k + 1, 12 - k, "confirmed", "twelve" if k == 0 else str(12 - k)) for k in range(9)]
    assert by["B"] == [(1, 21, "projected", "x"), (2, 22, "projected", "22")]
    assert by["C"] == [(None, 30 + i, "unknown", f"c{10 - i}") for i in range(9)] and by["D"] == []


def test_a_broken_file_keeps_no_other_from_loading(spark):
    path = new_path(spark, "landing")
    lines = [("a", '{"k": 1, "day": "2024-01-05", "v": 1.5}'), ("a", '{"k": 2, "day": "2024-01-06", "v": null}'), ("b", '{"k": 3, "day": "2024-01-05", "v": 2.5}'), ("b", '{"k": 4, "da')]
    spark.createDataFrame(lines, "who string, value string").write.partitionBy("who").text(path)
    rows, status = tables.load_isolated(spark, path, "k bigint, day date, v double", "who", "day")
    assert sorted((r.who, r.k, r.v) for r in rows.collect()) == [("a", 1, 1.5), ("a", 2, None)]
    assert {r.who: (r.lines, r.broken, str(r.newest), r.loaded) for r in status.collect()} == {"a": (2, 0, "2024-01-06", True), "b": (2, 1, "2024-01-05", False)}
    have = spark.createDataFrame([("a", 1, "2024-01-05", 0.0), ("b", 9, "2023-12-01", 7.0)], "who string, k bigint, day string, v double").withColumn("day", F.to_date("day"))
    log = spark.createDataFrame([("b", "2023-12-02"), ("c", "2023-11-01")], "who string, checked string").withColumn("checked", F.to_date("checked"))
    table, stamped = tables.refreshed(have, rows, status, log, "who", "day", ["who", "k"], F.to_date(F.lit("2024-01-07")))
    assert sorted((r.who, r.k, r.v) for r in table.collect()) == [("a", 1, 1.5), ("a", 2, None), ("b", 9, 7.0)]
    assert {r.who: str(r.checked) for r in stamped.collect()} == {"a": "2024-01-07", "b": "2023-12-02", "c": "2023-11-01"}
