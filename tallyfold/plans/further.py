"""Registered queries of pools, rosters, starters, small frames, calibrated models and the choice of a scaling, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import distributions as dist
from ..operators import evaluation, joins, models, rates, windows
from ..sources import landed, tables
from ..sources.shared import new_path, staged
from .bindings import ORDER, TRIALS, UNITS, rounded, table, trials, units
from .modelled import FORM, form_frame, split_frame

SQL: dict[str, str] = {}


def _by_nation(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def s2_pool(spark, d):
    """The first ten landed pools by name beside the wide one (S6): rows and totals of each."""
    path = new_path(spark, "pools")
    _by_nation(spark, d).repartition("nation").write.partitionBy("nation").option("header", True).csv(path)
    out = None
    for name, most in (("ten", 10), ("wide", None)):
        pool = tables.load_pool(spark, path, "nation", "o_orderkey long, o_custkey long, o_totalprice double", most)
        rows = pool.groupBy("nation").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).withColumn("pool", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 2)


SQL["s2_pool"] = """WITH x AS (SELECT CAST(c_nationkey AS VARCHAR) AS nation, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT nation, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM x GROUP BY nation),
r AS (SELECT *, row_number() OVER (ORDER BY nation) AS r FROM g)
SELECT nation, n, total, 'wide' AS pool FROM r UNION ALL SELECT nation, n, total, 'ten' FROM r WHERE r <= 10"""


def s13_roster(spark, d):
    """A nation's customers as one roster text, flattened: pitchers and people without an id are left out."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    place = F.struct(F.when(k % 7 == 0, "P").when(k % 7 != 1, "OF").alias("abbreviation"))
    entry = F.struct(F.struct(F.when(k % 11 != 0, k).alias("id"), F.col("c_name").alias("fullName")).alias("person"), place.alias("position"))
    rosters = c.groupBy(F.col("c_nationkey").alias("team")).agg(F.to_json(F.struct(F.collect_list(entry).alias("roster"))).alias("json"))
    return landed.roster(rosters, "team", "json")


SQL["s13_roster"] = """SELECT c_nationkey AS team, c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 7 <> 1 THEN 'OF' END AS position
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0"""


def s14_probables(spark, d):
    """Probable starters of each game with their names resolved to ids; names of one word and unknown ones have none."""
    c = table(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Josef"), (F.col("c_custkey") % 4).cast("string")).alias("first"), F.concat(F.lit("de la Cruz"), (F.col("c_custkey") % 30).cast("string")).alias("last"), (F.col("c_custkey") % 13).alias("played_last"))
    k = F.col("o_orderkey")
    home = F.when(k % 5 == 0, "TBD").otherwise(F.concat(F.lit("JOSEF"), (k % 6).cast("string"), F.lit(" De La Cruz"), (k % 40).cast("string")))
    games = table(spark, d, "orders").select(
        k.alias("game"), (F.col("o_custkey") % 9).alias("home_team"), (F.col("o_custkey") % 9 + 9).alias("away_team"), home.alias("home_probable"),
        F.concat(F.lit("Josef1 de la Cruz"), (k % 7).cast("string")).alias("away_probable"),
    )
    return landed.probable_starters(games, people)


SQL["s14_probables"] = """WITH p AS (SELECT c_custkey AS id, 'josef' || (c_custkey % 4) AS first, 'de la cruz' || (c_custkey % 30) AS last, c_custkey % 13 AS played FROM customer),
g AS (SELECT o_orderkey AS game, o_custkey % 9 AS home_team, o_custkey % 9 + 9 AS away_team,
  CASE WHEN o_orderkey % 5 = 0 THEN 'TBD' ELSE 'JOSEF' || (o_orderkey % 6) || ' De La Cruz' || (o_orderkey % 40) END AS home_probable, 'Josef1 de la Cruz' || (o_orderkey % 7) AS away_probable FROM orders),
n AS (SELECT DISTINCT home_probable AS name FROM g UNION SELECT DISTINCT away_probable FROM g),
w AS (SELECT name, lower(split_part(name, ' ', 1)) AS first, lower(substr(name, strpos(name, ' ') + 1)) AS last FROM n WHERE strpos(name, ' ') > 0),
i AS (SELECT name, arg_max(id, row(CAST(w.first = p.first AS INT), played, id)) AS id FROM w JOIN p ON p.last = w.last AND starts_with(p.first, left(w.first, 3)) GROUP BY name)
SELECT game, home_team, away_team, home_probable, h.id AS home_probable_id, away_probable, a.id AS away_probable_id
FROM g LEFT JOIN i h ON h.name = home_probable LEFT JOIN i a ON a.name = away_probable"""


def w17_game_number(spark, d):
    """A team's games of a season numbered in their order."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("team"), F.year("o_orderdate").alias("season"), F.col("o_orderdate").cast("date").alias("day"))
    return windows.numbered(o, ["team", "season"], ["day", "o_orderkey"], "game_number")


SQL["w17_game_number"] = """SELECT o_orderkey, o_custkey % 30 AS team, year(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS day,
row_number() OVER (PARTITION BY o_custkey % 30, year(o_orderdate) ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS game_number FROM orders"""


def a26_graded(spark, d):
    """Predictions graded so far: the largest count that a day's rows of the scored log have, summed over days."""
    log = units(spark, d).groupBy("day", (F.col("entity") % 3).alias("label")).agg(F.count("*").alias("n"))
    return log.groupBy("day").agg(F.max("n").alias("n")).agg(F.count("*").alias("days"), F.sum("n").alias("graded"))


SQL["a26_graded"] = f"WITH {UNITS}, l AS (SELECT day, entity % 3 AS label, count(*) AS n FROM u GROUP BY ALL), m AS (SELECT day, max(n) AS n FROM l GROUP BY day) SELECT count(*) AS days, sum(n) AS graded FROM m"


def a27_opponent_cards(spark, d):
    """A card for each opponent from its first row: the team it faces, its own, and how much has been seen of it."""
    first = F.struct(*ORDER)
    t = trials(spark, d)
    return t.groupBy("opponent").agg(F.min_by("side", first).alias("faces"), F.min_by("hand", first).alias("team"), F.min_by("quantity", first).alias("seen"))


SQL["a27_opponent_cards"] = f"WITH {TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY opponent ORDER BY {', '.join(ORDER)}) AS r FROM t) SELECT opponent, side AS faces, hand AS team, quantity AS seen FROM r WHERE r = 1"


def f8_team_ids(spark, d):
    """Codes to ids by a table of codes, else by a lookup of nation names; tomorrow is a day after today."""
    n = table(spark, d, "nation").select(F.substring("n_name", 1, 3).alias("code"), "n_nationkey")
    ids = text.coded(F.col("code"), {"FRA": 900, "JAP": 901}, F.col("n_nationkey") + 100)
    o = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("code", ids.cast("long").alias("team_id"))
    return o.groupBy("code", "team_id").agg(F.count("*").alias("n")).withColumn("ahead", F.datediff(text.tomorrow(), text.today()))


SQL["f8_team_ids"] = """SELECT substr(n_name, 1, 3) AS code, CAST(CASE substr(n_name, 1, 3) WHEN 'FRA' THEN 900 WHEN 'JAP' THEN 901 ELSE n_nationkey + 100 END AS BIGINT) AS team_id, count(*) AS n, 1 AS ahead
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""


def p5_pull_air(spark, d):
    """Batted-ball flags by hand: air balls more than ten degrees to the batter's own side, and the speed of air balls."""
    t = trials(spark, d).select("entity", "stand", (F.col("quantity") * 2 + 20).alias("speed"), (F.col("part") % 60 - 10).alias("angle"), ((F.col("part") % 91) - 45).alias("spray"))
    air = F.col("angle") >= 10
    pulled = F.col("spray") * F.when(F.col("stand") == "L", 1).otherwise(-1) > 10
    f = t.withColumns({"air": air.cast("int"), "pull_air": (air & pulled).cast("int"), "air_speed": F.when(air, F.col("speed")), "sweet": F.col("angle").between(8, 32).cast("int")})
    return rounded(f.groupBy("entity", "stand").agg(F.sum("air").alias("air"), F.sum("pull_air").alias("pull_air"), F.sum("sweet").alias("sweet"), F.avg("air_speed").alias("air_speed")), 6)


SQL["p5_pull_air"] = f"""WITH {TRIALS}, b AS (SELECT entity, stand, quantity * 2 + 20 AS s, part % 60 - 10 AS a, part % 91 - 45 AS spray FROM t)
SELECT entity, stand, count(*) FILTER (a >= 10) AS air, count(*) FILTER (a >= 10 AND spray * CASE WHEN stand = 'L' THEN 1 ELSE -1 END > 10) AS pull_air,
count(*) FILTER (a BETWEEN 8 AND 32) AS sweet, round(avg(s) FILTER (a >= 10), 6) AS air_speed FROM b GROUP BY ALL"""


def p25_composite(spark, d):
    """What a trial is worth: hits, runs and runs batted in per trial, runs from reaching base and the share that scores."""
    g = trials(spark, d).groupBy("entity").agg(F.avg("is_hit").alias("p_hit"), F.avg("is_hr").alias("p_hr"), F.avg("reached").alias("p_reach"), F.avg("rbi").alias("p_rbi"))
    run = F.col("p_hr") + F.greatest(F.col("p_reach") - F.col("p_hr"), F.lit(0.0)) * 0.31
    return rounded(g.withColumn("expected", F.col("p_hit") + run + F.col("p_rbi")).select("entity", "expected"))


SQL["p25_composite"] = f"WITH {TRIALS}, g AS (SELECT entity, avg(is_hit) AS h, avg(is_hr) AS r, avg(reached) AS o, avg(rbi) AS b FROM t GROUP BY entity) SELECT entity, round(h + r + greatest(o - r, 0) * 0.31 + b, 9) AS expected FROM g"


def j7_control(spark, d):
    """The opponent's control of the season before, and the own recent rate times what it allows; nulls where there is none."""
    t = trials(spark, d)
    season = F.year("day")
    control = t.groupBy("opponent", (season + 1).alias("season")).agg(F.avg("is_walk").alias("allowed"), F.count("*").alias("seen"))
    recent = t.withColumn("recent", windows.guarded(F.col("is_walk"), F.avg, windows.prior(["entity"], ORDER, 20), 3)).withColumn("season", season)
    rows = joins.guarded_join(recent.select("entity", "season", *ORDER, "recent"), control, ["opponent", "season"], "_control")
    rows = rows.withColumn("exposure", F.col("recent") * F.col("allowed_control"))
    return rounded(rows.select("entity", "unit", "seq", "quantity", "price", "season", "recent", "allowed_control", "seen_control", "exposure"))


SQL["j7_control"] = f"""WITH {TRIALS}, c AS (SELECT opponent, year(day) + 1 AS season, avg(is_walk) AS allowed, count(*) AS seen FROM t GROUP BY ALL),
r AS (SELECT *, year(day) AS season, CASE WHEN count(is_walk) OVER w >= 3 THEN avg(is_walk) OVER w END AS recent FROM t WINDOW w AS (PARTITION BY entity ORDER BY {', '.join(ORDER)} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT entity, unit, seq, quantity, price, season, round(recent, 9) AS recent, round(allowed, 9) AS allowed_control, seen AS seen_control, round(recent * allowed, 9) AS exposure FROM r LEFT JOIN c USING (opponent, season)"""


def s31_comparison(spark, d):
    """Several predictions of one outcome side by side (E11), through the comparison sink."""
    u = units(spark, d).select("unit", "entity", (F.col("is_hit") > 0).cast("int").alias("y"), "n")
    told = {"flat": u.withColumn("p", F.lit(0.6)), "size": u.withColumn("p", 0.3 + F.col("n") / 12.0), "group": u.withColumn("p", 0.5 + (F.col("entity") % 7) * -0.02)}
    return rounded(tables.store_comparison(rounded(evaluation.compared(told)), new_path(spark, "comparison")), 7)


SQL["s31_comparison"] = f"""WITH {UNITS}, b AS (SELECT CAST(is_hit > 0 AS INT) AS y, n, entity FROM u),
x AS (SELECT 0 AS place, 'flat' AS label, y, 0.6::DOUBLE AS p FROM b UNION ALL SELECT 1, 'size', y, 0.3 + n / 12.0 FROM b UNION ALL SELECT 2, 'group', y, 0.5 + (entity % 7) * -0.02 FROM b),
r AS (SELECT *, rank() OVER (PARTITION BY place ORDER BY p) + (count(*) OVER (PARTITION BY place, p) - 1) / 2.0 AS rk, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM x)
SELECT place, label, count(*) AS n, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 7) AS auc, round(avg((p - y) ** 2), 7) AS brier,
round(1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))), 7) AS brier_skill, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 7) AS log_loss FROM r GROUP BY place, label"""


def e18_team_calibration(spark, d):
    """A team's chance to win from its own and the difference to its opponent's form, fitted on the first 75 % of days and held against the rest in ten bins."""
    f = form_frame(spark, d).withColumn("diff", F.col("own_hit") - F.col("own_bases"))
    s = joins.time_split(f, ["number", "unit", "entity"], [0.75])
    model = models.logistic(s.where("part = 0"), [*FORM, "diff"], "got", 1.0)
    return rounded(evaluation.calibration_table(models.predicted(model, s.where("part = 1")), "got", "p", 10), 6)


def m12_calibrated(spark, d):
    """Penalty and calibrator chosen on the middle slice, the whole bundle stored and loaded (S30), evaluated on the last."""
    train, check, test = split_frame(form_frame(spark, d))
    fitted = models.fit_calibrated(train, check, FORM, "got", ["number", "unit", "entity"], None)
    figures = evaluation.evaluate(fitted.predict(test).withColumn("y", F.col("got")), []).first()
    fitted.figures = {"auc": figures["auc"], "skill": figures["skill"]}
    path = new_path(spark, "bundle")
    fitted.save(spark, path)
    loaded = models.Calibrated.load(spark, path)
    told = evaluation.evaluate(loaded.predict(test).withColumn("y", F.col("got")), [])
    return rounded(told.withColumns({"calibrator": F.lit(loaded.kind), "c": F.lit(loaded.c), "stored_auc": F.lit(loaded.figures.get("auc"))}), 6)


def j11_snapshot(spark, d):
    """Every entity's latest known form, scored by a stored model that saw no rows of the last slice."""
    f = form_frame(spark, d)
    train, check, _ = split_frame(f)
    path = new_path(spark, "snapshot")
    models.fit_calibrated(train, check, FORM, "got", ["number", "unit", "entity"]).save(spark, path)
    latest = windows.latest(f.select("entity", "day", "unit", *FORM), ["entity"], ["day", "unit"])
    return rounded(models.Calibrated.load(spark, path).predict(latest).select("entity", "day", "unit", "p"), 6)


def m16_projection(spark, d):
    """A size model by the day of the split, its mean error beside the own mean's, on later units; no row with too few."""
    f = form_frame(spark, d)
    s = joins.time_split(f, ["number", "unit", "entity"], [0.75])
    got = models.size_projection(s, FORM, "n", "part", (500, 300, 100))
    if got is None:
        return spark.createDataFrame([], "n long, model double, own double")
    mean = F.aggregate(F.transform("dist", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(got[1].withColumn("mean", mean).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("n") - F.col("mean"))).alias("model"), F.avg(F.abs(F.col("n") - F.col("own_n"))).alias("own")), 6)


def c18_project_sizes(spark, d):
    """Each entity's size distribution for its next unit: by the model where a slot is known, by its history elsewhere."""
    u = units(spark, d).select("entity", "unit", "n", (F.col("entity") % 9 + 1).alias("slot"))
    rows = u.groupBy("entity").agg(F.count("*").alias("seen")).withColumn("slot", F.when(F.col("entity") % 4 != 0, F.col("entity") % 9 + 1))
    told = models.projected_sizes(u, rows, "entity", "n", "slot")
    return rounded(told.select("entity", "slot", F.posexplode("size_dist").alias("at", "p")), 6)


def m18_compound_or_direct(spark, d):
    """A unit's chance of at least one hit: compounded from the rate per trial and the own sizes, against a model of the unit itself; skill of both."""
    f = form_frame(spark, d)
    train, _, test = split_frame(f)
    rate = rates.clip(F.col("own_hit") / F.greatest(F.col("own_n"), F.lit(1.0)), 0.0, 1.0)
    sizes = train.groupBy("entity", "n").agg(F.count("*").alias("w"))
    known = staged(test.withColumn("rate", rate), "compound-test")
    cases = known.join(sizes.select("entity", F.col("n").alias("size"), "w"), "entity").withColumn("any", dist.at_least_one(F.col("rate"), F.col("size")))
    compound = dist.marginal(cases, ["entity", "unit", "got"], "w", "any", "p")
    direct = models.predicted(models.logistic(train, FORM, "got", 0.1), known.join(sizes.select("entity").distinct(), "entity", "left_semi")).select("entity", "unit", "got", "p")
    return rounded(evaluation.compared({"compound": compound, "direct": direct}, "got", "p"), 6)


def m17_catalogues(spark, d):
    """Which columns each target's model sees, and how many trials are complete in them."""
    targets, windows_ = ("is_hr", "is_hit"), (150, 600)
    t = trials(spark, d)
    rolled = rates.rolling_rates(t, ["entity"], ORDER, list(targets), windows_)
    allowed = t.groupBy("opponent").agg(*(F.avg(x).alias(f"{x}_allowed") for x in targets), F.count("*").alias("seen"))
    f = rolled.join(allowed, "opponent").withColumns({f"{x}_matchup": rates.log5(F.col(f"{x}_rate_career"), F.col(f"{x}_allowed"), F.col(f"{x}_league")) for x in targets})
    f = f.withColumns({"is_home": F.col("side"), "context_factor": F.when(F.col("seen") >= 5, 1.0)})
    each = models.rate_features(targets, windows_)
    counts = f.agg(*(F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in cols)) == 0).alias(x) for x, cols in each.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("target"), F.lit(len(cols)).alias("columns"), F.col(x).alias("complete")) for x, cols in each.items())))
    return counts.select(rows.alias("r")).select("r.*")


SQL["m17_catalogues"] = f"""WITH {TRIALS}, s AS (SELECT opponent FROM t GROUP BY opponent HAVING count(*) >= 5), c AS (SELECT count(*) AS complete FROM t JOIN s USING (opponent))
SELECT target, 8 AS columns, complete FROM c, (VALUES ('is_hr'), ('is_hit')) AS x(target)"""


def _tilt_games(spark, d):
    """Units with a hand's distribution per trial, and a wanted mean that a group of entities has."""
    t = trials(spark, d)
    own = dist.histogram(t, ["hand"], "certain", 6).select("hand", F.col("dist").alias("base"))
    wanted = t.groupBy("hand", (F.col("entity") % 3).alias("g")).agg(F.round(F.avg("certain"), 4).alias("mean"))
    games = t.groupBy("hand", "unit", (F.col("entity") % 3).alias("g")).agg(F.count("*").cast("int").alias("n"), F.sum("certain").alias("total"))
    return games.join(F.broadcast(own), "hand").join(F.broadcast(wanted), ["hand", "g"])  # two rows, six rows


def c11_choose_scaling(spark, d):
    """Frequency or tilt, by measured calibration and 300 resamplings; tilt has to win clearly."""
    s = dist.method_scores(staged(_tilt_games(spark, d), "tilt-games"), "unit", "base", "mean", "n", "total", 0.359, (0.5, 1.5, 2.5))
    return rounded(s.withColumn("method", dist.chosen_method(F.col("frequency_wins"))), 6)


QUERIES = {f.__name__: f for f in (s2_pool, s13_roster, s14_probables, s31_comparison, w17_game_number, a26_graded, a27_opponent_cards, f8_team_ids, p5_pull_air, p25_composite, j7_control, e18_team_calibration, j11_snapshot, m12_calibrated, m16_projection, m17_catalogues, m18_compound_or_direct, c11_choose_scaling, c18_project_sizes)}
