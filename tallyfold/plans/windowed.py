"""Registered window queries with their SQL: rolling and career values that only look back, splits, fatigue, tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rates, windows
from .aggregates import STRENGTH
from .bindings import EVENTS, ORDER, ORDER_SQL, TRIALS, UNITS, raw_events, rounded, table, trials, units

SQL: dict[str, str] = {}


def _guard(value: str, agg: str, rows: int | None, least: int, keys: str, order: str) -> str:
    frame = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {rows if rows else 'UNBOUNDED'} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({value}) {frame} >= {least} THEN {agg}({value}) {frame} END"


def w1_rolling_means(spark, d):
    u = units(spark, d).select("entity", "unit", "day", "is_hit", "rbi")
    return rounded(windows.rolling_means(u, ["entity"], ["day", "unit"], ["is_hit", "rbi"]), 8)


SQL["w1_rolling_means"] = f"WITH {UNITS} SELECT entity, unit, day, is_hit, rbi, " + ", ".join(
    [f"round({_guard(v, 'avg', n, 3, 'entity', 'day, unit')}, 8) AS {v}_avg_{n}" for v in ("is_hit", "rbi") for n in (10, 20)]
    + [f"round({_guard(v, 'avg', None, 5, 'entity', 'day, unit')}, 8) AS {v}_career" for v in ("is_hit", "rbi")]
) + " FROM u"


def w3_season_rolling(spark, d):
    u = units(spark, d).select("entity", "unit", "day", "certain").withColumn("season", F.year("day").cast("int"))
    w = windows.prior(["entity", "season"], ["day", "unit"])
    out = windows.rolling_means(u, ["entity", "season"], ["day", "unit"], ["certain"], sizes=(5,), least=2, career_least=2)
    return rounded(windows.numbered(out.withColumn("seen", F.count("certain").over(w)), ["entity", "season"], ["day", "unit"], "game"), 8)


SQL["w3_season_rolling"] = f"WITH {UNITS}, y AS (SELECT entity, unit, day, certain, CAST(year(day) AS INT) AS season FROM u) SELECT *, round({_guard('certain', 'avg', 5, 2, 'entity, season', 'day, unit')}, 8) AS certain_avg_5, round({_guard('certain', 'avg', None, 2, 'entity, season', 'day, unit')}, 8) AS certain_career, count(certain) OVER (PARTITION BY entity, season ORDER BY day, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, row_number() OVER (PARTITION BY entity, season ORDER BY day, unit) AS game FROM y"


def w4_rolling_ratios(spark, d):
    """A ratio of window sums (also W5) and a window's largest value."""
    u = units(spark, d).select("entity", "unit", "day", "is_hit", "is_hr", "total_bases")
    out = windows.rolling_ratio(u, ["entity"], ["day", "unit"], "hr_per_hit", "is_hr", "is_hit")
    return rounded(windows.rolling_max(out, ["entity"], ["day", "unit"], "top_20", "total_bases", 20), 8)


SQL["w4_rolling_ratios"] = f"WITH {UNITS} SELECT entity, unit, day, is_hit, is_hr, total_bases, " + ", ".join(
    f"round({_guard('is_hr', 'sum', n, 3, 'entity', 'day, unit')} * 1.0 / nullif({_guard('is_hit', 'sum', n, 3, 'entity', 'day, unit')}, 0), 8) AS hr_per_hit_{n}" for n in (10, 20, 40)
) + f", {_guard('total_bases', 'max', 20, 3, 'entity', 'day, unit')} AS top_20 FROM u"


def w6_rolling_rates(spark, d):
    t = trials(spark, d)
    out = rates.rolling_rates(t, ["entity"], ORDER, ["is_hit"], sizes=(150,))
    return rounded(out.select("entity", "unit", "seq", "part", "price", "is_hit_rate_150", "is_hit_rate_career"), 8)


SQL["w6_rolling_rates"] = f"""WITH {TRIALS}, {STRENGTH}, r AS (SELECT entity, unit, seq, part, price,
  coalesce({_guard('is_hit', 'sum', 150, 20, 'entity', ORDER_SQL)}, 0) AS x, coalesce({_guard('is_hit', 'count', 150, 20, 'entity', ORDER_SQL)}, 0) AS n,
  coalesce({_guard('is_hit', 'sum', None, 1, 'entity', ORDER_SQL)}, 0) AS cx, coalesce({_guard('is_hit', 'count', None, 1, 'entity', ORDER_SQL)}, 0) AS cn FROM t)
SELECT entity, unit, seq, part, price, round((x + k * league) / (n + k), 8) AS is_hit_rate_150, round((cx + k * league) / (cn + k), 8) AS is_hit_rate_career FROM r, k"""


def w8_matchup(spark, d):
    """The entity's and the opponent's (W7) career rates before a trial, blended against the league."""
    t = trials(spark, d)
    a = rates.rolling_rates(t, ["entity"], ORDER, ["is_hit"], sizes=()).withColumnsRenamed({"is_hit_rate_career": "own", "is_hit_league": "league"}).drop("is_hit_k")
    b = rates.rolling_rates(a, ["opponent"], ORDER, ["is_hit"], sizes=()).withColumnRenamed("is_hit_rate_career", "theirs")
    return rounded(b.select("entity", "opponent", "unit", "seq", "part", "price", "own", "theirs", rates.log5(F.col("own"), F.col("theirs"), F.col("league")).alias("matchup")), 8)


def _career(key: str, name: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"(coalesce(sum(is_hit) {w}, 0) + k{key[0]}.k * k{key[0]}.league) / (count(is_hit) {w} + k{key[0]}.k) AS {name}"


SQL["w8_matchup"] = f"""WITH {TRIALS}, {STRENGTH.replace("k AS (", "ke AS (")}, {STRENGTH.replace("own AS", "own2 AS").replace("FROM own ", "FROM own2 ").replace("m AS (", "m2 AS (").replace("FROM m)", "FROM m2)").replace("k AS (", "ko AS (").replace("entity", "opponent")},
r AS (SELECT entity, opponent, unit, seq, part, price, ke.league AS l, {_career('entity', 'a')}, {_career('opponent', 'b')} FROM t, ke, ko),
o AS (SELECT *, (a / (1 - a)) * (b / (1 - b)) / (l / (1 - l)) AS o FROM r)
SELECT entity, opponent, unit, seq, part, price, round(a, 8) AS own, round(b, 8) AS theirs, round(o / (1 + o), 8) AS matchup FROM o"""


def w9_split_edge(spark, d):
    t = trials(spark, d)
    return rounded(windows.split_edge(t, "entity", "hand", "is_hit", ORDER).select("entity", "unit", "seq", "part", "price", "edge", "edge_n"), 8)


_SAME = f"OVER (PARTITION BY entity, hand ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_OWN = f"OVER (PARTITION BY entity ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL["w9_split_edge"] = f"WITH {TRIALS}, r AS (SELECT entity, unit, seq, part, price, avg(is_hit) {_OWN} AS b, count(is_hit) {_SAME} AS n, coalesce(sum(is_hit) {_SAME}, 0) AS x FROM t) SELECT entity, unit, seq, part, price, round(coalesce((x + 30 * b) / (n + 30) - b, 0), 8) + 0.0 AS edge, n AS edge_n FROM r"


def _sky(u):
    """Made-up conditions of a unit, some of them missing."""
    return u.withColumns({
        "venue": F.when(F.col("unit") % 11 != 0, F.col("unit") % 30), "day_night": F.when(F.col("unit") % 7 != 0, F.when(F.col("unit") % 3 == 0, "day").otherwise("night")),
        "temp": F.when(F.col("unit") % 13 != 0, F.col("unit") % 97), "wind_out": F.when(F.col("unit") % 5 != 0, F.col("unit") % 21 - 10), "wind_side": F.when(F.col("unit") % 4 != 0, F.col("unit") % 13 - 6),
    })


def w10_context(spark, d):
    """Where, when and in what weather: four split edges of a unit's top outcome by venue, weekday, home and day or night, weather and calendar keys."""
    frame = _sky(units(spark, d).select("entity", "unit", "day", (F.col("is_hr") > 0).cast("int").alias("got")))
    meta = trials(spark, d).select("entity", "unit", "stand", (F.col("opponent") % 2).cast("int").alias("home"), *[c for c in ORDER if c != "unit"])
    out = windows.context_features(frame, meta, "entity", "unit", "day", "got", ["day", "unit"], ORDER, ["day", "night"])
    names = [f"{x}_{y}" for x in ("venue", "weekday", "home", "daynight") for y in ("edge", "edge_n")]
    calendar = [F.year("day").cast("int").alias("season"), (F.year("day") - 1).cast("int").alias("last_season"), F.datediff(F.lit("1999-01-01"), "day").alias("age")]
    return rounded(out.select("entity", "unit", "stand", "is_home", "weekday", *calendar, *names, "temp", "wind_out", "wind_pull"), 8)


def _edge(name: str, col: str) -> str:
    w = f"OVER (PARTITION BY entity, {col} ORDER BY day, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"coalesce(round((coalesce(sum(got) {w}, 0) + 30 * base) / (count(got) {w} + 30) - base, 8), 0) + 0.0 AS {name}_edge, count(got) {w} AS {name}_edge_n"


SQL["w10_context"] = f"""WITH {UNITS}, m AS (SELECT entity, unit, stand, opponent % 2 AS home FROM t QUALIFY row_number() OVER (PARTITION BY entity, unit ORDER BY {ORDER_SQL}) = 1),
f AS (SELECT u.entity, u.unit, u.day, CAST(is_hr > 0 AS INT) AS got, stand, CAST(home AS INT) AS is_home, CAST(isodow(u.day) - 1 AS INT) AS weekday, CASE WHEN u.unit % 11 <> 0 THEN u.unit % 30 ELSE -1 END AS venue,
  CASE WHEN u.unit % 7 = 0 THEN 'unknown' WHEN u.unit % 3 = 0 THEN 'day' ELSE 'night' END AS dn, CASE WHEN u.unit % 13 <> 0 AND u.unit % 97 > 32 THEN u.unit % 97 END AS temp,
  CASE WHEN u.unit % 5 <> 0 THEN u.unit % 21 - 10 ELSE 0 END AS wind_out, CASE WHEN u.unit % 4 <> 0 THEN u.unit % 13 - 6 ELSE 0 END AS side FROM u JOIN m ON u.entity = m.entity AND u.unit = m.unit),
b AS (SELECT *, avg(got) OVER (PARTITION BY entity ORDER BY day, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM f)
SELECT entity, unit, stand, is_home, weekday, CAST(year(day) AS INT) AS season, CAST(year(day) - 1 AS INT) AS last_season, CAST(date_diff('day', day, DATE '1999-01-01') AS INT) AS age,
  {_edge("venue", "venue")}, {_edge("weekday", "weekday")}, {_edge("home", "is_home")}, {_edge("daynight", "dn")},
  CAST(coalesce(temp, (SELECT median(temp) FROM b)) AS DOUBLE) AS temp, CAST(wind_out AS DOUBLE) AS wind_out, CAST(side * CASE WHEN stand = 'L' THEN -1 ELSE 1 END AS DOUBLE) + 0.0 AS wind_pull FROM b"""


def w11_fatigue(spark, d):
    e = raw_events(spark, d).select("user_id", "ts", "day")
    return windows.fatigue(e, "user_id", "day", ["ts"])


SQL["w11_fatigue"] = f"""WITH {EVENTS}, n AS (SELECT user_id, ts, day, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS c,
  count(*) OVER (PARTITION BY user_id, day) AS same, row_number() OVER (PARTITION BY user_id, day ORDER BY ts) AS r, CAST(date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY ts), day) AS INT) AS rest_days FROM e)
SELECT user_id, ts, day, rest_days, c - (same - r + 1) AS recent FROM n"""


def w12_history(spark, d):
    """Before a unit: the entity's mean size of its last 20 units, and its team's of the team's last 50 rows in earlier units."""
    u = units(spark, d).select("entity", "unit", "day", "n").withColumn("team", F.col("entity") % 5)
    own = u.withColumn("own_mean", windows.guarded(F.col("n"), F.avg, windows.prior(["entity"], ["day", "unit"], 20), 3))
    return rounded(windows.last_rows_before(own, ["team"], ["day"], ["unit", "entity"], "n", 50, 5, "team_mean"), 8)


SQL["w12_history"] = f"""WITH {UNITS}, o AS (SELECT entity, unit, day, n, entity % 5 AS team, {_guard('n', 'avg', 20, 3, 'entity', 'day, unit')} AS own_mean FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, unit, entity) AS r FROM o),
f AS (SELECT *, min(r) OVER (PARTITION BY team, day) AS f FROM r),
m AS (SELECT a.team, a.f, avg(b.n) AS mean, count(*) AS c FROM (SELECT DISTINCT team, f FROM f) a JOIN f b ON a.team = b.team AND b.r BETWEEN a.f - 50 AND a.f - 1 GROUP BY ALL)
SELECT team, day, entity, unit, n, round(own_mean, 8) AS own_mean, round(CASE WHEN c >= 5 THEN mean END, 8) AS team_mean FROM f LEFT JOIN m USING (team, f)"""


def w13_forward_label(spark, d):
    u = units(spark, d).select("entity", "unit", "day", (F.col("is_hr") > 0).cast("int").alias("got"))
    return windows.forward_max(u, ["entity"], ["day", "unit"], "got")


SQL["w13_forward_label"] = f"WITH {UNITS}, f AS (SELECT entity, unit, day, CAST(is_hr > 0 AS INT) AS got, max(CAST(is_hr > 0 AS INT)) OVER (PARTITION BY entity ORDER BY day, unit ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS label FROM u) SELECT * FROM f WHERE label IS NOT NULL"


def w14_tiers(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return windows.quantile_tiers(p, "p_retailprice", "p_partkey", 3)


SQL["w14_tiers"] = "WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part) SELECT p_partkey, p_retailprice, 1 + CAST(r > 1 + (n - 1) / 3.0 AS INT) + CAST(r > 1 + (n - 1) * 2 / 3.0 AS INT) AS tier FROM r"


def w15_dense_slots(spark, d):
    u = units(spark, d).groupBy((F.col("entity") % 5).alias("team"), "entity").agg(F.count("*").alias("starts"), F.min("n").alias("usual"))
    return windows.numbered(u, ["team"], ["usual", F.desc("starts"), "entity"], "slot")


SQL["w15_dense_slots"] = f"WITH {UNITS}, g AS (SELECT entity % 5 AS team, entity, count(*) AS starts, min(n) AS usual FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY team ORDER BY usual, starts DESC, entity) AS slot FROM g"


def w16_latest(spark, d):
    t = trials(spark, d).select("entity", *ORDER, "is_hit")
    return windows.latest(t, ["entity"], ORDER).select("entity", "day", "unit", "seq", "opponent", "is_hit")


SQL["w16_latest"] = f"WITH {TRIALS} SELECT entity, day, unit, seq, opponent, is_hit FROM t QUALIFY row_number() OVER (PARTITION BY entity ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) = 1"

QUERIES = {f.__name__: f for f in (w1_rolling_means, w3_season_rolling, w4_rolling_ratios, w6_rolling_rates, w8_matchup, w9_split_edge, w10_context, w11_fatigue, w12_history, w13_forward_label, w14_tiers, w15_dense_slots, w16_latest)}
