"""Registered frames that models and grading start from, with their SQL: sizes, seasons before, official lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, models
from ..sources.shared import staged
from .bindings import ORDER, ORDER_SQL, TRIALS, UNITS, rounded, table, trials, units
from .windowed import _guard

SQL: dict[str, str] = {}


def m5_size_frame(spark, d):
    """What a unit's size is told from: slot and its square, home, and the means of the entity's and the team's earlier units, for starters with a slot."""
    u = units(spark, d).select("entity", "unit", "day", "n", (F.col("entity") % 5).alias("team"), ((F.col("entity") + F.col("unit")) % 12).alias("at"))
    u = u.withColumns({"starts": (F.col("unit") % 10 != 0).cast("int"), "home": (F.col("unit") % 2).cast("int")})
    out = models.size_frame(u, "entity", "team", "day", "unit", "n", "at", "starts", "home")
    return rounded(out.select("entity", "unit", "day", "team", *models.SIZE_FEATURES, "size"), 8)


SQL["m5_size_frame"] = f"""WITH {UNITS}, o AS (SELECT entity, unit, day, n, entity % 5 AS team, {_guard('n', 'avg', 20, 3, 'entity', 'day, unit')} AS own_mean FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, unit, entity) AS r FROM o),
f AS (SELECT *, min(r) OVER (PARTITION BY team, day) AS f FROM r),
m AS (SELECT a.team, a.f, avg(b.n) AS mean, count(*) AS c FROM (SELECT DISTINCT team, f FROM f) a JOIN f b ON a.team = b.team AND b.r BETWEEN a.f - 50 AND a.f - 1 GROUP BY ALL)
SELECT entity, unit, day, team, CAST((entity + unit) % 12 AS DOUBLE) AS slot, CAST(((entity + unit) % 12) ** 2 AS DOUBLE) AS slot_sq, CAST(unit % 2 AS DOUBLE) AS is_home, round(own_mean, 8) AS own_mean,
  round(CASE WHEN c >= 5 THEN mean ELSE own_mean END, 8) AS team_mean, CAST(least(greatest(n, 1), 6) AS INT) AS size
FROM f LEFT JOIN m USING (team, f) WHERE unit % 10 <> 0 AND (entity + unit) % 12 BETWEEN 1 AND 9 AND own_mean IS NOT NULL"""


def j8_opponent_and_venue(spark, d):
    """Units with their first opponent's rates of the season before and their venue's factor, complete rows only."""
    t = trials(spark, d)
    first = t.where("unit % 9 != 0").groupBy("unit").agg(F.min_by("opponent", F.struct(*ORDER)).alias("opponent"))  # some units have no facts
    place = table(spark, d, "supplier").select(F.col("s_suppkey").alias("opponent"), F.col("s_nationkey").alias("venue"))
    meta = first.join(place, "opponent", "left")
    by_season = t.groupBy("opponent", F.year("day").alias("season")).agg(F.avg("is_hit").alias("hit_allowed"), F.avg("is_walk").alias("walk_allowed"))
    factor = F.when(F.col("venue") % 5 != 0, 0.9 + (F.col("venue") % 7) / 20.0).otherwise(1.0)
    rows = units(spark, d).select("entity", "unit", "day", "n", "is_hit")
    out = joins.with_prior_season(rows, meta, by_season, "unit", "day", "opponent", "season", factor, ["hit_allowed", "walk_allowed"])
    return rounded(out.select("entity", "unit", "day", "n", "is_hit", "opponent", "venue", "venue_factor", "hit_allowed", "walk_allowed"), 8)


SQL["j8_opponent_and_venue"] = f"""WITH {UNITS}, m AS (SELECT unit, arg_min(opponent, row({ORDER_SQL})) AS opponent FROM t WHERE unit % 9 <> 0 GROUP BY unit),
p AS (SELECT opponent, year(day) + 1 AS season, avg(is_hit) AS hit_allowed, avg(is_walk) AS walk_allowed FROM t GROUP BY ALL)
SELECT entity, u.unit, day, n, is_hit, m.opponent, s_nationkey AS venue, round(CASE WHEN s_nationkey % 5 <> 0 THEN 0.9 + (s_nationkey % 7) / 20.0 ELSE 1 END, 8) AS venue_factor,
  round(hit_allowed, 8) AS hit_allowed, round(walk_allowed, 8) AS walk_allowed
FROM u JOIN m ON u.unit = m.unit LEFT JOIN supplier ON s_suppkey = m.opponent JOIN p ON p.opponent = m.opponent AND p.season = year(day)"""


def e13_actuals(spark, d):
    """Outcomes of the units since 1997 with official lines fetched anew: a line stored while its unit was under way is not graded; by day, with what has no line."""
    u = staged(units(spark, d).select("entity", "unit", "day", "is_hit", "rbi", "certain"), "actual-units")
    store = u.select("entity", "unit", F.floor(F.col("is_hit") / 2).alias("hits"), F.lit(0).cast("long").alias("driven"))  # as it stood under way
    fetched = u.where("unit % 13 != 0").select("entity", "unit", F.col("is_hit").alias("hits"), F.col("rbi").alias("driven"))  # some are not final yet
    graded, after = joins.actuals(u.where("day >= '1997-01-01'"), store, fetched, ["entity", "unit"], "unit")
    stored = after.agg(F.count("*").alias("stored"), F.sum("hits").alias("stored_hits"))
    by_day = graded.groupBy("day").agg(F.count("*").alias("n"), F.count("hits").alias("official"), F.sum("hits").alias("hits"), F.sum("driven").alias("driven"), F.avg(F.col("hits") + F.col("driven")).alias("mean"))
    return rounded(by_day.join(F.broadcast(stored)), 8)  # one row


SQL["e13_actuals"] = f"""WITH {UNITS}, g AS (SELECT day, unit, CASE WHEN unit % 13 <> 0 THEN is_hit END AS hits, CASE WHEN unit % 13 <> 0 THEN rbi END AS driven FROM u WHERE day >= DATE '1997-01-01'),
s AS (SELECT hits FROM g WHERE hits IS NOT NULL UNION ALL SELECT is_hit // 2 FROM u WHERE day < DATE '1997-01-01')
SELECT day, count(*) AS n, count(hits) AS official, sum(hits) AS hits, sum(driven) AS driven, round(avg(hits + driven), 8) AS mean, (SELECT count(*) FROM s) AS stored, (SELECT sum(hits) FROM s) AS stored_hits FROM g GROUP BY day"""


QUERIES = {f.__name__: f for f in (m5_size_frame, j8_opponent_and_venue, e13_actuals)}
