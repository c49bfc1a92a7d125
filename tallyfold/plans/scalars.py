"""Registered text, date and profile queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import names
from .bindings import EVENTS, UNITS, raw_events, rounded, table, units

SQL: dict[str, str] = {}


def f1_names(spark, d):
    """Customers' names, written with other case and accents, back to ids."""
    c = table(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Ana"), (F.col("c_custkey") % 5).cast("string")).alias("first"), F.concat(F.lit("Nuñez"), (F.col("c_custkey") % 50).cast("string")).alias("last"), (F.col("c_custkey") % 13).alias("played_last"))
    wanted = people.select(F.upper("first").alias("first"), F.translate("last", "ñ", "n").alias("last"))
    return names.resolve_names(wanted, people)


SQL["f1_names"] = "WITH p AS (SELECT c_custkey AS id, upper('Ana' || (c_custkey % 5)) AS first, 'Nunez' || (c_custkey % 50) AS last, c_custkey % 13 AS played FROM customer), w AS (SELECT DISTINCT first, last FROM p) SELECT w.first, w.last, arg_max(id, row(p.first = w.first, played, id)) AS id FROM w JOIN p ON p.last = w.last AND (p.first = w.first OR starts_with(p.first, left(w.first, 3))) GROUP BY ALL"


def f2_schedule_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    written = F.concat(F.date_format("o_orderdate", "EEEE, MMM d"), F.when(F.col("o_orderkey") % 3 == 0, " (2)").otherwise(""))
    written = F.when(F.col("o_orderkey") % 17 == 0, "to be told").otherwise(written)
    return o.select("o_orderkey", text.season_date(written, F.year("o_orderdate")).alias("day"), text.game_of_day(written).alias("game"))


SQL["f2_schedule_dates"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS game FROM orders"


def f3_game_log(spark, d):
    """Numbers from text, complete rows only, a win from the first letter."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise((F.col("o_orderkey") % 12).cast("string")).alias("r"), (F.col("o_custkey") % 10).cast("string").alias("ra"), F.when(F.col("o_orderkey") % 2 == 0, "W-wo").otherwise("L").alias("wl"))
    n = o.withColumns({"r": F.col("r").try_cast("int"), "ra": F.col("ra").try_cast("int"), "win": F.startswith("wl", F.lit("W")).cast("int")}).dropna(subset=["r", "ra"])
    return n.select("o_orderkey", "r", "ra", "win", (F.col("r") - F.col("ra")).alias("run_diff"))


SQL["f3_game_log"] = "SELECT o_orderkey, CAST(o_orderkey % 12 AS INT) AS r, CAST(o_custkey % 10 AS INT) AS ra, CAST(o_orderkey % 2 = 0 AS INT) AS win, CAST(o_orderkey % 12 - o_custkey % 10 AS INT) AS run_diff FROM orders WHERE o_orderkey % 9 <> 0"


def f5_wind(spark, d):
    """Speed and directions from a text, and the handed wind."""
    e = raw_events(spark, d)
    phrase = F.element_at(F.array(*(F.lit(x) for x in ("Out To CF", "In From CF", "R To L", "L To R", "Calm", "Out To LF", "Varies"))), (F.col("user_id") % 7 + 1).cast("int"))
    wind = F.when(F.col("user_id") % 8 == 0, None).otherwise(F.concat(F.coalesce("k", F.lit(0)).cast("string"), F.lit(" mph, "), phrase))
    speed, out, left = text.wind_parts(wind)
    return rounded(e.select("event_id", speed.alias("speed"), out.alias("out"), left.alias("left_"), (left * F.when(F.col("user_id") % 2 == 0, -1).otherwise(1)).alias("handed")), 6)


SQL["f5_wind"] = f"""WITH {EVENTS}, x AS (SELECT event_id, user_id, CASE WHEN user_id % 8 = 0 THEN 0.0 ELSE coalesce(k, 0) END AS s, user_id % 7 AS c FROM e),
y AS (SELECT *, s * CASE c WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 5 THEN 0.7 ELSE 0 END AS o, s * CASE c WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 5 THEN 0.7 ELSE 0 END AS l FROM x)
SELECT event_id, round(s, 6) AS speed, round(o, 6) + 0.0 AS "out", round(l, 6) + 0.0 AS left_, round(l * CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END, 6) + 0.0 AS handed FROM y"""


def f6_labels(spark, d):
    """Clock (F7: in another zone), percent and context labels."""
    e = raw_events(spark, d)
    return e.select("event_id", text.clock(F.col("ts").cast("timestamp"), "America/New_York").alias("clock"), text.percent(F.col("k") / 100.0).alias("share"), text.context_line(F.col("event_type"), F.when(F.col("k") > 50, "high"), F.lit(" ")).alias("line"))


SQL["f6_labels"] = f"WITH {EVENTS} SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%-I:%M %p') AS clock, CASE WHEN k IS NULL THEN '-' ELSE printf('%.1f%%', k * 1.0) END AS share, event_type || CASE WHEN k > 50 THEN ' · high' ELSE '' END AS line FROM e"


def f12_lines(spark, d):
    """Columns that carry a line in their name, as rows."""
    u = units(spark, d).select("unit", "entity", (F.col("certain") > 0.5).cast("int").alias("over_0_5"), (F.col("certain") > 1.5).cast("int").alias("over_1_5"))
    long = u.unpivot(["unit", "entity"], ["over_0_5", "over_1_5"], "name", "hit")
    return long.select("unit", "entity", F.replace(F.regexp_extract("name", "^over_(.*)$", 1), F.lit("_"), F.lit(".")).cast("double").alias("line"), "hit")


SQL["f12_lines"] = f"WITH {UNITS} SELECT unit, entity, line, CAST(certain > line AS INT) AS hit FROM u, (SELECT CAST(unnest([0.5, 1.5]) AS DOUBLE) AS line)"


def s32_profile(spark, d):
    """How many values of each text column there are, are numbers, and are different."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey"))
    long = o.unpivot([], o.columns, "column", "v")
    return long.groupBy("column").agg(F.count("v").alias("n"), F.count(F.col("v").try_cast("double")).alias("numbers"), F.countDistinct("v").alias("different"), F.min("v").alias("least"))


SQL["s32_profile"] = "WITH l AS (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders) SELECT \"column\", count(v) AS n, count(TRY_CAST(v AS DOUBLE)) AS numbers, count(DISTINCT v) AS different, min(v) AS least FROM l GROUP BY 1"

QUERIES = {f.__name__: f for f in (f1_names, f2_schedule_dates, f3_game_log, f5_wind, f6_labels, f12_lines, s32_profile)}
