"""Registered queries over JSON texts that Spark makes from the given tables, stored tables, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import landed, tables
from ..sources.shared import new_path
from ..streaming import jobs
from .bindings import EVENTS, SLOTS, TRIALS, raw_events, rounded, slots, table, trials

SQL: dict[str, str] = {}


def _boxscores(spark, d):
    """A JSON text for each unit: players by side with an order and counts as texts, some of them broken."""
    t = trials(spark, d).groupBy("unit", "side", "opponent").agg(F.count("*").alias("pa"), F.sum("is_hit").alias("hits"))
    player = F.struct(
        F.struct(F.when(F.col("opponent") % 10 != 0, F.col("opponent")).alias("id")).alias("person"),
        F.when(F.col("opponent") % 7 == 0, "none").otherwise(((F.col("opponent") % 9 + 1) * 100 + F.col("opponent") % 2).cast("string")).alias("battingOrder"),
        F.create_map(F.lit("pa"), F.when(F.col("opponent") % 4 == 0, "0").otherwise(F.col("pa").cast("string")), F.lit("hits"), F.when(F.col("opponent") % 3 == 0, "x").otherwise(F.col("hits").cast("string"))).alias("stats"),
    )
    side = t.groupBy("unit", "side").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("ID"), F.col("opponent").cast("string")), player))).alias("players"))
    both = side.groupBy("unit").agg(F.first(F.when(F.col("side") == 0, F.struct("players")), True).alias("home"), F.first(F.when(F.col("side") == 1, F.struct("players")), True).alias("away"))
    return both.select("unit", F.to_json(F.struct(F.struct("home", "away").alias("teams"))).alias("json"))


_BOX = f"WITH {TRIALS}, b AS (SELECT unit, side, opponent, count(*) AS pa, sum(is_hit) AS hits FROM t GROUP BY ALL)"


def s7_unit_lines(spark, d):
    return landed.unit_lines(_boxscores(spark, d), "unit", "json", ["pa", "hits"])


SQL["s7_unit_lines"] = f"{_BOX} SELECT unit, opponent AS player_id, CAST(pa AS INT) AS pa, CAST(CASE WHEN opponent % 3 = 0 THEN 0 ELSE hits END AS INT) AS hits FROM b WHERE opponent % 10 <> 0 AND opponent % 4 <> 0"


def s9_slots(spark, d):
    return landed.slots(_boxscores(spark, d), "unit", "json")


SQL["s9_slots"] = f"{_BOX} SELECT unit, opponent AS player_id, CAST(opponent % 9 + 1 AS INT) AS slot, CAST(opponent % 2 = 0 AS INT) AS starter FROM b WHERE opponent % 10 <> 0 AND opponent % 7 <> 0"


def s10_context(spark, d):
    e = raw_events(spark, d)
    j = F.to_json(F.struct(F.struct((F.col("user_id") % 30).alias("id"), F.concat(F.lit("v"), (F.col("user_id") % 30).cast("string")).alias("name")).alias("venue"), F.when(F.col("k") % 2 == 0, "day").otherwise("night").alias("dayNight"), F.struct(F.when(F.col("k") % 5 == 0, "warm").otherwise(F.col("k").cast("string")).alias("temp"), F.lit("Calm").alias("wind")).alias("weather")))
    return landed.context(e.select("event_id", j.alias("json")), "event_id", "json")


SQL["s10_context"] = f"WITH {EVENTS} SELECT event_id, CAST(user_id % 30 AS BIGINT) AS venue_id, 'v' || (user_id % 30) AS venue, CASE WHEN k % 2 = 0 THEN 'day' ELSE 'night' END AS day_night, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS temp, 'Calm' AS wind FROM e"


def s11_schedule(spark, d):
    """Games of a day as one JSON text, flattened; then P24 on top and each team's opposing starter."""
    o = table(spark, d, "orders")
    side = lambda n: F.struct(F.concat(F.lit(n), (F.col("o_custkey") % 9).cast("string")).alias("team"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("p"), F.lit(n))).alias("probable"), F.when(F.col("o_orderkey") % 4 != 0, F.array(F.struct(F.col("o_custkey").alias("id")))).alias("lineup"))
    game = F.struct(F.col("o_orderkey").alias("gamePk"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("gameDate"), side("h").alias("home"), side("a").alias("away"))
    text = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.to_json(F.struct(F.collect_list(game).alias("games"))).alias("json"))
    games = landed.schedule(text, "json")
    status = landed.posted(games, F.to_timestamp(F.lit("1992-01-01 00:00:00")))
    away = landed.starters(games.select("home_team", "away_probable", "away_team", "home_probable")).groupBy("team").agg(F.count("*").alias("games"))
    return games.join(status, "game").join(away, games["home_team"] == away["team"]).select("game", "home_team", "away_team", "home_probable", F.size("home_lineup").alias("home_n"), "posted", "tbd", "hours_to_first", "games")


SQL["s11_schedule"] = "WITH g AS (SELECT o_orderkey AS game, 'h' || (o_custkey % 9) AS home_team, 'a' || (o_custkey % 9) AS away_team, CASE WHEN o_orderkey % 5 <> 0 THEN 'ph' ELSE 'TBD' END AS home_probable, CAST(o_orderkey % 4 <> 0 AS INT) AS home_n, o_orderkey % 4 <> 0 AS posted, CASE WHEN o_orderkey % 5 <> 0 THEN 0 ELSE 2 END AS tbd, o_orderdate FROM orders), c AS (SELECT home_team, count(*) AS games FROM g GROUP BY 1) SELECT game, g.home_team, away_team, home_probable, home_n, posted, tbd, (SELECT date_diff('second', TIMESTAMP '1992-01-01', CAST(min(o_orderdate) AS TIMESTAMP)) / 3600.0 FROM g) AS hours_to_first, games FROM g JOIN c USING (home_team)"


def s12_season_table(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    stat = F.struct(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 6 == 0, "P").when(k % 6 != 1, "OF").alias("position"), F.when(k % 13 == 0, "-").otherwise((k % 600).cast("string")).alias("pa"), F.lit("0.25").alias("avg"), F.lit("0.31").alias("obp"), ((k % 10) / 20.0).cast("string").alias("slg"), F.when(k % 4 != 0, ((k % 10) / 10.0).cast("string")).alias("ops"))
    text = c.groupBy(F.floor(k / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(stat).alias("stats"))).alias("json"))
    return rounded(landed.season_table(text, "json").select("id", "name", "pa", "ops", "iso"), 6)


SQL["s12_season_table"] = "SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 600 AS DOUBLE) AS pa, round(CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 10) / 10.0 ELSE (c_custkey % 10) / 20.0 + 0.31 END, 6) AS ops, round((c_custkey % 10) / 20.0 - 0.25, 6) + 0.0 AS iso FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 13 <> 0"


def s1_csv_table(spark, d):
    """A table through a CSV file, S5's pool semi-join and defaults for absent columns on the way."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    pool = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.with_default_columns(tables.round_trip_csv(tables.of_pool(o, pool, "o_custkey")), {"stand": F.lit("R"), "o_custkey": F.lit(-1)})


SQL["s1_csv_table"] = "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, 'R' AS stand FROM orders WHERE o_custkey % 3 = 0"


def s3_distinct_ids(spark, d):
    """Only the id column is read."""
    return table(spark, d, "lineitem").select("l_orderkey").where("l_orderkey is not null").distinct()


SQL["s3_distinct_ids"] = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL"


def s27_replace_dates(spark, d):
    """A scored log by day: a second write replaces the days it holds, others stay; then S29's list of days."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit(1).alias("run"))
    path = new_path(spark, "log")
    tables.replace_dates(o, path, "day")
    tables.replace_dates(o.where("day >= '1995-02-01'").withColumn("run", F.lit(2)), path, "day")
    return spark.read.option("basePath", path).parquet(path).groupBy(F.col("day").cast("string").alias("day"), "run").agg(F.count("*").alias("n"))


SQL["s27_replace_dates"] = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderdate >= '1995-02-01' THEN 2 ELSE 1 END AS run, count(*) AS n FROM orders GROUP BY ALL"


def s26_batch_output(spark, d):
    """A scoring batch's rows in (unit, slot) order, empty slots last, with their number."""
    s = slots(spark, d).select("day", "lineup", "entity", F.when(F.col("slot") <= 7, F.col("slot")).alias("slot"))
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("day", "lineup").orderBy(F.asc_nulls_last("slot"), "entity"))
    return s.withColumn("line", n).orderBy("day", "lineup", F.asc_nulls_last("slot"), "entity")


SQL["s26_batch_output"] = f"WITH {SLOTS} SELECT day, lineup, entity, CASE WHEN slot <= 7 THEN slot END AS slot, row_number() OVER (PARTITION BY day, lineup ORDER BY CASE WHEN slot <= 7 THEN slot END NULLS LAST, entity) AS line FROM s"


def st1_ingest(spark, d):
    e = jobs.stream_of(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.ingest(e, ["event_id"], "ts", "40 days").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


SQL["st1_ingest"] = "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1"


def st1_upsert(spark, d):
    e = jobs.stream_of(spark, d, "events.parquet").select("user_id", "event_id", "ts", "event_type")
    return jobs.upserted(e, ["user_id"], "ts").select("user_id", "event_id", "event_type")


SQL["st1_upsert"] = "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id"


def st2_late_rows(spark, d):
    """Events that land out of order in three loads, a day's lateness allowed: the accepted, repeated and rejected rows of each load."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = new_path(spark, "landing"), new_path(spark, "counted")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1, F.col("event_id") % 2 == 0):
        e.where(part).write.mode("append").parquet(folder)
        counts = jobs.ingest_counted(spark.readStream.schema(e.schema).parquet(folder), ["event_id"], "ts", 1, out)[2]
    return counts


_LOADS = ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 2 = 0"]
_LATE = "ts::TIMESTAMP < {0} - INTERVAL 1 DAY"
SQL["st2_late_rows"] = f"""WITH e AS (SELECT event_id, ts::TIMESTAMP AS ts FROM events), m0 AS (SELECT max(ts) AS m FROM e WHERE {_LOADS[0]}), m1 AS (SELECT max(ts) AS m FROM e WHERE {_LOADS[0]} OR {_LOADS[1]}),
a0 AS (SELECT DISTINCT event_id FROM e WHERE {_LOADS[0]}),
l1 AS (SELECT *, {_LATE.format("m")} AS late FROM e, m0 WHERE {_LOADS[1]}), a1 AS (SELECT DISTINCT event_id FROM l1 WHERE NOT late),
l2 AS (SELECT *, {_LATE.format("m")} AS late FROM e, m1 WHERE {_LOADS[2]}), a2 AS (SELECT DISTINCT event_id FROM l2 WHERE NOT late AND event_id NOT IN (SELECT event_id FROM a0) AND event_id NOT IN (SELECT event_id FROM a1))
SELECT 0::BIGINT AS batch, (SELECT count(*) FROM a0) AS accepted, (SELECT count(*) FROM e WHERE {_LOADS[0]}) - (SELECT count(*) FROM a0) AS repeated, 0::BIGINT AS rejected
UNION ALL SELECT 1, (SELECT count(*) FROM a1), count(*) - count_if(late) - (SELECT count(*) FROM a1), count_if(late) FROM l1
UNION ALL SELECT 2, (SELECT count(*) FROM a2), count(*) - count_if(late) - (SELECT count(*) FROM a2), count_if(late) FROM l2"""


def st3_gate(spark, d):
    e = jobs.stream_of(spark, d, "events.parquet")
    return rounded(jobs.gate(e, ["user_id"], "value", 54.0), 5)


SQL["st3_gate"] = "SELECT user_id, round(sum(value), 5) AS amount FROM events GROUP BY user_id HAVING sum(value) >= 54"


def st4_upgrade(spark, d):
    e = jobs.stream_of(spark, d, "events.parquet").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", "confirmed").otherwise("projected").alias("status"))
    return jobs.upgraded(e, "user_id", "status", "ts").select("user_id", "event_id", "status")


SQL["st4_upgrade"] = "WITH s AS (SELECT user_id, event_id, ts, event_type = 'signup' AS c FROM events) SELECT user_id, event_id, CASE WHEN c THEN 'confirmed' ELSE 'projected' END AS status FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, ts DESC) = 1"


def st5_totals(spark, d):
    return rounded(jobs.totals(jobs.stream_of(spark, d, "events.parquet"), "event_type", "value"), 5)


SQL["st5_totals"] = "SELECT event_type, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY 1"

QUERIES = {f.__name__: f for f in (s1_csv_table, s3_distinct_ids, s7_unit_lines, s9_slots, s10_context, s11_schedule, s12_season_table, s26_batch_output, s27_replace_dates, st1_ingest, st1_upsert, st2_late_rows, st3_gate, st4_upgrade, st5_totals)}
