"""Registered joins, upserts, samples and splits with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, rates, windows
from ..sources import tables
from ..sources.shared import new_path
from .aggregates import SQL as AGGREGATES
from .aggregates import a13_group_rates
from .bindings import EVENTS, ORDER, ORDER_SQL, SLOTS, TRIALS, UNITS, raw_events, rounded, slots, table, trials, units

SQL: dict[str, str] = {}


def _daily(spark, d):
    """Orders and revenue of a nation's day."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("team"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("form"))


_DAILY = "dl AS (SELECT c_nationkey AS team, CAST(o_orderdate AS DATE) AS day, count(*) AS n, avg(o_totalprice) AS form FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def j1_opponent_features(spark, d):
    """A self-join on the partner's key and day, with differences."""
    a = _daily(spark, d).withColumn("partner", (F.col("team") + 12) % 25)
    b = _daily(spark, d).select(F.col("team").alias("partner"), "day", F.col("n").alias("n_partner"), F.col("form").alias("form_partner"))
    return rounded(a.join(b, ["partner", "day"]).withColumns({"strength_diff_n": F.col("n") - F.col("n_partner"), "strength_diff_form": F.col("form") - F.col("form_partner")}), 4)


SQL["j1_opponent_features"] = f"WITH {_DAILY} SELECT (a.team + 12) % 25 AS partner, a.day, a.team, a.n, round(a.form, 4) AS form, b.n AS n_partner, round(b.form, 4) AS form_partner, a.n - b.n AS strength_diff_n, round(a.form - b.form, 4) + 0.0 AS strength_diff_form FROM dl a JOIN dl b ON b.team = (a.team + 12) % 25 AND a.day = b.day"


def j2_attach_slots(spark, d):
    u = units(spark, d).select("entity", "unit", "day", "n")
    return u.join(slots(spark, d).select("day", "entity", "slot", "team"), ["day", "entity"], "left").withColumn("starter", F.coalesce((F.col("slot") <= 9).cast("int"), F.lit(0)))


SQL["j2_attach_slots"] = f"WITH {UNITS}, {SLOTS} SELECT day, entity, unit, n, slot, team, CASE WHEN slot <= 9 THEN 1 ELSE 0 END AS starter FROM u LEFT JOIN s USING (day, entity)"


def j4_training_frame(spark, d):
    """Totals joined with official lines under a suffix; what they miss counts as none."""
    u = units(spark, d).select("entity", "unit", "is_hit", "is_hr", "is_walk", "rbi")
    official = table(spark, d, "orders").where("o_orderkey % 5 != 0").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 3).alias("runs"), (F.col("o_orderkey") % 2).alias("rbi"))
    f = joins.guarded_join(u, official, ["entity", "unit"], "_official")
    return f.withColumns({"on_base": F.greatest(F.col("is_hit") + F.col("is_walk") - F.col("is_hr"), F.lit(0)), "hrr": F.col("is_hit") + F.col("runs_official") + F.col("rbi_official")})


SQL["j4_training_frame"] = f"WITH {UNITS}, o AS (SELECT o_custkey AS entity, o_orderkey AS unit, o_orderkey % 3 AS runs_official, o_orderkey % 2 AS rbi_official FROM orders WHERE o_orderkey % 5 <> 0) SELECT entity, unit, is_hit, is_hr, is_walk, rbi, runs_official, rbi_official, greatest(is_hit + is_walk - is_hr, 0) AS on_base, is_hit + runs_official + rbi_official AS hrr FROM u LEFT JOIN o USING (entity, unit)"


def j6_prior_season(spark, d):
    t = trials(spark, d)
    table_ = t.groupBy("opponent", F.year("day").alias("season")).agg(F.avg("is_walk").alias("control"))
    prior = table_.select("opponent", (F.col("season") + 1).alias("season"), F.col("control").alias("last_control"))
    rows = t.groupBy("opponent", "entity", F.year("day").alias("season")).agg(F.avg("is_walk").alias("own"))
    out = rows.join(prior, ["opponent", "season"], "left")
    return rounded(out.withColumns({"product": F.col("own") * F.col("last_control"), "season": F.col("season").cast("int")}), 8)


SQL["j6_prior_season"] = f"WITH {TRIALS}, p AS (SELECT opponent, year(day) + 1 AS season, avg(is_walk) AS last_control FROM t GROUP BY ALL), r AS (SELECT opponent, entity, year(day) AS season, avg(is_walk) AS own FROM t GROUP BY ALL) SELECT opponent, CAST(season AS INT) AS season, entity, round(own, 8) AS own, round(last_control, 8) AS last_control, round(own * last_control, 8) AS product FROM r LEFT JOIN p USING (opponent, season)"


def j9_precedence(spark, d):
    """What an opponent allows, by four levels: by split or its own (two thirds of them have figures), from the pool, or the league's; all but the last blended."""
    t = trials(spark, d)
    own = a13_group_rates(spark, d).where("opponent % 3 != 0").withColumn("is_hit_rate_R", F.when(F.col("opponent") % 5 != 0, F.col("is_hit_rate_R")))
    pooled = t.where("opponent % 2 = 0").groupBy("opponent").agg(F.avg("is_hit").alias("is_hit_pool"))
    residual = rates.residual_opponent(t.withColumn("crew", F.col("opponent") % 3), "unit", "side", "crew", F.col("seq") == 1, ORDER, ["is_hit"])
    facts = t.agg(F.avg("is_hit").alias("is_hit_league")).join(rounded(residual.select("primary_share", "is_hit_residual")))  # one row and one row
    rows = t.select("entity", "stand", F.when(F.col("unit") % 10 != 0, F.col("opponent")).alias("opponent")).distinct()
    return rounded(rates.opponent_rates(rows, own, pooled, facts, "opponent", "stand", ["L", "R"], ["is_hit"]))


SQL["j9_precedence"] = f"""WITH {TRIALS}, o AS ({AGGREGATES["a13_group_rates"]}), p AS (SELECT opponent, avg(is_hit) AS pool FROM t WHERE opponent % 2 = 0 GROUP BY opponent),
b AS ({AGGREGATES["a14_residual_opponent"]}), f AS (SELECT primary_share AS s, is_hit_residual AS r, (SELECT avg(is_hit) FROM t) AS league FROM b WHERE b."by" = 'crew'),
x AS (SELECT DISTINCT entity, stand, CASE WHEN unit % 10 <> 0 THEN opponent END AS opponent FROM t),
y AS (SELECT x.*, f.*, o.opponent IS NOT NULL AS own, CASE WHEN stand = 'L' THEN is_hit_rate_L WHEN o.opponent % 5 <> 0 THEN is_hit_rate_R END AS split, is_hit_rate AS whole, pool
  FROM x LEFT JOIN (SELECT * FROM o WHERE opponent % 3 <> 0) o ON o.opponent = x.opponent LEFT JOIN p ON p.opponent = x.opponent, f)
SELECT entity, stand, opponent, round(CASE WHEN own THEN s * coalesce(split, whole) + (1 - s) * r WHEN pool IS NOT NULL THEN s * pool + (1 - s) * r ELSE league END, 9) AS is_hit_allowed,
  CASE WHEN own AND split IS NOT NULL THEN 'split' WHEN own THEN 'own' WHEN pool IS NOT NULL THEN 'pool' ELSE 'league' END AS is_hit_origin FROM y"""


def j12_scored(spark, d):
    """Predictions against outcomes by entity and unit, with counts of what finds no partner on either side."""
    u = units(spark, d)
    said = u.where("unit % 7 != 0").select("entity", "unit", ((F.col("entity") % 7) / 10.0).alias("p"))
    did = u.where("unit % 11 != 0").select("entity", "unit", F.col("is_hit").alias("y"))
    j = said.join(did, ["entity", "unit"], "full")
    return rounded(j.agg(F.count_if(F.col("p").isNotNull() & F.col("y").isNotNull()).alias("matched"), F.count_if(F.col("y").isNull()).alias("no_outcome"), F.count_if(F.col("p").isNull()).alias("no_prediction"), F.avg(F.when(F.col("y").isNotNull(), F.col("p"))).alias("mean_p"), F.avg(F.when(F.col("p").isNotNull(), F.col("y"))).alias("mean_y")))


SQL["j12_scored"] = f"WITH {UNITS}, a AS (SELECT entity, unit, (entity % 7) / 10.0 AS p FROM u WHERE unit % 7 <> 0), b AS (SELECT entity, unit, is_hit AS y FROM u WHERE unit % 11 <> 0), j AS (SELECT p, y FROM a FULL JOIN b USING (entity, unit)) SELECT count(*) FILTER (p IS NOT NULL AND y IS NOT NULL) AS matched, count(*) FILTER (y IS NULL) AS no_outcome, count(*) FILTER (p IS NULL) AS no_prediction, round(avg(p) FILTER (y IS NOT NULL), 9) AS mean_p, round(avg(y) FILTER (p IS NOT NULL), 9) AS mean_y FROM j"


def j13_circular_ahead(spark, d):
    return rounded(joins.circular_neighbours(slots(spark, d), ["day", "lineup"], "slot", "metric", F.lit(0.31), ahead=True))


def j14_circular_behind(spark, d):
    return rounded(joins.circular_neighbours(slots(spark, d), ["day", "lineup"], "slot", "metric", F.lit(0.31), ahead=False))


for _name, _at in (("j13_circular_ahead", "((s.slot - k - 1 + 9) % 9) + 1"), ("j14_circular_behind", "((s.slot + k - 1) % 9) + 1")):
    SQL[_name] = f"WITH {SLOTS}, k AS (SELECT unnest([1, 2, 3]) AS k) SELECT s.day, s.lineup, s.entity, s.slot, s.team, round(s.metric, 9) AS metric, round(avg(coalesce(o.metric, 0.31)), 9) AS neighbours FROM s CROSS JOIN k LEFT JOIN s o ON o.day = s.day AND o.lineup = s.lineup AND o.slot = {_at} GROUP BY ALL"


def j21_slot_histogram(spark, d):
    u = units(spark, d).select("day", "entity").distinct()
    return slots(spark, d).select("day", "entity", "slot").join(u, ["day", "entity"]).groupBy("slot").agg(F.count("*").alias("n"))


SQL["j21_slot_histogram"] = f"WITH {UNITS}, {SLOTS} SELECT slot, count(*) AS n FROM s JOIN (SELECT DISTINCT day, entity FROM u) USING (day, entity) GROUP BY slot"


def j22_candidates(spark, d):
    """Both sides of a unit as rows: the posted list on even days, else the projected one where the club has one, else the first nine of its roster."""
    s = slots(spark, d)
    sides = s.groupBy("day", "lineup", "team").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "entity"))), lambda x: x["entity"]).alias("all"))
    club = lambda team: (F.dayofyear("day") + 7 * F.col("lineup") + 11 * team) % 25
    posted = F.when(F.dayofmonth("day") % 2 == 0, F.col("all"))
    sides = sides.select("day", "lineup", "team", club(F.col("team")).alias("club"), club(1 - F.col("team")).alias("opponent"), club(F.lit(0)).alias("home"), posted.alias("list"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("club"), F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), "c_acctbal")
    order = windows.numbered(c.where("club % 3 != 0"), ["club"], [F.desc("c_acctbal"), "entity"], "slot").where("slot <= 9")
    venues = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("home"), F.col("n_name").alias("venue"))
    out = joins.candidates(sides.join(F.broadcast(venues), "home", "left"), order, c.where("club % 6 != 5"), "club", "list", "entity", "slot", "name")  # nations
    return out.select("day", "lineup", "team", "club", "opponent", "venue", "status", "slot", "entity", "name")


SQL["j22_candidates"] = f"""WITH {SLOTS}, g AS (SELECT day, lineup, team, list(entity ORDER BY slot) AS l, (dayofyear(day) + 7 * lineup + 11 * team) % 25 AS club,
  (dayofyear(day) + 7 * lineup + 11 * (1 - team)) % 25 AS opponent, (dayofyear(day) + 7 * lineup) % 25 AS home FROM s GROUP BY ALL),
c AS (SELECT c_nationkey AS club, c_custkey AS entity, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS p,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
x AS (SELECT g.*, 'confirmed' AS status, unnest(range(1, len(l) + 1)) AS slot, unnest(l) AS entity FROM g WHERE day(day) % 2 = 0
  UNION ALL SELECT g.*, 'projected', p, entity FROM g JOIN c USING (club) WHERE day(day) % 2 = 1 AND club % 3 <> 0 AND p <= 9
  UNION ALL SELECT g.*, 'unknown', NULL, entity FROM g JOIN c USING (club) WHERE day(day) % 2 = 1 AND club % 3 = 0 AND club % 6 <> 5 AND r <= 9)
SELECT day, lineup, team, CAST(x.club AS INT) AS club, CAST(opponent AS INT) AS opponent, n_name AS venue, status, CAST(slot AS INT) AS slot, x.entity, coalesce(c.name, CAST(x.entity AS VARCHAR)) AS name
FROM x JOIN nation ON n_nationkey = home LEFT JOIN c ON c.club = x.club AND c.entity = x.entity AND c.club % 6 <> 5"""


def s17_upsert(spark, d):
    """Old and refetched rows by key, the refetched winning; then the wanted keys without sentinels."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("v"))
    have = o.where("o_orderkey % 3 != 0").withColumn("v", F.when(F.col("o_orderkey") % 10 == 0, -1.0).otherwise(F.col("v")))
    fresh = o.where("o_orderkey % 3 = 0 or o_orderkey % 20 = 0")
    wanted = o.where("o_custkey % 2 = 0").select("o_orderkey")
    return joins.upsert(have, fresh, ["o_orderkey"], wanted, F.col("v") < 0)


SQL["s17_upsert"] = "WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN -1.0 ELSE o_totalprice END AS v, 0 AS l FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 20 = 0), x AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l DESC) = 1) SELECT o_orderkey, o_custkey, v FROM x WHERE o_custkey % 2 = 0 AND v >= 0"


def s21_top_up(spark, d):
    e = raw_events(spark, d).select("event_id", "user_id", "day", F.col("value").alias("v"))
    have, new = e.where("day < date '2024-01-20' or user_id % 3 = 0"), e.withColumn("v", F.col("v") + 1)
    return rounded(joins.top_up(have, new, "user_id", "day", ["event_id"]), 6)


SQL["s21_top_up"] = f"WITH {EVENTS}, h AS (SELECT event_id, user_id, day, value AS v FROM e WHERE day < DATE '2024-01-20' OR user_id % 3 = 0), m AS (SELECT user_id, max(day) - 1 AS mark FROM h GROUP BY user_id), n AS (SELECT event_id, e.user_id, day, value + 1 AS v FROM e LEFT JOIN m USING (user_id) WHERE mark IS NULL OR day >= mark), b AS (SELECT *, 0 AS l FROM h UNION ALL SELECT *, 1 FROM n) SELECT event_id, user_id, day, round(v, 6) AS v FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY l DESC) = 1"


def s22_refresh(spark, d):
    """Orders land as a folder of JSON lines a month, some with torn lines: whole months load or stay as they were, and only loaded ones are stamped."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    line = F.to_json(F.struct("o_orderkey", "day", "o_totalprice"))
    torn = (F.month("day") % 5 == 0) & (F.col("o_orderkey") % 4 == 0)
    path = new_path(spark, "landing")
    o.where("month(day) != 7").select("month", F.when(torn, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.partitionBy("month").text(path)
    rows, status = tables.load_isolated(spark, path, "o_orderkey bigint, day date, o_totalprice double", "month", "day")
    have = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0))
    log = o.select("month", F.to_date(F.lit("1990-01-01")).alias("checked")).where("month < '1995-01'").distinct()
    table_now, log_now = tables.refreshed(have, rows, status, log, "month", "day", ["month", "o_orderkey"], F.to_date(F.lit("2000-01-01")))
    sums = table_now.groupBy("month").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(sums.join(status.select("month", "loaded", "broken"), "month", "left").join(log_now, "month", "left"), 2)


SQL["s22_refresh"] = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
l AS (SELECT month, count_if(month(day) % 5 = 0 AND o_orderkey % 4 = 0) AS broken FROM o WHERE month(day) <> 7 GROUP BY month),
m AS (SELECT month, max(day) - 1 AS mark FROM o WHERE o_orderkey % 3 = 0 GROUP BY month),
f AS (SELECT o.* FROM o JOIN l USING (month) LEFT JOIN m USING (month) WHERE broken = 0 AND (mark IS NULL OR day >= mark)),
a AS (SELECT month, v FROM f UNION ALL SELECT month, 0.0 FROM o WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM f))
SELECT month, count(*) AS n, round(sum(v), 2) AS total, broken = 0 AS loaded, broken,
  CASE WHEN broken = 0 THEN DATE '2000-01-01' WHEN month < '1995-01' THEN DATE '1990-01-01' END AS checked FROM a LEFT JOIN l USING (month) GROUP BY month, broken"""


def s8_complete_units(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return joins.complete_units(line, ["l_orderkey"], "l_quantity", 54).groupBy("l_orderkey", "complete").agg(F.count("*").alias("n"))


SQL["s8_complete_units"] = "SELECT l_orderkey, sum(l_quantity) >= 54 AS complete, count(*) AS n FROM lineitem GROUP BY l_orderkey"


def s24_stale(spark, d):
    log = table(spark, d, "orders").where("o_custkey % 4 != 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("date")).alias("checked"))
    return joins.stale(table(spark, d, "customer").select("c_custkey"), log, "c_custkey", "checked", F.to_date(F.lit("1998-08-01")), 60)


SQL["s24_stale"] = "WITH l AS (SELECT o_custkey AS c_custkey, max(CAST(o_orderdate AS DATE)) AS checked FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1) SELECT c_custkey FROM customer LEFT JOIN l USING (c_custkey) WHERE checked IS NULL OR date_diff('day', checked, DATE '1998-08-01') > 60"


def s25_committed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), F.col("o_totalprice").alias("v"))
    old, fresh = o.where("o_orderkey % 4 != 0"), o.where("o_orderkey % 6 != 0").withColumn("v", F.lit(0.0))
    return joins.keep_committed(old, fresh, "o_orderkey", "start", F.to_date(F.lit("1995-06-01")))


SQL["s25_committed"] = "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, o_totalprice AS v FROM orders), k AS (SELECT * FROM o WHERE o_orderkey % 4 <> 0 AND start <= DATE '1995-06-01') SELECT * FROM k UNION ALL SELECT o_orderkey, start, 0.0 FROM o WHERE o_orderkey % 6 <> 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM k)"


def l1_top_k(spark, d):
    u = units(spark, d).groupBy("entity").agg(F.sum("certain").alias("total"))
    top = u.orderBy(F.desc("total"), "entity").limit(10).withColumn("end", F.lit("top"))
    return top.unionByName(u.orderBy("total", "entity").limit(5).withColumn("end", F.lit("bottom")))


SQL["l1_top_k"] = f"WITH {UNITS}, g AS (SELECT entity, sum(certain) AS total FROM u GROUP BY entity) SELECT * FROM (SELECT entity, total, 'top' AS \"end\" FROM g ORDER BY total DESC, entity LIMIT 10) UNION ALL SELECT * FROM (SELECT entity, total, 'bottom' AS \"end\" FROM g ORDER BY total, entity LIMIT 5)"


def l2_stratified_sample(spark, d):
    p = table(spark, d, "part").where("p_size >= 5").select("p_partkey", "p_retailprice")
    return joins.hashed_sample(windows.quantile_tiers(p, "p_retailprice", "p_partkey", 3), "tier", "p_partkey", 20, 7)


SQL["l2_stratified_sample"] = "WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part WHERE p_size >= 5), q AS (SELECT p_partkey, p_retailprice, 1 + CAST(r > 1 + (n - 1) / 3.0 AS INT) + CAST(r > 1 + (n - 1) * 2 / 3.0 AS INT) AS tier FROM r) SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY tier ORDER BY md5(concat_ws('|', CAST(p_partkey AS VARCHAR), '7')), p_partkey) <= 20"


def l3_time_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return joins.time_split(o, ["day", "o_orderkey"], [0.6, 0.15])


SQL["l3_time_split"] = "WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, day, CAST(r > floor(n * 0.6) AS INT) + CAST(r > floor(n * 0.75) AS INT) AS part FROM r"


def l5_quantile_split(spark, d):
    return joins.quantile_split(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), "day", 0.75)


SQL["l5_quantile_split"] = "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders) SELECT o_orderkey, day, CAST(n > (SELECT quantile_cont(n, 0.75) FROM o) AS INT) AS test FROM o"


def l7_key_sets(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return joins.missing(b, a, ["k"]).withColumn("origin", F.lit("missing")).unionByName(b.join(a, "k", "left_semi").withColumn("origin", F.lit("have")))


SQL["l7_key_sets"] = "SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'have' ELSE 'missing' END AS origin FROM customer"

QUERIES = {f.__name__: f for f in (j1_opponent_features, j2_attach_slots, j4_training_frame, j6_prior_season, j9_precedence, j12_scored, j13_circular_ahead, j14_circular_behind, j21_slot_histogram, j22_candidates, s8_complete_units, s17_upsert, s21_top_up, s22_refresh, s24_stale, s25_committed, l1_top_k, l2_stratified_sample, l3_time_split, l5_quantile_split, l7_key_sets)}
