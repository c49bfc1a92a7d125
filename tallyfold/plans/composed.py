"""Registered queries that put several operators together, and the smaller ones, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as dist
from ..operators import evaluation, joins, rates, windows
from ..sources import tables
from ..sources.shared import new_path, staged
from .evaluated import PAIRED, sql_verdict, sql_weights
from .bindings import EVENTS, ORDER, ORDER_SQL, SLOTS, TRIALS, UNITS, raw_events, rounded, slots, table, trials, units

SQL: dict[str, str] = {}


def a4_contact_log(spark, d):
    """Flags of a measured outcome (P5), counted by entity and unit; a code decides where the column has any, else the formula."""
    t = trials(spark, d).select("entity", "unit", (F.col("quantity") * 2 + 20).alias("speed"), (F.col("part") % 60 - 10).alias("angle"), F.when(F.col("part") % 4 == 0, F.col("part") % 7).alias("code"))
    coded = t.agg((F.count("code") > 0).alias("coded"))
    formula = (F.col("speed") >= 98) & F.col("angle").between(F.greatest(F.lit(8), 26 - (F.col("speed") - 98)), F.least(F.lit(50), 30 + (F.col("speed") - 98)))
    barrel = F.when(F.col("coded"), F.coalesce(F.col("code") == 6, F.lit(False))).otherwise(formula)
    f = t.join(F.broadcast(coded)).withColumns({"barrel": barrel.cast("int"), "hard": (F.col("speed") >= 95).cast("int"), "air": (F.col("angle") >= 10).cast("int"), "formula": formula.cast("int")})
    g = f.groupBy("entity", "unit").agg(F.count("*").alias("balls"), F.sum("barrel").alias("barrels"), F.sum("formula").alias("formulas"), F.sum("hard").alias("hard"), F.sum("air").alias("air"), F.max("speed").alias("top"), F.avg(F.when(F.col("air") == 1, F.col("speed"))).alias("air_speed"))
    return rounded(g, 6)


SQL["a4_contact_log"] = f"WITH {TRIALS}, b AS (SELECT entity, unit, quantity * 2 + 20 AS s, part % 60 - 10 AS a, CASE WHEN part % 4 = 0 THEN part % 7 END AS c FROM t), f AS (SELECT *, s >= 98 AND a BETWEEN greatest(8, 26 - (s - 98)) AND least(50, 30 + (s - 98)) AS fo, (SELECT count(c) > 0 FROM b) AS coded FROM b) SELECT entity, unit, count(*) AS balls, sum(CAST(CASE WHEN coded THEN coalesce(c = 6, false) ELSE fo END AS INT)) AS barrels, sum(CAST(fo AS INT)) AS formulas, sum(CAST(s >= 95 AS INT)) AS hard, sum(CAST(a >= 10 AS INT)) AS air, max(s) AS top, round(avg(s) FILTER (a >= 10), 6) AS air_speed FROM f GROUP BY ALL"


def a11_run_factors(spark, d):
    """League share of extras, factors by slot (few: 1) and by entity, shrunk with the table's own strength (A12) and clipped."""
    u = units(spark, d).withColumns({"slot": F.col("entity") % 9, "extra": F.col("rbi"), "tob": F.col("reached_nonhr")})
    league = u.agg((F.sum("extra") / F.sum("tob")).alias("q"))
    of_slot = F.when(F.col("t") >= 100, F.try_divide(F.col("e"), F.col("t")) / F.col("q")).otherwise(1.0)
    by_slot = u.groupBy("slot").agg(F.sum("extra").alias("e"), F.sum("tob").alias("t")).join(F.broadcast(league)).select("slot", of_slot.alias("slot_factor"))
    placed = u.join(F.broadcast(by_slot), "slot").join(F.broadcast(league))
    own = placed.groupBy("entity", "slot", "q", "slot_factor").agg(F.sum("extra").alias("actual"), F.sum("tob").alias("tob"), F.sum(F.col("tob") * F.col("q") * F.col("slot_factor")).alias("expected"))
    strength = rates.ratio_strength(own, "actual", "expected", "tob", least=20, groups=30)
    k = F.col("strength") * F.col("q")
    shrunk = F.when(F.col("strength").isNull(), 1.0).otherwise((F.col("actual") + k) / (F.col("expected") + k))
    factor = F.least(F.greatest(shrunk, F.lit(0.7)), F.lit(1.35))
    return rounded(own.join(F.broadcast(strength)).select("entity", "slot", "slot_factor", factor.alias("factor"), "strength"), 6)


SQL["a11_run_factors"] = f"""WITH {UNITS}, b AS (SELECT entity, entity % 9 AS slot, rbi AS e, reached_nonhr AS t FROM u), l AS (SELECT sum(e) * 1.0 / sum(t) AS q FROM b),
s AS (SELECT slot, CASE WHEN sum(t) >= 100 THEN sum(e) * 1.0 / sum(t) / (SELECT q FROM l) ELSE 1 END AS f FROM b GROUP BY slot),
o AS (SELECT entity, slot, f, q, sum(e) AS a, sum(t) AS t, sum(t * q * f) AS x FROM b JOIN s USING (slot), l GROUP BY ALL),
m AS (SELECT count(*) AS g, var_samp(a / x) - (1 - any_value(q)) / any_value(q) * avg(1.0 / t) AS v, any_value(q) AS q FROM o WHERE t >= 20 AND x > 0),
z AS (SELECT CASE WHEN g < 30 THEN 260 WHEN v > 0 THEN (1 - q) / (q * v) END AS k FROM m)
SELECT entity, slot, round(f, 6) AS slot_factor, round(least(greatest(CASE WHEN k IS NULL THEN 1 ELSE (a + k * q) / (x + k * q) END, 0.7), 1.35), 6) AS factor, round(k, 6) AS strength FROM o, z"""


def a22_entity_rates(spark, d):
    """On-base rates of entities beside the league's, and the unit means that go with them."""
    t = trials(spark, d)
    league = t.agg((F.avg("is_hit") + F.avg("is_walk")).alias("league_obp"))
    own = t.groupBy("entity").agg((F.avg("is_hit") + F.avg("is_walk")).alias("obp"), F.count("*").alias("n"), F.avg("rbi").alias("rbi"), F.avg("reached").alias("reached"))
    return rounded(own.join(F.broadcast(league)).withColumn("thin", (F.col("n") < 150).cast("int")))


SQL["a22_entity_rates"] = f"WITH {TRIALS} SELECT entity, round(avg(is_hit) + avg(is_walk), 9) AS obp, count(*) AS n, round(avg(rbi), 9) AS rbi, round(avg(reached), 9) AS reached, round((SELECT avg(is_hit) + avg(is_walk) FROM t), 9) AS league_obp, CAST(count(*) < 150 AS INT) AS thin FROM t GROUP BY entity"


def a30_tier_summary(spark, d):
    p = windows.quantile_tiers(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_partkey", 3)
    return rounded(p.groupBy("tier").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.avg("p_size").alias("size")), 6)


SQL["a30_tier_summary"] = "WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part), q AS (SELECT *, 1 + CAST(r > 1 + (n - 1) / 3.0 AS INT) + CAST(r > 1 + (n - 1) * 2 / 3.0 AS INT) AS tier FROM r) SELECT tier, count(*) AS n, round(min(p_retailprice), 6) AS low, round(max(p_retailprice), 6) AS high, round(avg(p_size), 6) AS size FROM q GROUP BY tier"


def a31_first_opponent(spark, d):
    """Each unit's first opponent by the total order, and how many trials were against it."""
    t = trials(spark, d)
    first = t.groupBy("unit", "side").agg(F.min_by("opponent", F.struct(*ORDER)).alias("first"))
    return t.join(first, ["unit", "side"]).groupBy("unit", "side", "first").agg(F.count_if(F.col("opponent") == F.col("first")).alias("against"), F.count("*").alias("n"))


SQL["a31_first_opponent"] = f"WITH {TRIALS}, p AS (SELECT unit, side, arg_min(opponent, row({ORDER_SQL})) AS first FROM t GROUP BY unit, side) SELECT unit, side, first, count(*) FILTER (opponent = first) AS against, count(*) AS n FROM t JOIN p USING (unit, side) GROUP BY ALL"


def j3_unit_context(spark, d):
    """A dimension of the unit on every trial; unknown ones keep null."""
    t = trials(spark, d).select("entity", "unit", "opponent", "is_hit")
    context = table(spark, d, "supplier").where("s_suppkey % 4 != 0").select(F.col("s_suppkey").alias("opponent"), F.col("s_nationkey").alias("venue"))
    return t.join(context, "opponent", "left").groupBy("venue").agg(F.count("*").alias("n"), F.sum("is_hit").alias("hits"))


SQL["j3_unit_context"] = f"WITH {TRIALS} SELECT CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS venue, count(*) AS n, sum(is_hit) AS hits FROM t LEFT JOIN supplier ON s_suppkey = opponent AND s_suppkey % 4 <> 0 GROUP BY 1"


def j10_latest_state(spark, d):
    """Each entity's last trial with its career rate there, joined to a day's candidates (J11: the same for one)."""
    t = trials(spark, d)
    w = windows.prior(["entity"], ORDER)
    state = windows.latest(t.withColumn("career", F.avg("is_hit").over(w)).select("entity", *ORDER, "career"), ["entity"], ORDER)
    today = slots(spark, d).where("day = date '1997-03-03'").select("entity", "slot")
    return rounded(today.join(state.select("entity", "day", "unit", "career"), "entity"), 8)


SQL["j10_latest_state"] = f"WITH {TRIALS}, {SLOTS}, c AS (SELECT entity, day, unit, avg(is_hit) OVER (PARTITION BY entity ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS career, row_number() OVER (PARTITION BY entity ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS r FROM t) SELECT s.entity, slot, c.day, unit, round(career, 8) AS career FROM s JOIN c ON c.entity = s.entity AND r = 1 WHERE s.day = DATE '1997-03-03'"


def j16_value_map(spark, d):
    """A value for each key with a default for others, then J17's and J18's joins of groups of features."""
    t = trials(spark, d)
    rate = t.where("entity % 5 != 0").groupBy("entity").agg(F.avg("is_hit").alias("r"))
    u = units(spark, d).select("entity", "unit", "n")
    by_hand = t.groupBy("entity", "unit").agg(F.count_if(F.col("hand") == "L").alias("left_"), F.max("price").alias("top"))
    return rounded(u.join(rate, "entity", "left").withColumn("r", F.coalesce("r", F.lit(0.25))).join(by_hand, ["entity", "unit"], "left"), 8)


SQL["j16_value_map"] = f"WITH {UNITS}, r AS (SELECT entity, avg(is_hit) AS r FROM t WHERE entity % 5 <> 0 GROUP BY 1), h AS (SELECT entity, unit, count(*) FILTER (hand = 'L') AS left_, max(price) AS top FROM t GROUP BY ALL) SELECT entity, unit, n, round(coalesce(r, 0.25), 8) AS r, left_, round(top, 8) AS top FROM u LEFT JOIN r USING (entity) LEFT JOIN h USING (entity, unit)"


def j19_side_by_side(spark, d):
    """All rows' scores beside those of the clean ones, with the gap."""
    u = units(spark, d).select((F.col("is_hit") > 0).cast("int").alias("y"), (0.3 + F.col("n") / 12.0).alias("p"), (F.col("entity") % 3).cast("int").alias("label"), (F.col("unit") % 4 != 0).alias("clean"))
    every, clean = (evaluation.scores(x, ["label"]).select("label", "n", "brier", "skill") for x in (u, u.where("clean")))
    j = joins.guarded_join(every, clean, ["label"], "_clean")
    return rounded(j.withColumn("gap", F.col("skill") - F.col("skill_clean")), 8)


_SIDE = "count(*) AS n, avg((p - y) ** 2) AS brier, 1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))) AS skill"
SQL["j19_side_by_side"] = f"WITH {UNITS}, x AS (SELECT CAST(is_hit > 0 AS INT) AS y, 0.3 + n / 12.0 AS p, CAST(entity % 3 AS INT) AS label, unit % 4 <> 0 AS clean FROM u), a AS (SELECT label, {_SIDE} FROM x GROUP BY label), b AS (SELECT label, {_SIDE} FROM x WHERE clean GROUP BY label) SELECT label, a.n, round(a.brier, 8) AS brier, round(a.skill, 8) AS skill, b.n AS n_clean, round(b.brier, 8) AS brier_clean, round(b.skill, 8) AS skill_clean, round(a.skill - b.skill, 8) + 0.0 AS gap FROM a JOIN b USING (label)"


def l4_two_way(spark, d):
    """A 75/25 split in time order, then distinct pairs (L8) and a union (L6) over its parts."""
    o = joins.time_split(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day")), ["day", "o_orderkey"], [0.75], "test")
    a = o.where("test = 0").select("o_custkey", F.year("day").cast("int").alias("year")).dropDuplicates()
    return a.withColumn("test", F.lit(0)).unionByName(o.where("test = 1").select("o_custkey", F.year("day").cast("int").alias("year"), "test").dropDuplicates())


SQL["l4_two_way"] = "WITH r AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) > floor(count(*) OVER () * 0.75) AS INT) AS test FROM orders) SELECT DISTINCT o_custkey, year, test FROM r"


def p21_interaction(spark, d):
    """The sum over kinds of an entity's rate times the opponent's share of that kind."""
    t = trials(spark, d)
    kinds = ("A", "N", "R")
    own = t.groupBy("entity").agg(*(F.coalesce(F.avg(F.when(F.col("returnflag") == k, F.col("is_hit"))), F.lit(0.0)).alias(f"r_{k}") for k in kinds))
    mix = t.groupBy("opponent").agg(*(F.avg((F.col("returnflag") == k).cast("double")).alias(f"s_{k}") for k in kinds))
    pairs = t.select("entity", "opponent").distinct().join(own, "entity").join(mix, "opponent")
    return rounded(pairs.select("entity", "opponent", sum((F.col(f"r_{k}") * F.col(f"s_{k}") for k in kinds), F.lit(0.0)).alias("exposure")).dropna(subset=["exposure"]))


SQL["p21_interaction"] = f"WITH {TRIALS}, o AS (SELECT entity, " + ", ".join(f"coalesce(avg(is_hit) FILTER (returnflag = '{k}'), 0) AS r_{k}" for k in "ANR") + " FROM t GROUP BY 1), m AS (SELECT opponent, " + ", ".join(f"avg(CAST(returnflag = '{k}' AS INT)) AS s_{k}" for k in "ANR") + " FROM t GROUP BY 1) SELECT entity, opponent, round(r_A * s_A + r_N * s_N + r_R * s_R, 9) AS exposure FROM (SELECT DISTINCT entity, opponent FROM t) JOIN o USING (entity) JOIN m USING (opponent)"


def s4_entity_range(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return tables.entity_range(o, "o_custkey", list(range(0, 60, 4)), "o_orderdate", "1995-01-01", "1999-12-31")


SQL["s4_entity_range"] = "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT unnest(range(0, 60, 4))) AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-12-31'"


def s16_code_fallback(spark, d):
    """Rows under a code or, where that has none, under its other code; tagged with the wanted code."""
    wanted = table(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") + 1) % 25).alias("other"))
    c = table(spark, d, "customer").where("c_nationkey % 3 != 0").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))
    first = wanted.join(F.broadcast(c), wanted["n_nationkey"] == c["c_nationkey"], "left").drop("c_nationkey")
    second = c.select(F.col("c_nationkey").alias("other"), F.col("n").alias("n2"), F.col("total").alias("total2"))
    return rounded(first.join(F.broadcast(second), "other", "left").select("n_nationkey", F.coalesce("n", "n2").alias("n"), F.coalesce("total", "total2").alias("total")).dropna(), 2)


SQL["s16_code_fallback"] = "WITH c AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS t FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) SELECT n_nationkey, coalesce(a.n, b.n) AS n, round(coalesce(a.t, b.t), 2) + 0.0 AS total FROM nation LEFT JOIN c a ON a.k = n_nationkey LEFT JOIN c b ON b.k = (n_nationkey + 1) % 25 WHERE coalesce(a.n, b.n) IS NOT NULL AND coalesce(a.t, b.t) IS NOT NULL"


def s20_legacy_union(spark, d):
    """Canonical and legacy files with unequal columns, bad dates dropped, the canonical row winning."""
    e = raw_events(spark, d)
    old = e.where("event_id % 3 != 0").select("event_id", "user_id", F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    new = e.where("event_id % 4 != 0").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    both = joins.upsert(old.withColumn("event_type", F.lit(None).cast("string")), new, ["event_id"])
    return both.withColumn("day", F.to_date(F.try_to_timestamp("day", F.lit("yyyy-MM-dd")))).where("day is not null")


SQL["s20_legacy_union"] = f"WITH {EVENTS} SELECT event_id, user_id, day, CASE WHEN event_id % 4 <> 0 THEN event_type END AS event_type FROM e WHERE event_id % 4 <> 0 OR (event_id % 3 <> 0 AND event_id % 11 <> 0)"


def s28_load_day(spark, d):
    """A stored batch by day, built on the first read (S33) and checked for its columns."""
    path = new_path(spark, "batch")
    build = lambda: table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy").alias("season"))
    tables.read_or_build(spark, path, build)
    return tables.load_day(spark, path, "season", "1996", ["o_custkey"]).groupBy("season").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("who"))


SQL["s28_load_day"] = "SELECT strftime(o_orderdate, '%Y') AS season, count(*) AS n, count(DISTINCT o_custkey) AS who FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1"


#: Lines of each target, and trials that stand behind a mean.
LINES = {"hrr": (0.5, 1.5, 2.5, 3.5), "bases": (0.5, 1.5, 2.5, 3.5), "hits": (0.5, 1.5, 2.5)}
VALUES = {"hrr": "certain", "bases": "total_bases", "hits": "is_hit"}
FLAGGED, BEHIND, LARGEST = ("is_hr", "is_hit", "is_walk", "is_k"), 100.0, 7


def c9_batch_lines(spark, d):
    """The scoring batch: every entity, its mixture of unit sizes, three compounded targets at their lines with overdispersion, and four flags at least once."""
    t, u = trials(spark, d), staged(units(spark, d), "batch-units")
    league = t.agg(*(F.avg(c).alias(f"m_{c}") for c in (*VALUES.values(), *FLAGGED) if c != "is_hit"), F.avg("is_hit").alias("m_is_hit"), *(F.var_pop(c).alias(f"v_{c}") for c in VALUES.values()))
    league = staged(league, "league")
    # an entity's sizes, everyone's with fewer than eight units
    sized = lambda df: df.select(*(c for c in df.columns if c != "dist"), F.slice("dist", 2, LARGEST).alias("dist"))
    everyone = sized(dist.histogram(u, [], "n", LARGEST)).select(F.col("dist").alias("_all"))
    own = sized(dist.histogram(u, ["entity"], "n", LARGEST)).join(F.broadcast(everyone)).select("entity", F.when(F.col("n_rows") >= 8, F.col("dist")).otherwise(F.col("_all")).alias("sizes"))
    sums = u.groupBy("entity").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in {*VALUES.values(), *FLAGGED})).join(F.broadcast(league))
    rate = lambda c: (F.col(c) + BEHIND * F.col(f"m_{c}")) / (F.col("n") + BEHIND)
    rows = sums.select("entity", *(rate(c).alias(f"r_{c}") for c in {*VALUES.values(), *FLAGGED})).join(own, "entity")
    long = rows.select("entity", "sizes", F.inline(F.array(*(F.struct(F.lit(k).alias("target"), F.col(f"r_{c}").alias("mean")) for k, c in VALUES.items()))))
    shapes = None
    for k, c in VALUES.items():
        shape = dist.contributions(t, c, "reached_nonhr", F.lit(0.31)) if k == "hrr" else dist.histogram(t, [], c, 6)
        sd = dist.dispersion(u.join(F.broadcast(league)), "n", c, F.first(f"m_{c}"), F.first(f"v_{c}"))
        one = shape.join(sd).select(F.lit(k).alias("target"), F.col("dist").alias("shape"), "sd", F.array(*map(F.lit, LINES[k])).alias("lines"))  # one row and one row
        shapes = one if shapes is None else shapes.unionByName(one)
    over = dist.batch_over_lines(staged(long, "batch-rows"), ["entity"], "mean", "sizes", staged(shapes, "shapes"), LARGEST)
    weighed = lambda p: F.aggregate(F.transform("sizes", lambda w, k: w * dist.at_least_one(p, k + 1)), F.lit(0.0), lambda a, x: a + x) / F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x)
    any_ = rows.select("entity", F.inline(F.array(*(F.struct(F.lit(f"any_{c}").alias("target"), F.lit(0.5).alias("line"), weighed(F.col(f"r_{c}")).alias("over")) for c in FLAGGED))))
    return rounded(over.unionByName(any_), 7)


_VALUE_ROWS = " UNION ALL ".join(f"SELECT entity, '{k}' AS target, {c} AS x FROM t" for k, c in VALUES.items())
_UNIT_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS target, n, {c} AS x FROM u" for k, c in VALUES.items())
_LINE_ROWS = ", ".join(f"('{k}', {x})" for k, lines in LINES.items() for x in lines)
_CERTAIN = "SELECT 'hrr' AS target, least(greatest(certain, 0), 6) AS v, CASE WHEN reached_nonhr = 1 THEN 0.69 ELSE 1.0 END AS w FROM t UNION ALL SELECT 'hrr', least(greatest(certain, 0) + 1, 6), 0.31 FROM t WHERE reached_nonhr = 1"
SQL["c9_batch_lines"] = f"""WITH RECURSIVE {UNITS}, v AS ({_VALUE_ROWS}), lg AS (SELECT target, avg(x) AS m, var_pop(x) AS s FROM v GROUP BY target),
w AS ({_CERTAIN} UNION ALL SELECT target, least(x, 6), 1.0 FROM v WHERE target <> 'hrr'), i7 AS (SELECT unnest(range(7)) AS i),
sh AS (SELECT target, list(p ORDER BY i) AS shape, sum(i * p) AS mean, 1 - list_first(list(p ORDER BY i)) AS above FROM (SELECT target, i, sum(CASE WHEN v = i THEN w ELSE 0 END)::DOUBLE / sum(w) AS p FROM w, i7 GROUP BY ALL) GROUP BY target),
ds AS (SELECT target, CASE WHEN count(*) >= 100 AND var_pop(x) > avg(n) * any_value(s) THEN sqrt((var_pop(x) - avg(n) * any_value(s)) / (avg(n * n) * any_value(m) ** 2)) ELSE 0 END AS sd FROM ({_UNIT_ROWS}) JOIN lg USING (target) GROUP BY target),
en AS (SELECT entity, target, (sum(x) + {BEHIND} * any_value(m)) / (count(*) + {BEHIND}) AS mean FROM v JOIN lg USING (target) GROUP BY ALL),
g0 AS (SELECT target, z, wt, greatest(1 + z * sd, 0.05) AS raw FROM ds, (VALUES {", ".join(f"({z}, {w})" for z, w in dist.GRID)}) AS q(z, wt)),
g AS (SELECT target, wt, raw / sum(raw * wt) OVER (PARTITION BY target) AS m FROM g0),
cs AS (SELECT DISTINCT target, floor(mean * 10000 + 0.5000001) / 10000 AS q FROM en),
sc AS (SELECT target, q, m, wt, [CASE WHEN k = 0 THEN 1 - q / mean * m * above ELSE q / mean * m * shape[k + 1] END FOR k IN range(7)] AS l FROM cs JOIN sh USING (target) JOIN g USING (target)),
r AS (SELECT target, q, m, wt, l, 0 AS n, [CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR k IN range(21)] AS c FROM sc
  UNION ALL SELECT target, q, m, wt, l, n + 1, [list_sum([coalesce(c[k - i + 1], 0) * l[i + 1] FOR i IN range(least(k, 6) + 1)]) FOR k IN range(21)] FROM r WHERE n < {LARGEST}),
a AS (SELECT target, q, n, line, sum(wt * list_sum(c[CAST(floor(line) AS INT) + 2:21]) / list_sum(c)) AS p FROM r JOIN (VALUES {_LINE_ROWS}) AS ln(target, line) USING (target) WHERE n >= 1 GROUP BY target, q, n, line),
h0 AS (SELECT entity, least(greatest(n, 0), {LARGEST}) AS n, count(*) AS c FROM u GROUP BY 1, 2), hz AS (SELECT *, sum(c) OVER (PARTITION BY entity) AS units FROM h0),
al AS (SELECT n, sum(c) AS c FROM hz GROUP BY n), ee AS (SELECT DISTINCT entity, units FROM hz),
sz AS (SELECT entity, n, c FROM hz WHERE units >= 8 UNION ALL SELECT entity, al.n, al.c FROM ee, al WHERE units < 8),
fl AS (SELECT entity, target, (sum(x) + {BEHIND} * any_value(m)) / (count(*) + {BEHIND}) AS p FROM (UNPIVOT (SELECT entity, {", ".join(FLAGGED)} FROM t) ON {", ".join(FLAGGED)} INTO NAME target VALUE x)
  JOIN (SELECT target, avg(x) AS m FROM (UNPIVOT (SELECT {", ".join(FLAGGED)} FROM t) ON {", ".join(FLAGGED)} INTO NAME target VALUE x) GROUP BY target) USING (target) GROUP BY ALL)
SELECT entity, target, line::DOUBLE AS line, round(sum(c * p) / sum(c), 7) AS over FROM en JOIN sz USING (entity) JOIN a ON a.target = en.target AND a.q = floor(en.mean * 10000 + 0.5000001) / 10000 AND a.n = sz.n GROUP BY entity, en.target, line
UNION ALL SELECT entity, 'any_' || target, 0.5, round(sum(c * (1 - (1 - p) ** n)) / sum(c), 7) FROM fl JOIN sz USING (entity) WHERE n >= 1 GROUP BY entity, target"""
SQL["c9_batch_lines"] = SQL["c9_batch_lines"].replace("SELECT entity, target, line::DOUBLE", "SELECT entity, en.target, line::DOUBLE")


def c15_slot_monotone(spark, d):
    """Entities' own size distributions (everyone's below eight units), retilted so that means do not rise along a team's slots in a lineup of four or more."""
    unit = ["day", "lineup", "team"]
    u = units(spark, d)
    everyone = dist.histogram(u, [], "n", LARGEST).select(F.col("dist").alias("_all"))
    own = dist.histogram(u, ["entity"], "n", LARGEST).where("n_rows >= 8").select("entity", "dist")
    rows = slots(spark, d).join(own, "entity", "left").join(F.broadcast(everyone)).withColumn("sizes", F.coalesce("dist", "_all"))  # one row
    out = dist.monotone_sizes(rows.select("entity", *unit, "slot", "sizes"), unit, "slot", "sizes")
    return rounded(out.select("entity", *unit, "slot", dist.mean_of(F.col("sizes")).alias("mean"), "fit", dist.mean_of(F.col("new_sizes")).alias("new_mean")), 6)


#: A distribution's mean, and those of its furthest tilts.
_TILTED = "sum(c * v) * 1.0 / sum(c) AS m" + "".join(f", sum(c * exp({x} * v) * v) / sum(c * exp({x} * v)) AS {name}" for name, x in (("lo", -dist.SPAN), ("hi", dist.SPAN)))
SQL["c15_slot_monotone"] = f"""WITH {UNITS}, {SLOTS},
h AS (SELECT entity, least(n, {LARGEST}) AS v, count(*) AS c FROM u GROUP BY 1, 2), e AS (SELECT NULL AS entity, v, sum(c) AS c FROM h GROUP BY v),
k AS (SELECT entity, {_TILTED} FROM h GROUP BY 1 HAVING sum(c) >= 8), a AS (SELECT {_TILTED} FROM e),
f AS (SELECT s.entity, day, lineup, team, slot, coalesce(k.m, a.m) AS mean, coalesce(k.lo, a.lo) AS lo, coalesce(k.hi, a.hi) AS hi, count(*) OVER (PARTITION BY day, lineup, team) AS c FROM s CROSS JOIN a LEFT JOIN k ON s.entity = k.entity),
r AS (SELECT a.day, a.lineup, a.team, a.slot AS a, b.slot AS b, avg(m.mean) AS m FROM f a JOIN f b ON a.day = b.day AND a.lineup = b.lineup AND a.team = b.team AND a.slot <= b.slot
  JOIN f m ON m.day = a.day AND m.lineup = a.lineup AND m.team = a.team AND m.slot BETWEEN a.slot AND b.slot WHERE a.c >= {dist.SLOTTED} GROUP BY ALL),
i AS (SELECT f.day, f.lineup, f.team, f.slot, r.a, max(r.m) AS m FROM f JOIN r ON r.day = f.day AND r.lineup = f.lineup AND r.team = f.team AND r.a <= f.slot AND r.b >= f.slot GROUP BY ALL),
o AS (SELECT day, lineup, team, slot, min(m) AS fit FROM i GROUP BY ALL)
SELECT entity, f.day, f.lineup, f.team, f.slot, round(mean, 6) AS mean, round(coalesce(fit, mean), 6) AS fit, round(CASE WHEN abs(fit - mean) >= 1e-9 THEN least(greatest(fit, lo), hi) ELSE mean END, 6) AS new_mean
FROM f LEFT JOIN o ON f.day = o.day AND f.lineup = o.lineup AND f.team = o.team AND f.slot = o.slot"""


def e16_many_comparisons(spark, d):
    """Verdicts of many targets at once: how many of each, and how many wins chance alone would give."""
    u = units(spark, d).select("unit", (F.col("is_hit") > 0).cast("int").alias("y"), (0.3 + F.col("n") / 12.0).alias("p"), F.lit(0.6).alias("q"))
    out = None
    for k in range(3):
        one = evaluation.paired_bootstrap(u.where(F.pmod("unit", F.lit(3)) == k), "unit", PAIRED, "y", "q", "p")
        one = one.select(evaluation.verdict(F.col("point"), F.col("low"), F.col("high")).alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("by_chance", F.lit(0.05 * 3))


SQL["e16_many_comparisons"] = f"""WITH {UNITS}, x AS (SELECT unit, unit % 3 AS k, CAST(is_hit > 0 AS INT) AS y, 0.3 + n / 12.0 AS p, 0.6 AS q FROM u), {sql_weights(PAIRED, "x")},
v AS (SELECT k, avg(y) * (1 - avg(y)) AS v, avg((q - y) ** 2 - (p - y) ** 2) AS g FROM x GROUP BY k),
g AS (SELECT k, b, sum(w * ((q - y) ** 2 - (p - y) ** 2)) / sum(w) / any_value(v.v) AS s FROM w JOIN v USING (k) WHERE w > 0 GROUP BY k, b),
i AS (SELECT k, any_value(v.g / v.v) AS m, quantile_cont(s, 0.025) AS l, quantile_cont(s, 0.975) AS h FROM g JOIN v USING (k) GROUP BY k)
SELECT {sql_verdict("m", "l", "h")} AS verdict, count(*) AS n, {0.05 * 3} AS by_chance FROM i GROUP BY 1"""


QUERIES = {f.__name__: f for f in (a4_contact_log, a11_run_factors, a22_entity_rates, a30_tier_summary, a31_first_opponent, j3_unit_context, j10_latest_state, j16_value_map, j19_side_by_side, l4_two_way, p21_interaction, s4_entity_range, s16_code_fallback, s20_legacy_union, s28_load_day, c9_batch_lines, c15_slot_monotone, e16_many_comparisons)}
