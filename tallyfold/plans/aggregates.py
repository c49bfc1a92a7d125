"""Registered aggregates and projections with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rates, windows
from .bindings import EVENTS, FLAGS, ORDER, ORDER_SQL, TRIALS, UNITS, raw_events, rounded, table, trials, units


def s0_top_shrunk(spark, d) -> DataFrame:
    """The flagship: each entity's hit rate shrunk by the table's own strength, best twenty."""
    t = trials(spark, d)
    own = t.groupBy("entity").agg(F.sum("is_hit").alias("x"), F.count("is_hit").alias("n"))
    k = rates.strength(t, "entity", "is_hit", 20)
    rate = windows.shrunk(F.col("x"), F.col("n"), F.col("league"), F.col("k"))
    return rounded(own.join(F.broadcast(k)).select("entity", "x", "n", rate.alias("rate"))).orderBy(F.desc("rate"), "entity").limit(20)


STRENGTH = """own AS (SELECT entity, sum(is_hit) AS x, count(*) AS n FROM t GROUP BY entity),
m AS (SELECT count(*) AS g, sum(x) * 1.0 / sum(n) AS p, var_samp(x * 1.0 / n) - (sum(x) * 1.0 / sum(n)) * (1 - sum(x) * 1.0 / sum(n)) * avg(1.0 / n) AS v FROM own WHERE n >= 20),
k AS (SELECT (SELECT avg(is_hit) FROM t) AS league, CASE WHEN g < 3 THEN 500 WHEN v <= 1e-9 THEN 5000 ELSE least(greatest(p * (1 - p) / v - 1, 10), 5000) END AS k FROM m)"""

SQL: dict[str, str] = {}
SQL["s0_top_shrunk"] = f"WITH {TRIALS}, {STRENGTH} SELECT entity, x, n, round((x + k * league) / (n + k), 9) AS rate FROM own, k ORDER BY rate DESC, entity LIMIT 20"


def p1_trials(spark, d):
    return rounded(trials(spark, d).select("entity", "opponent", "unit", "day", "seq", *FLAGS, "stand", "hand", "platoon_edge"))


SQL["p1_trials"] = f"WITH {TRIALS} SELECT entity, opponent, unit, day, seq, {', '.join(FLAGS)}, stand, hand, platoon_edge FROM t"


def p3_base_state(spark, d):
    t = trials(spark, d)
    base = lambda k: F.when(F.col("part") % k == 0, F.col("part"))
    on = t.select("entity", "unit", "seq", "part", base(2).alias("on_1"), base(3).alias("on_2"), base(5).alias("on_3"))
    flags = {f"has_{k}": F.col(f"on_{k}").isNotNull().cast("int") for k in (1, 2, 3)}
    return on.withColumns(flags).withColumns({"runners": F.expr("has_1 + has_2 + has_3"), "scoring": F.expr("has_2 + has_3")}).drop("on_1", "on_2", "on_3")


SQL["p3_base_state"] = f"WITH {TRIALS}, b AS (SELECT entity, unit, seq, part, CAST(part % 2 = 0 AS INT) AS has_1, CAST(part % 3 = 0 AS INT) AS has_2, CAST(part % 5 = 0 AS INT) AS has_3 FROM t) SELECT *, has_1 + has_2 + has_3 AS runners, has_2 + has_3 AS scoring FROM b"


def p4_chase_flags(spark, d):
    e = raw_events(spark, d)
    swing = F.col("event_type").isin("click", "purchase", "signup")
    out = F.coalesce(F.col("k") > 9, F.lit(False))
    return e.select("user_id", "ts", swing.cast("int").alias("swing"), out.cast("int").alias("outside"), (swing & out).cast("int").alias("chase"))


SQL["p4_chase_flags"] = f"WITH {EVENTS}, f AS (SELECT user_id, ts, event_type IN ('click', 'purchase', 'signup') AS s, coalesce(k > 9, false) AS o FROM e) SELECT user_id, ts, CAST(s AS INT) AS swing, CAST(o AS INT) AS outside, CAST(s AND o AS INT) AS chase FROM f"


def p6_band(spark, d):
    """A two-sided band whose edges move with the speed: at least 98, 26..30 degrees and a degree wider for each unit more."""
    t = trials(spark, d).select("entity", "unit", "seq", (F.col("quantity") * 2 + 20).alias("speed"), (F.col("part") % 60).cast("double").alias("angle"))
    low, high = F.greatest(F.lit(8.0), 26 - (F.col("speed") - 98)), F.least(F.lit(50.0), 30 + (F.col("speed") - 98))
    inside = (F.col("speed") >= 98) & F.col("angle").between(low, high)
    x, y = F.col("angle") * 4 - 125.42, 203.5 - F.col("speed")
    return rounded(t.withColumns({"barrel": inside.cast("int"), "sweet": F.col("angle").between(8, 32).cast("int"), "hard": (F.col("speed") >= 95).cast("int"), "spray": F.degrees(F.atan2(x, y))}), 6)


SQL["p6_band"] = f"""WITH {TRIALS}, b AS (SELECT entity, unit, seq, quantity * 2 + 20 AS speed, CAST(part % 60 AS DOUBLE) AS angle FROM t)
SELECT *, CAST(speed >= 98 AND angle BETWEEN greatest(8, 26 - (speed - 98)) AND least(50, 30 + (speed - 98)) AS INT) AS barrel,
  CAST(angle BETWEEN 8 AND 32 AS INT) AS sweet, CAST(speed >= 95 AS INT) AS hard, round(degrees(atan2(angle * 4 - 125.42, 203.5 - speed)), 6) + 0.0 AS spray FROM b"""


def p8_buckets(spark, d):
    """Codes to buckets, and A5: counts and sums of an entity's unit by bucket, pivoted."""
    e = raw_events(spark, d)
    bucket = F.when(F.col("event_type").isin("click", "view"), "light").when(F.col("event_type") == "purchase", "heavy").when(F.col("event_type") == "signup", "once").otherwise("other")
    p = e.withColumn("bucket", bucket).groupBy("user_id", "day").pivot("bucket", ["light", "heavy", "once", "other"]).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return rounded(p.fillna(0), 6)


SQL["p8_buckets"] = (
    f"WITH {EVENTS}, b AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'light' WHEN event_type = 'purchase' THEN 'heavy' WHEN event_type = 'signup' THEN 'once' ELSE 'other' END AS bucket FROM e) SELECT user_id, day, "
    + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}_n, round(coalesce(sum(value) FILTER (bucket = '{b}'), 0.0), 6) AS {b}_v" for b in ("light", "heavy", "once", "other"))
    + " FROM b GROUP BY user_id, day"
)


def p9_opponent_side(spark, d):
    t = trials(spark, d)
    first = t.groupBy("unit", "side").agg(F.min_by("opponent", F.struct(*ORDER)).alias("first_opponent"))
    return first.withColumn("other_side", 1 - F.col("side"))


SQL["p9_opponent_side"] = f"WITH {TRIALS} SELECT unit, side, arg_min(opponent, row({ORDER_SQL})) AS first_opponent, 1 - side AS other_side FROM t GROUP BY unit, side"


def p10_log5(spark, d):
    t = trials(spark, d)
    a = t.groupBy("entity").agg(F.avg("is_hit").alias("a"))
    b = t.groupBy("opponent").agg(F.avg("is_hit").alias("b"))
    league = t.agg(F.avg("is_hit").alias("l"))
    pairs = t.select("entity", "opponent").distinct().join(a, "entity").join(b, "opponent").join(F.broadcast(league))
    p = rates.log5(F.col("a"), F.col("b"), F.col("l"))
    return rounded(pairs.select("entity", "opponent", p.alias("p"), rates.blend(F.col("a"), F.col("b"), F.lit(0.528)).alias("blended"), rates.expected_bases(F.col("a") * 0.2, F.col("a"), F.lit(1.3)).alias("bases"), rates.clip(1 - F.pow(1 - F.col("a"), 4), 0, 1).alias("any_of_4")))


SQL["p10_log5"] = f"""WITH {TRIALS}, a AS (SELECT entity, least(greatest(avg(is_hit), 1e-6), 1 - 1e-6) AS a, avg(is_hit) AS ra FROM t GROUP BY entity),
b AS (SELECT opponent, least(greatest(avg(is_hit), 1e-6), 1 - 1e-6) AS b, avg(is_hit) AS rb FROM t GROUP BY opponent), l AS (SELECT avg(is_hit) AS l FROM t),
o AS (SELECT entity, opponent, ra, rb, (a / (1 - a)) * (b / (1 - b)) / (l / (1 - l)) AS o FROM (SELECT DISTINCT entity, opponent FROM t) JOIN a USING (entity) JOIN b USING (opponent), l)
SELECT entity, opponent, round(o / (1 + o), 9) AS p, round(0.528 * ra + 0.472 * rb, 9) AS blended, round(4 * (ra * 0.2) + greatest(ra - ra * 0.2, 0) * 1.3, 9) AS bases, round(1 - (1 - ra) ** 4, 9) AS any_of_4 FROM o"""


def p16_bands(spark, d):
    """Quartile band 1..4 over the whole table, 0 for null."""
    docs = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("v"))
    cuts = windows.exact_percentiles(docs, "v", [0.25, 0.5, 0.75])
    band = F.when(F.col("v").isNull(), 0).otherwise(1 + F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    return docs.join(F.broadcast(cuts)).select("p_partkey", band.alias("band"))


SQL["p16_bands"] = "WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS v FROM part), c AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM b) SELECT p_partkey, CASE WHEN v IS NULL THEN 0 ELSE 1 + CAST(v > c.a AS INT) + CAST(v > c.b AS INT) + CAST(v > c.c AS INT) END AS band FROM b, c"


def p17_text_filter(spark, d):
    """Rows any of whose columns holds the needle, upper or lower case."""
    c = table(spark, d, "customer")
    hit = F.lit(False)
    for col in ("c_name", "c_mktsegment"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit("build"))
    return c.where(hit).select("c_custkey", "c_name", "c_mktsegment")


SQL["p17_text_filter"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(coalesce(c_name, '')), 'build') OR contains(lower(coalesce(c_mktsegment, '')), 'build')"


def p18_median_fill(spark, d):
    e = raw_events(spark, d).select("user_id", "ts", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    middle = windows.exact_percentiles(e, "v", [0.5], "c").select(F.get("c", 0).alias("m"))
    return rounded(e.join(F.broadcast(middle)).select("user_id", "ts", F.coalesce("v", "m").alias("v")), 6)


SQL["p18_median_fill"] = "WITH b AS (SELECT user_id, ts, CASE WHEN value > 10 THEN value END AS v FROM events) SELECT user_id, ts, round(coalesce(v, (SELECT median(v) FROM b)), 6) AS v FROM b"


def p20_dimension_default(spark, d):
    """A dimension joined with a default for what it lacks, and P19: a sign by hand."""
    dim = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") * 5 + 90).alias("factor"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    out = s.join(F.broadcast(dim), s["s_nationkey"] == dim["k"], "left")
    return rounded(out.select("s_suppkey", (F.coalesce("factor", F.lit(100)) / 100).alias("factor"), F.when(F.col("s_suppkey") % 3 == 0, -1).otherwise(1).alias("sign")))


SQL["p20_dimension_default"] = "SELECT s_suppkey, round(coalesce(CASE WHEN s_nationkey < 20 THEN n_regionkey * 5 + 90 END, 100) / 100.0, 9) AS factor, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END AS sign FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"


def p22_threshold(spark, d):
    return units(spark, d).select("entity", "unit", (F.col("certain") >= 2).cast("int").alias("label"), (F.col("n") < 3).cast("int").alias("thin"))


SQL["p22_threshold"] = f"WITH {UNITS} SELECT entity, unit, CAST(certain >= 2 AS INT) AS label, CAST(n < 3 AS INT) AS thin FROM u"


def a2_unit_log(spark, d):
    """Conditional counts, means and maxima of a user's day, with a rate that is null over nothing."""
    e = raw_events(spark, d)
    g = e.groupBy("user_id", "day").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("k") > 9).alias("outside"),
        F.count_if((F.col("k") > 9) & (F.col("event_type") == "click")).alias("chases"), F.avg("value").alias("mean"), F.max("value").alias("top"),
    )
    return rounded(g.withColumns({"chase_rate": F.try_divide("chases", "outside"), "got": (F.col("clicks") > 0).cast("int")}), 6)


SQL["a2_unit_log"] = f"WITH {EVENTS}, g AS (SELECT user_id, day, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (k > 9) AS outside, count(*) FILTER (k > 9 AND event_type = 'click') AS chases, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM e GROUP BY user_id, day) SELECT *, round(CASE WHEN outside > 0 THEN chases * 1.0 / outside END, 6) AS chase_rate, CAST(clicks > 0 AS INT) AS got FROM g"


def a3_unit_totals(spark, d):
    u = units(spark, d)
    return u.withColumns({f"got_{c[3:]}": (F.col(c) > 0).cast("int") for c in ("is_hr", "is_hit", "is_walk")})


SQL["a3_unit_totals"] = f"WITH {UNITS} SELECT *, CAST(is_hr > 0 AS INT) AS got_hr, CAST(is_hit > 0 AS INT) AS got_hit, CAST(is_walk > 0 AS INT) AS got_walk FROM u"


def a6_shares(spark, d):
    """Shares per opponent and year in one job, A7 and A8 alike: kinds, rates per trial, mean of a measure."""
    t = trials(spark, d)
    share = lambda c: F.avg(c.cast("double"))
    return rounded(t.groupBy("opponent", F.year("day").cast("int").alias("season")).agg(
        share(F.col("returnflag") == "A").alias("a"), share(F.col("returnflag") == "N").alias("n"), share(F.col("returnflag") == "R").alias("r"),
        F.try_divide(F.sum("is_walk"), F.count("*")).alias("walks"), F.avg("is_k").alias("ks"), F.avg("price").alias("mean_price")), 6)


SQL["a6_shares"] = f"WITH {TRIALS} SELECT opponent, CAST(year(day) AS INT) AS season, round(avg(CAST(returnflag = 'A' AS INT)), 6) AS a, round(avg(CAST(returnflag = 'N' AS INT)), 6) AS n, round(avg(CAST(returnflag = 'R' AS INT)), 6) AS r, round(avg(is_walk), 6) AS walks, round(avg(is_k), 6) AS ks, round(avg(price), 6) AS mean_price FROM t GROUP BY ALL"


def a9_strength(spark, d):
    """Four flags' leagues and strengths out of one aggregate."""
    flags = ("is_hit", "is_hr", "is_k", "is_walk")
    wide = rates.strengths(trials(spark, d), "entity", list(flags), 20)
    rows = F.inline(F.array(*(F.struct(F.col(f"{v}_league").alias("league"), F.col(f"{v}_k").alias("k"), F.lit(v).alias("flag")) for v in flags)))
    return rounded(wide.select(rows), 6)


SQL["a9_strength"] = f"WITH {TRIALS}, l AS (UNPIVOT (SELECT entity, is_hit, is_hr, is_k, is_walk FROM t) ON is_hit, is_hr, is_k, is_walk INTO NAME flag VALUE x), own AS (SELECT flag, entity, sum(x) AS x, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT flag, count(*) AS g, sum(x) * 1.0 / sum(n) AS p, var_samp(x * 1.0 / n) - (sum(x) * 1.0 / sum(n)) * (1 - sum(x) * 1.0 / sum(n)) * avg(1.0 / n) AS v FROM own WHERE n >= 20 GROUP BY flag), a AS (SELECT flag, avg(x) AS league FROM l GROUP BY flag) SELECT flag, round(league, 6) AS league, round(CASE WHEN g < 3 THEN 500 WHEN v <= 1e-9 THEN 5000 ELSE least(greatest(p * (1 - p) / v - 1, 10), 5000) END, 6) AS k FROM m JOIN a USING (flag)"


def a10_bases_per_hit(spark, d):
    return rounded(rates.bases_per_hit(trials(spark, d), "entity", "total_bases", "is_hit", "is_hr"), 6)


SQL["a10_bases_per_hit"] = f"""WITH {TRIALS}, h AS (SELECT * FROM t WHERE is_hit = 1 AND is_hr = 0), own AS (SELECT entity, sum(total_bases) AS x, count(*) AS n FROM h GROUP BY entity),
l AS (SELECT avg(total_bases) AS league, var_samp(total_bases) AS within, count(*) AS hits FROM h), m AS (SELECT count(*) AS g, var_samp(x * 1.0 / n) AS b, avg(1.0 / n) AS inv FROM own WHERE n >= 50),
k AS (SELECT league, hits, CASE WHEN g < 30 THEN 189 WHEN b - within * inv > 0 THEN within / (b - within * inv) END AS k FROM l, m)
SELECT entity, n, round(CASE WHEN hits < 2000 THEN 1.2728 ELSE least(greatest(CASE WHEN k IS NULL THEN league ELSE (x + k * league) / (n + k) END, 1.0), 2.2) END, 6) AS bases_per_hit FROM own, k"""


def a13_group_rates(spark, d):
    return rounded(rates.group_rates(trials(spark, d), "opponent", ["is_hit"], "stand", ["L", "R"]), 6)


SQL["a13_group_rates"] = f"""WITH {TRIALS}, own AS (SELECT opponent, count(*) AS n, sum(is_hit) AS x, count(*) FILTER (stand = 'L') AS n_L, count(*) FILTER (stand = 'R') AS n_R,
  coalesce(sum(is_hit) FILTER (stand = 'L'), 0) AS x_L, coalesce(sum(is_hit) FILTER (stand = 'R'), 0) AS x_R FROM t GROUP BY opponent),
m AS (SELECT count(*) AS g, sum(x) * 1.0 / sum(n) AS p, var_samp(x * 1.0 / n) - (sum(x) * 1.0 / sum(n)) * (1 - sum(x) * 1.0 / sum(n)) * avg(1.0 / n) AS v FROM own WHERE n >= 20),
k AS (SELECT (SELECT avg(is_hit) FROM t) AS l, CASE WHEN g < 3 THEN 500 WHEN v <= 1e-9 THEN 5000 ELSE least(greatest(p * (1 - p) / v - 1, 10), 5000) END AS k FROM m),
r AS (SELECT *, (x + k * l) / (n + k) AS r FROM own, k)
SELECT opponent, n, n_L, n_R, round(r, 6) AS is_hit_rate, round((x_L + 200 * r) / (n_L + 200), 6) AS is_hit_rate_L, round((x_R + 200 * r) / (n_R + 200), 6) AS is_hit_rate_R FROM r"""


def a14_residual_opponent(spark, d):
    """By crews of opponents, who come back within a unit; and by opponents, who seldom do, so that the fixed figures stand."""
    t = trials(spark, d).withColumn("crew", F.col("opponent") % 3)
    found = [rates.residual_opponent(t, "unit", "side", o, F.col("seq") == 1, ORDER, ["is_hit", "is_k"]).withColumn("by", F.lit(o)) for o in ("crew", "opponent")]
    return rounded(found[0].unionByName(found[1]), 9)


def _residual(by: str) -> str:
    return f"""SELECT n, ok AS measured, round(CASE WHEN ok THEN s ELSE 0.528 END, 9) AS primary_share, round(CASE WHEN ok THEN h ELSE 0.2279 END, 9) AS is_hit_residual,
round(CASE WHEN ok THEN k ELSE 0.2336 END, 9) AS is_k_residual, '{by}' AS by FROM (SELECT *, n >= 5000 AND coalesce(s BETWEEN 0.35 AND 0.75, false) AND h IS NOT NULL AS ok FROM (
SELECT count(*) AS n, avg(CAST({by} = f AS INT)) AS s, avg(is_hit) FILTER ({by} <> f) AS h, avg(is_k) FILTER ({by} <> f) AS k
FROM c JOIN (SELECT unit, side, arg_min({by}, row({ORDER_SQL})) AS f FROM c WHERE seq = 1 GROUP BY unit, side) USING (unit, side)))"""


SQL["a14_residual_opponent"] = f"WITH {TRIALS}, c AS (SELECT *, opponent % 3 AS crew FROM t) {_residual('crew')} UNION ALL {_residual('opponent')}"


def a15_modal(spark, d):
    return trials(spark, d).groupBy("entity").agg(F.coalesce(F.mode("hand", True), F.lit("R")).alias("hand"))


SQL["a15_modal"] = f"WITH {TRIALS}, c AS (SELECT entity, hand, count(*) AS c FROM t GROUP BY ALL), m AS (SELECT entity, max(c) AS c FROM c GROUP BY entity) SELECT entity, min(hand) AS hand FROM c JOIN m USING (entity, c) GROUP BY entity"


def a16_projected_order(spark, d):
    """The nine entities of each group with the most starts, ranked by usual slot."""
    e = raw_events(spark, d)
    e = e.withColumn("team", F.col("user_id") % 5)
    own = e.groupBy("team", "user_id").agg(F.countDistinct("day").alias("starts"), F.mode("k", True).alias("usual"))
    top = windows.numbered(own, ["team"], [F.desc("starts"), "user_id"], "rank").where("rank <= 9")
    return windows.numbered(top, ["team"], [F.asc_nulls_last("usual"), F.desc("starts"), "user_id"], "slot").drop("rank")


SQL["a16_projected_order"] = f"""WITH {EVENTS}, b AS (SELECT *, user_id % 5 AS team FROM e), c AS (SELECT team, user_id, k, count(*) AS c FROM b WHERE k IS NOT NULL GROUP BY ALL),
m AS (SELECT team, user_id, min(k) AS usual FROM (SELECT *, max(c) OVER (PARTITION BY team, user_id) AS mc FROM c) WHERE c = mc GROUP BY ALL),
o AS (SELECT team, user_id, count(DISTINCT day) AS starts FROM b GROUP BY ALL), r AS (SELECT team, user_id, starts, usual, row_number() OVER (PARTITION BY team ORDER BY starts DESC, user_id) AS rank FROM o LEFT JOIN m USING (team, user_id))
SELECT team, user_id, starts, usual, row_number() OVER (PARTITION BY team ORDER BY usual NULLS LAST, starts DESC, user_id) AS slot FROM r WHERE rank <= 9"""


def a20_slot_summary(spark, d):
    u = units(spark, d)
    return rounded(u.groupBy((F.col("entity") % 9 + 1).alias("slot")).agg(F.count("*").alias("units"), F.avg("n").alias("mean_n"), F.avg((F.col("n") >= 5).cast("double")).alias("share_5"), F.avg("is_hit").alias("hits"), F.avg("rbi").alias("rbi")))


SQL["a20_slot_summary"] = f"WITH {UNITS} SELECT entity % 9 + 1 AS slot, count(*) AS units, round(avg(n), 9) AS mean_n, round(avg(CAST(n >= 5 AS INT)), 9) AS share_5, round(avg(is_hit), 9) AS hits, round(avg(rbi), 9) AS rbi FROM u GROUP BY 1"


def a24_pooled(spark, d):
    """Running totals pooled by size: said, did, and how many standard errors they are apart."""
    t = trials(spark, d)
    daily = t.groupBy("day", "hand").agg(F.count("*").alias("n"), F.avg("is_hit").alias("did"), F.avg(0.3 + 0.01 * (F.col("entity") % 7)).alias("said"))
    g = daily.groupBy("hand").agg(F.sum("n").alias("n"), (F.sum(F.col("said") * F.col("n")) / F.sum("n")).alias("said"), (F.sum(F.col("did") * F.col("n")) / F.sum("n")).alias("did"), F.countDistinct("day").alias("days"), F.max("n").alias("most"))
    return rounded(g.withColumn("sigma", (F.col("said") - F.col("did")) / F.sqrt(F.col("did") * (1 - F.col("did")) / F.col("n"))), 6)


SQL["a24_pooled"] = f"WITH {TRIALS}, dl AS (SELECT day, hand, count(*) AS n, avg(is_hit) AS did, avg(0.3 + 0.01 * (entity % 7)) AS said FROM t GROUP BY ALL), g AS (SELECT hand, sum(n) AS n, sum(said * n) / sum(n) AS said, sum(did * n) / sum(n) AS did, count(DISTINCT day) AS days, max(n) AS most FROM dl GROUP BY hand) SELECT hand, n, round(said, 6) AS said, round(did, 6) AS did, days, most, round((said - did) / sqrt(did * (1 - did) / n), 6) AS sigma FROM g"


def a28_unit_headers(spark, d):
    t = trials(spark, d)
    return t.groupBy("unit").agg(F.min("day").alias("first_day"), F.count_if(F.col("side") == 0).alias("home"), F.bool_and(F.col("quantity") > 5).alias("confirmed"), F.min_by("opponent", F.struct(*ORDER)).alias("first_opponent"))


SQL["a28_unit_headers"] = f"WITH {TRIALS} SELECT unit, min(day) AS first_day, count(*) FILTER (side = 0) AS home, bool_and(quantity > 5) AS confirmed, arg_min(opponent, row({ORDER_SQL})) AS first_opponent FROM t GROUP BY unit"


def a29_composite_report(spark, d):
    u = units(spark, d)
    over = [F.avg((F.col("certain") > x).cast("double")).alias(f"over_{k}") for k, x in enumerate((0.5, 1.5, 2.5, 3.5))]
    return rounded(u.groupBy((F.col("entity") % 2).alias("side")).agg(F.avg("certain").alias("mean"), *over))


SQL["a29_composite_report"] = f"WITH {UNITS} SELECT entity % 2 AS side, round(avg(certain), 9) AS mean, round(avg(CAST(certain > 0.5 AS INT)), 9) AS over_0, round(avg(CAST(certain > 1.5 AS INT)), 9) AS over_1, round(avg(CAST(certain > 2.5 AS INT)), 9) AS over_2, round(avg(CAST(certain > 3.5 AS INT)), 9) AS over_3 FROM u GROUP BY 1"


def a32_predictability(spark, d):
    u = units(spark, d)
    r = u.withColumn("res", F.col("n") - F.avg("n").over(Window.partitionBy("entity")))
    return rounded(r.agg((1 - F.var_samp("res") / F.var_samp("n")).alias("explained")), 8)


SQL["a32_predictability"] = f"WITH {UNITS}, r AS (SELECT n, n - avg(n) OVER (PARTITION BY entity) AS res FROM u) SELECT round(1 - var_samp(res) / var_samp(n), 8) AS explained FROM r"


def a33_counts(spark, d):
    return raw_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


SQL["a33_counts"] = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"

QUERIES = {f.__name__: f for f in (s0_top_shrunk, p1_trials, p3_base_state, p4_chase_flags, p6_band, p8_buckets, p9_opponent_side, p10_log5, p16_bands, p17_text_filter, p18_median_fill, p20_dimension_default, p22_threshold, a2_unit_log, a3_unit_totals, a6_shares, a9_strength, a10_bases_per_hit, a13_group_rates, a14_residual_opponent, a15_modal, a16_projected_order, a20_slot_summary, a24_pooled, a28_unit_headers, a29_composite_report, a32_predictability, a33_counts)}
