"""Registered distribution queries: from trials to counts over lines, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as dist
from ..operators import joins, scoring
from ..sources.shared import new_path, staged
from .bindings import SLOTS, TRIALS, UNITS, rounded, slots, trials, units

SQL: dict[str, str] = {}


def _listed(df, column: str):
    """An array column as rows, so that results compare number by number."""
    return df.select(*(c for c in df.columns if c != column), F.posexplode(column).alias("v", "p"))


def a17_contributions(spark, d):
    t = trials(spark, d)
    return rounded(_listed(dist.contributions(t, "certain", "reached_nonhr", F.lit(0.31)), "dist"), 9)


SQL["a17_contributions"] = f"WITH {TRIALS}, c AS (SELECT least(greatest(certain, 0), 6) AS v, reached_nonhr AS r FROM t), x AS (SELECT v, CASE WHEN r = 1 THEN 0.69 ELSE 1 END AS w FROM c UNION ALL SELECT least(v + 1, 6), 0.31 FROM c WHERE r = 1) SELECT CAST(i AS INT) AS v, round(coalesce(sum(w), 0) / (SELECT sum(w) FROM x), 9) AS p FROM (SELECT unnest(range(7)) AS i) LEFT JOIN x ON x.v = i GROUP BY i"


def a18_unit_sizes(spark, d):
    """An entity's distribution of trials in a unit; with fewer than eight units that of everyone."""
    u = units(spark, d)
    own = dist.histogram(u, ["entity"], "n", 7)
    everyone = dist.histogram(u, [], "n", 7).select(F.col("dist").alias("all_dist"))
    return rounded(_listed(own.join(F.broadcast(everyone)).select("entity", F.when(F.col("n_rows") >= 8, F.col("dist")).otherwise(F.col("all_dist")).alias("dist")), "dist"))


SQL["a18_unit_sizes"] = f"WITH {UNITS}, e AS (SELECT entity, count(*) AS c FROM u GROUP BY 1), g AS (SELECT entity, CAST(i AS INT) AS v, avg(CAST(least(n, 7) = i AS INT)) AS p FROM u, (SELECT unnest(range(8)) AS i) GROUP BY ALL), a AS (SELECT CAST(i AS INT) AS v, avg(CAST(least(n, 7) = i AS INT)) AS ap FROM u, (SELECT unnest(range(8)) AS i) GROUP BY ALL) SELECT entity, v, round(CASE WHEN c >= 8 THEN p ELSE ap END, 9) AS p FROM g JOIN a USING (v) JOIN e USING (entity)"


def a19_dispersion(spark, d):
    t = trials(spark, d).agg(F.avg("certain").alias("m"), F.var_pop("certain").alias("s"))
    u = units(spark, d).join(F.broadcast(t))
    facts = u.groupBy("m", "s").agg(F.count("*").alias("c"), F.var_pop("certain").alias("vt"), F.avg("n").alias("mn"), F.avg(F.col("n") * F.col("n")).alias("mn2"))
    excess = (F.col("vt") - F.col("mn") * F.col("s")) / (F.col("mn2") * F.col("m") * F.col("m"))
    return rounded(facts.select(F.when((F.col("c") >= 100) & (excess > 0), F.sqrt(excess)).otherwise(0.0).alias("sd")), 8)


SQL["a19_dispersion"] = f"WITH {UNITS}, a AS (SELECT avg(certain) AS m, var_pop(certain) AS s FROM t), f AS (SELECT count(*) AS c, var_pop(certain) AS vt, avg(n) AS mn, avg(n * n) AS mn2 FROM u), x AS (SELECT c, (vt - mn * s) / (mn2 * m * m) AS e FROM f, a) SELECT round(CASE WHEN c >= 100 AND e > 0 THEN sqrt(e) ELSE 0 END, 8) AS sd FROM x"


def _per_side(spark, d):
    """The contribution distribution of each hand, and the unit sizes that occur: few distinct keys for array work."""
    t = trials(spark, d)
    own = dist.histogram(t, ["hand"], "certain", 6).select("hand", "dist")
    n = t.groupBy("hand", "unit").agg(F.count("*").cast("int").alias("n")).groupBy("hand", "n").agg(F.count("*").alias("w"))
    return own, n


def c1_compound(spark, d):
    """The n-fold sum's distribution, once for each distinct (distribution, n), and the chance to beat lines."""
    own, n = _per_side(spark, d)
    c = own.join(n, "hand").select("hand", "n", dist.compounded(F.col("dist"), F.col("n")).alias("dist"))
    return rounded(_listed(c, "dist"))


_CONV = f"""WITH RECURSIVE {TRIALS}, n AS (SELECT hand, unit, CAST(count(*) AS INT) AS n FROM t GROUP BY hand, unit), nw AS (SELECT hand, n, count(*) AS w FROM n GROUP BY hand, n),
dd AS (SELECT hand, CAST(i AS INT) AS v, avg(CAST(least(greatest(certain, 0), 6) = i AS INT)) AS p FROM t, (SELECT unnest(range(7)) AS i) GROUP BY hand, i),
dl AS (SELECT hand, list(p ORDER BY v) AS l FROM dd GROUP BY hand),
r AS (SELECT hand, 0 AS n, l, [CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR k IN range(21)] AS c FROM dl
  UNION ALL SELECT hand, n + 1, l, [list_sum([coalesce(c[i + 1], 0) * coalesce(l[k - i + 1], 0) FOR i IN range(k + 1)]) FOR k IN range(21)] FROM r WHERE n < 40),
f AS (SELECT hand, n, w, [x / list_sum(c) FOR x IN c] AS c FROM r JOIN nw USING (hand, n))"""
SQL["c1_compound"] = f"{_CONV} SELECT hand, n, CAST(k AS INT) AS v, round(c[k + 1], 9) AS p FROM f, (SELECT unnest(range(21)) AS k)"


def c8_over_lines(spark, d):
    """P(count > line), averaged over the sizes that a unit has."""
    own, n = _per_side(spark, d)
    c = own.join(n, "hand").withColumn("c", dist.compounded(F.col("dist"), F.col("n")))
    lines = c.withColumn("line", F.explode(F.array(F.lit(0.5), F.lit(1.5), F.lit(2.5)))).withColumn("over", dist.over_line(F.col("c"), F.col("line")))
    return rounded(dist.marginal(lines, ["hand", "line"], "w", "over", "p"), 8)


SQL["c8_over_lines"] = f"{_CONV}, o AS (SELECT hand, w, line, list_sum(c[CAST(floor(line) AS INT) + 2:21]) AS o FROM f, (SELECT CAST(unnest([0.5, 1.5, 2.5]) AS DOUBLE) AS line)) SELECT hand, line, round(sum(w * o) / sum(w), 8) AS p FROM o GROUP BY hand, line"


def c7_any(spark, d):
    """P(at least one) averaged over the sizes of each entity's units."""
    u = units(spark, d)
    rate = trials(spark, d).groupBy("entity").agg(F.avg("is_hit").alias("r"))
    long = u.groupBy("entity", "n").agg(F.count("*").alias("w")).join(rate, "entity").withColumn("a", dist.at_least_one(F.col("r"), F.col("n")))
    return rounded(dist.marginal(long, ["entity"], "w", "a", "p"))


SQL["c7_any"] = f"WITH {UNITS}, r AS (SELECT entity, avg(is_hit) AS r FROM t GROUP BY 1), c AS (SELECT entity, n, count(*) AS w FROM u GROUP BY ALL) SELECT entity, round(sum(w * (1 - (1 - r) ** n)) / sum(w), 9) AS p FROM c JOIN r USING (entity) GROUP BY entity"


def c4_scaled(spark, d):
    """Distributions scaled to 0.8 and 1.3 times their mean by frequency, and tilted there: no SQL for the bisection."""
    own, _ = _per_side(spark, d)
    many = own.withColumn("m", F.explode(F.array(F.lit(0.8), F.lit(1.3), F.lit(3.0)))).withColumn("target", dist.mean_of(F.col("dist")) * F.col("m"))
    out = many.select("hand", "m", "target", dist.frequency_scaled(F.col("dist"), F.col("target")).alias("a"), dist.tilted(F.col("dist"), F.col("target")).alias("b"))
    return rounded(out.select("hand", "m", "target", dist.mean_of(F.col("a")).alias("by_frequency"), dist.mean_of(F.col("b")).alias("by_tilt"), F.round(F.element_at("a", 1), 9).alias("a0"), F.round(F.element_at("b", 1), 9).alias("b0")), 7)


def c3_overdispersed(spark, d):
    """The overdispersed mixture over five multipliers, scored at three lines."""
    own, n = _per_side(spark, d)
    c = dist.compounded_overdispersed(own.join(n, "hand"), ["hand", "n", "w"], "dist", "n", 0.359, "c")
    lines = c.withColumn("line", F.explode(F.array(F.lit(0.5), F.lit(1.5), F.lit(2.5)))).withColumn("over", dist.over_line(F.col("c"), F.col("line")))
    return rounded(dist.marginal(lines, ["hand", "line"], "w", "over", "p"), 7)


def c14_non_increasing(spark, d):
    """Means by slot made non-increasing within a lineup."""
    s = slots(spark, d).select("day", "lineup", "slot", (F.col("metric") + 0.0).alias("m"))
    return rounded(dist.non_increasing(s, ["day", "lineup"], "slot", "m", "fit"), 8)


SQL["c14_non_increasing"] = f"""WITH {SLOTS},
r AS (SELECT a.day, a.lineup, a.slot AS a, b.slot AS b, avg(m.metric) AS m FROM s a JOIN s b ON a.day = b.day AND a.lineup = b.lineup AND a.slot <= b.slot
  JOIN s m ON m.day = a.day AND m.lineup = a.lineup AND m.slot BETWEEN a.slot AND b.slot GROUP BY ALL),
i AS (SELECT s.day, s.lineup, s.slot, r.a, max(r.m) AS m FROM s JOIN r ON r.day = s.day AND r.lineup = s.lineup AND r.a <= s.slot AND r.b >= s.slot GROUP BY ALL)
SELECT day, lineup, slot, round(min(m), 8) AS fit FROM i GROUP BY ALL"""


def lineup_lines(spark, d):
    """An entity's line in a unit with its slot and the mean rate of the three behind it in that day's lineup."""
    placed = joins.circular_neighbours(slots(spark, d), ["day", "lineup"], "slot", "metric", F.lit(scoring.LEAGUE_OBP), ahead=False, name="behind")
    lines = units(spark, d).select("entity", "unit", "day", "is_hr", (F.col("rbi") + F.col("is_hr")).alias("runs"), "reached", "reached_nonhr", "n")
    return lines.join(placed.select("day", "entity", "lineup", "slot", "behind"), ["day", "entity"], "left")


#: Lines before this day fit the score tables, later ones are scored.
SCORED_FROM = "1996-01-01"


def c16_scoring_share(spark, d):
    """Score tables (A11, A12) fitted on the earlier lines and stored; the later lines' chance to score, and runs per trial (C17)."""
    lines = staged(lineup_lines(spark, d), "lineup-lines")
    fitted = scoring.fit_scores(lines.where(F.col("day") < SCORED_FROM), "entity", "slot", "runs", "is_hr", "reached_nonhr", "behind", 30, 20).save(new_path(spark, "score-tables"))
    # some lines have lost their slot, as before a lineup is known
    later = lines.where(F.col("day") >= SCORED_FROM).withColumn("slot", F.when(F.col("unit") % 10 != 0, F.col("slot")))
    out = scoring.score_chance(later, fitted, "entity", "slot", "behind")
    return rounded(out.select("entity", "unit", "slot", "share", scoring.runs_per_trial(F.col("is_hr") / F.col("n"), F.col("reached") / F.col("n"), F.col("share")).alias("runs")), 8)


_FALLBACK = " ".join(f"WHEN {k} THEN {v}" for k, v in scoring.SLOT_FACTORS.items())
SQL["c16_scoring_share"] = f"""WITH {UNITS}, {SLOTS}, k AS (SELECT unnest([1, 2, 3]) AS k),
nb AS (SELECT s.day, s.lineup, s.entity, s.slot, avg(coalesce(o.metric, {scoring.LEAGUE_OBP})) AS behind FROM s CROSS JOIN k LEFT JOIN s o ON o.day = s.day AND o.lineup = s.lineup AND o.slot = ((s.slot + k - 1) % 9) + 1 GROUP BY ALL),
ln AS (SELECT entity, unit, day, is_hr, rbi AS extra, reached, reached_nonhr AS tob, n, slot, behind FROM u LEFT JOIN nb USING (day, entity)),
f AS (SELECT * FROM ln WHERE day < DATE '{SCORED_FROM}' AND slot IS NOT NULL),
lg AS (SELECT CASE WHEN count(*) >= {scoring.LEAST_ROWS} AND sum(tob) > 0 THEN sum(extra) * 1.0 / sum(tob) END AS q FROM f), lq AS (SELECT q FROM lg WHERE q IS NOT NULL),
sl AS (SELECT slot, CASE WHEN sum(tob) >= {scoring.LEAST_ON_BASE} THEN sum(extra) * 1.0 / sum(tob) / any_value(q) ELSE CASE slot {_FALLBACK} END END AS sf, avg(behind) AS usual FROM f, lq GROUP BY slot),
ow AS (SELECT entity, sum(extra) AS a, sum(tob * sf * q) AS x, sum(tob) AS t, any_value(q) AS q FROM f JOIN sl USING (slot), lq GROUP BY entity),
m AS (SELECT count(*) AS g, var_samp(a / x) - (1 - any_value(q)) / any_value(q) * avg(1.0 / t) AS v, any_value(q) AS q FROM ow WHERE t >= 20 AND x > 0),
z AS (SELECT CASE WHEN g < 30 THEN {scoring.FEW} WHEN v > 0 THEN (1 - q) / (q * v) END AS k FROM m),
en AS (SELECT entity, least(greatest(CASE WHEN k IS NULL THEN 1 ELSE (a + k * q) / (x + k * q) END, {scoring.FACTOR[0]}), {scoring.FACTOR[1]}) AS own FROM ow, z),
r AS (SELECT ln.* EXCLUDE (slot), CASE WHEN unit % 10 <> 0 THEN slot END AS slot FROM ln WHERE day >= DATE '{SCORED_FROM}'),
c AS (SELECT r.entity, r.unit, r.slot, least(greatest(is_hr / n, 0), 1) AS top, least(greatest(reached / n, 0), 1) AS reach,
  least(greatest(coalesce(q, {scoring.LEAGUE}) * coalesce(sf, CASE WHEN q IS NULL THEN coalesce(CASE r.slot {_FALLBACK} END, 1) ELSE 1 END)
    * (1 + CASE WHEN q IS NULL THEN 0 ELSE {scoring.SLOPE} * (coalesce(behind, usual, {scoring.LEAGUE_OBP}) - coalesce(usual, {scoring.LEAGUE_OBP})) / q END) * coalesce(own, 1), {scoring.CHANCE[0]}), {scoring.CHANCE[1]}) AS share
  FROM r CROSS JOIN lg LEFT JOIN sl ON sl.slot = r.slot LEFT JOIN en ON en.entity = r.entity)
SELECT entity, unit, slot, round(share, 8) AS share, round(top + least(greatest(reach - top, 0), 1) * share, 8) AS runs FROM c"""


def c10_cross_check(spark, d):
    """Two routes to the same chance: a compounded flag over 0.5, and at least one; their largest gap."""
    t = trials(spark, d).groupBy("opponent").agg(F.avg("is_hit").alias("r"))
    rows = t.withColumn("n", F.explode(F.array(*(F.lit(k) for k in range(1, 6)))))
    c = rows.withColumn("a", dist.over_line(dist.compounded(F.array(1 - F.col("r"), F.col("r")), F.col("n")), F.lit(0.5))).withColumn("b", dist.at_least_one(F.col("r"), F.col("n")))
    return rounded(c.groupBy("n").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 9).alias("gap"), F.avg("a").alias("mean")), 8)


SQL["c10_cross_check"] = f"WITH {TRIALS}, r AS (SELECT opponent, avg(is_hit) AS r FROM t GROUP BY 1) SELECT CAST(n AS INT) AS n, 0.0 AS gap, round(avg(1 - (1 - r) ** n), 8) AS mean FROM r, (SELECT unnest(range(1, 6)) AS n) GROUP BY n"


def c12_leverage(spark, d):
    """The Brier score of a chance from the true size, the mean size and the entity's sizes: what knowing the size is worth."""
    u = units(spark, d)
    rate = trials(spark, d).groupBy("entity").agg(F.avg("is_hit").alias("r"))
    mean = u.groupBy("entity").agg(F.avg("n").alias("mean_n"))
    typical = c7_any(spark, d).withColumnRenamed("p", "by_sizes")
    y = (F.col("is_hit") > 0).cast("double")
    j = u.join(rate, "entity").join(mean, "entity").join(typical, "entity")
    b = lambda p: F.avg(F.pow(p - y, 2))
    return rounded(j.agg(b(dist.at_least_one(F.col("r"), F.col("n"))).alias("actual"), b(dist.at_least_one(F.col("r"), F.col("mean_n"))).alias("mean"), b(F.col("by_sizes")).alias("historical")), 7)


SQL["c12_leverage"] = f"WITH {UNITS}, r AS (SELECT entity, avg(is_hit) AS r FROM t GROUP BY 1), c AS (SELECT entity, n, count(*) AS w FROM u GROUP BY ALL), h AS (SELECT entity, round(sum(w * (1 - (1 - r) ** n)) / sum(w), 9) AS h FROM c JOIN r USING (entity) GROUP BY entity), m AS (SELECT entity, avg(n) AS m FROM u GROUP BY 1) SELECT round(avg((1 - (1 - r) ** n - CAST(is_hit > 0 AS INT)) ** 2), 7) AS actual, round(avg((1 - (1 - r) ** m - CAST(is_hit > 0 AS INT)) ** 2), 7) AS mean, round(avg((h - CAST(is_hit > 0 AS INT)) ** 2), 7) AS historical FROM u JOIN r USING (entity) JOIN m USING (entity) JOIN h USING (entity)"

QUERIES = {f.__name__: f for f in (a17_contributions, a18_unit_sizes, a19_dispersion, c1_compound, c3_overdispersed, c4_scaled, c7_any, c8_over_lines, c10_cross_check, c12_leverage, c14_non_increasing, c16_scoring_share)}
