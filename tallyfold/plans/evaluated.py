"""Registered evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, windows
from .bindings import UNITS, rounded, units

SQL: dict[str, str] = {}


def _predictions(spark, d):
    """Whether a unit had a hit, and two made-up predictions of it."""
    u = units(spark, d)
    return u.select("unit", "entity", (F.col("is_hit") > 0).cast("int").alias("y"), (0.35 + (F.col("n") / 12.0) + (F.col("entity") % 7) * -0.02).alias("p"), (0.2 + (F.col("n") / 10.0)).alias("q"), (F.col("entity") % 3).cast("int").alias("g"))


_P = UNITS + ", p AS (SELECT unit, entity, CAST(is_hit > 0 AS INT) AS y, 0.35 + n / 12.0 + (entity % 7) * -0.02 AS p, 0.2 + n / 10.0 AS q, CAST(entity % 3 AS INT) AS g FROM u)"
_CLIP = "least(greatest({0}, 1e-6), 1 - 1e-6)"


def _evaluated(key: str, p: str) -> str:
    """SQL: the metrics by key, the area by ranks with ties halved."""
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {p}) + (count(*) OVER (PARTITION BY {key}, {p}) - 1) / 2.0 AS rk FROM x),
a AS (SELECT {key}, count(*) AS n, avg(y) AS base_rate, avg(({p} - y) ** 2) AS brier, avg(-(y * ln({_CLIP.format(p)}) + (1 - y) * ln(1 - {_CLIP.format(p)}))) AS log_loss, avg({p}) AS mean_p, avg(y) * (1 - avg(y)) AS brier_base,
  -(avg(y) * ln({_CLIP.format('avg(y)')}) + (1 - avg(y)) * ln(1 - {_CLIP.format('avg(y)')})) AS log_loss_base,
  (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY {key})
SELECT {key}, n, round(base_rate, 8) AS base_rate, round(brier, 8) AS brier, round(log_loss, 8) AS log_loss, round(mean_p, 8) AS mean_p, round(brier_base, 8) AS brier_base, round(log_loss_base, 8) AS log_loss_base, round(1 - brier / brier_base, 8) AS skill, round(auc, 8) AS auc FROM a"""


def e1_evaluate(spark, d):
    return rounded(evaluation.evaluate(_predictions(spark, d), ["g"]), 8)


SQL["e1_evaluate"] = f"WITH {_P}, x AS (SELECT * FROM p), " + _evaluated("g", "p")


def e2_report(spark, d):
    return rounded(evaluation.report(_predictions(spark, d), "y", "p", 0.6), 8)


SQL["e2_report"] = f"WITH {_P}, s AS (SELECT y, CAST(p >= 0.6 AS INT) AS s FROM p), l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (y = label AND s = label) AS tp, count(*) FILTER (y <> label AND s = label) AS fp, count(*) FILTER (y = label AND s <> label) AS fn, count(*) FILTER (y = s) AS r, count(*) AS a FROM s, l GROUP BY label) SELECT label, round(tp * 1.0 / nullif(tp + fp, 0), 8) AS precision, round(tp * 1.0 / nullif(tp + fn, 0), 8) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1, tp + fn AS support, round(r * 1.0 / a, 8) AS accuracy FROM c"


def e3_calibration(spark, d):
    return rounded(evaluation.calibration_table(_predictions(spark, d), "y", "p", 8), 8)


SQL["e3_calibration"] = f"WITH {_P}, m AS (SELECT min(p) AS lo, max(p) AS hi FROM p), b AS (SELECT y, p, " + " + ".join(f"CAST(lo + (hi - lo) * {k} / 8 < p AS INT)" for k in range(1, 8)) + " AS bin FROM p, m) SELECT bin, round(avg(p), 8) AS said, round(avg(y), 8) AS did, count(*) AS n, round(avg(p) - avg(y), 8) + 0.0 AS gap, count(*) < 30 AS thin FROM b GROUP BY bin"


def e4_reliability(spark, d):
    return rounded(evaluation.reliability(_predictions(spark, d), "y", "p", 10), 8)


SQL["e4_reliability"] = f"WITH {_P}, c AS (SELECT list_distinct(quantile_cont(p, [{', '.join(str(k / 10) for k in range(1, 10))}])) AS c FROM p), b AS (SELECT y, p, len([e FOR e IN c IF e < p]) AS bin FROM p, c) SELECT CAST(bin AS INT) AS bin, round(avg(p), 8) AS said, round(avg(y), 8) AS did, count(*) AS n FROM b GROUP BY bin"


def e5_calibration_error(spark, d):
    ranked = windows.global_rank(_predictions(spark, d), ["p", "unit", "entity"], "rank")
    return rounded(evaluation.calibration_error(ranked, "y", "p", "rank"), 8)


SQL["e5_calibration_error"] = f"""WITH {_P}, tt AS (SELECT y, p, ntile(10) OVER (ORDER BY p, unit, entity) AS t FROM p),
b AS (SELECT abs(avg(p) - avg(y)) AS gap, count(*) AS c FROM tt GROUP BY tt.t)
SELECT round(sum(gap * c) / sum(c), 8) AS ece FROM b"""


def e6_univariate(spark, d):
    """The area of each column alone, in one job over the unpivoted columns."""
    long = _predictions(spark, d).unpivot(["y"], ["p", "q"], "column", "v")
    a = evaluation.auc(long, ["column"], "y", "v")
    return rounded(a.withColumn("distance", F.abs(F.col("auc") - 0.5)), 8)


SQL["e6_univariate"] = f"WITH {_P}, l AS (SELECT y, 'p' AS \"column\", p AS v FROM p UNION ALL SELECT y, 'q', q FROM p), r AS (SELECT *, rank() OVER (PARTITION BY \"column\" ORDER BY v) + (count(*) OVER (PARTITION BY \"column\", v) - 1) / 2.0 AS rk FROM l), a AS (SELECT \"column\", (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1) SELECT \"column\", round(auc, 8) AS auc, round(abs(auc - 0.5), 8) AS distance FROM a"


def sql_weights(replicates: int, rows: str = "p") -> str:
    """SQL: the rows with their weight in each replicate, as a common table expression named w."""
    prime, draw = evaluation.PRIME, " + ".join(f"CAST(u >= {e} AS INT)" for e in evaluation.poisson_edges())
    return f"""h0 AS (SELECT {rows}.*, CAST('0x' || substr(md5(CAST(unit AS VARCHAR)), 1, 7) AS BIGINT) AS seed FROM {rows}),
h1 AS (SELECT h0.*, b, (seed * (b * 1103515 + 12345) + b * 69069 + 1) % {prime} AS x FROM h0, (SELECT unnest(range(1, {replicates + 1})) AS b)),
h2 AS (SELECT *, (xor(x, x >> 15) * 48271 + b) % {prime} AS u FROM h1),
w AS (SELECT *, {draw} AS w FROM h2)"""


REPLICATES, PAIRED = 4000, 2000


def e7_bootstrap(spark, d):
    return rounded(evaluation.bootstrap_skill(_predictions(spark, d), "unit", REPLICATES), 7)


SQL["e7_bootstrap"] = f"""WITH {_P}, {sql_weights(REPLICATES)},
g AS (SELECT b, sum(w) AS n, sum(w * y) * 1.0 / sum(w) AS r, sum(w * (p - y) ** 2) / sum(w) AS br FROM w WHERE w > 0 GROUP BY b),
s AS (SELECT 1 - br / nullif(r * (1 - r), 0) AS s FROM g)
SELECT (SELECT round(1 - avg((p - y) ** 2) / nullif(avg(y) * (1 - avg(y)), 0), 7) FROM p) AS point,
  round(quantile_cont(s, 0.025), 7) AS low, round(quantile_cont(s, 0.975), 7) AS high, round(avg(CAST(s > 0 AS INT)), 7) AS above FROM s"""


def e8_paired(spark, d):
    out = evaluation.paired_bootstrap(_predictions(spark, d), "unit", PAIRED, "y", "q", "p")
    return rounded(out.withColumn("verdict", evaluation.verdict(F.col("point"), F.col("low"), F.col("high"))), 7)


def sql_verdict(point: str, low: str, high: str) -> str:
    return f"CASE WHEN {low} <= 0 AND {high} >= 0 THEN 'tie' WHEN abs({point}) < 0.0005 THEN 'negligible' WHEN {point} > 0 THEN 'BETTER' ELSE 'WORSE' END"


SQL["e8_paired"] = f"""WITH {_P}, {sql_weights(PAIRED)},
v AS (SELECT avg(y) * (1 - avg(y)) AS v, avg((q - y) ** 2 - (p - y) ** 2) AS g FROM p),
g AS (SELECT b, sum(w * ((q - y) ** 2 - (p - y) ** 2)) / sum(w) / (SELECT v FROM v) AS s FROM w WHERE w > 0 GROUP BY b),
i AS (SELECT (SELECT g / v FROM v) AS m, quantile_cont(s, 0.025) AS l, quantile_cont(s, 0.975) AS h, avg(CAST(s > 0 AS INT)) AS wins FROM g)
SELECT round(m, 7) AS point, round(l, 7) AS low, round(h, 7) AS high, round(wins, 7) AS wins, {sql_verdict("m", "l", "h")} AS verdict FROM i"""


#: The last line is one that no unit passes, so it has no scores.
SCORED_LINES = (0.5, 1.5, 2.5, 999.5)


def e12_line_scores(spark, d):
    """Wide prediction columns named by line (F12) to long rows, each line scored against its own outcome, given 30 rows and outcomes of both kinds."""
    u = units(spark, d)
    wide = u.select("unit", "certain", *((1 / (1 + F.exp(-(F.col("n") / 2.0 - x)))).alias(f"over_{str(x).replace('.', '_')}") for x in SCORED_LINES))
    long = wide.unpivot(["unit", "certain"], [c for c in wide.columns if c.startswith("over_")], "name", "p")
    line = F.replace(F.regexp_extract("name", "^over_(.*)$", 1), F.lit("_"), F.lit(".")).cast("double")
    return rounded(evaluation.enough_scores(long.withColumn("line", line).withColumn("y", (F.col("certain") > F.col("line")).cast("int")), ["line"]), 8)


SQL["e12_line_scores"] = f"WITH {UNITS}, x AS (SELECT unit, line, 1 / (1 + exp(-(n / 2.0 - line))) AS p, CAST(certain > line AS INT) AS y FROM u, (SELECT CAST(unnest({list(SCORED_LINES)}) AS DOUBLE) AS line)), " + _evaluated("line", "p") + " WHERE n >= 30 AND base_rate > 0 AND base_rate < 1"


def e14_clean_counts(spark, d):
    """Rows predicted strictly before their own start (P15), and distinct units, by class."""
    u = units(spark, d).select("unit", "entity", F.when(F.col("entity") % 6 != 0, F.date_sub("day", 1)).alias("said_at"), F.when(F.col("unit") % 5 == 0, F.date_sub("day", 2)).otherwise(F.col("day")).alias("start"))
    clean = F.coalesce(F.col("said_at") < F.col("start"), F.lit(False))
    return u.groupBy(clean.alias("clean")).agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"))


SQL["e14_clean_counts"] = f"WITH {UNITS}, c AS (SELECT unit, CASE WHEN entity % 6 <> 0 THEN day - 1 END AS said_at, CASE WHEN unit % 5 = 0 THEN day - 2 ELSE day END AS start FROM u) SELECT coalesce(said_at < start, false) AS clean, count(*) AS n, count(DISTINCT unit) AS units FROM c GROUP BY 1"


def e17_spread(spark, d):
    return rounded(_predictions(spark, d).groupBy("g").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.stddev_samp("p").alias("sd")), 8)


SQL["e17_spread"] = f"WITH {_P} SELECT g, round(min(p), 8) AS low, round(max(p), 8) AS high, round(stddev_samp(p), 8) AS sd FROM p GROUP BY g"


def e19_bias(spark, d):
    p = _predictions(spark, d).groupBy("g").agg(F.sum("p").alias("said"), F.sum("y").alias("did"))
    return rounded(p.withColumn("ratio", F.try_divide("said", "did")), 6)


SQL["e19_bias"] = f"WITH {_P} SELECT g, round(sum(p), 6) AS said, sum(y) AS did, round(sum(p) / sum(y), 6) AS ratio FROM p GROUP BY g"


def m14_threshold(spark, d):
    return rounded(evaluation.best_threshold(_predictions(spark, d).withColumn("p", F.round("p", 6)), "y", "p"), 8)


SQL["m14_threshold"] = f"WITH {_P}, c AS (SELECT round(p, 6) AS threshold, sum(y) AS a, sum(1 - y) AS b FROM p GROUP BY 1), j AS (SELECT threshold, sum(a) OVER (ORDER BY threshold DESC) * 1.0 / sum(a) OVER () - sum(b) OVER (ORDER BY threshold DESC) * 1.0 / sum(b) OVER () AS j FROM c) SELECT threshold, round(j, 8) AS j FROM j ORDER BY round(j, 12) DESC, threshold DESC LIMIT 1"

QUERIES = {f.__name__: f for f in (e1_evaluate, e2_report, e3_calibration, e4_reliability, e5_calibration_error, e6_univariate, e7_bootstrap, e8_paired, e12_line_scores, e14_clean_counts, e17_spread, e19_bias, m14_threshold)}
