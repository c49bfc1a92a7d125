"""Registered model queries: fits are beyond SQL, so they have none; tests hold them against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, joins, models, windows
from ..sources.shared import new_path, staged
from .bindings import rounded, units

SQL: dict[str, str] = {}
FORM = ["own_hit", "own_n", "own_bases"]


def form_frame(spark, d):
    """Units with what was known before them: means of the entity's last ten units, and the day's calendar."""
    u = units(spark, d).select("entity", "unit", "day", "n", "is_hit", "rbi", "total_bases")
    w = windows.prior(["entity"], ["day", "unit"], 10)
    f = u.withColumns({"own_hit": windows.guarded(F.col("is_hit"), F.avg, w, 3), "own_n": windows.guarded(F.col("n"), F.avg, w, 3), "own_bases": windows.guarded(F.col("total_bases"), F.avg, w, 3)})
    f = f.withColumns({"number": F.datediff("day", F.lit("1990-01-01")), "month": F.month("day").cast("double"), "got": (F.col("is_hit") > 0).cast("int")})
    return staged(f.dropna(subset=FORM), "model-frame")


def split_frame(f):
    s = joins.time_split(f, ["number", "unit", "entity"], [0.6, 0.15])
    return s.where("part = 0"), s.where("part = 1"), s.where("part = 2")


def m1_balanced(spark, d):
    train, _, test = split_frame(form_frame(spark, d))
    m = models.logistic(train, FORM, "got", 1.0, standardised=False, balanced=True)
    return rounded(evaluation.report(models.predicted(m, test), "got", "p", 0.5), 6)


def m2_logistic(spark, d):
    """Fit, store, load (S30), and evaluate on later units."""
    train, _, test = split_frame(form_frame(spark, d))
    path = new_path(spark, "model")
    models.logistic(train, FORM, "got", 0.1).write().save(path)
    loaded = models.PipelineModel.load(path)
    return rounded(evaluation.evaluate(models.predicted(loaded, test).withColumn("y", F.col("got")), []), 6)


def m4_counts(spark, d):
    """A unit's size as a distribution, with the mean errors of the model, the own mean and the pool's mean (M6)."""
    train, _, test = split_frame(form_frame(spark, d))
    p = models.predicted_counts(models.counts_model(train, FORM, "n"), test)
    mean = F.aggregate(F.transform("dist", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    pool = train.agg(F.avg("n").alias("pool"))
    return rounded(p.withColumn("mean", mean).join(F.broadcast(pool)).agg(F.avg(F.abs(F.col("n") - F.col("mean"))).alias("model"), F.avg(F.abs(F.col("n") - F.col("own_n"))).alias("own"), F.avg(F.abs(F.col("n") - F.col("pool"))).alias("pool"), F.corr("n", "mean").alias("corr")), 6)


def m7_two_stage(spark, d):
    """Two ridges in a chain, clipped, against a constant."""
    train, _, test = split_frame(form_frame(spark, d))
    first = models.ridge(train, FORM, "total_bases", least=100)
    chain = lambda rows: models.predicted_value(first, rows, "bases", 0.0, 12.0, 1.0)
    second = models.ridge(chain(train), ["bases"], "rbi", least=100)
    out = models.predicted_value(second, chain(test), "said", 0.0, 4.0, 0.1)
    mean = train.agg(F.avg("rbi").alias("constant"))
    return rounded(out.join(F.broadcast(mean)).agg(F.avg(F.abs(F.col("rbi") - F.col("said"))).alias("two_stage"), F.avg(F.abs(F.col("rbi") - F.col("constant"))).alias("constant"), F.avg("said").alias("said"), F.avg("rbi").alias("did")), 6)


def m10_calibrators(spark, d):
    train, check, _ = split_frame(form_frame(spark, d))
    p = models.predicted(models.logistic(train, FORM, "got", 0.1), check).withColumn("y", F.col("got"))
    return rounded(models.choose_calibrator(p, ["number", "unit", "entity"])[1], 6)


def m11_choose_c(spark, d):
    train, check, _ = split_frame(form_frame(spark, d))
    return rounded(models.choose_c(train, check, FORM, "got"), 6)


def m13_compare(spark, d):
    train, _, test = split_frame(form_frame(spark, d))
    return rounded(models.compare(train, test, FORM, "got", "unit", 60, (15, 30)), 6)


def m15_coefficients(spark, d):
    train, _, _ = split_frame(form_frame(spark, d))
    return rounded(models.coefficients(models.logistic(train, FORM, "got", 0.1), train), 6)


def e9_rolling_origin(spark, d):
    return rounded(models.rolling_origin(form_frame(spark, d), ["number", "unit", "entity"], FORM, "got"), 6)


def e10_permutation(spark, d):
    train, _, test = split_frame(form_frame(spark, d))
    return rounded(models.permutation_test(train, test, FORM, ["own_hit"], "got"), 6)


def e15_ladder(spark, d):
    train, _, test = split_frame(form_frame(spark, d))
    return rounded(models.ladder(train, test, {"form": FORM[:1], "form+size": FORM[:2], "all": [*FORM, "month"]}, "got"), 6)


QUERIES = {f.__name__: f for f in (m1_balanced, m2_logistic, m4_counts, m7_two_stage, m10_calibrators, m11_choose_c, m13_compare, m15_coefficients, e9_rolling_origin, e10_permutation, e15_ladder)}
