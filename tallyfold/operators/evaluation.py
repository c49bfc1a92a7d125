"""How good predictions are: skill, calibration, resampling. y is 0/1, p a probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import exact_percentiles


def auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """The exact area under the curve of each key: counts per score, then a running count over the scores.

    Scores are counted in ranges of 1/1024 first, so that the running count inside a range stays small.
    """
    part = F.floor(F.col(p) * 1024)
    counts = df.groupBy(*keys, part.alias("_part"), F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg"))
    ranges = counts.groupBy(*keys, "_part").agg(F.sum("_neg").alias("_n"))
    before = ranges.withColumn("_below", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("_neg").over(Window.partitionBy(*keys, "_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_inside", inside).join(before, [*keys, "_part"])
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_inside") + F.col("_neg") / 2))
    return placed.groupBy(*keys).agg(F.try_divide(wins, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"))


def scores(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """n, base rate, Brier and its base and skill, log loss and its base, mean prediction."""
    q, t = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6)), F.col(y).cast("double")
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(t).alias("base_rate"), F.avg(F.pow(F.col(p) - t, 2)).alias("brier"),
        F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"), F.avg(p).alias("mean_p"),
    )
    b = F.least(F.greatest(F.col("base_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    g = g.withColumns({"brier_base": F.col("base_rate") * (1 - F.col("base_rate")), "log_loss_base": -(b * F.log(b) + (1 - b) * F.log(1 - b))})
    return g.withColumn("skill", 1 - F.try_divide("brier", "brier_base"))


def evaluate(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    keyed = df if keys else df.withColumn("_all", F.lit(0))
    own = keys or ["_all"]
    return scores(keyed, own, y, p).join(auc(keyed, own, y, p), own).drop("_all")


def enough_scores(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", least: int = 30) -> DataFrame:
    """`evaluate` over rows with both values, for keys with `least` of them and outcomes of both kinds; other keys have no row."""
    whole = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return evaluate(whole, keys, y, p).where((F.col("n") >= least) & (F.col("base_rate") > 0) & (F.col("base_rate") < 1))


def report(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """Precision, recall, F1, support of both classes, and accuracy, at a threshold."""
    said = (F.col(p) >= threshold).cast("int")
    rows = df.select(F.col(y).cast("int").alias("y"), said.alias("s"))
    cells = rows.agg(*(F.count_if((F.col("y") == a) & (F.col("s") == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    per = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"c{k}{k}").alias("tp"), F.col(f"c{1 - k}{k}").alias("fp"), F.col(f"c{k}{1 - k}").alias("fn"), (F.col("c00") + F.col("c11")).alias("right"), F.expr("c00 + c01 + c10 + c11").alias("all")) for k in (0, 1))))
    x = cells.select(per.alias("x")).select("x.*")
    return x.select("label", F.try_divide("tp", F.expr("tp + fp")).alias("precision"), F.try_divide("tp", F.expr("tp + fn")).alias("recall"), F.try_divide(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")).alias("f1"), F.expr("tp + fn").alias("support"), F.try_divide("right", "all").alias("accuracy"))


def calibration_table(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """Equal-width bins over the range of p, closed on the right: mean prediction, outcome, rows, gap."""
    ends = df.agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
    edges = F.array(*((F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / bins) for k in range(1, bins)))
    bin_ = F.size(F.filter(edges, lambda e: e < F.col(p)))
    g = df.join(F.broadcast(ends)).withColumn("bin", bin_).groupBy("bin").agg(F.avg(p).alias("said"), F.avg(y).alias("did"), F.count("*").alias("n"))
    return g.withColumns({"gap": F.col("said") - F.col("did"), "thin": F.col("n") < 30})


def reliability(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """Bins of equal counts at p's quantiles; equal edges count once."""
    cut = exact_percentiles(df, p, [k / bins for k in range(1, bins)], "_cut").select(F.array_distinct("_cut").alias("_cut"))
    bin_ = F.size(F.filter("_cut", lambda e: e < F.col(p)))
    return df.join(F.broadcast(cut)).withColumn("bin", bin_).groupBy("bin").agg(F.avg(p).alias("said"), F.avg(y).alias("did"), F.count("*").alias("n"))


def calibration_error(df: DataFrame, y: str, p: str, rank: str, bins: int = 10) -> DataFrame:
    """One row (ece): mean gap between said and did over `bins` runs of the rank column 1..n, weighted by rows.

    The first n mod bins runs have one row more, like ntile.
    """
    n = df.agg(F.count("*").alias("_n"))
    small, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    long = more * (small + 1)
    tile = F.when(F.col(rank) <= long, F.floor((F.col(rank) - 1) / (small + 1))).otherwise(more + F.floor((F.col(rank) - 1 - long) / F.greatest(small, F.lit(1))))
    g = df.join(F.broadcast(n)).groupBy(tile.alias("tile")).agg(F.abs(F.avg(p) - F.avg(y)).alias("gap"), F.count("*").alias("c"))
    return g.agg((F.sum(F.col("gap") * F.col("c")) / F.sum("c")).alias("ece"))


#: Resampling draws are whole numbers below this prime, so that any engine gives the same ones.
PRIME = (1 << 31) - 1


def poisson_edges() -> list[int]:
    """A Poisson(1) draw is the number of these edges that a draw below PRIME reaches; up to 7."""
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(1, 8):
        total += term
        term /= k
        out.append(int(total * PRIME))
    return out


#: Replicates' weights that a task holds at once: 8 bytes each.
_DRAWS = 1 << 20


def resampled_sums(df: DataFrame, key: str, replicates: int, values: dict[str, Column]) -> DataFrame:
    """(replicate, w, and the weighted sum of each value) for replicates 1..n: Poisson resampling with weights from a hash of key and replicate.

    A row's seed is a digest of its key; the draws of its replicates are two rounds of products below PRIME from it.  Every task
    keeps its own sums, so what is shuffled is a row for each task and replicate, however many rows there are.
    """
    seed = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long")
    rows = df.select(seed.alias("_seed"), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(c) for c, v in values.items()))
    edges, names = poisson_edges(), ["replicate", "w", *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.arange(1, replicates + 1, dtype=np.int64)
        factor, more = b * 1103515 + 12345, b * 69069 + 1
        sums, step = None, max(1, _DRAWS // replicates)
        for batch in batches:
            cols = [np.ones(batch.num_rows), *(c.to_numpy() for c in batch.columns[1:])]
            seeds = batch.column(0).to_numpy()
            for at in range(0, len(seeds), step):
                x = (seeds[at : at + step, None] * factor + more) % PRIME
                u = ((x ^ (x >> 15)) * 48271 + b) % PRIME
                w = np.zeros(u.shape)
                for e in edges:
                    w += u >= e
                part = np.stack([c[at : at + step] for c in cols]) @ w
                sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(b), *map(pa.array, sums)], names=names)

    parts = rows.mapInArrow(run, "replicate long, w double, " + ", ".join(f"{c} double" for c in values))
    return parts.groupBy("replicate").agg(F.sum("w").alias("w"), *(F.sum(c).alias(c) for c in values)).where("w > 0")


def _interval(name: str) -> list[Column]:
    """The 2.5 % and 97.5 % points over replicates, of which there are a few thousand."""
    return [F.percentile(name, 0.025).alias("low"), F.percentile(name, 0.975).alias("high"), F.avg((F.col(name) > 0).cast("double")).alias("above")]


def bootstrap_skill(df: DataFrame, key: str, replicates: int = 4000, y: str = "y", p: str = "p") -> DataFrame:
    """One row: the Brier skill (point), the 2.5 % and 97.5 % points of it over replicates and the share above 0."""
    t = F.col(y).cast("double")
    rows = df.select(key, t.alias("_t"), F.pow(F.col(p) - t, 2).alias("_e"))
    g = resampled_sums(rows, key, replicates, {"x": F.col("_t"), "b": F.col("_e")})
    r = F.col("x") / F.col("w")
    skill = g.select((1 - (F.col("b") / F.col("w")) / F.nullif(r * (1 - r), F.lit(0.0))).alias("s"))
    point = rows.agg((1 - F.avg("_e") / F.nullif(F.avg("_t") * (1 - F.avg("_t")), F.lit(0.0))).alias("point"))
    return point.crossJoin(skill.agg(*_interval("s")))  # one row and one row


def paired_bootstrap(df: DataFrame, key: str, replicates: int = 2000, y: str = "y", first: str = "p", second: str = "q") -> DataFrame:
    """One row: the second prediction's gain in Brier over the outcome's variance (point), its interval, and how often it wins."""
    t = F.col(y).cast("double")
    rows = df.select(key, t.alias("_t"), (F.pow(F.col(first) - t, 2) - F.pow(F.col(second) - t, 2)).alias("_gain"))
    base = rows.agg((F.avg("_t") * (1 - F.avg("_t"))).alias("_v"), F.avg("_gain").alias("_g"))
    g = resampled_sums(rows, key, replicates, {"g": F.col("_gain")})
    s = g.crossJoin(F.broadcast(base)).select((F.col("g") / F.col("w") / F.col("_v")).alias("s"))  # one row beside each replicate
    point = base.select((F.col("_g") / F.col("_v")).alias("point"))
    return point.crossJoin(s.agg(*_interval("s")).withColumnRenamed("above", "wins"))


def verdict(point: Column, low: Column, high: Column, least: float = 0.0005) -> Column:
    """In words: a gain must clear both zero and a floor."""
    return F.when((low <= 0) & (high >= 0), "tie").when(F.abs(point) < least, "negligible").when(point > 0, "BETTER").otherwise("WORSE")


def best_threshold(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: the score with the largest true minus false positive rate (the highest such score)."""
    c = df.groupBy(F.col(p).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg"))
    part = F.floor(F.col("threshold") * 1024)
    c = c.withColumn("_part", part)
    ranges = c.groupBy("_part").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # 1,025 rows at most
    before = ranges.select("_part", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    at = c.withColumns({"_pi": F.sum("_pos").over(inside), "_ni": F.sum("_neg").over(inside)}).join(F.broadcast(before), "_part")
    totals = ranges.agg(F.sum("_p").alias("_pt"), F.sum("_n").alias("_nt"))
    j = at.join(F.broadcast(totals)).select("threshold", ((F.col("_pi") + F.col("_p0")) / F.col("_pt") - (F.col("_ni") + F.col("_n0")) / F.col("_nt")).alias("j"))
    return j.agg(F.max(F.struct(F.round("j", 12).alias("j"), "threshold")).alias("x")).select("x.threshold", "x.j")


def compared(results: dict[str, DataFrame], y: str = "y", p: str = "p") -> DataFrame:
    """label, n, auc, brier, brier_skill, log_loss of several frames of predictions, in their order (`place`)."""
    out = None
    for at, (label, df) in enumerate(results.items()):
        rows = df.select(F.lit(at).alias("place"), F.lit(label).alias("label"), F.col(y).alias("y"), F.col(p).alias("p"))
        out = rows if out is None else out.unionByName(rows)
    e = evaluate(out, ["place", "label"])
    return e.select("place", "label", "n", "auc", "brier", F.col("skill").alias("brier_skill"), "log_loss")
