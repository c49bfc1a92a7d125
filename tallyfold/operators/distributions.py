"""Count distributions as arrays: element v is the probability of the count v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import resampled_sums

MOST = 20


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often and deep in lambdas it is used."""
    return F.transform(F.array(value), use)[0]


def normalised(dist: Column) -> Column:
    return bound(dist, lambda d: bound(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(d, lambda x: x / total)))


def mean_of(dist: Column) -> Column:
    return F.aggregate(F.transform(dist, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)


def convolved(a: Column, b: Column, most: int = MOST) -> Column:
    """The distribution of the sum, cut off above `most`."""
    at = F.sequence(F.lit(0), F.lit(most))
    last = F.size(b) - 1  # b is the shorter one
    return F.transform(at, lambda k: F.aggregate(F.sequence(F.lit(0), F.least(k, last)), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(a, k - i), F.lit(0.0)) * F.get(b, i)))


def compounded(dist: Column, n: Column, most: int = MOST) -> Column:
    """The distribution of the sum of n independent draws, cut off above `most` and normalised."""
    start = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda v: F.when(v == 0, 1.0).otherwise(0.0))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return normalised(F.aggregate(steps, start, lambda acc, _: convolved(acc, dist, most)))


def over_line(dist: Column, line: Column) -> Column:
    """P(count > line)."""
    first = F.floor(line).cast("int") + 1
    return F.aggregate(F.filter(F.transform(dist, lambda p, v: F.when(v >= first, p)), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def at_least_one(p: Column, n: Column) -> Column:
    return 1 - F.pow(1 - F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), n)


def tilted(dist: Column, target: Column, span: float = 5.0, rounds: int = 80) -> Column:
    """`dist` reweighted by exp(theta * v) so that its mean is `target`, theta found by bisection."""

    def low(mid: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("m"))
        weights = F.transform(dist, lambda p, v: F.struct((p * F.exp(mid * v)).alias("w"), v.alias("v")))
        return F.aggregate(weights, start, lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), (a["m"] + x["w"] * x["v"]).alias("m")), lambda a: a["m"] < target * a["s"])

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        return bound(low(mid), lambda below: F.struct(F.when(below, mid).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(-span).alias("lo"), F.lit(span).alias("hi"))
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return normalised(bound(theta, lambda t: F.transform(dist, lambda p, v: p * F.exp(t * v))))


def frequency_scaled(dist: Column, target: Column) -> Column:
    """`dist` with its non-zero counts scaled so that the mean is `target`; where that takes more than all mass, tilted."""
    facts = F.struct((target / mean_of(dist)).alias("factor"), F.aggregate(F.slice(dist, 2, MOST + 1), F.lit(0.0), lambda a, x: a + x).alias("some"))

    def scaled(f: Column) -> Column:
        plain = F.transform(dist, lambda p, v: F.when(v == 0, 1 - f["factor"] * f["some"]).otherwise(f["factor"] * p))
        return F.when((target <= 0) | (F.abs(f["factor"] - 1) < 1e-12), dist).when(f["factor"] * f["some"] >= 1, tilted(dist, target)).otherwise(plain)

    return bound(facts, scaled)


#: A mean-one multiplier's points in standard deviations, and their weights.
GRID = [(-2.0, 0.05), (-1.0, 0.25), (0.0, 0.4), (1.0, 0.25), (2.0, 0.05)]


def dispersion_grid(sd: float) -> list[tuple[float, float]]:
    """(multiplier, weight): floored at 0.05 and brought back to mean 1."""
    raw = [(max(1 + z * sd, 0.05), w) for z, w in GRID]
    mean = sum(x * w for x, w in raw)
    return [(x / mean, w) for x, w in raw]


def scaled_to(dist: Column, target: Column, method: str) -> Column:
    """`dist` with the mean `target`, by "frequency" or by "tilt"."""
    return frequency_scaled(dist, target) if method == "frequency" else tilted(dist, target)


def compounded_overdispersed(df: DataFrame, keys: list[str], dist: str, n: str, sd: float, name: str, most: int = MOST, method: str = "frequency") -> DataFrame:
    """keys and `name`: a mixture of `compounded` over multipliers of the mean. Keys must be unique.

    The grid's five rows per key are separate rows, so each scaled distribution is worked out once.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(w).alias("w")) for m, w in dispersion_grid(sd))))
    rows = df.select(*keys, F.col(dist).alias("_d"), F.col(n).alias("_n"), grid.alias("_g")).withColumn("_target", mean_of(F.col("_d")) * F.col("_g.m"))
    scaled = rows.withColumn("_s", scaled_to(F.col("_d"), F.col("_target"), method)).withColumn("_c", compounded(F.col("_s"), F.col("_n"), most))
    mixed = [F.sum(F.col("_g.w") * F.element_at("_c", k + 1)) for k in range(most + 1)]
    return scaled.groupBy(*keys).agg(F.array(*mixed).alias(name))


def point_at_zero(most: int = MOST) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda v: F.when(v == 0, 1.0).otherwise(0.0))


def answers_by_size(dist: Column, lines: Column, largest: int, most: int = MOST) -> Column:
    """Element n - 1: P(sum of n draws > line) for each line. One fold over the sizes 1..largest emits them all."""

    def answers(c: Column) -> Column:
        return bound(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(lines, lambda line: over_line(c, line) / total))

    def step(state: Column, _: Column) -> Column:
        said = lambda c: F.struct(c.alias("c"), F.array_append(state["said"], answers(c)).alias("said"))
        return bound(convolved(state["c"], dist, most), said)

    start = F.struct(point_at_zero(most).alias("c"), F.array().cast("array<array<double>>").alias("said"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(largest)), start, step, lambda s: s["said"])


def grid_of(sd: Column) -> Column:
    """`dispersion_grid` of a column: an array of (m, w)."""
    raw = [F.greatest(1 + z * sd, F.lit(0.05)) for z, _ in GRID]
    mean = sum((x * w for x, (_, w) in zip(raw, GRID)), F.lit(0.0))
    return F.array(*(F.struct((x / mean).alias("m"), F.lit(w).alias("w")) for x, (_, w) in zip(raw, GRID)))


def batch_over_lines(rows: DataFrame, keys: list[str], mean: str, sizes: str, shapes: DataFrame, largest: int, digits: int = 4, method: str = "frequency", most: int = MOST) -> DataFrame:
    """keys, target, line, over: the chance of every row to be above every line of its target.

    rows: keys, target, the mean per trial, and `sizes`, whose element k is the weight of k + 1 trials, up to `largest`.  shapes: a row for each
    target with shape (the distribution of one trial), sd (of the mean-one multiplier) and lines.  Means are rounded to `digits`, so that
    a distribution is worked out once for each target, mean and multiplier that occurs, however many rows share it; their number is bounded by
    the grid of means.  Rows whose target has no shape, and rows with a null mean or no sizes, are left out.
    """
    step = 10.0**digits
    # halves that differ in their last bits round alike
    told = rows.select(*keys, "target", (F.floor(F.col(mean) * step + 0.5000001) / step).alias("_q"), F.col(sizes).alias("_sizes")).where("_q is not null and size(_sizes) > 0")
    cases = told.select("target", "_q").distinct().join(F.broadcast(shapes), "target")
    shaped = cases.withColumn("_d", scaled_to(F.col("shape"), F.col("_q"), method))
    # a row for each multiplier, so that work on one case can be dealt to several tasks
    each = shaped.select("target", "_q", "_d", "lines", F.explode(grid_of(F.col("sd"))).alias("_g")).repartition("target", "_q", "_g")
    scaled = each.withColumn("_s", scaled_to(F.col("_d"), mean_of(F.col("_d")) * F.col("_g.m"), method))
    answered = scaled.select("target", "_q", "lines", F.col("_g.w").alias("_w"), F.posexplode(answers_by_size(F.col("_s"), F.col("lines"), largest, most)).alias("_n", "_a"))
    by_line = answered.select("target", "_q", "_n", "_w", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("_a").alias("p"))))
    mixed = by_line.groupBy("target", "_q", "line", "_n").agg(F.sum(F.col("_w") * F.col("p")).alias("p"))
    table = mixed.groupBy("target", "_q", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "p"))), lambda x: x["p"]).alias("p"))
    table = table.groupBy("target", "_q").agg(F.collect_list(F.struct("line", "p")).alias("_lines"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    over = lambda x: F.struct(x["line"].alias("line"), (total(F.zip_with(F.slice("_sizes", 1, largest), x["p"], lambda w, p: w * p)) / total(F.slice("_sizes", 1, largest))).alias("over"))
    return told.join(table, ["target", "_q"]).select(*keys, "target", F.inline(F.transform("_lines", over)))


def histogram(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """`dist` for each key: the share of rows at each value, clipped to 0..most."""
    v = F.least(F.greatest(F.col(value), F.lit(0)), F.lit(most)).cast("int")
    counts = [F.avg((v == k).cast("double")) for k in range(most + 1)]
    return df.groupBy(*keys).agg(F.array(*counts).alias("dist"), F.count("*").alias("n_rows"))


def contributions(df: DataFrame, value: str, on_base: str, share: Column, most: int = 6) -> DataFrame:
    """One row: the distribution of `value`, rows on base being worth one more with probability `share`."""
    v = F.least(F.greatest(F.col(value), F.lit(0)), F.lit(most)).cast("int")
    more = F.least(v + 1, F.lit(most))
    split = F.when(F.col(on_base) == 1, F.array(F.struct(v.alias("v"), (1 - share).alias("w")), F.struct(more.alias("v"), share.alias("w")))).otherwise(F.array(F.struct(v.alias("v"), F.lit(1.0).alias("w"))))
    rows = df.select(F.explode(split).alias("x")).select("x.*")
    total = F.sum("w")
    return rows.agg(F.array(*(F.sum(F.when(F.col("v") == k, F.col("w")).otherwise(0.0)) / total for k in range(most + 1))).alias("dist"))


def dispersion(df: DataFrame, n: str, total: str, mean: float | Column, variance: float | Column, least: int = 100) -> DataFrame:
    """One row (sd): the spread of a mean-one multiplier behind the totals; 0 without enough rows or excess."""
    mean, variance = (F.lit(x) if not isinstance(x, Column) else x for x in (mean, variance))
    excess = (F.var_pop(total) - F.avg(n) * variance) / (F.avg(F.col(n) * F.col(n)) * mean * mean)
    return df.agg(F.when((F.count("*") >= least) & (excess > 0), F.sqrt(excess)).otherwise(0.0).alias("sd"))


def marginal(df: DataFrame, keys: list[str], weight: str, answer: str, name: str) -> DataFrame:
    """The weighted mean answer over a long table of cases."""
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(answer)) / F.sum(weight)).alias(name))


def non_increasing(df: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """The least-squares non-increasing fit along `at` within each key (groups of a few rows).

    fit(i) = min over a <= i of max over b >= i of the mean of a..b.
    """
    group = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]).alias("_v"), F.array_sort(F.collect_list(at)).alias("_at"))

    def mean(a: Column, b: Column) -> Column:
        return F.aggregate(F.slice("_v", a, b - a + 1), F.lit(0.0), lambda s, x: s + x) / (b - a + 1)

    size = F.size("_v")
    fit = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.array_min(F.transform(F.sequence(F.lit(1), i), lambda a: F.array_max(F.transform(F.sequence(i, size), lambda b: mean(a, b))))),
    )
    return group.select(*keys, F.explode(F.arrays_zip(F.col("_at").alias(at), fit.alias(name))).alias("_x")).select(*keys, f"_x.{at}", f"_x.{name}")


#: Fewest rows with a slot for which a unit's sizes are held to its order.
SLOTTED = 4
SPAN = 10.0


def monotone_sizes(df: DataFrame, unit: list[str], slot: str, sizes: str, least: int = SLOTTED) -> DataFrame:
    """`df` with columns fit and new_sizes: the distributions in column `sizes` tilted so that means do not rise along the slots of a unit.

    Slots are unique within a unit.  Rows without a slot, rows of units with fewer than `least` slots taken, and rows whose mean already fits keep their
    distribution, and fit is their own mean.  Each (distribution, fit) is tilted once for all rows that share it, by SPAN at
    most: a fit beyond the sizes that a distribution holds is not reached.
    """
    own = df.withColumn("_mean", mean_of(F.col(sizes)))
    held = own.where(F.col(slot).isNotNull()).withColumn("_many", F.count("*").over(Window.partitionBy(*unit))).where(F.col("_many") >= least)
    fit = non_increasing(held, unit, slot, "_mean", "_fit")
    j = own.join(fit, [*unit, slot], "left").withColumn("fit", F.when(F.abs(F.col("_fit") - F.col("_mean")) >= 1e-9, F.col("_fit")))
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be put together into one task
    moved = j.where("fit is not null").select(sizes, "fit").repartition(wide, sizes, "fit").distinct()
    moved = moved.withColumn("_new", tilted(F.col(sizes), F.col("fit"), SPAN, rounds=45))
    j = j.join(moved, [sizes, "fit"], "left")
    return j.select(*df.columns, F.coalesce("fit", "_mean").alias("fit"), F.coalesce("_new", sizes).alias("new_sizes"))


METHODS = ("frequency", "tilt")


def method_scores(games: DataFrame, key: str, base: str, mean: str, n: str, total: str, sd: float, lines: tuple[float, ...], replicates: int = 300, most: int = MOST) -> DataFrame:
    """One row: each method's mean gap between said and did over the lines, and how often "frequency" has the smaller gap in resampled games.

    games: a row for each game with the base distribution, the wanted mean, the size n and the total. Distributions are
    worked out once for each distinct (base, mean, n); the resampling only sums their answers.
    """
    cases = games.select(F.col(base).alias("k_base"), F.col(mean).alias("k_mean"), F.col(n).alias("k_n")).distinct()
    rows = games.select(key, F.col(base).alias("k_base"), F.col(mean).alias("k_mean"), F.col(n).alias("k_n"), F.col(total).alias("_t"))
    for method in METHODS:
        scaled = cases.withColumn("_d", scaled_to(F.col("k_base"), F.col("k_mean"), method))
        c = compounded_overdispersed(scaled, ["k_base", "k_mean", "k_n"], "_d", "k_n", sd, "_c", most, method)
        rows = rows.join(c.select("k_base", "k_mean", "k_n", F.array(*(over_line(F.col("_c"), F.lit(x)) for x in lines)).alias(f"_{method}")), ["k_base", "k_mean", "k_n"])

    facts = {f"{m}_{k}": F.get(f"_{m}", k) for m in METHODS for k in range(len(lines))} | {f"did_{k}": (F.col("_t") > x).cast("double") for k, x in enumerate(lines)}

    def gap(method: str) -> Column:
        each = [F.abs(F.col(f"{method}_{k}") - F.col(f"did_{k}")) / F.col("w") for k in range(len(lines))]
        return sum(each[1:], each[0]) / len(lines)

    own = rows.agg(F.count("*").alias("w"), *(F.sum(v).alias(c) for c, v in facts.items())).select(*(gap(m).alias(f"{m}_gap") for m in METHODS))
    drawn = resampled_sums(rows, key, replicates, facts).select(*(gap(m).alias(m) for m in METHODS))
    return own.crossJoin(drawn.agg(F.avg((F.col("frequency") < F.col("tilt")).cast("double")).alias("frequency_wins")))  # one row and one row


def chosen_method(frequency_wins: Column, least: float = 0.75) -> Column:
    """"tilt" only if it wins clearly; "frequency" keeps the shape that was seen."""
    return F.when(frequency_wins < 1 - least, "tilt").otherwise("frequency")
