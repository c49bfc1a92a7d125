"""Shrunk rates, their strengths, and the blends that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import guarded, prior, shrunk

#: Strengths without enough groups, without spread, and the range of all others.
FEW, NO_SPREAD, WEAKEST, STRONGEST = 500.0, 5000.0, 10.0, 5000.0


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def odds(p: Column) -> Column:
    p = clip(p, 1e-6, 1 - 1e-6)
    return p / (1 - p)


def log5(a: Column, b: Column, league: Column) -> Column:
    """Two sides' rates against the league's, as an odds ratio turned back into a probability."""
    o = odds(a) * odds(b) / odds(league)
    return o / (1 + o)


def blend(first: Column, second: Column, share: Column) -> Column:
    return share * first + (1 - share) * second


def expected_bases(p_top: Column, p_hit: Column, per_hit: Column) -> Column:
    """Four for the top outcome, `per_hit` for every other hit."""
    return 4 * p_top + F.greatest(p_hit - p_top, F.lit(0.0)) * per_hit


def strengths(df: DataFrame, entity: str, values: list[str], least: int) -> DataFrame:
    """One row with {v}_league and {v}_k for each value: how many trials of the league mean an entity's rate is worth.

    Beta-binomial method of moments over entities with `least` trials.  One aggregate by entity serves the league's mean, the moments and all values.
    """
    sums = [a for v in values for a in (F.sum(v).alias(f"_x_{v}"), F.count(v).alias(f"_n_{v}"))]
    own = df.groupBy(entity).agg(*sums)
    aggs = []
    for v in values:
        x, n = F.col(f"_x_{v}"), F.col(f"_n_{v}")
        many = lambda c, n=n: F.when(n >= least, c)
        moments = {"groups": F.count_if(n >= least), "p": F.sum(many(x)) / F.sum(many(n)), "var": F.var_samp(many(x / n)), "inv": F.avg(many(1 / n))}
        aggs += [(F.sum(x) / F.sum(n)).alias(f"{v}_league"), *(c.alias(f"_{name}_{v}") for name, c in moments.items())]

    def worth(v: str) -> Column:
        p = F.col(f"_p_{v}")
        spread = F.col(f"_var_{v}") - p * (1 - p) * F.col(f"_inv_{v}")
        return F.when(F.col(f"_groups_{v}") < 3, FEW).when(spread <= 1e-9, NO_SPREAD).otherwise(clip(p * (1 - p) / spread - 1, WEAKEST, STRONGEST))

    return own.agg(*aggs).select(*(c for v in values for c in (F.col(f"{v}_league"), worth(v).alias(f"{v}_k"))))


def strength(df: DataFrame, entity: str, value: str, least: int) -> DataFrame:
    """`strengths` of one value as (league, k)."""
    return strengths(df, entity, [value], least).toDF("league", "k")


def ratio_strength(own: DataFrame, actual: str, expected: str, trials: str, rate: str = "q", least: int = 100, groups: int = 50, few: float = 260.0) -> DataFrame:
    """One row (strength): how many trials of the league an entity's ratio actual / expected is worth; null if the ratios show no real spread.

    Method of moments over entities with `least` trials: the spread of ratios beyond what binomial noise of the
    league's `rate` (one value in all rows) gives. Fewer than `groups` entities give `few`.
    """
    q, usable = F.first("_q"), own.where((F.col(trials) >= least) & (F.col(expected) > 0)).withColumn("_q", F.col(rate))
    m = usable.agg(F.count("*").alias("groups"), F.var_samp(F.col(actual) / F.col(expected)).alias("var"), F.avg(1 / F.col(trials)).alias("inv"), q.alias("q"))
    spread = F.col("var") - (1 - F.col("q")) / F.col("q") * F.col("inv")
    k = F.when(F.col("groups") < groups, few).when(spread > 0, (1 - F.col("q")) / (F.col("q") * spread))
    return m.select(k.alias("strength"))


def rolling_rates(df: DataFrame, keys: list[str], order: list[str], values: list[str], sizes=(150, 600), least=20, min_trials=20) -> DataFrame:
    """`v_rate_n` and `v_rate_career`: sums over earlier trials, shrunk to the league with the table's own strength."""
    out = df.join(F.broadcast(strengths(df, keys[0], values, min_trials)))  # one row
    cols = {}
    for v in values:
        for n in (*sizes, None):
            w = prior(keys, order, n)
            enough = 1 if n is None else least
            x = F.coalesce(guarded(F.col(v), F.sum, w, enough), F.lit(0))
            m = F.coalesce(guarded(F.col(v), F.count, w, enough), F.lit(0))
            cols[f"{v}_rate_{n or 'career'}"] = shrunk(x, m, F.col(f"{v}_league"), F.col(f"{v}_k"))
    return out.withColumns(cols)


def group_rates(df: DataFrame, key: str, values: list[str], split: str, split_values: list[str], min_trials: int = 20, split_strength: float = 200.0) -> DataFrame:
    """Each group's rates shrunk to the league, and its rates by `split` shrunk to its own."""
    aggs = {"n": F.count("*")}
    for v in values:
        aggs[f"x_{v}"] = F.sum(v)
        for s in split_values:
            aggs[f"x_{v}_{s}"] = F.sum(F.when(F.col(split) == s, F.col(v)).otherwise(0))
    for s in split_values:
        aggs[f"n_{s}"] = F.count_if(F.col(split) == s)
    out = df.groupBy(key).agg(*(a.alias(c) for c, a in aggs.items())).join(F.broadcast(strengths(df, key, values, min_trials)))  # one row
    for v in values:
        out = out.withColumn(f"{v}_rate", shrunk(F.col(f"x_{v}"), F.col("n"), F.col(f"{v}_league"), F.col(f"{v}_k")))
        for s in split_values:
            out = out.withColumn(f"{v}_rate_{s}", shrunk(F.col(f"x_{v}_{s}"), F.col(f"n_{s}"), F.col(f"{v}_rate"), F.lit(split_strength)))
    return out.select(key, "n", *(f"n_{s}" for s in split_values), *(c for v in values for c in (f"{v}_rate", *(f"{v}_rate_{s}" for s in split_values))))


#: Mean bases of a hit with too few hits to measure; share of trials against the first opponent, and rates against all others.
BASES_PER_HIT = 1.2728
PRIMARY_SHARE = 0.528
RESIDUAL_RATES = {"is_hr": 0.0571, "is_hit": 0.2279, "is_walk": 0.1267, "is_k": 0.2336}


def bases_per_hit(df: DataFrame, entity: str, bases: str, hit: str, top: str, least: int = 50, few: int = 2000, low: float = 1.0, high: float = 2.2) -> DataFrame:
    """Mean bases of hits other than the top outcome, per entity, shrunk to the league by the spread between entities.

    With fewer than `few` hits in all everyone has BASES_PER_HIT; entities with `least` hits show the spread, and fewer than 30 of them none.
    """
    hits = df.where((F.col(hit) == 1) & (F.col(top) == 0))
    own = hits.groupBy(entity).agg(F.sum(bases).alias("x"), F.count("*").alias("n"))
    league = hits.agg(F.avg(bases).alias("league"), F.var_samp(bases).alias("within"), F.count("*").alias("hits"))
    many = own.where(F.col("n") >= least).agg(F.count("*").alias("groups"), F.var_samp(F.col("x") / F.col("n")).alias("between"), F.avg(1 / F.col("n")).alias("inv"))
    spread = F.col("between") - F.col("within") * F.col("inv")
    k = F.when(F.col("groups") < 30, 189.0).when(spread > 0, F.col("within") / spread)  # null: no spread, so the league's mean
    facts = league.join(F.broadcast(many)).select("league", "hits", k.alias("k"))
    mean = F.when(F.col("k").isNull(), F.col("league")).otherwise(shrunk(F.col("x"), F.col("n"), F.col("league"), F.col("k")))
    mean = F.when(F.col("hits") < few, BASES_PER_HIT).otherwise(clip(mean, low, high))
    return own.join(F.broadcast(facts)).select(entity, "n", mean.alias("bases_per_hit"))


def residual_opponent(df: DataFrame, unit: str, side: str, opponent: str, opening: Column, first: list[str], values: list[str], least: int = 5000, low: float = 0.35, high: float = 0.75) -> DataFrame:
    """One row: the share of trials against each side's first opponent, rates against all the others, and whether both were measured.

    The first opponent is the one of the side's first trial in its opening period; trials of sides without one do not count.  With fewer than
    `least` trials that count, a share outside low..high, or no other opponent, the fixed share and rates stand instead.
    """
    primary = df.where(opening).groupBy(unit, side).agg(F.min_by(opponent, F.struct(*first)).alias("_primary")).where("_primary is not null")
    tagged = df.join(primary, [unit, side]).withColumn("_is", F.coalesce(F.col(opponent) == F.col("_primary"), F.lit(False)))
    rest = [F.avg(F.when(~F.col("_is"), F.col(v))).alias(v) for v in values]
    found = tagged.agg(F.count("*").alias("n"), F.avg(F.col("_is").cast("double")).alias("share"), *rest)
    measured = (F.col("n") >= least) & F.coalesce(F.col("share").between(low, high), F.lit(False)) & F.coalesce(*values).isNotNull()
    rates = [F.when(F.col("measured"), F.col(v)).otherwise(F.lit(RESIDUAL_RATES.get(v))).alias(f"{v}_residual") for v in values]
    return found.withColumn("measured", measured).select("n", "measured", F.when(F.col("measured"), F.col("share")).otherwise(PRIMARY_SHARE).alias("primary_share"), *rates)


def opponent_rates(rows: DataFrame, own: DataFrame, pooled: DataFrame, facts: DataFrame, opponent: str, split: str, split_values: list[str], values: list[str]) -> DataFrame:
    """`rows` with the rate that each value's opponent allows, and where it comes from: "split", "own", "pool" or "league".

    own: opponent, {v}_rate and {v}_rate_{s} for the split values; pooled: opponent and {v}_pool; facts, one row: {v}_league, primary_share and
    {v}_residual (null: the league's).  The opponent's rate by split comes first, then its own, then the pool's, each blended with the rate of the others by the
    primary share; without any of them the league's stands unblended.
    """
    have = own.withColumn("_own", F.lit(True)).join(pooled.withColumn("_pool", F.lit(True)), opponent, "full")
    j = rows.join(have, opponent, "left").join(F.broadcast(facts))  # one row
    for v in values:
        by_split = F.coalesce(*(F.when(F.col(split) == s, F.col(f"{v}_rate_{s}")) for s in split_values))
        theirs = F.when(F.col("_own"), F.coalesce(by_split, f"{v}_rate")).when(F.col("_pool"), F.col(f"{v}_pool"))
        origin = F.when(F.col("_own") & by_split.isNotNull(), "split").when(F.col("_own") & F.col(f"{v}_rate").isNotNull(), "own").when(F.col("_own").isNull() & F.col(f"{v}_pool").isNotNull(), "pool").otherwise("league")
        others = F.coalesce(f"{v}_residual", f"{v}_league")
        j = j.withColumns({f"{v}_allowed": F.coalesce(blend(theirs, others, F.col("primary_share")), f"{v}_league"), f"{v}_origin": origin})
    return j.select(*rows.columns, *(c for v in values for c in (f"{v}_allowed", f"{v}_origin")))
