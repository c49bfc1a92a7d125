"""Joins: neighbours on a circle, precedence chains, keyed upserts, committed rows, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import exact_percentiles, global_rank, numbered


def guarded_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """A left join that renames every other column of `right`, and raises if a renamed one is taken."""
    renamed = right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c not in keys})
    taken = set(left.columns) & set(renamed.columns) - set(keys)
    if taken:
        raise ValueError(f"both sides have {sorted(taken)}")
    return left.join(renamed, keys, "left")


def circular_neighbours(df: DataFrame, unit: list[str], slot: str, metric: str, default: Column, ahead: bool, reach: int = 3, size: int = 9, name: str = "neighbours") -> DataFrame:
    """The mean metric of the next (or previous) slots of a unit's circle; an empty slot counts as the default, and so does a row without a slot."""
    k = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    shifted = (F.col("_slot") - F.col("_k") - 1 + size) if ahead else (F.col("_slot") + F.col("_k") - 1)
    rows = df.select(*unit, F.col(slot).alias("_slot")).where(F.col(slot).isNotNull()).distinct().withColumn("_k", k).withColumn("_at", F.pmod(shifted, F.lit(size)) + 1)
    there = df.where(F.col(slot).isNotNull()).groupBy(*unit, F.col(slot).alias("_at")).agg(F.max(metric).alias("_m"))
    means = rows.join(there, [*unit, "_at"], "left").groupBy(*unit, "_slot").agg(F.avg(F.coalesce("_m", default)).alias(name))
    return df.withColumn("_slot", F.col(slot)).join(means, [*unit, "_slot"], "left").withColumn(name, F.coalesce(name, default)).drop("_slot")


def upsert(have: DataFrame, fresh: DataFrame, keys: list[str], wanted: DataFrame | None = None, sentinel: Column | None = None) -> DataFrame:
    """Rows of both by key, fresh ones last and winning; then only wanted keys, and without sentinel rows."""
    both = have.withColumn("_load", F.lit(0)).unionByName(fresh.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_load")]
    top = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_load").alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
    if wanted is not None:
        top = top.join(wanted, wanted.columns, "left_semi")
    return top if sentinel is None else top.where(~sentinel)


def refetched(store: DataFrame, fetched: DataFrame, wanted: DataFrame, unit: str) -> DataFrame:
    """The store after the `wanted` units were fetched anew: their stored rows go, even where the fetch brought none, and only what was fetched for them comes in."""
    again = wanted.select(unit).distinct()
    return store.join(again, unit, "left_anti").unionByName(fetched.select(*store.columns).join(again, unit, "left_semi"))


def actuals(totals: DataFrame, store: DataFrame, fetched: DataFrame, keys: list[str], unit: str) -> tuple[DataFrame, DataFrame]:
    """(`totals` with the official line of every row, the store after it): lines of the units in `totals` are fetched anew, so that none that was stored while a unit was under way is graded.

    Rows without an official line keep null in its columns and stay, so that they can be counted.
    """
    after = refetched(store, fetched, totals, unit)
    return totals.join(after, keys, "left"), after


def with_prior_season(rows: DataFrame, meta: DataFrame, season_table: DataFrame, unit: str, day: str, opponent: str, season: str, factor: Column, needed: list[str]) -> DataFrame:
    """`rows` with their unit's `meta` (opponent and venue), the column venue_factor, and the opponent's row of the season before the row's own, which holds nothing that came later.

    Only rows with all `needed` columns stay.  season_table has a row for each opponent and season at most.
    """
    seen = rows.join(meta, unit, "left").withColumns({"venue_factor": factor, "_before": F.year(day) - 1})
    return seen.join(season_table.withColumnRenamed(season, "_before"), [opponent, "_before"], "left").drop("_before").dropna(subset=[*needed, "venue_factor"])


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(have, keys, "left_anti")


def keep_committed(old: DataFrame, fresh: DataFrame, unit: str, start: str, now: Column) -> DataFrame:
    """Rows of units that have started stay as they were; all others come from the fresh run."""
    started = old.where(F.col(start) <= now)
    return started.unionByName(fresh.join(started.select(unit).distinct(), unit, "left_anti"), allowMissingColumns=True)


def top_up(have: DataFrame, new: DataFrame, entity: str, day: str, keys: list[str], overlap: int = 1) -> DataFrame:
    """New rows from each entity's newest day on, `overlap` days earlier included, laid over the old ones."""
    mark = have.groupBy(entity).agg(F.date_sub(F.max(day), overlap).alias("_mark"))
    fresh = new.join(mark, entity, "left").where(F.col("_mark").isNull() | (F.col(day) >= F.col("_mark"))).drop("_mark")
    return upsert(have, fresh, keys)


def complete_units(lines: DataFrame, unit: list[str], amount: str, least: float) -> DataFrame:
    """Adds `complete`: whether the unit's amounts reach what a finished unit has."""
    return lines.withColumn("complete", F.sum(amount).over(Window.partitionBy(*unit)) >= least)


def stale(wanted: DataFrame, log: DataFrame, key: str, checked: str, as_of: Column, most_days: int) -> DataFrame:
    """Wanted keys that were never checked or too long ago."""
    return wanted.join(log, key, "left").where(F.col(checked).isNull() | (F.datediff(as_of, F.col(checked)) > most_days)).select(wanted.columns)


def candidates(sides: DataFrame, projected: DataFrame, roster: DataFrame, team: str, posted: str, entity: str, slot: str, name: str, most: int = 9) -> DataFrame:
    """Each side's expected entities with slot, status and name; `sides` keeps its other columns.

    The first `most` of the posted list are "confirmed" and its positions are the slots; without one the projected order of the team counts ("projected"),
    else the first `most` of its roster by id, without slots ("unknown").  Entities that the roster does not name are named by their id; a side with none of the
    three gives no row.  No list is longer than `most`.
    """
    entry = lambda at, who, status: F.struct(F.expr(at).cast("int").alias(slot), F.expr(who).alias(entity), F.lit(status).alias("status"))
    ordered = projected.groupBy(team).agg(F.slice(F.array_sort(F.collect_list(entry(slot, entity, "projected"))), 1, most).alias("_projected"))
    first = numbered(roster.select(team, entity), [team], [entity], "_at").where(F.col("_at") <= most)
    listed = first.groupBy(team).agg(F.array_sort(F.collect_list(entry("null", entity, "unknown"))).alias("_listed"))
    confirmed = F.when(F.size(posted) > 0, F.transform(F.slice(posted, 1, most), lambda x, i: F.struct((i + 1).cast("int").alias(slot), x.alias(entity), F.lit("confirmed").alias("status"))))
    lists = sides.join(ordered, team, "left").join(listed, team, "left").withColumn("_e", F.explode(F.coalesce(confirmed, "_projected", "_listed")))
    rows = lists.select(*(c for c in sides.columns if c != posted), "_e.*")
    names = roster.select(team, entity, name).dropDuplicates([team, entity])
    return rows.join(names, [team, entity], "left").withColumn(name, F.coalesce(name, F.col(entity).cast("string")))


def hashed_sample(df: DataFrame, stratum: str, key: str, each: int, seed: int) -> DataFrame:
    """`each` rows of every stratum, drawn by a hash of key and seed: the same on any partitioning."""
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return numbered(df.withColumn("_h", order), [stratum], ["_h", key], "_n").where(F.col("_n") <= each).drop("_h", "_n")


def time_split(df: DataFrame, order: list[str], shares: list[float], name: str = "part") -> DataFrame:
    """Parts 0, 1, ... by row fractions of the order, the first column of which is a number or date."""
    number = F.datediff(F.col(order[0]), F.lit("1970-01-01")) if dict(df.dtypes)[order[0]] in ("date", "timestamp") else F.col(order[0])
    ranked = global_rank(df.withColumn("_t", number), ["_t", *order], "_rank")
    total = df.select(F.count("*").alias("_n"))
    cuts, at = [], 0.0
    for s in shares:
        at += s
        cuts.append(F.floor(F.col("_n") * F.lit(round(at, 9))))
    part = sum(((F.col("_rank") > c).cast("int") for c in cuts), F.lit(0))
    return ranked.join(F.broadcast(total)).withColumn(name, part).drop("_rank", "_n", "_t")


def quantile_split(df: DataFrame, day: str, share: float, name: str = "test") -> DataFrame:
    """Whether the day lies beyond the quantile of all rows' days."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    cut = exact_percentiles(df.select(number.alias("_number")), "_number", [share], "_c").select(F.get("_c", 0).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn(name, (number > F.col("_cut")).cast("int")).drop("_cut")
