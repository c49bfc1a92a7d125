"""The chance that a runner scores: league, slot, neighbours and own factor, fitted once, stored, and applied to other rows."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rates

#: The league's chance, slot factors where a slot has too little behind it, the slope of the on-base rate
#: behind, the strength of an entity's factor without enough entities, and the bounds of factor and chance.
LEAGUE, LEAGUE_OBP, SLOPE, FEW = 0.3084, 0.32, 0.367, 260.0
SLOT_FACTORS = {1: 1.161, 2: 1.058, 3: 0.947, 4: 0.914, 5: 0.934, 6: 0.929, 7: 0.940, 8: 1.016, 9: 1.085}
FACTOR, CHANCE = (0.7, 1.35), (0.1, 0.6)
#: Rows and times on base below which the league and a slot have no figures of their own.
LEAST_ROWS, LEAST_ON_BASE = 2000, 500


def slot_fallback(slot: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SLOT_FACTORS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, slot.cast("int")), F.lit(1.0))


def _within(value: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(value, F.lit(bounds[0])), F.lit(bounds[1]))


@dataclasses.dataclass(frozen=True)
class ScoreTables:
    """league: one row (q, strength, n; q null: too few rows); slots: slot, factor, obp_behind; entities: entity, factor."""

    league: DataFrame
    slots: DataFrame
    entities: DataFrame

    def save(self, path: str) -> ScoreTables:
        """Write the three tables; returns them as read back."""
        for name in ("league", "slots", "entities"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return ScoreTables.load(self.league.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoreTables:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("league", "slots", "entities")))


def fit_scores(rows: DataFrame, entity: str, slot: str, runs: str, top: str, on_base: str, behind: str | None = None, least_entities: int = 50, least_trials: int = 100) -> ScoreTables:
    """Factor tables from one row for each entity and unit: runs and top outcomes, times on base without top outcomes, the slot, and the mean
    on-base rate of those behind (`behind`).

    Rows with a slot of 1..9 and known runs count, those without a time on base too.  Below LEAST_ROWS of them nothing is fitted: the league's
    chance is null, and the other tables are empty.  A slot with fewer than LEAST_ON_BASE times on base takes its fixed factor.  An entity is held against
    what its slots let expect, shrunk towards 1 with the strength that the spread between entities shows (none: everyone 1).
    """
    used = rows.where(F.col(slot).between(1, 9)).dropna(subset=[runs, top]).select(
        F.col(entity).alias("entity"), F.col(slot).cast("int").alias("slot"), F.greatest(F.col(runs) - F.col(top), F.lit(0)).alias("extra"),
        F.coalesce(on_base, F.lit(0)).alias("tob"), (F.col(behind) if behind else F.lit(None)).cast("double").alias("behind"),
    )
    enough = (F.count("*") >= LEAST_ROWS) & (F.sum("tob") > 0)
    league = used.agg(F.count("*").alias("n"), F.when(enough, F.sum("extra") / F.sum("tob")).alias("q"))
    q = league.select("q").where("q is not null")
    by_slot = used.groupBy("slot").agg(F.sum("extra").alias("e"), F.sum("tob").alias("t"), F.avg("behind").alias("obp_behind")).join(F.broadcast(q))  # one row, or none
    slots = by_slot.select("slot", F.when(F.col("t") >= LEAST_ON_BASE, F.col("e") / F.col("t") / F.col("q")).otherwise(slot_fallback(F.col("slot"))).alias("factor"), "obp_behind")
    placed = used.join(F.broadcast(slots.select("slot", "factor")), "slot").join(F.broadcast(q))  # nine rows and one
    own = placed.groupBy("entity").agg(F.sum("extra").alias("actual"), F.sum(F.col("tob") * F.col("factor") * F.col("q")).alias("expected"), F.sum("tob").alias("tob"), F.first("q").alias("q"))
    strength = rates.ratio_strength(own, "actual", "expected", "tob", least=least_trials, groups=least_entities, few=FEW)
    k = F.col("strength") * F.col("q")
    factor = F.when(F.col("strength").isNull(), 1.0).otherwise((F.col("actual") + k) / (F.col("expected") + k))
    entities = own.join(F.broadcast(strength)).select("entity", _within(factor, FACTOR).alias("factor"))
    return ScoreTables(league.join(F.broadcast(strength)).select("q", "strength", "n"), slots, entities)


def score_chance(rows: DataFrame, tables: ScoreTables, entity: str, slot: str, behind: str | None = None, name: str = "share", league_obp: float = LEAGUE_OBP) -> DataFrame:
    """`rows` with the chance to score once on base; each term that is missing falls back alone.

    No league chance: the fixed one; an unknown slot: factor 1 (the fixed table where nothing was fitted); no rate behind or no usual one: no deviation;
    an unknown entity: factor 1.
    """
    league = tables.league.select(F.col("q").alias("_q"))
    slots = tables.slots.select(F.col("slot").alias("_slot"), F.col("factor").alias("_slot_factor"), F.col("obp_behind").alias("_usual"))
    own = tables.entities.select(F.col("entity").alias("_entity"), F.col("factor").alias("_own"))
    j = rows.join(F.broadcast(league)).join(F.broadcast(slots), F.col(slot) == F.col("_slot"), "left").join(own, F.col(entity) == F.col("_entity"), "left")
    q = F.coalesce("_q", F.lit(LEAGUE))
    slot_factor = F.coalesce("_slot_factor", F.when(F.col("_q").isNull(), slot_fallback(F.col(slot))).otherwise(1.0))
    usual = F.coalesce("_usual", F.lit(league_obp))
    away = (F.coalesce(F.col(behind).cast("double"), usual) - usual) if behind else F.lit(0.0)
    away = F.when(F.col("_q").isNull(), 0.0).otherwise(away)
    chance = q * slot_factor * (1 + SLOPE * away / F.greatest(q, F.lit(1e-6))) * F.coalesce("_own", F.lit(1.0))
    return j.withColumn(name, _within(chance, CHANCE)).drop("_q", "_slot", "_slot_factor", "_usual", "_entity", "_own")


def runs_per_trial(top: Column, reach: Column, share: Column) -> Column:
    """The top outcome scores for certain, every other time on base with the chance `share`."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clip(top) + clip(clip(reach) - clip(top)) * share
