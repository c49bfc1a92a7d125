"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets its j-th block (from 0) released at slot floor(j / w) with deadline
ceil((j + 1) / w).  In every slot the released block with the earliest deadline is dealt, so after t slots
each source has had less than one block more or less than t * w.

The schedule of one period repeats.  Sources that have at least LARGE slots in it are dealt there by whole quanta, a share at most half a slot of the
period away from its target.  All smaller ones, however many, share the slots of one more task: its slots take their blocks by earliest deadline,
ranked by a distributed sort with each source's exact weight, so that no block is later than its deadline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import fresh_name, staged
from .merkle import numbered

#: Slots of a period, those that a large source has at least, bytes of a block.
PERIOD, LARGE, BLOCK_BYTES = 1000, 20, 1 << 16
#: Parts that a source's running sum is split into, for each so many rows of the corpus; the fewest.
PART_ROWS, LEAST_PARTS = 100_000, 256
#: Target weights go as a source's bytes to this power, if none are given.
TEMPER = 0.5


def tempered(totals: dict[str | None, int], power: float = TEMPER) -> dict[str | None, float]:
    """Target weights from each source's bytes: a power below 1 lifts small sources."""
    raw = {s: max(b, 1) ** power for s, b in totals.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def quanta(weights: dict, period: int = PERIOD) -> dict:
    """Whole quanta of at least 1 that sum to the period, largest remainders first; raises for more weights than quanta."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} weights for {period} slots")
    total = sum(weights.values())
    exact = {s: period * w / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    late = sorted(exact, key=lambda s: (out[s] - exact[s], s is None, str(s)))
    for s in late[: max(0, period - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > period:  # those lifted to 1 take from the largest
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1.0))] -= 1
    return out


def period_schedule(spark: SparkSession, shares: list[int]) -> DataFrame:
    """slot, source (index), turn (the source's how manieth block of the period) by earliest deadline first.

    Sources of one share have the same releases and deadlines and take turns by index, so the fold over the slots
    of a period keeps the number of blocks for each distinct share only: shares that sum to the period have at most
    sqrt(2 * period) distinct values, whatever the number of sources.
    """
    period, kinds = sum(shares), sorted(set(shares))
    members: dict[int, list[int]] = {a: [] for a in kinds}
    for i, a in enumerate(shares):
        members[a].append(i)
    row = spark.createDataFrame([(kinds, [members[a] for a in kinds])], "share array<int>, members array<array<int>>")

    def next_block(t: Column, had: Column, k: Column) -> Column:
        many, a = F.size(F.get("members", k)), F.get("share", k)
        turn = F.floor(F.get(had, k) / many)
        source = F.get(F.get("members", k), (F.get(had, k) % many).cast("int"))
        block = F.struct(F.ceil((turn + 1) * period / a).alias("deadline"), source.alias("source"), k.alias("kind"))
        return F.when(F.floor(turn * period / a) <= t, block)

    def step(state: Column, t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(len(kinds) - 1)), lambda k: next_block(t, state["had"], k))
        return F.struct(state["had"].alias("had"), state["dealt"].alias("dealt"), F.array_min(F.filter(each, lambda x: x.isNotNull())).alias("next"))

    def dealt_next(state: Column, t: Column) -> Column:
        picked = step(state, t)
        return F.transform(
            F.array(picked),  # binds what is dealt, so that it is worked out once
            lambda x: F.struct(
                F.transform(x["had"], lambda c, k: F.when(k == x["next"]["kind"], c + 1).otherwise(c)).alias("had"),
                F.array_append(x["dealt"], x["next"]["source"]).alias("dealt"),
            ),
        )[0]

    start = F.struct(F.array_repeat(F.lit(0), len(kinds)).alias("had"), F.array().cast("array<int>").alias("dealt"))
    dealt = row.select(F.reduce(F.sequence(F.lit(0), F.lit(period - 1)), start, dealt_next, lambda s: s["dealt"]).alias("dealt"))
    slots = dealt.select(F.posexplode("dealt").alias("slot", "source_index"))
    turn = F.row_number().over(W.Window.partitionBy("source_index").orderBy("slot")) - 1
    return slots.withColumn("turn", turn)


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, period: int = PERIOD,
) -> DataFrame:
    """id, source, size, key, block (of its source), slot, for every row of `docs`.

    Rows of a source follow in hash order and fill its blocks by bytes (UTF-8 plus 1); a row belongs to the
    block where it begins.  Sorting by slot, then key, gives the mixture; no row is dropped or repeated, so
    once a source has run out the others go on in their slots.  `weights` must cover every source (default:
    each source by its bytes to the power TEMPER).  A null source is a source of its own; null texts have size 1; null ids and rows that
    repeat are scheduled like any other; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    sized = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.xxhash64(F.lit("mix"), F.col(id_col), text).alias("key"),
        ),
        "mix-sizes",
    )
    totals = staged(sized.groupBy("source").agg(F.sum("size").alias("b"), F.count("*").alias("n")), "mix-sources")
    rows = totals.agg(F.sum("n")).first()[0]
    if not rows:
        return sized.select("*", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"))
    if weights is None:
        weighed = totals.withColumn("w", F.pow(F.greatest("b", F.lit(1)).cast("double"), F.lit(TEMPER)))
    else:
        kind = sized.schema["source"].dataType.simpleString()
        told = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], f"t_source {kind}, w double")
        weighed = totals.join(told, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
        missing = [r["source"] for r in weighed.where("w is null or not w > 0").limit(10).collect()]
        if missing:
            raise ValueError(f"no weight for {missing}")
    weighed = staged(weighed, "mix-weights")
    total = weighed.agg(F.sum("w")).first()[0]
    large = {r["source"]: r["w"] / total for r in weighed.where(F.col("w") >= total * LARGE / period).collect()}  # period / LARGE rows at most
    names = sorted(large, key=lambda s: (s is None, str(s)))
    small = weighed.join(_sources(spark, names, sized, "l_source"), F.col("source").eqNullSafe(F.col("l_source")), "left_anti")
    rest = small.agg(F.sum("w")).first()[0]
    shares = quanta({k: large[s] for k, s in enumerate(names)} | ({len(names): rest / total} if rest else {}), period)
    shares = [shares[k] for k in range(len(shares))]
    parts = max(LEAST_PARTS, -(-rows // PART_ROWS))

    # hash order in two levels, so that a source with a third of all rows is summed in many tasks
    part = F.floor((F.shiftright("key", 33) + (1 << 30)) * parts / (1 << 31)).cast("int")
    parted = sized.withColumn("part", part)
    inside = W.Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    before = W.Window.partitionBy("source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = parted.groupBy("source", "part").agg(F.sum("size").alias("b")).withColumn("start", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")
    run = parted.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    offsets = offsets.withColumnsRenamed({"source": "o_source", "part": "o_part"})
    placed = run.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("part") == F.col("o_part")))
    blocks = placed.select("id", "source", "size", "key", F.floor((F.col("at") + F.col("start")) / block_bytes).cast("long").alias("block"))
    if rest:
        blocks = staged(blocks, "mix-blocks")
    # a row for each slot of the period, and one for each large source
    dealt = staged(period_schedule(spark, shares), "period")
    counted = _sources(spark, names, sized, "n_source").withColumn("n_share", F.get(F.array(*map(F.lit, shares)), F.col("source_index")))
    own = dealt.select(F.col("source_index").alias("p_index"), "turn", F.col("slot").alias("p_slot"))
    turned = blocks.join(F.broadcast(counted), F.col("source").eqNullSafe(F.col("n_source"))).withColumn("b_turn", (F.col("block") % F.col("n_share")).cast("int"))
    slotted = turned.join(F.broadcast(own), (F.col("source_index") == F.col("p_index")) & (F.col("b_turn") == F.col("turn")))
    slot = F.floor(F.col("block") / F.col("n_share")) * period + F.col("p_slot")
    out = slotted.select("id", "source", "size", "key", "block", slot.cast("long").alias("slot"))
    if not rest:
        return out
    places = dealt.where(F.col("source_index") == len(names)).select("turn", F.col("slot").alias("p_slot"))
    ranked = _by_deadline(small, rest, block_bytes).withColumn("turn", (F.col("pos") % shares[-1]).cast("int"))
    slots = ranked.join(F.broadcast(places), "turn").select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), (F.floor(F.col("pos") / shares[-1]) * period + F.col("p_slot")).cast("long").alias("slot"))
    few = blocks.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    return out.unionByName(few.select("id", "source", "size", "key", "block", "slot"))


def _sources(spark: SparkSession, names: list, like: DataFrame, name: str) -> DataFrame:
    """(source_index, `name`) of the large sources."""
    return spark.createDataFrame(list(enumerate(names)), f"source_index int, {name} {like.schema['source'].dataType.simpleString()}")


def _by_deadline(small: DataFrame, rest: float, block_bytes: int) -> DataFrame:
    """(source, block, pos): all blocks of the small sources, numbered by deadline (ties by source).

    A range sort gives the numbers, so no task holds them all.
    """
    last = F.floor((F.col("b") - 1) / block_bytes).cast("long")
    blocks = small.select("source", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), (F.col("w") / rest).alias("v"))
    keyed = blocks.select("source", "block", F.ceil((F.col("block") + 1) / F.col("v")).alias("deadline"), F.lit("").alias("tree"))
    return numbered(keyed, "tree", ["deadline", "source", "block"]).select("source", "block", "pos")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None) -> DataFrame:
    """All rows of `docs`, columns kept, sorted in mixture order: written out, the files follow the schedule.

    Ids should be unique; of a repeated id every row takes the id's first slot, and rows with a null id come last.  Texts are
    shuffled to their slots and into the order, and not written between: the sort's sample of its keys reads the first shuffle once more.
    """
    slots = schedule(docs, id_col, text_col, source_col, weights)
    own = fresh_name(docs, "mix")
    first = slots.where("id is not null").groupBy(F.col("id").alias(id_col)).agg(F.min(F.struct("slot", "key")).alias(own))
    placed = docs.join(staged(first, "mix-slots"), id_col, "left")
    return placed.orderBy(F.col(own).asc_nulls_last(), id_col).select(docs.columns)
