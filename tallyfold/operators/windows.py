"""Leak-free windows: every value looks at strictly earlier rows of its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.shared import staged


def prior(keys: list[str], order: list[str], rows: int | None = None) -> WindowSpec:
    """The last `rows` rows before the current one (None: all of them)."""
    start = Window.unboundedPreceding if rows is None else -rows
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(start, -1)


def guarded(value: Column, agg, window: WindowSpec, least: int) -> Column:
    """agg(value) over the window once it holds `least` values, else null."""
    return F.when(F.count(value).over(window) >= least, agg(value).over(window))


def rolling_means(df: DataFrame, keys: list[str], order: list[str], values: list[str], sizes=(10, 20), least=3, career_least=5) -> DataFrame:
    """`v_avg_n` over the last n rows and `v_career` over all earlier ones."""
    out = {}
    for v in values:
        for n in sizes:
            out[f"{v}_avg_{n}"] = guarded(F.col(v), F.avg, prior(keys, order, n), least)
        out[f"{v}_career"] = guarded(F.col(v), F.avg, prior(keys, order), career_least)
    return df.withColumns(out)


def rolling_ratio(df: DataFrame, keys: list[str], order: list[str], name: str, top: str, bottom: str, sizes=(10, 20, 40), least=3) -> DataFrame:
    """`name_n`: sum of `top` over sum of `bottom` in the last n rows; null over nothing or zero."""
    out = {}
    for n in sizes:
        w = prior(keys, order, n)
        out[f"{name}_{n}"] = F.try_divide(guarded(F.col(top), F.sum, w, least), F.nullif(guarded(F.col(bottom), F.sum, w, least), F.lit(0)))
    return df.withColumns(out)


def rolling_max(df: DataFrame, keys: list[str], order: list[str], name: str, value: str, size: int, least=3) -> DataFrame:
    return df.withColumn(name, guarded(F.col(value), F.max, prior(keys, order, size), least))


def shrunk(x: Column, n: Column, mean: Column, strength: Column) -> Column:
    """(x + k * mean) / (n + k)."""
    return (x + strength * mean) / (n + strength)


def split_edge(df: DataFrame, entity: str, split: str, value: str, order: list[str], strength: float = 30.0) -> DataFrame:
    """edge: how the entity's earlier rows under the same `split` value, shrunk to its own mean, differ from that mean; edge_n rows back it."""
    own, same = prior([entity], order), prior([entity, split], order)
    base = F.avg(value).over(own)
    n = F.count(value).over(same)
    inside = F.coalesce(F.sum(value).over(same), F.lit(0))
    return df.withColumns({"edge": F.coalesce(shrunk(inside, n, base, F.lit(strength)) - base, F.lit(0.0)), "edge_n": n})


def last_rows_before(df: DataFrame, keys: list[str], peers: list[str], order: list[str], value: str, rows: int, least: int, name: str) -> DataFrame:
    """`name`: the mean of the last `rows` rows of the key that stand before the first of the row's peers; null below `least` of them.

    Rows of one `peers` value (of a key) see the same frame and not each other.  The sum over a frame that ends at the first peer is that row's own, so
    every other peer takes it from there: running sums once, no frame for each row.
    """
    w = Window.partitionBy(*keys).orderBy(*peers, *order)
    frame = w.rowsBetween(-rows, -1)
    own = F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))
    at = df.withColumns({"_own": own, "_at": F.row_number().over(w)})
    first = Window.partitionBy(*keys, *peers).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn(name, F.first("_own").over(first)).drop("_own", "_at")


def split_edges(df: DataFrame, entity: str, value: str, order: list[str], splits: dict[str, str], listed: dict[str, list] | None = None, strength: float = 30.0) -> DataFrame:
    """`split_edge` for several columns, {name: column}: `name`_edge and `name`_edge_n; 0 where the entity has no earlier row.

    One exchange by entity serves them all.  A column whose few values are `listed` needs no sort of its own: its values' running sums stand side
    by side in the entity's one window; a value that is not listed raises.  Other columns are sorted within the entity's partition.
    """
    own, listed = prior([entity], order), listed or {}
    sums = {"_base": F.avg(value).over(own)}
    for name, col in splits.items():
        for k, v in enumerate(listed.get(col, ())):
            mine = F.when(F.col(col).eqNullSafe(F.lit(v)), F.col(value))
            sums |= {f"_{name}_x{k}": F.sum(mine).over(own), f"_{name}_n{k}": F.count(mine).over(own)}
    for name, col in splits.items():
        if col not in listed:
            same = prior([entity, col], order)
            sums |= {f"_{name}_x": F.sum(value).over(same), f"_{name}_n": F.count(value).over(same)}
    out, edges = df.withColumns(sums), {}
    for name, col in splits.items():
        x, n = F.col(f"_{name}_x") if col not in listed else None, F.col(f"_{name}_n") if col not in listed else None
        if col in listed:
            x = n = F.raise_error(F.concat(F.lit(f"{col} is not listed: "), F.col(col).cast("string")))
            for k, v in enumerate(listed[col]):
                is_v = F.col(col).eqNullSafe(F.lit(v))
                x, n = F.when(is_v, F.col(f"_{name}_x{k}")).otherwise(x.cast("double")), F.when(is_v, F.col(f"_{name}_n{k}")).otherwise(n.cast("long"))
        edge = shrunk(F.coalesce(x.cast("double"), F.lit(0.0)), n, F.col("_base"), F.lit(strength)) - F.col("_base")
        edges |= {f"{name}_edge": F.coalesce(edge, F.lit(0.0)), f"{name}_edge_n": n}
    return out.withColumns(edges).drop(*sums)


def context_features(
    frame: DataFrame, meta: DataFrame, entity: str, unit: str, day: str, value: str, order: list[str], first: list[str], nights: list[str], strength: float = 30.0, coldest: float = 32.0
) -> DataFrame:
    """A frame of (entity, unit) rows with stand, is_home, weekday and day_night, four split edges of `value`, temperature and wind.

    `meta` (entity, unit, stand, home, and the columns of `first`) has a row for each trial: a unit's first one says where the entity stood.
    Optional columns of the frame: venue, day_night (of `nights`, else "unknown"), temp, wind_out, wind_side.  A missing venue is a place of its own.  Temperatures of `coldest`
    or below are no readings; missing ones get the median; missing winds are 0, and wind to the side is signed by the stand.
    """
    has = lambda c, kind: F.col(c).try_cast(kind) if c in frame.columns else F.lit(None).cast(kind)
    where = meta.groupBy(entity, unit).agg(F.min_by(F.struct("stand", "home"), F.struct(*first)).alias("_m"))
    j = frame.join(where, [entity, unit], "left").withColumns({
        "stand": F.coalesce("_m.stand", F.lit("R")), "is_home": F.coalesce("_m.home", F.lit(0)).cast("int"), "_venue": F.coalesce(has("venue", "string"), F.lit("-1")),
        "weekday": F.weekday(day), "day_night": F.coalesce(has("day_night", "string"), F.lit("unknown")), "_temp": F.when(has("temp", "double") > coldest, has("temp", "double")),
        "wind_out": F.coalesce(has("wind_out", "double"), F.lit(0.0)), "_side": F.coalesce(has("wind_side", "double"), F.lit(0.0)),
    })
    edges = split_edges(
        j.drop("_m"), entity, value, order, {"venue": "_venue", "weekday": "weekday", "home": "is_home", "daynight": "day_night"},
        {"weekday": list(range(7)), "is_home": [0, 1], "day_night": [*nights, "unknown"]}, strength,
    )
    middle = exact_percentiles(frame.select(F.when(has("temp", "double") > coldest, has("temp", "double")).alias("_t")), "_t", [0.5], "_c").select(F.get("_c", 0).alias("_middle"))
    out = edges.join(F.broadcast(middle))  # one row
    return out.withColumns({"temp": F.coalesce("_temp", "_middle"), "wind_pull": F.col("_side") * F.when(F.col("stand") == "L", -1.0).otherwise(1.0)}).drop("_venue", "_temp", "_side", "_middle")


def fatigue(df: DataFrame, entity: str, day: str, order: list[str], days: int = 7) -> DataFrame:
    """rest_days since the previous row, and recent: earlier rows of the last `days` days, rows of the same day in order."""
    by_order = Window.partitionBy(entity).orderBy(day, *order)
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    frame = Window.partitionBy(entity).orderBy("_day").rangeBetween(-(days - 1), 0)
    same_day = Window.partitionBy(entity, day)
    later = F.count("*").over(same_day) - F.row_number().over(same_day.orderBy(*order)) + 1
    out = df.withColumn("_day", number).withColumns({
        "rest_days": F.datediff(F.col(day), F.lag(day).over(by_order)),
        "recent": F.count("*").over(frame) - later,
    })
    return out.drop("_day")


def forward_max(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 3) -> DataFrame:
    """label: the largest value of the next rows; rows without a next one are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, rows)
    return df.withColumn("label", F.max(value).over(w)).where("label is not null")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one map-side combined aggregate, no sort of the groups."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return top.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def quantile_tiers(df: DataFrame, value: str, tie: str, tiers: int, name: str = "tier") -> DataFrame:
    """Tiers 1..n of near-equal size: a row's tier counts the quantile edges of the distinct ranks below its own.

    Ranks come from a two-level count over ranges of the value, so no task sorts the whole table.
    """
    ranked = global_rank(df, [value, tie], "_rank")
    n = df.select(F.count("*").alias("_n"))
    out = ranked.join(F.broadcast(n))
    edges = [1 + (F.col("_n") - 1) * k / F.lit(float(tiers)) for k in range(1, tiers)]
    tier = sum(((F.col("_rank") > e).cast("int") for e in edges), F.lit(1))
    return out.withColumn(name, tier).drop("_rank", "_n")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 in the order of the columns.

    Rows are dealt into ranges of the whole order, as many as the session has shuffle partitions, and written once, so that
    both the counts of the ranges and the numbers inside see the same ones; a value that many rows share is cut by the
    columns after it.
    """
    dealt = staged(df.repartitionByRange(*(F.col(c) for c in order)).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def exact_percentiles(df: DataFrame, value: str, shares: list[float], name: str = "cuts") -> DataFrame:
    """One row: the interpolated percentiles of a column's values, from ranks, so that no task holds all values."""
    values = df.select(F.col(value).cast("double").alias("_v")).where("_v is not null")
    ranked = global_rank(values, ["_v"], "_rank")
    n = values.agg(F.count("*").alias("_n"))
    wanted = n.select(F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("_k", "_s"), "_n").withColumn("_at", F.col("_s") * (F.col("_n") - 1))
    near = wanted.select("_k", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_i"))
    found = ranked.join(F.broadcast(near), F.col("_rank") == F.col("_i") + 1)  # two rows for each share
    part = 1 - F.abs(F.col("_at") - F.col("_i"))
    each = found.groupBy("_k").agg(F.sum(F.when(part == 0, 0.0).otherwise(part * F.col("_v"))).alias("_p"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_p"))), lambda x: x["_p"]).alias(name))
