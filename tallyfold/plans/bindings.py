"""The given tables bound to the neutral schema: trials, raw events, units and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: lineitem repeats (l_orderkey, l_linenumber), so the order of trials ends in every remaining column.
ORDER = ["day", "unit", "seq", "opponent", "part", "quantity", "price", "discount", "tax", "returnflag", "linestatus", "shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trial: lineitem joined to its order, with outcome flags."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    t = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("entity"), F.col("l_suppkey").alias("opponent"), F.col("l_orderkey").alias("unit"), "day", F.col("l_linenumber").alias("seq"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") + 0.0).alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("l_shipdate").alias("shipdate"),
    )
    hit = F.col("quantity") > 30 + 2 * (F.col("entity") % 7)
    top = hit & (F.col("quantity") > 44 + F.col("entity") % 5)
    flag = lambda c: c.cast("int")
    t = t.withColumns({
        "is_hit": flag(hit), "is_hr": flag(top),
        "is_walk": flag(~hit & (F.col("returnflag") == "A") & (F.col("linestatus") == "F")), "is_k": flag(~hit & (F.col("returnflag") == "N")),
        "total_bases": F.when(top, 4).when(hit, 1 + flag(F.col("part") % 3 == 0)).otherwise(0),
        "rbi": F.when(top, 1 + F.col("seq") % 4).when(hit, F.col("seq") % 2).otherwise(0),
        "stand": F.when(F.col("entity") % 2 == 0, "L").otherwise("R"), "hand": F.when(F.col("opponent") % 3 == 0, "L").otherwise("R"),
        "side": (F.col("entity") % 2).cast("int"),
    })
    return t.withColumns({
        "reached": flag((F.col("is_hit") == 1) | (F.col("is_walk") == 1)), "reached_nonhr": flag(((F.col("is_hit") == 1) | (F.col("is_walk") == 1)) & (F.col("is_hr") == 0)),
        "certain": F.col("is_hit") + F.col("rbi") + F.col("is_hr"), "platoon_edge": flag(F.col("stand") != F.col("hand")),
    })


#: The same rows in SQL, as a common table expression named t.
TRIALS = """t0 AS (
  SELECT o_custkey AS entity, l_suppkey AS opponent, l_orderkey AS unit, CAST(o_orderdate AS DATE) AS day, l_linenumber AS seq,
    l_partkey AS part, l_quantity AS quantity, l_extendedprice AS price, l_discount + 0.0 AS discount, l_tax AS tax,
    l_returnflag AS returnflag, l_linestatus AS linestatus, l_shipdate AS shipdate,
    l_quantity > 30 + 2 * (o_custkey % 7) AS hit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t1 AS (SELECT *, hit AND quantity > 44 + entity % 5 AS top FROM t0),
t2 AS (
  SELECT *, CAST(hit AS INT) AS is_hit, CAST(top AS INT) AS is_hr,
    CAST(NOT hit AND returnflag = 'A' AND linestatus = 'F' AS INT) AS is_walk, CAST(NOT hit AND returnflag = 'N' AS INT) AS is_k,
    CASE WHEN top THEN 4 WHEN hit THEN 1 + CAST(part % 3 = 0 AS INT) ELSE 0 END AS total_bases,
    CASE WHEN top THEN 1 + seq % 4 WHEN hit THEN seq % 2 ELSE 0 END AS rbi,
    CASE WHEN entity % 2 = 0 THEN 'L' ELSE 'R' END AS stand, CASE WHEN opponent % 3 = 0 THEN 'L' ELSE 'R' END AS hand, CAST(entity % 2 AS INT) AS side
  FROM t1),
t AS (
  SELECT *, CAST(is_hit = 1 OR is_walk = 1 AS INT) AS reached, CAST((is_hit = 1 OR is_walk = 1) AND is_hr = 0 AS INT) AS reached_nonhr,
    is_hit + rbi + is_hr AS certain, CAST(stand <> hand AS INT) AS platoon_edge
  FROM t2)"""

ORDER_SQL = ", ".join(ORDER)

FLAGS = ["is_hr", "is_hit", "is_walk", "is_k", "rbi", "total_bases", "reached", "reached_nonhr", "certain"]


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an entity in a unit."""
    t = trials(spark, sf_dir)
    return t.groupBy("entity", "unit", "day").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in FLAGS))


UNITS = TRIALS + ",\nu AS (SELECT entity, unit, day, count(*) AS n, " + ", ".join(f"sum({c}) AS {c}" for c in FLAGS) + " FROM t GROUP BY entity, unit, day)"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their day; one user's day is a unit."""
    return table(spark, sf_dir, "events").withColumns({"day": F.col("ts").cast("date"), "k": F.get_json_object("props", "$.k").try_cast("int")})


EVENTS = "e AS (SELECT *, CAST(ts AS DATE) AS day, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular slots 1..9: the entities, by key, that have an order on a day, in lineups of nine; metric is a made-up stable one of the entity."""
    from pyspark.sql.window import Window

    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("entity")).distinct()
    at = F.row_number().over(Window.partitionBy("day").orderBy("entity")) - 1
    numbered = days.withColumns({"lineup": F.floor(at / 9).cast("int"), "slot": (at % 9 + 1).cast("int")})
    return numbered.withColumns({"team": (F.col("entity") % 2).cast("int"), "metric": (F.col("entity") % 11) / 20.0})


SLOTS = """s AS (
  SELECT day, entity, CAST(k // 9 AS INT) AS lineup, CAST(k % 9 + 1 AS INT) AS slot, CAST(entity % 2 AS INT) AS team, (entity % 11) / 20.0 AS metric FROM (
    SELECT day, entity, row_number() OVER (PARTITION BY day ORDER BY entity) - 1 AS k
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_custkey AS entity FROM orders)))"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, negative zero made plain, for comparison with another engine."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c, kind in df.dtypes if kind == "double"})
