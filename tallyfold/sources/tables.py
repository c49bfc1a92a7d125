"""Stored tables: tolerant scans, entity pools, and sinks that replace one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import top_up, upsert
from .shared import new_path, staged


def with_default_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Optional columns that the table lacks get a default; present ones stay."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"the table lacks {lacking}")
    return df


def entity_range(df: DataFrame, entity: str, ids: list, day: str, first: str, last: str) -> DataFrame:
    """Rows of some entities between two days, pushed down to the scan; raises if there are none."""
    rows = df.where(F.col(entity).isin(ids) & F.col(day).between(F.lit(first), F.lit(last)))
    if rows.isEmpty():
        raise ValueError(f"no rows for {ids} between {first} and {last}")
    return rows


def of_pool(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Rows of the pool's members, in one scan."""
    return df.join(pool.select(key).distinct(), key, "left_semi")


def replace_dates(df: DataFrame, path: str, day: str) -> None:
    """Write by day; days that `df` holds replace what was stored for them, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def load_day(spark: SparkSession, path: str, day: str, value: str, needed: list[str]) -> DataFrame:
    rows = require_columns(spark.read.parquet(path), needed).where(F.col(day) == value)
    if rows.isEmpty():
        raise ValueError(f"nothing stored for {value}")
    return rows


def read_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored table, or a new one from `build`, stored first."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def round_trip_csv(df: DataFrame) -> DataFrame:
    """Through a CSV file with a header and the table's own schema."""
    path = new_path(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def load_pool(spark: SparkSession, path: str, partition: str, schema: str, most: int | None = None) -> DataFrame:
    """A table landed as one CSV folder `partition=key` for each entity: the first `most` folders by name, or all (the wide pool)."""
    rows = spark.read.schema(f"{schema}, {partition} string").option("header", True).csv(path)
    if most is None:
        return rows
    # names of folders only; the filter prunes the others before anything of them is read
    keys = sorted(r[0] for r in rows.select(partition).distinct().collect())[:most]
    return rows.where(F.col(partition).isin(keys))


def store_comparison(df: DataFrame, path: str) -> DataFrame:
    """A comparison table as one CSV file with a header, replaced whole; returns it as read back."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row for each candidate
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def load_isolated(spark: SparkSession, path: str, schema: str, entity: str, day: str) -> tuple[DataFrame, DataFrame]:
    """(rows, status) of JSON lines landed in a folder `entity=key` for each entity, in one job: what is broken keeps no other entity from loading.

    An entity with a line that is no JSON of this schema gives no rows.  status has one row for each: lines, broken, newest day, loaded.
    """
    lines = spark.read.schema(f"{schema}, _broken string, {entity} string").option("columnNameOfCorruptRecord", "_broken").json(path)
    counts = lines.groupBy(entity).agg(F.count("*").alias("lines"), F.count_if(F.col("_broken").isNotNull()).alias("broken"), F.max(day).alias("newest"))
    status = staged(counts.withColumn("loaded", F.col("broken") == 0), "status")
    rows = lines.join(status.where("not loaded").select(entity), entity, "left_anti")
    return rows.drop("_broken"), status


def refreshed(have: DataFrame, rows: DataFrame, status: DataFrame, log: DataFrame, entity: str, day: str, keys: list[str], today: Column) -> tuple[DataFrame, DataFrame]:
    """(table, log): the loaded rows laid over the old ones, and the log with `today` for entities that were loaded; broken and absent ones keep their stamp."""
    done = status.where("loaded").select(entity, today.alias("checked"))
    return top_up(have, rows, entity, day, keys), upsert(log, done, [entity])
