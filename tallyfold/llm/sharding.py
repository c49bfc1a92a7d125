"""Sharding by sampled splitters: near-equal bytes per shard, records in key order.

Size-weighted key samples give quantile boundaries; records are range-partitioned between them, and
ranges that turn out overfull (a hot key, an unlucky sample) are sampled again and subdivided.  Exact
running sums over the ranges then place every record, so shard sizes differ by one record at most.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import fresh_name, staged

#: Rows that one range should hold, and the fewest ranges.
RANGE_ROWS, LEAST_RANGES = 100_000, 1024
#: Expected samples for a range: the driver holds this many keys times the ranges, no more.
SAMPLES = 16
#: A range with more than this many times its share of bytes is subdivided.
OVERFULL = 4


def _uniform(seed: str, *cols: Column) -> Column:
    """In [0, 1), from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def _draw(sized: DataFrame, wanted: float, total: int, seed: str) -> list[tuple[int, int]]:
    """About `wanted` (key, tie) pairs, a record's chance in proportion to its size."""
    chance = F.col("size") * (wanted / max(total, 1))
    return sorted((r["key"], r["tie"]) for r in sized.where(_uniform(seed, "key", "tie") < chance).select("key", "tie").collect())


def _sortable(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """(key, tie) as 16 bytes that sort like the pair."""
    sign = np.uint64(1 << 63)
    both = np.stack([key.astype(np.int64).view(np.uint64) ^ sign, tie.astype(np.int64).view(np.uint64) ^ sign], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below (key, tie)."""
    if not splitters:
        return F.lit(0)
    edges = _sortable(*(np.array(x, np.int64) for x in zip(*splitters)))

    @F.pandas_udf("int")
    def search(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _sortable(key.to_numpy(), tie.to_numpy()), side="right").astype(np.int32))

    return search("key", "tie")


def place(sized: DataFrame, shards: int) -> DataFrame:
    """Add shard and slot to rows with columns key, tie (long, not null) and size (long, above 0).

    Rows go to shards in (key, tie) order; a row's shard is where its middle byte falls, and slot counts
    from 0 within a shard.  Rows equal in key and tie keep the order of all their columns.
    """
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(LEAST_RANGES, -(-rows // RANGE_ROWS))
    sample = _draw(sized, SAMPLES * ranges, total, "first")
    splitters = sorted(set(sample[SAMPLES::SAMPLES]))
    varied = (F.min("key") != F.max("key")) | (F.min("tie") != F.max("tie"))
    for k in itertools.count():  # until no range is overfull, or holds one (key, tie) alone
        # at most one row per range comes back
        full = [
            r["range"]
            for r in sized.groupBy(_range_of(splitters).alias("range")).agg(F.sum("size").alias("b"), varied.alias("varied")).collect()
            if r["b"] * ranges > OVERFULL * total and r["varied"]
        ]
        if not full:
            break
        inside = sized.where(_range_of(splitters).isin(full))
        more = sorted({*splitters, *_draw(inside, SAMPLES * ranges, total, f"round {k}")})
        if len(more) == len(splitters):
            break
        splitters = more
    ranged = sized.withColumn("range", _range_of(splitters))
    others = [c for c in sized.columns if c not in ("key", "tie", "size")]
    inside = W.Window.partitionBy("range").orderBy("key", "tie", "size", *others).rowsBetween(W.Window.unboundedPreceding, -1)
    run = staged(ranged.withColumn("_b", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("_r", F.count("*").over(inside)), "ranges")
    # one row per range: small by construction
    sums = run.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = W.Window.orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r0"))
    middle = (F.col("_b") + F.col("b0")) * 2 + F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(total, 1)))).cast("int")
    placed = run.join(starts, "range").withColumn("shard", shard).withColumn("_at", F.col("_r") + F.col("r0"))
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_at") - F.col("_first")).drop("range", "_b", "_r", "b0", "r0", "_at", "_first")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row, with near-equal bytes per shard.

    The key is a hash of the text, so equal texts are neighbours and the order is a shuffled one; the id
    breaks ties, which also lets a splitter cut through a group of equal texts.  size is the text's UTF-8
    bytes plus 1 (null: 1), text_crc32 the unsigned CRC of the text (null: of no bytes).  Null ids sort by
    a fixed hash; repeated rows are all placed; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col(id_col)).alias("tie"),
    )
    return place(staged(sized, "sized"), shards).select("id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows of `docs` to `path`, a folder per shard in slot order. Returns the assignment.

    Rows with null ids and rows that repeat are written like any other: rows that are equal in id and text are counted
    off on both sides.  The folders are named by `shard`, or with underscores in front where `docs` has such a column.
    """
    assigned = staged(assign_shards(docs, shards, id_col, text_col), "shards")
    shard, slot, copy, crc, size = (fresh_name(docs, x) for x in ("shard", "slot", "copy", "crc", "size"))

    def counted(df: DataFrame, *keys: Column) -> DataFrame:
        return df.withColumn(copy, F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.lit(0))))

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({crc: F.crc32(F.encode(text, "UTF-8")), size: (F.octet_length(text) + 1).cast("long")})
    own = counted(own, F.col(id_col), F.col(crc), F.col(size))
    mine = counted(assigned, F.col("id"), F.col("text_crc32"), F.col("size"))
    mine = mine.select(F.col("id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.col(copy).alias("_copy"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    same = own[id_col].eqNullSafe(mine["_id"]) & (own[crc] == mine["_crc"]) & (own[size] == mine["_size"]) & (own[copy] == mine["_copy"])
    placed = own.join(mine, same).select(*(own[c] for c in docs.columns), F.col("_shard").alias(shard), F.col("_slot").alias(slot))
    placed.repartition(shard).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
    return assigned
