"""Removal of repeated byte strings through a suffix array, built by the distributed difference-cover algorithm.

Positions 1 and 2 modulo 3 are the sample.  Their triples of symbols are sorted and named; unless all names differ, the
names form a text of two thirds the length, whose suffixes are sorted in the same way.  The order of the sample then
gives that of all other positions, by one symbol and the rank behind it, and both are merged by counting
(Karkkainen, Sanders, Burkhardt: Linear work suffix array construction).  Neighbours in the order whose prefixes of LENGTH
bytes are equal hold one string.

Every symbol of every level is a row, so the disk that this takes is a multiple of the text that no corpus can
afford; substrings.py gives the same result from a sample by content.  README has figures of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_sized, staged
from .substrings import LENGTH

#: Positions of a bucket in which neighbours are looked up.
BUCKET = 1 << 14


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """`df` with the sum of each expression over all rows before, in the order of the columns, which must tell rows apart."""
    dealt = staged(df.repartitionByRange(*(F.col(c) for c in order)).withColumns({"_part": F.spark_partition_id(), **{f"_{k}": v.cast("long") for k, v in sums.items()}}), "dealt")
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each partition
    parts = dealt.groupBy("_part").agg(*(F.sum(f"_{k}").alias(f"_p{k}") for k in sums)).select("_part", *(F.coalesce(F.sum(f"_p{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in sums))
    inside = W.Window.partitionBy("_part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_i{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums}).join(F.broadcast(parts), "_part")
    return staged(out.select(*df.columns, *((F.col(f"_b{k}") + F.col(f"_i{k}")).alias(k) for k in sums)), "running")


def _ahead(df: DataFrame, value: str, steps: int = 2) -> DataFrame:
    """`df` (a row for each position g) with the values of the next positions as value1, value2; 0 beyond the end."""
    bucket = F.floor(F.col("g") / BUCKET)
    twice = F.array_distinct(F.array(bucket, F.floor((F.col("g") - steps) / BUCKET)))
    rows = df.withColumn("_own", bucket).withColumn("_bucket", F.explode(twice))
    w = W.Window.partitionBy("_bucket").orderBy("g")
    ahead = rows.withColumns({f"{value}{k}": F.coalesce(F.lead(value, k).over(w), F.lit(0)) for k in range(1, steps + 1)})
    return ahead.where("_bucket = _own").drop("_own", "_bucket")


def suffix_ranks(text: DataFrame, n: int) -> DataFrame:
    """(g, rank): the place, from 0, of each suffix of a text (g from 0 to n - 1, v above 0) among all."""
    symbols = staged(_ahead(text.select("g", F.col("v").cast("long").alias("v")), "v"), "triples")
    dummy = int(n % 3 == 1)  # keeps the two halves of the sample apart
    first = (n + 2) // 3
    sample = symbols.where("g % 3 != 0")
    if dummy:
        zero = F.lit(0).cast("long")
        sample = sample.unionByName(text.sparkSession.range(n, n + 1).select(F.col("id").alias("g"), zero.alias("v"), zero.alias("v1"), zero.alias("v2")))
    distinct = running_sums(sample.select("v", "v1", "v2").distinct(), ["v", "v1", "v2"], {"name": F.lit(1)})
    named = staged(sample.join(distinct, ["v", "v1", "v2"]).select("g", (F.col("name") + 1).alias("name")), "names")
    size = named.count()
    if distinct.count() == size:
        ranks = named.withColumnRenamed("name", "r")
    else:
        at = F.when(F.col("g") % 3 == 1, F.floor(F.col("g") / 3)).otherwise(F.floor(F.col("g") / 3) + first)
        below = suffix_ranks(named.select(at.alias("g"), F.col("name").alias("v")), size)
        g = F.when(F.col("g") < first, 3 * F.col("g") + 1).otherwise(3 * (F.col("g") - first) + 2)
        ranks = below.select(g.alias("g"), (F.col("rank") + 1).alias("r"))
    known = symbols.join(ranks, "g", "left").withColumn("r", F.coalesce("r", F.lit(0)))
    rows = staged(_ahead(known, "r"), "ranked-sample").withColumn("k", (F.col("g") % 3).cast("int"))

    def against(k: int, order: list[str]) -> DataFrame:
        """How many suffixes of either kind stand before each of kinds 0 and k, by symbols and a rank behind them."""
        return running_sums(rows.where(F.col("k").isin(0, k)), order, {"n0": (F.col("k") == 0).cast("int"), "nk": (F.col("k") == k).cast("int")}).select("g", "k", "r", "n0", "nk")

    one, two = against(1, ["v", "r1", "g"]), against(2, ["v", "v1", "r2", "g"])
    others = one.where("k = 1").union(two.where("k = 2")).select("g", (F.col("r") - 1 - dummy + F.col("n0")).alias("rank"))
    zeros = one.where("k = 0").join(two.where("k = 0").select("g", F.col("nk").alias("n2")), "g").select("g", (F.col("n0") + F.col("nk") + F.col("n2")).alias("rank"))
    return staged(others.union(zeros), "suffix-ranks")


def covered_windows(docs: DataFrame) -> DataFrame:
    """(doc, pos) of every string of LENGTH bytes that also starts in a document with a smaller id; docs: doc (unique, not null), text."""
    sized = running_sums(docs.select("doc", (F.octet_length("text") + 1).cast("long").alias("size")), ["doc"], {"start": F.col("size"), "number": F.lit(1)})
    last = sized.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, start, number, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH) if len(raw) >= LENGTH else np.zeros((0, LENGTH), np.uint8)
                for at in range(0, len(raw) + 1, 4096):
                    v = raw[at : at + 4096].astype(np.int64) + 1
                    if at + 4096 > len(raw):  # the document's own end mark
                        v = np.append(v, 300 + number)
                    pos = np.arange(at, at + len(v))
                    window = [windows[p].tobytes() if p < len(windows) else None for p in pos]
                    yield pa.RecordBatch.from_arrays([pa.array(start + pos), pa.array(np.full(len(v), doc, np.int64)), pa.array(pos), pa.array(v), pa.array(window, pa.binary())], names=["g", "doc", "pos", "v", "window"])

    placed = docs.join(sized.select("doc", "start", "number"), "doc").select("doc", "start", "number", "text")
    text = staged(arrow_sized(placed).mapInArrow(run, "g long, doc long, pos long, v long, window binary"), "symbols")
    if not last:
        return text.select("doc", "pos").where("false")
    ranked = text.select("g", "doc", "pos", "window").join(suffix_ranks(text.select("g", "v"), last), "g")
    # the prefix before each in the order of suffixes, then runs of equal prefixes
    before = _ahead(ranked.select((F.lit(last) - F.col("rank")).alias("g"), F.xxhash64("window").alias("h")), "h", 1).select((F.lit(last) - F.col("g")).alias("rank"), F.col("h1").alias("before"))
    hashed = ranked.withColumn("h", F.xxhash64("window")).join(before, "rank")
    runs = running_sums(hashed.select("rank", "doc", "pos", "window", F.col("h").alias("own"), "before"), ["rank"], {"fresh": (F.col("own") != F.col("before")).cast("int")})
    grouped = runs.where("window is not null").withColumn("run", F.col("fresh") + (F.col("own") != F.col("before")).cast("long"))
    least = grouped.groupBy("run", "window").agg(F.min("doc").alias("least"))
    return grouped.join(least, ["run", "window"]).where("doc > least").select("doc", "pos")


def dedup_by_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs`, whose ids must be unique and not null.

    Null texts are empty; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    starts = staged(covered_windows(rows), "covered-windows").groupBy("doc").agg(F.collect_list("pos").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                at = np.array(at or [], np.int64)
                change = np.bincount(at, minlength=len(raw) + 1) - np.bincount(at + LENGTH, minlength=len(raw) + 1)
                gone = np.cumsum(change[: len(raw)]) > 0
                out.append((doc, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(starts, "doc", "left").select("doc", "text", "starts").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
