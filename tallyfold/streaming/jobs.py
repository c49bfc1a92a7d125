"""The incremental jobs as Structured Streaming queries that stop when they have read all there is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import new_path


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet file `name` of a folder as a stream, in batches of a file."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)


def _finish(writer, folder: str) -> None:
    """Run until all there is has been read.  The checkpoint lies in the job's folder: a second run goes on where the first ended."""
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(events: DataFrame, key: list[str], time: str, late: str = "1 day", folder: str | None = None) -> DataFrame:
    """ST1, ST2: new rows once each; repeats within the watermark are dropped, later rows too.

    `folder` (default: a new one) keeps the rows and the checkpoint; a later run with the same folder reads only new files.
    """
    folder = folder or new_path(events.sparkSession, "ingested")
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    _finish(once.writeStream.format("parquet").option("path", f"{folder}/rows").outputMode("append"), folder)
    return events.sparkSession.read.schema(events.schema).parquet(f"{folder}/rows")


def ingest_counted(events: DataFrame, key: list[str], time: str, late_days: float, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ST2: (accepted, rejected, counts): new rows once each, those too late apart, and how many of each every batch had.

    A row is too late if it lies more than `late_days` before the newest time of the batches before its own; a row whose key was accepted no longer ago than
    that is a repeat.  Every batch writes into folders of its number, so one that is tried again replaces itself; only earlier rows within the
    allowed lateness are read for repeats.  rejected has the column batch; counts: batch, accepted, repeated, rejected.
    """
    spark, folder = events.sparkSession, folder or new_path(events.sparkSession, "counted")
    schema = T.StructType([*events.schema.fields, T.StructField("batch", T.LongType())])
    marks = T.StructType([T.StructField("newest", T.TimestampType()), *(T.StructField(c, T.LongType()) for c in ("accepted", "repeated", "rejected", "batch"))])

    def stored(name: str, kind: T.StructType) -> DataFrame:
        try:
            return spark.read.schema(kind).parquet(f"{folder}/{name}")
        except AnalysisException:  # no batch yet
            return spark.createDataFrame([], kind)

    def lay(batch: DataFrame, number: int) -> None:
        newest = stored("marks", marks).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        at = F.col(time).cast("timestamp")
        edge = F.lit(newest).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {86400 * late_days})")
        late = F.coalesce(at < edge, F.lit(False))
        batch = batch.withColumn("_late", late).persist()
        batch.where("_late").drop("_late").write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        before = stored("accepted", schema).where((F.col("batch") < number) & ((F.col(time).cast("timestamp") >= edge) | edge.isNull()))
        fresh = batch.where("not _late").drop("_late").dropDuplicates(key).join(before.select(*key), key, "left_anti").select(events.columns)
        fresh.write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
        kept = spark.read.schema(events.schema).parquet(f"{folder}/accepted/batch={number}").agg(F.count("*").alias("accepted"))
        facts = batch.agg(F.max(at).alias("newest"), F.count_if("_late").alias("rejected"), F.count("*").alias("_n")).join(kept)  # one row and one row
        done = facts.select("newest", "accepted", (F.col("_n") - F.col("accepted") - F.col("rejected")).alias("repeated"), "rejected")
        done.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
        batch.unpersist()

    _finish(events.writeStream.foreachBatch(lay), folder)
    counts = stored("marks", marks).select("batch", "accepted", "repeated", "rejected")
    return stored("accepted", schema).drop("batch"), stored("rejected", schema), counts


def newest_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order of each key."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return newest.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upserted(events: DataFrame, keys: list[str], order: str, folder: str | None = None) -> DataFrame:
    """ST1 with revisions: the newest row of a key wins.

    Each batch writes only the newest rows of the keys that it touches, into a folder of its number, so a batch that is
    tried again replaces itself and no batch rewrites the table; reading merges the batches by key.
    """
    spark, folder = events.sparkSession, folder or new_path(events.sparkSession, "upserted")

    def lay(batch: DataFrame, number: int) -> None:
        newest_rows(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    _finish(events.writeStream.foreachBatch(lay), folder)
    schema = T.StructType([*events.schema.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], events.schema)
    return newest_rows(rows.drop("batch"), keys, order)


def gate(events: DataFrame, unit: list[str], amount: str, least: float, folder: str | None = None) -> DataFrame:
    """ST3: every unit once, with its amount when that first reached `least`.

    A unit's state is its running sum and whether it has been sent, so each batch handles its own units only and appends those that
    pass; a later run goes on from the stored state.
    """
    spark, folder = events.sparkSession, folder or new_path(events.sparkSession, "gate")
    kinds = ", ".join(f"{c} {dict(events.dtypes)[c]}" for c in unit)

    def passed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, sent = state.get if state.exists else (0.0, False)
        total += sum(float(b["amount"].sum()) for b in batches)
        if not sent and total >= least:
            sent = True
            yield pd.DataFrame({**{c: [k] for c, k in zip(unit, key)}, "amount": [total]})
        state.update((total, sent))

    rows = events.select(*unit, F.col(amount).cast("double").alias("amount"))
    out = rows.groupBy(*unit).applyInPandasWithState(passed, f"{kinds}, amount double", "total double, sent boolean", "append", GroupStateTimeout.NoTimeout)
    _finish(out.writeStream.format("parquet").option("path", f"{folder}/rows").outputMode("append"), folder)
    return spark.read.schema(f"{kinds}, amount double").parquet(f"{folder}/rows")


def upgraded(events: DataFrame, key: str, status: str, order: str, folder: str | None = None) -> DataFrame:
    """ST4: a key's best row: a confirmed one wins over a projected one, then the newest."""
    ranked = events.withColumn("_rank", F.struct((F.col(status) == "confirmed").cast("int").alias("c"), F.col(order).alias("o")))
    return upserted(ranked, [key], "_rank", folder).drop("_rank")


def totals(events: DataFrame, label: str, value: str, folder: str | None = None) -> DataFrame:
    """ST5: running count and sum for each label; each batch writes the labels that it changes, the last of which count."""
    spark, folder = events.sparkSession, folder or new_path(events.sparkSession, "totals")
    sums = events.groupBy(label).agg(F.count("*").alias("n"), F.sum(value).alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    _finish(sums.writeStream.outputMode("update").foreachBatch(write), folder)
    return newest_rows(spark.read.parquet(f"{folder}/totals"), [label], "batch").drop("batch")
