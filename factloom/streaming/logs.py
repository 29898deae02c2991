"""Incremental logs by Structured Streaming. The file source and its checkpoint take the place of byte offsets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from factloom.sources.staging import staged
from factloom.sources.store import Store

LOG = "function string, status string, score double, ts timestamp"


def tail(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """New lines of JSON files as they come; malformed lines are left out, scores that aren't finite count as none."""
    rows = spark.readStream.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    finite = ~F.isnan("score") & (F.abs("score") != float("inf"))
    return rows.filter("_bad IS NULL").drop("_bad").withColumn("score", F.when(finite, F.col("score")))


def previous_scores(rows: DataFrame) -> DataFrame:
    """function, ts, place, score, previous: the score before of the same function (rows have function, ts, place and score), kept
    as state between batches. ``place`` orders rows of one time; scores that are null are passed over."""

    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        # a function's rows of one batch come in pieces, each in any order
        pdf = pd.concat(batches).sort_values(["ts", "place"])
        filled = pdf["score"].ffill()
        previous = filled.shift()
        pdf["previous"] = previous if last is None else previous.fillna(last)
        if filled.notna().any():
            last = float(filled.iloc[-1])
        state.update((last,))
        yield pdf[["function", "ts", "place", "score", "previous"]].astype({"previous": "float64"})

    narrow = rows.select("function", "ts", F.col("place").cast("long").alias("place"), F.col("score").cast("double").alias("score"))
    return narrow.groupBy("function").applyInPandasWithState(step, "function string, ts timestamp, place long, score double, previous double", "last double", "append", "NoTimeout")


def windowed(rows: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and best score in event-time windows; rows later than the watermark are dropped."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return w.select(F.col("window.start").alias("start"), "status", "n", "best")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "function").agg(F.count("*").alias("n"))
    return s.select("function", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_each(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Handle all that is there now, each batch once; ``each`` gets the batch and its number."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def retry_decision(paused: Column, inputs_changed: Column, code: Column, failures: Column, most: int = 3) -> Column:
    """What happens after a run, first rule that fits."""
    return F.when(paused, "wait").when(inputs_changed, "restart").when(code == 0, "finish").when(failures < most, "retry").otherwise("stop")


def status_sink(store: Store, table: str) -> Callable[[DataFrame, int], None]:
    """For :func:`run_to_end`: keeps function, tries and best up to date. The number of the batch that wrote a row makes a
    batch that comes twice count once."""

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("function").agg(F.count("*").alias("tries"), F.max("score").alias("best")).withColumn("batch", F.lit(number).cast("long"))
        if store.current(table):
            old = store.read(table).select("function", F.col("tries").alias("_t"), F.col("best").alias("_b"), F.col("batch").alias("_at"))
            both = fresh.join(old, "function", "left").filter("_at IS NULL OR _at < batch")
            fresh = both.select("function", (F.col("tries") + F.coalesce("_t", F.lit(0))).alias("tries"), F.greatest("best", "_b").alias("best"), "batch")
        store.upsert(table, staged(fresh), ["function"])

    return each
