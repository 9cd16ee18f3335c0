"""The metrics table as a stream: windows, daily counts, deduplication, late rows, sessions, expiring results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.operators import metrics


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return metrics.metrics_rows(spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))


def windowed(rows: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests, refusals and mean time of each sliding window and environment; late rows within the watermark count."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "env").agg(F.count(F.lit(1)).alias("n"), F.sum("refused").alias("refused"), F.avg("total_time_ms").alias("mean_ms"))


def daily_counts(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def deduplicated(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it, so state stays bounded."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sink(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to a Parquet table that batch readers may read meanwhile: a file counts once its batch is committed."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def split_late(rows: DataFrame, on_time: str, late: str, checkpoint: str, lateness: str = "10 minutes", **trigger) -> StreamingQuery:
    """Rows older than the newest time seen so far by more than `lateness` go to a side table, marked refused; none is lost.

    The newest time is kept beside the on-time table, so a restart goes on with it.
    """

    def deal(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("seen timestamp, batch bigint").option("recursiveFileLookup", "true").parquet(f"{late}_marks") if _there(spark, f"{late}_marks") else None
        before = marks.where(F.col("batch") < batch_id).agg(F.max("seen")).first()[0] if marks is not None else None
        edge = F.lit(before) - F.expr(f"INTERVAL {lateness}") if before is not None else F.lit(None).cast("timestamp")
        is_late = F.coalesce(F.col("ts") < edge, F.lit(False))
        # a batch that is repeated after a failure replaces its own folder
        batch.where(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        batch.where(is_late).withColumn("refused", F.lit(1).cast("bigint")).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.agg(F.max("ts").alias("seen"), F.lit(batch_id).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{late}_marks/n{batch_id}")

    return rows.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def conversation_state(turns: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """conv_id, turns, last_concept after each batch of turns (conv_id, turn, role, concept); a silent conversation ends after the ttl."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, concept = state.get
            state.remove()
            yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "last_concept": [concept], "ended": [True]})
            return
        n, concept = state.get if state.exists else (0, None)
        for batch in batches:
            n += len(batch)
            known = batch[(batch["role"] == "assistant") & batch["concept"].notna()].sort_values("turn")
            concept = known["concept"].iloc[-1] if len(known) else concept
        state.update((n, concept))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "last_concept": [concept], "ended": [False]})

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turns long, last_concept string, ended boolean", "turns long, last_concept string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def unexpired(results: DataFrame, now, ttl_seconds: int = 3600, most: int | None = None) -> DataFrame:
    """Stored results (key, stored_at, used_at) that are younger than the ttl; of these the most recently used ones."""
    alive = results.where(F.col("stored_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    return alive if most is None else alive.orderBy(F.col("used_at").desc(), "key").limit(most)


def hit_rate(look_ups: DataFrame) -> DataFrame:
    """hits, misses, rate of look-ups (hit boolean)."""
    hits = F.count_if("hit")
    return look_ups.agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.try_divide(hits, F.count(F.lit(1))), F.lit(0.0)).alias("rate"))
