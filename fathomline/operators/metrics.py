"""Request metrics: one fact row per request, and what a dashboard makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics_rows(events: DataFrame) -> DataFrame:
    """The event table as metrics rows."""
    return events.select(
        F.col("event_id").alias("id"), F.col("ts"), F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev").alias("env"), "user_id", F.col("value").alias("total_time_ms"),
        (F.col("event_type") == "error").cast("bigint").alias("refused"), F.col("event_type").isin("view", "click", "purchase").cast("bigint").alias("hit"), F.col("props").alias("stage_timings_json"), "event_type",
    )


def recent(rows: DataFrame, n: int = 100, env: str | None = None) -> DataFrame:
    rows = rows if env is None else rows.where(F.col("env") == env)
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def kpis(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("total_time_ms", 0.5).alias("p50"), F.percentile("total_time_ms", 0.95).alias("p95"), F.avg("refused").alias("refused_rate"), F.avg("hit").alias("hit_rate"))


def stage_latency(rows: DataFrame) -> DataFrame:
    stages = rows.select(F.explode(F.from_json("stage_timings_json", "map<string,double>")).alias("stage", "ms"))
    return stages.groupBy("stage").agg(F.avg("ms").alias("mean_ms"), F.count(F.lit(1)).alias("n"))


def top_and_other(means: DataFrame, key: str, value: str, most: int = 7) -> DataFrame:
    """Beyond `most` groups the smallest ones fold into `other`, whose value is their sum. One small row a group."""
    w = Window.orderBy(F.col(value).desc(), F.col(key))
    ranked = means.withColumn("rk", F.row_number().over(w))
    return ranked.groupBy(F.when(F.col("rk") <= most, F.col(key)).otherwise("other").alias(key)).agg(F.sum(value).alias(value))


def rolling(rows: DataFrame, width: int) -> DataFrame:
    """Number, rolling mean and running sum of each user's requests in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    return rows.select("user_id", "id", F.row_number().over(w).alias("i"), F.avg("total_time_ms").over(w.rowsBetween(-(width - 1), 0)).alias("rolling_ms"), F.sum("total_time_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total_ms"))


def rolling_tenth(rows: DataFrame) -> DataFrame:
    """The rolling mean over a tenth of each user's requests, at least three: a width that differs by user.

    A frame cannot be as wide as a column says, so the mean is the difference of two running sums, `width` rows apart.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    total = F.sum("total_time_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))
    width = F.greatest(F.lit(3), F.floor(F.count(F.lit(1)).over(Window.partitionBy("user_id")) / 10)).cast("int")
    marked = rows.withColumn("i", F.row_number().over(w)).withColumn("run", total).withColumn("width", width)
    back = marked.select(F.col("user_id").alias("of"), (F.col("i") + F.col("width")).alias("at"), F.col("run").alias("earlier"))
    joined = marked.join(back, (F.col("user_id") == F.col("of")) & (F.col("i") == F.col("at")), "left")
    held = F.least(F.col("i"), F.col("width"))
    return joined.select("user_id", "id", "i", ((F.col("run") - F.coalesce("earlier", F.lit(0.0))) / held).alias("rolling_ms"))


def incidents(rows: DataFrame) -> DataFrame:
    """Runs of flagged requests of each user: from, to, length."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    flagged = rows.withColumn("i", F.row_number().over(w)).where("refused = 1")
    islands = flagged.withColumn("island", F.col("i") - F.row_number().over(w))
    return islands.groupBy("user_id", "island").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count(F.lit(1)).alias("length"))


def nearest_second(rows: DataFrame, ts: str) -> Column:
    """The whole second since 1970 that is nearest (a half goes to the even one). A time without a zone is taken as it
    stands, whatever the session's zone."""
    if dict(rows.dtypes)[ts] == "timestamp_ntz":
        whole = F.unix_date(F.to_date(ts)) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
        micros = whole.cast("bigint") * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    else:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.rint(micros / 1e6).cast("bigint")


def usage(rows: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests and time of each user within the seconds up to each request."""
    w = Window.partitionBy("user_id").orderBy(nearest_second(rows, "ts")).rangeBetween(-seconds, 0)
    return rows.select("id", "user_id", F.count(F.lit(1)).over(w).alias("requests"), F.sum("total_time_ms").over(w).alias("used"))


def sampled(rows: DataFrame, every: int) -> DataFrame:
    """Every n-th eligible (hit) request of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("nth", F.sum("hit").over(w)).where((F.col("hit") == 1) & ((F.col("nth") - 1) % every == 0))


def breakdown(scored: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Mean, rows and scored rows by either key, in one pass (grouping sets)."""
    view = scored.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(score).alias("score"))
    both = view.groupingSets([["a"], ["b"]], "a", "b").agg(F.grouping("a").alias("ga"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"))
    return both.select(F.when(F.col("ga") == 0, a).otherwise(b).alias("key"), F.when(F.col("ga") == 0, F.col("a")).otherwise(F.col("b")).alias("value"), "mean", "n", "n_scored")


def learned_weights(samples: DataFrame, features: list[str], share: float = 0.3) -> DataFrame:
    """Inverse-variance weights blended into equal ones, summing to 1."""
    inverse = {f: 1 / (F.var_pop(f) + 1e-6) for f in features}
    row = samples.agg(*(v.alias(f) for f, v in inverse.items()))
    total = sum((F.col(f) for f in features[1:]), F.col(features[0]))
    return row.select(*((F.lit((1 - share) / len(features)) + share * F.col(f) / total).alias(f) for f in features))
