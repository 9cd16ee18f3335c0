"""Tables: reading, keyed upsert, namespaces, the metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A scan of fewer bytes than this for each core, in fewer files than cores, is dealt out before work on its texts.
SPREAD_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a few small files would otherwise be the work of a few tasks.

    A row group is one task's work however many cores there are. Larger tables, and those of more files than cores,
    are returned as they are: nothing is shuffled then.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    total = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if total < SPREAD_BYTES * cores else df


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; of equal versions the new table's."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("side").desc())
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "side")


def split_valid(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of the right length, and the rejected ones."""
    good = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return vectors.where(good), vectors.where(~good)


def vector_rows(chunks: DataFrame, dim: int, model: str, drop: tuple[str, ...] = ("global_context", "key_topics")) -> tuple[DataFrame, DataFrame]:
    """What is stored of embedded chunks: without the wide fields, with dimension, model and a flag; and the rejected rows."""
    good, bad = split_valid(chunks, dim)
    return good.drop(*drop).withColumns({"embedding_dim": F.lit(dim), "embedding_model": F.lit(model), "has_embedding": F.lit(True)}), bad


def upsert_statistics(batches: DataFrame, *by: str) -> DataFrame:
    """Of batches (n, failed, ms): vectors written and failed, batches, and their response times."""
    return batches.groupBy(*by).agg(
        F.sum(F.when(~F.col("failed"), F.col("n")).otherwise(0)).alias("written"), F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("lost"), F.count(F.lit(1)).alias("batches"),
        F.avg("ms").alias("mean_ms"), F.max("ms").alias("most_ms"), F.min("ms").alias("least_ms"),
    )


def namespace_of_id(name: Column, slug: Column, uuid: Column) -> Column:
    """Slug and the first 8 characters of an id; `doc_` and these without a name."""
    short = F.substring(F.regexp_replace(uuid, "-", ""), 1, 8)
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.concat(F.lit("doc_"), short)).otherwise(F.concat_ws("_", slug, short))


# ---- namespaces are the partitions of a stored table -------------------------------------------------------------


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that df has rows of; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def namespaces(spark: SparkSession, path: str, by: str = "namespace") -> list[str]:
    return sorted(r[0] for r in spark.read.parquet(path).select(by).distinct().collect())


def drop_namespace(spark: SparkSession, path: str, value: str, by: str = "namespace") -> bool:
    """Whether there was such a partition; a missing one is a success too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def drop_table(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


# ---- the metrics table -------------------------------------------------------------------------------------------

METRICS = "request_id string, ts timestamp, env string, query string, total_time_ms double, retrieval_hit int, is_grounded int, refused int, cost_usd double, faithfulness_score double, stage_timings_json string"


def metrics_record(calls: DataFrame) -> DataFrame:
    """Rows as the metrics table holds them: timings as JSON, flags as 0 and 1 (null is 0), now where no time is given."""
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int").alias(c)
    return calls.select(
        "request_id", F.coalesce("ts", F.current_timestamp()).alias("ts"), "env", "query", "total_time_ms", flag("retrieval_hit"), flag("is_grounded"), flag("refused"), "cost_usd", "faithfulness_score",
        F.to_json("stage_timings").alias("stage_timings_json"),
    )


def record(calls: DataFrame, path: str) -> None:
    """Append; the table is laid out by environment."""
    metrics_record(calls).write.mode("append").partitionBy("env").parquet(path)


def every_record(spark: SparkSession, path: str, env: str | None = None) -> DataFrame:
    """All rows, oldest first."""
    rows = spark.read.schema(METRICS).parquet(path)
    return (rows if env is None else rows.where(F.col("env") == env)).orderBy("ts", "request_id")
