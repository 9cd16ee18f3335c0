"""The stored keyword index: postings, term statistics and sizes as tables, one namespace a partition of the postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import search
from fathomline.sources.tables import drop_table, exists


def save(docs: DataFrame, path: str, namespace: str | None = None) -> None:
    """docs: doc_id, text and, where named, a namespace column. Replaces what was there."""
    spaces = docs.select("doc_id", (F.col(namespace) if namespace else F.lit("default")).alias("namespace"))
    idf, sizes = search.term_statistics(docs)
    rows = search.postings(docs).join(spaces, "doc_id")
    rows.repartition("namespace", "term").sortWithinPartitions("term").write.mode("overwrite").partitionBy("namespace").parquet(f"{path}/postings")
    idf.write.mode("overwrite").parquet(f"{path}/terms")
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")


def stored(spark: SparkSession, path: str) -> bool:
    return all(exists(spark, f"{path}/{t}/_SUCCESS") for t in ("postings", "terms", "sizes"))


def drop(spark: SparkSession, path: str) -> bool:
    return drop_table(spark, path)


def look_up(spark: SparkSession, path: str, queries: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank from the stored tables: no text is read. keep: a predicate on namespace and doc_id."""
    rows, terms = spark.read.parquet(f"{path}/postings"), search.query_terms(queries)
    rows = (rows if keep is None else rows.where(keep)).join(terms.select("term").distinct(), "term", "left_semi")
    scored = search.keyword_scores(rows.drop("namespace"), terms, spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/sizes"))
    return search.top_k(scored, ["query_id"], k, F.round("score", 6).desc(), F.col("doc_id"))
