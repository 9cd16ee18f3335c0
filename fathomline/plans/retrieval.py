"""The retrieval loop: search, rerank, assess, and again with a wider preset for queries that are not answered yet.

A batch of queries takes at most MAX_RETRIES + 1 plans, whatever its size; only unresolved queries go into the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import assembly, context, search
from fathomline.plans.config import Preset, for_fallback, for_retry

MAX_RETRIES = 2
_RANK = {"low": 0, "medium": 1, "high": 2}


def attempt(queries: DataFrame, docs: DataFrame, preset: Preset, retry: int = 0) -> DataFrame:
    """query_id, chunk_id, rerank_rank, rerank_score, confidence, level: the chunks of each query and what they are worth.

    queries: query_id, text; docs: doc_id, text, section. Queries without any candidate have no row.
    """
    asked = queries.select("query_id", "text", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))
    found = search.hybrid(asked, docs, preset.weights, most=max(search.MOST, preset.candidate_k), semantic_k=preset.candidate_k)
    told = found.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "section"), "chunk_id").join(asked, "query_id")
    ranked = search.rerank(told, search.lexical_score(F.col("text"), F.col("content")), preset.rerank_k)
    kinds = found.groupBy("query_id").agg(F.countDistinct(F.substring_index("source", "_", 1)).alias("kinds"))
    about = asked.join(kinds, "query_id").select("query_id", F.col("text").alias("query"), "keywords", F.lit(len(preset.filters)).alias("n_filters"), F.lit(False).alias("diversified"), F.lit(retry).alias("retry"), "kinds")
    view = ranked.select("query_id", F.col("rerank_rank").alias("rank"), F.col("rerank_score").alias("score"), "section", "content")
    worth = context.confidence(view, about, preset.rerank_k)
    return ranked.select("query_id", "chunk_id", "rerank_rank", "rerank_score").join(worth.select("query_id", "confidence", "level"), "query_id")


def _settled(rows: DataFrame) -> DataFrame:
    """Rows computed once: a few for each query. What follows neither plans nor runs the attempt again."""
    return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows.persist()


def retrieve(queries: DataFrame, docs: DataFrame, preset: Preset, max_retries: int = MAX_RETRIES) -> DataFrame:
    """attempt() of the first try whose level suffices, or of the last; with attempts and is_fallback.

    The second try asks for more candidates and one level less, the last one is the semantic fallback.
    """
    out, open_, now = [], queries, preset
    for k in range(max_retries + 1):
        got = attempt(open_, docs, now, k).withColumn("attempts", F.lit(k + 1)).withColumn("is_fallback", F.lit(now.name.endswith("_fallback")))
        last = k == max_retries or not now.retry
        got = got if last else _settled(got)
        enough = F.lit(True) if last else F.col("level").isin(*(x for x, n in _RANK.items() if n >= _RANK[now.min_confidence]))
        out.append(got.where(enough))
        if last:
            break
        open_ = _settled(open_.join(got.where(enough).select("query_id").distinct(), "query_id", "left_anti"))
        now = for_retry(now) if k + 1 < max_retries else for_fallback(preset)
    return reduce(DataFrame.unionByName, out)


def empty_results(queries: DataFrame, found: DataFrame, kind: str = "error", message: str = "nothing was retrieved") -> DataFrame:
    """A row for each query without a result: confidence 0, level low, the kind and the message."""
    lost = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    says = {"timeout": "Retrieval timed out. Please try a simpler query.", "error": "An error occurred during retrieval. Please try again.", "clarification": "What exactly do you mean?"}
    return lost.select("query_id", F.lit("").alias("context"), F.lit(0.0).alias("confidence"), F.lit("low").alias("level"), F.lit(kind).alias("action"), F.lit(says.get(kind, message)).alias("recommendation"), F.lit(message).alias("error"))


def decomposed(queries: DataFrame, parts: DataFrame, docs: DataFrame, preset: Preset) -> DataFrame:
    """query_id, chunk_id, score, rank: the chunks of all parts of a query, each chunk once at its best.

    parts: query_id, part, text, k (expansion.sub_queries).
    """
    keyed = parts.withColumn("part_id", F.col("query_id") * 100 + F.col("part"))
    got = attempt(keyed.select(F.col("part_id").alias("query_id"), "text"), docs, preset).withColumnRenamed("query_id", "part_id")
    rows = got.join(keyed.select("part_id", F.col("query_id").alias("of"), "k"), "part_id").where(F.col("rerank_rank") <= F.col("k"))
    best = rows.groupBy("of", "chunk_id").agg(F.max("rerank_score").alias("score"))
    w = Window.partitionBy("of").orderBy(F.col("score").desc(), "chunk_id")
    return best.select(F.col("of").alias("query_id"), "chunk_id", "score", F.row_number().over(w).alias("rank"))


def contexts(found: DataFrame, docs: DataFrame, template: str, budget: int = 4000) -> DataFrame:
    """The assembled context of each query's chunks. docs as assembly.build wants its chunks, under doc_id."""
    rows = found.select("query_id", "chunk_id", F.col("rerank_score").alias("score")).join(docs.withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    return assembly.build(rows, "query_id", template, budget)


def status(docs: DataFrame, indexed: bool, presets: dict) -> dict:
    """What a retrieval has to work with."""
    return {"columns": docs.columns, "keyword_backend": "bm25" if indexed else "semantic_fallback", "presets": sorted(presets)}
