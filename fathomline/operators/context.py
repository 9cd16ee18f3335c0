"""Context assembly, citations and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: The weights and thresholds of a retrieval's confidence.
WEIGHTS = {"reranker_scores": 0.30, "score_distribution": 0.15, "chunk_diversity": 0.15, "context_completeness": 0.15, "keyword_coverage": 0.10, "metadata_match": 0.10, "retrieval_depth": 0.05}
HIGH, MEDIUM = 0.75, 0.50


def citation(course: Column, chapter: Column, first: Column, last: Column, kind: Column | str = "Page") -> Column:
    """`[course | chapter | Page 1-2]`; without a first page N/A, unknown names as Unknown."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    span = F.when(last.isNull() | (last == 0) | (last == first), first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))
    place = F.when(first.isNotNull() & (first != 0), F.concat(kind, F.lit(" "), span)).otherwise("N/A")
    return F.concat(F.lit("["), F.concat_ws(" | ", F.coalesce(course, F.lit("Unknown")), F.coalesce(chapter, F.lit("Unknown")), place), F.lit("]"))


def within_budget(rows: DataFrame, by: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows in order while their running sum of tokens fits; ends at the first that does not."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(w)).where(F.col("running") <= budget)


def drop_repeated_lines(text: Column) -> Column:
    """Lines that equal the one before go; blank ones stay."""
    kept = T.bound(F.split(text, "\n"), lambda lines: F.filter(lines, lambda x, i: (i == 0) | (F.trim(x) == "") | (F.trim(x) != F.trim(F.get(lines, F.greatest(i - 1, F.lit(0)))))))
    return F.array_join(kept, "\n")


def match_citations(cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each citation's chunk: same course and chapter, the page range inside the chunk's; else course and chapter only."""
    c = cites.select("cite_id", F.lower("course").alias("course"), F.lower("chapter").alias("chapter"), "first", "last")
    d = chunks.select("chunk_id", F.lower("course").alias("course"), F.lower("chapter").alias("chapter"), "start", "end")
    inside = (F.col("first") >= F.col("start")) & (F.col("last") <= F.col("end"))
    rows = c.join(d, ["course", "chapter"]).withColumn("tier", F.when(inside, 0).otherwise(1).cast("bigint"))
    w = Window.partitionBy("cite_id").orderBy("tier", "chunk_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cite_id", "chunk_id", "tier")


def distribution(drop: Column, n: Column) -> Column:
    return F.when(n < 2, 0.5).when(drop >= 0.3, 0.9).when(drop <= 0.1, 0.3).otherwise(0.3 + (drop - 0.1) / 0.2 * 0.6)


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


#: Where keyword coverage counts half, and how queries and keywords share.
LEAST_OVERLAP, QUERY_SHARE, EMBEDDING_SHARE = 0.3, 0.7, 0.5


def keyword_coverage(query: Column, context: Column) -> Column:
    """Share of the query's distinct words of over two characters that stand in the context; 0.5 without such words, 0 without a text."""
    words = F.array_distinct(F.filter(F.transform(F.split(F.lower(query), r"\s+"), T.strip_marks), lambda w: F.length(w) > 2))
    share = T.bound(F.lower(context), lambda c: F.size(F.filter(words, lambda w: F.contains(c, w)))) / F.size(words)
    empty = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == "")
    return F.when(empty, 0.0).when(F.size(words) == 0, 0.5).otherwise(share)


def embedding_coverage(cosine: Column) -> Column:
    """A cosine of 0.5 counts 0, one of 1 counts 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - 0.5) / 0.5))


def coverage(query: Column, context: Column, cosine: Column | None = None) -> Column:
    """Keyword and embedding coverage blended; without vectors keyword coverage, stretched around LEAST_OVERLAP."""
    words = keyword_coverage(query, context)
    stretched = F.when(words >= LEAST_OVERLAP, 0.5 + (words - LEAST_OVERLAP) * (0.5 / (1.0 - LEAST_OVERLAP))).otherwise(words * (0.5 / LEAST_OVERLAP))
    if cosine is None:
        return stretched
    return F.when(cosine.isNull(), stretched).otherwise(words * (1 - EMBEDDING_SHARE) + embedding_coverage(cosine) * EMBEDDING_SHARE)


def context_coverage(query: Column, keywords: Column, context: Column) -> Column:
    """Of the query and, where there are any, its keywords; 0 without a context."""
    asked = coverage(query, context)
    both = QUERY_SHARE * asked + (1 - QUERY_SHARE) * coverage(keywords, context)
    return F.when(F.coalesce(context, F.lit("")) == "", 0.0).when(F.coalesce(keywords, F.lit("")) == "", asked).otherwise(both)


def metadata_match(n_filters: Column) -> Column:
    return F.when(n_filters <= 0, 0.3).otherwise(0.5 + 0.5 * F.least(F.lit(1.0), n_filters / 3.0))


def confidence(ranked: DataFrame, about: DataFrame, used: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, the seven features, confidence, level.

    ranked: query_id, rank, score, section, content (of the reranked chunks, best first); about: query_id, query,
    keywords, n_filters, diversified, retry, kinds (how many of semantic, keyword, metadata search answered).
    """
    weights = WEIGHTS if weights is None else weights
    w = Window.partitionBy("query_id").orderBy("rank")
    steps = ranked.withColumn("fall", F.col("score") - F.lead("score").over(w))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= used, F.struct("rank", "content")))), lambda x: x["content"]), " ")
    f = steps.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("rank") <= used, F.col("score"))), F.lit(0.0)).alias("mean"), F.avg(F.when(F.col("rank") <= 5, F.col("score"))).alias("top_mean"),
        F.coalesce(F.max(F.when(F.col("rank") < 5, F.col("fall"))), F.lit(0.0)).alias("fall"), F.countDistinct("section").alias("sections"), texts.alias("context"),
    )
    rows = f.join(about, "query_id")
    diverse = F.least(F.lit(1.0), F.col("sections") / 4 + F.when(F.col("diversified"), 0.2).otherwise(0.0))
    weak = (F.col("kinds") > 2) & (F.col("top_mean") < 0.5)
    rows = rows.select(
        "query_id", "retry", F.least(F.lit(1.0), F.col("mean")).alias("reranker_scores"), distribution(F.col("fall"), F.col("n")).alias("score_distribution"),
        F.when((F.col("n") <= 1) | (F.col("sections") == 0), 0.5).otherwise(diverse).alias("chunk_diversity"), F.least(F.lit(1.0), F.least(F.lit(used), F.col("n")) / F.least(F.col("n"), F.lit(10))).alias("context_completeness"),
        context_coverage(F.col("query"), F.col("keywords"), F.col("context")).alias("keyword_coverage"), metadata_match(F.col("n_filters")).alias("metadata_match"),
        (F.least(F.lit(1.0), F.col("kinds") / 3.0) * F.when(weak, 0.7).otherwise(1.0)).alias("retrieval_depth"),
    )
    score = sum((F.col(k) * v for k, v in weights.items()), F.lit(0.0)) * F.greatest(F.lit(0.5), 1 - 0.15 * F.col("retry"))
    return rows.withColumn("confidence", F.round(score, 4)).withColumn("level", level(F.col("confidence")))


#: Retries, how much wider each is, and what is said.
MAX_RETRIES, WIDER, LOWER_SCORE = 2, 10, 0.1
SAYS = {
    "expand": "Consider expanding query terms for better coverage", "moderate": "Top chunks have moderate relevance — verify with user if unsure", "low": "Retrieval quality is low — context may be insufficient",
    "uncovered": "Topic may not be covered in uploaded materials", "gap": "Consider acknowledging the gap to the user", "rephrase": "Consider asking the user to rephrase or clarify their question",
}


def advice(lvl: Column, retry: Column, covered: Column, reranked: Column, max_retries: int = MAX_RETRIES) -> Column:
    """struct(action, recommendations, should_retry, retry_config) of a confidence level."""
    say = lambda cond, *keys: [F.when(cond, SAYS[k]) for k in keys]
    medium, low, more = lvl == "medium", lvl == "low", retry < max_retries
    again = F.when(low & more, F.concat(F.lit("Retrying with expanded parameters (attempt "), (retry + 1).cast("string"), F.lit(")")))
    lost = low & ~more
    lines = [*say(medium & (covered < 0.5), "expand"), *say(medium & (reranked < 0.6), "moderate"), *say(low, "low"), again, *say(lost & (covered < 0.2), "uncovered", "gap"), *say(lost & (covered >= 0.2), "rephrase")]
    config = F.when(low & more, F.struct(F.lit(WIDER).alias("increase_candidate_k"), (F.lit(LOWER_SCORE) * (retry + 1)).alias("decrease_min_score"), F.lit(True).alias("enable_aggressive_expansion"), (retry + 1).alias("retry_count")))
    action = F.when(lvl == "high", "proceed").when(medium, "proceed_with_caution").otherwise("retry_or_clarify")
    return F.struct(action.alias("action"), F.array_compact(F.array(*lines)).alias("recommendations"), (low & more).alias("should_retry"), config.alias("retry_config"))


def quick_level(ranked: DataFrame) -> DataFrame:
    """query_id, level by the best score alone."""
    return ranked.groupBy("query_id").agg(F.max_by("score", -F.col("rank")).alias("top")).select("query_id", level(F.col("top")).alias("level"))


def learned(samples: DataFrame, by: str, order: list[str], features: list[str], every: int = 50, least: int = 100, share: float = 0.3) -> DataFrame:
    """by, updates and the learned weight of each feature: equal ones at first, moved at every `every`-th sample from `least` on.

    An update adds `share` of the inverse variances (summing to 1) of all samples so far. As each keeps the sum at 1,
    the last weights are a sum over the updates: no sample is visited twice.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    seen = rows.select(by, "i", *((1 / (F.var_pop(f).over(w) + 1e-6)).alias(f) for f in features)).where((F.col("i") % every == 0) & (F.col("i") >= least))
    total = sum((F.col(f) for f in features[1:]), F.col(features[0]))
    ordered = seen.select(by, *((F.col(f) / total).alias(f) for f in features), F.row_number().over(Window.partitionBy(by).orderBy(F.col("i").desc())).alias("back"))
    per = ordered.groupBy(by).agg(F.count(F.lit(1)).alias("updates"), *(F.sum(F.col(f) * share * F.pow(F.lit(1 - share), F.col("back") - 1)).alias(f) for f in features))
    start = F.pow(F.lit(1 - share), F.col("updates")) / len(features)
    return per.select(by, "updates", *((start + F.col(f)).alias(f) for f in features))
