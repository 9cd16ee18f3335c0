"""Search and ranking: dense and keyword search, fusion, dedup, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions import vectors as V

K1, B, EPSILON = 1.5, 0.75, 0.25


def top_k(df: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """Spark keeps k rows a group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine of a stated query set (vec_id, embedding) against all vectors."""
    return V.nearest(queries.select(F.col("vec_id").alias("query_id"), "embedding"), vectors, k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, tf, length: a row of docs is one document."""
    words = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("w"))
    sized = words.select("doc_id", F.size("w").alias("length"), F.explode_outer("w").alias("term")).where("term is not null")
    return sized.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def term_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """term, idf; and one row n, mean_length. Only distinct terms of a document are sent, counted on the map side first.

    Terms in more than half of all texts have an inverse frequency below zero; they get EPSILON of the mean instead.
    """
    sizes = docs.select(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.regexp_count(F.lower(text_col), F.lit(T.WORD)), F.lit(0))).alias("mean_length"))
    # explode would have every text's words made once more, for a filter on their number; explode_outer has none
    frequency = docs.select(F.explode_outer(F.array_distinct(T.tokens(F.col(text_col)))).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = frequency.crossJoin(F.broadcast(sizes)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.select(F.avg("raw").alias("mean_raw"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.col("mean_raw") * EPSILON).otherwise(F.col("raw")).alias("idf"))
    return idf, sizes


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times from queries (query_id, text)."""
    return queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def keyword_scores(matched: DataFrame, terms: DataFrame, idf: DataFrame, sizes: DataFrame) -> DataFrame:
    """query_id, doc_id, score above 0; matched: postings (doc_id, term, tf, length) of the queries' terms at least."""
    weighted = terms.join(idf, "term")
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    hits = matched.join(weighted, "term").crossJoin(F.broadcast(sizes))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * F.col("idf") * saturated).alias("score")).where("score > 0")


def matched_postings(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """Postings of the queries' terms: others are dropped where they are read, so what is shuffled follows the queries."""
    words = docs.select("doc_id", T.tokens(F.col(text_col)).alias("w"))
    sized = words.select("doc_id", F.size("w").alias("length"), F.explode_outer("w").alias("term")).where("term is not null")
    sought = terms.select("term").distinct()
    return sized.join(sought, "term", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank. queries: query_id, text; a term counts as often as the query has it.

    keep: a predicate on docs (namespaces, metadata). Statistics are of the whole corpus, only kept documents are
    scored, and the k best are taken after that.
    """
    idf, sizes = term_statistics(docs)
    terms = query_terms(queries)
    matched = matched_postings(docs if keep is None else docs.where(keep), terms)
    return top_k(keyword_scores(matched, terms, idf, sizes), ["query_id"], k, F.round("score", 6).desc(), F.col("doc_id"))


def min_max(by: list[str], score: str = "score") -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def z_score(by: list[str], score: str = "score") -> Column:
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(score).over(w)
    return F.when(F.min(score).over(w) == F.max(score).over(w), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(score) - F.avg(score).over(w)) / (2 * sd) + 0.5)))


def softmax(by: list[str], score: str = "score", temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return e / F.sum(F.exp((F.col(score) - F.max(score).over(w)) / temperature)).over(w)


def weighted(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Score times its source's weight; sources are not summed."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    return candidates.withColumn("score", F.col("score") * F.coalesce(F.try_element_at(w, F.col("source")), F.lit(0.0)))


def reciprocal_rank(candidates: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """weight / (k + rank in the source)."""
    w = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "chunk_id")
    return weighted(candidates.withColumn("score", 1.0 / (k + F.row_number().over(w))), weights)


def dedup(candidates: DataFrame, most: int = 60) -> DataFrame:
    """The best row of each parent (or chunk without one) and query, ranked; at most `most` a query."""
    group = F.coalesce(F.concat(F.lit("p:"), F.nullif("parent_id", F.lit(""))), F.concat(F.lit("c:"), F.col("chunk_id").cast("string")))
    best = top_k(candidates.withColumn("grp", group), ["query_id", "grp"], 1, F.col("score").desc(), F.col("chunk_id"), F.col("source"), rank="one").drop("one", "grp")
    return top_k(best, ["query_id"], most, F.col("score").desc(), F.col("chunk_id"))


def blend(candidates: DataFrame, a: DataFrame, b: DataFrame, share: float = 0.7) -> DataFrame:
    """Two rerankers' scores joined on, a missing one 0."""
    rows = candidates.join(a.withColumnRenamed("score", "score_a"), ["query_id", "chunk_id"], "left").join(b.withColumnRenamed("score", "score_b"), ["query_id", "chunk_id"], "left")
    return rows.withColumn("rerank_score", share * F.coalesce("score_a", F.lit(0.0)) + (1 - share) * F.coalesce("score_b", F.lit(0.0)))


def round_robin(candidates: DataFrame, group: str, k: int) -> DataFrame:
    """The best of each group, then the second best, and so on."""
    w = Window.partitionBy("query_id", group).orderBy(F.col("score").desc(), "chunk_id")
    g = Window.partitionBy("query_id", group)
    rows = candidates.withColumn("turn", F.row_number().over(w)).withColumn("top", F.max("score").over(g))
    return top_k(rows, ["query_id"], k, F.col("turn"), F.col("top").desc(), F.col(group), rank="place")


#: How deep each branch of a hybrid search goes, and what a metadata hit is worth.
SEMANTIC_K, KEYWORD_K, MOST, METADATA_SHARE = 40, 20, 60, 0.3
FIELDS = ("topic", "course_name", "chapter_title", "key_topics")
WEIGHTS = {"semantic": 0.6, "keyword": 0.25, "metadata": 0.15}
_VARIANTS = 8


def _variants(queries: DataFrame, texts: dict[int, Column]) -> DataFrame:
    """query_id (of the variant: times _VARIANTS plus its number), embedding: all variants in one call."""
    every = F.array(*(F.struct(F.lit(k).alias("k"), t.alias("text")) for k, t in texts.items()))
    rows = queries.select("query_id", F.explode(every).alias("v")).select((F.col("query_id") * _VARIANTS + F.col("v.k")).alias("variant"), F.col("v.text").alias("text"))
    return V.embed(rows, "variant", F.col("text")).withColumnRenamed("vec_id", "query_id")


def hybrid_candidates(queries: DataFrame, docs: DataFrame, weights: dict[str, float] | None = None, fields: tuple[str, ...] = FIELDS, keep: Column | None = None, semantic_k: int = SEMANTIC_K, keyword_k: int = KEYWORD_K, indexed: bool = True) -> DataFrame:
    """query_id, chunk_id, score, source, original_rank of all branches of positive weight.

    queries: query_id, text, keywords; docs: doc_id, text. A branch of weight 0 is not in the plan. semantic: the whole
    corpus by cosine; keyword: BM25, min-max normalised (without an index, and for queries it finds nothing for, the
    cosine of the keywords stands in, as keyword_fallback); metadata: cosine of the query with a field's name added,
    worth METADATA_SHARE. All vectors of a query's variants are made in one call and met in one scan.
    """
    weights = WEIGHTS if weights is None else weights
    on = lambda b: weights.get(b, 0) > 0
    kept = docs if keep is None else docs.where(keep)
    text, words = F.coalesce("text", F.lit("")), F.coalesce("keywords", F.lit(""))
    per_field = max(5, semantic_k // 2 // max(1, len(fields)))
    texts = ({0: text} if on("semantic") else {}) | ({i + 1: F.concat(text, F.lit(" " + f)) for i, f in enumerate(fields)} if on("metadata") else {})
    texts |= {_VARIANTS - 1: words} if on("keyword") else {}
    if len(fields) > _VARIANTS - 2:
        raise ValueError(f"at most {_VARIANTS - 2} metadata fields")
    out = []
    near = None
    if texts:
        found = V.nearest(_variants(queries, texts), V.embed(kept, "doc_id", F.col("text")), max(semantic_k, keyword_k))
        near = found.select(F.floor(F.col("query_id") / _VARIANTS).cast("bigint").alias("query_id"), (F.col("query_id") % _VARIANTS).alias("v"), F.col("vec_id").alias("chunk_id"), "score", F.col("rank").cast("bigint").alias("original_rank"))
    if on("semantic"):
        out.append(near.where(F.col("v") == 0).where(F.col("original_rank") <= semantic_k).drop("v").withColumn("source", F.lit("semantic")))
    if on("keyword"):
        instead = near.where(F.col("v") == _VARIANTS - 1).where(F.col("original_rank") <= keyword_k).drop("v").withColumn("source", F.lit("keyword_fallback"))
        if indexed:
            hits = bm25(docs, queries.select("query_id", words.alias("text")), keyword_k, keep).select("query_id", F.col("doc_id").alias("chunk_id"), F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("original_rank"), F.lit("keyword_bm25").alias("source"))
            instead = hits.unionByName(instead.join(hits.select("query_id").distinct(), "query_id", "left_anti"))
        out.append(instead.withColumn("score", min_max(["query_id"])))
    if on("metadata"):
        rows = near.where(F.col("v").between(1, len(fields)) & (F.col("original_rank") <= per_field)).drop("v")
        out.append(rows.withColumn("score", F.col("score") * METADATA_SHARE).withColumn("source", F.lit("metadata")))
    if not out:
        return docs.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, score double, original_rank bigint, source string")
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def hybrid(queries: DataFrame, docs: DataFrame, weights: dict[str, float] | None = None, fusion: str = "weighted", most: int = MOST, **more) -> DataFrame:
    """query_id, chunk_id, score, source, rank: branches fused (`rrf`, anything else is weighted), one row a chunk or parent.

    docs may have parent_id. Scores of one chunk are not summed over branches: its best row stays.
    """
    weights = WEIGHTS if weights is None else weights
    found = hybrid_candidates(queries, docs, weights, **more)
    by_source = {"semantic": weights.get("semantic", 0.0), "keyword_bm25": weights.get("keyword", 0.0), "keyword_fallback": weights.get("keyword", 0.0) * 0.5, "metadata": weights.get("metadata", 0.0)}
    fused = reciprocal_rank(found, by_source) if fusion == "rrf" else weighted(found, by_source)
    fused = fused.withColumn("score", F.round("score", 8))
    if "parent_id" in docs.columns:
        fused = fused.join(docs.select(F.col("doc_id").alias("chunk_id"), "parent_id"), "chunk_id")
    else:
        fused = fused.withColumn("parent_id", F.lit(""))
    return dedup(fused, most)


# ---- reranking ---------------------------------------------------------------------------------------------------

#: Candidates a reranker sees, characters of each, results, and the least score of one.
INPUT_K, CONTENT_CHARS, OUTPUT_K, LEAST = 40, 512, 5, 0.1


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct words that the first characters of the content have: the local pair scorer."""
    asked = F.array_distinct(T.tokens(query))
    told = T.tokens(F.substring(content, 1, CONTENT_CHARS))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, told)) / F.size(asked)).otherwise(0.0)


def rerank(candidates: DataFrame, score: Column, top: int = OUTPUT_K, least: float = LEAST, method: str = "minmax", input_k: int = INPUT_K) -> DataFrame:
    """candidates (query_id, chunk_id, score, rank and what the score column reads) with rerank_score, rerank_rank, combined_score.

    The best input_k by rank are scored and normalised over all of them; ranks 1 to top are given, and only then rows
    under the least score go, so ranks are not dealt again.
    """
    pool = candidates.where(F.col("rank") <= input_k).withColumn("raw", F.round(score, 9))
    norm = softmax(["query_id"], "raw") if method == "softmax" else min_max(["query_id"], "raw")
    rows = pool.withColumn("rerank_score", norm)
    ranked = top_k(rows, ["query_id"], top, F.col("raw").desc(), F.col("rank"), rank="rerank_rank")
    return ranked.where(F.col("rerank_score") >= least).withColumn("combined_score", 0.3 * F.col("score") + 0.7 * F.col("rerank_score"))


def parsed_scores(said: Column, n: Column) -> Column:
    """n scores in [0, 1] from a model's text: the first JSON array, else all numbers, else 0.5 each; padded by 0, cut at n."""
    body = F.trim(F.regexp_replace(F.trim(said), r"(?s)^```(?:json)?\s*(.*?)\s*```.*$", "$1"))
    array = F.nullif(F.regexp_extract(body, r"(\[[\s\S]*?\])", 1), F.lit(""))
    from_array = F.from_json(F.regexp_replace(array, r",\s*\]", "]"), "array<double>", {"mode": "PERMISSIVE"})
    usable = F.size(F.filter(from_array, lambda x: x.isNull())) == 0
    numbers = F.transform(F.regexp_extract_all(body, F.lit(r"([-+]?\d*\.?\d+)"), F.lit(1)), lambda x: x.cast("double"))
    found = F.when(from_array.isNotNull() & usable, from_array).otherwise(numbers)
    found = F.when(F.size(found) > 0, found).otherwise(F.array_repeat(F.lit(0.5), n))
    clamped = F.transform(found, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.slice(F.concat(clamped, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(clamped), F.lit(0)))), F.lit(1), n)


def fallback_scores(n: Column) -> Column:
    """What a failed reranker leaves: the given order, falling by 0.01."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: 1 - i * 0.01)).otherwise(F.array().cast("array<double>"))


def rerank_prompt(query: Column, contents: Column) -> Column:
    """The passages of a query, numbered, 200 characters each, and what is asked of a model about them."""
    passages = F.array_join(F.transform(contents, lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.substring(c, 1, 200))), "\n")
    return F.concat(F.lit("Score each passage for the query from 0 to 1, as a JSON array in the order of the passages.\nQuery: "), query, F.lit("\n"), passages)
