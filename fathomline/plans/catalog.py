"""Every query of the engine with its SQL twin (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import context, ingest, metrics, predicates, search
from fathomline.sources.tables import read, spread, upsert

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stated queries against all vectors, as candidates of two sources."""
    v = read(spark, d, "embeddings")
    near = search.dense(v.where("vec_id % 50 = 0"), v, 20)
    rows = near.join(v.select("vec_id", "label"), "vec_id")
    base = rows.select("query_id", F.col("vec_id").alias("chunk_id"), F.round("score", 5).alias("score"), F.col("label").cast("bigint").alias("section"))
    both = base.withColumn("source", F.lit("semantic")).unionByName(base.where("chunk_id % 3 <> 0").withColumn("score", F.round(1 - F.col("score") * 0.5, 6)).withColumn("source", F.lit("keyword")))
    return both.withColumn("parent_id", F.when(F.col("chunk_id") % 4 == 0, F.concat(F.lit("g"), F.col("section").cast("string"))).otherwise(""))


_NEAR = """near AS (SELECT q.vec_id query_id, v.vec_id, v.label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-6), 9) score
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM near QUALIFY rank <= 20)"""
_CAND = f"""WITH {_NEAR}, base AS (SELECT query_id, vec_id chunk_id, round(score, 5) score, label::BIGINT AS section FROM top),
 both_ AS (SELECT *, 'semantic' source FROM base UNION ALL SELECT query_id, chunk_id, round(1 - score * 0.5, 6), section, 'keyword' FROM base WHERE chunk_id % 3 <> 0),
 cand AS (SELECT *, CASE WHEN chunk_id % 4 = 0 THEN 'g' || section::VARCHAR ELSE '' END parent_id FROM both_)"""
_M = """WITH m AS (SELECT event_id id, ts, CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END env, user_id, value total_time_ms, (event_type = 'error')::BIGINT refused, (event_type IN ('view','click','purchase'))::BIGINT hit, props, event_type FROM events)"""
_E = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 elem_idx FROM documents),
 e AS (SELECT doc_id, elem_idx::BIGINT elem_idx, trim(raw, ' ') content, (elem_idx // 8 + 1)::BIGINT page FROM l WHERE trim(raw, ' ') <> '')"""


def _m(spark, d):
    return metrics.metrics_rows(read(spark, d, "events"))


def _e(spark, d):
    return ingest.elements(spread(read(spark, d, "documents")))


@query("""WITH b AS (SELECT c_custkey, c_acctbal, c_custkey % 7 version, 0 side FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, c_custkey % 5, 1 FROM customer WHERE c_custkey % 2 = 0)
 SELECT c_custkey, round(c_acctbal, 4) c_acctbal, version FROM b QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY version DESC, side DESC) = 1""")
def s10_upsert(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), (F.col("c_custkey") % 5).alias("version"))
    return upsert(c.withColumn("version", F.col("c_custkey") % 7), new, ["c_custkey"], "version").select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "version")


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s_-]', '', 'g'), '\\s+', '_', 'g'), '^[-_]+|[-_]+$', '', 'g'), ''), 'default') slug,
 substr(sha256(p_name), 1, 12) hash FROM part""")
def s15_namespace_slug(spark, d):
    return read(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), F.substring(F.sha2("p_name", 256), 1, 12).alias("hash"))


@query("SELECT lang AS namespace, count(*) n, count(DISTINCT source) sources, sum(length(text))::BIGINT chars FROM documents GROUP BY 1")
def s16_namespace_stats(spark, d):
    return read(spark, d, "documents").groupBy(F.col("lang").alias("namespace")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query(_M + " SELECT id, env, total_time_ms, refused FROM m WHERE env = 'prod' ORDER BY ts DESC, id DESC LIMIT 100")
def s18_recent_requests(spark, d):
    return metrics.recent(_m(spark, d), 100, "prod").select("id", "env", "total_time_ms", "refused")


_ORDERS = {"status": predicates.Field("string", "o_orderstatus"), "price": predicates.Field("number", "o_totalprice"), "priority": predicates.Field("string", "o_orderpriority"), "customer": predicates.Field("integer", "o_custkey")}


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O','F') AND (o_totalprice >= 100000 OR o_custkey < 50) AND NOT (o_orderpriority IN ('5-LOW'))")
def f2_predicates(spark, d):
    built = predicates.build(_ORDERS, {"status": ["O", "F"], "$or": [{"price": {"$gte": 100000}}, {"customer": {"$lt": 50}}], "priority": {"$nin": ["5-LOW"]}, "unknown": 1})
    return read(spark, d, "orders").where(built.predicate).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 50000")
def f8_template_predicate(spark, d):
    built = predicates.from_template(_ORDERS, {"status": "$eq", "price": "$lt", "priority": "$in"}, {"status": "F", "price": 50000})
    return read(spark, d, "orders").where(built.predicate).select("o_orderkey")


@query(_E + " SELECT doc_id, count(*) n, sum((length(content) < 2)::BIGINT)::BIGINT dropped FROM e GROUP BY 1")
def f1_min_length(spark, d):
    return _e(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.length("content") < 2).cast("bigint")).alias("dropped"))


@query(f"WITH {_NEAR} SELECT query_id, vec_id, round(score, 5) score, rank FROM top WHERE rank <= 10")
def j1_vector_topk(spark, d):
    v = read(spark, d, "embeddings")
    return search.dense(v.where("vec_id % 50 = 0"), v, 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_BM = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') w FROM documents),
 p AS (SELECT doc_id, term, count(*) tf, any_value(len) len FROM (SELECT doc_id, unnest(w) term, len(w) len FROM t) GROUP BY 1, 2),
 s AS (SELECT count(*) n, avg(coalesce(len(w), 0)) ml FROM t), f AS (SELECT term, count(*) df FROM p GROUP BY 1),
 r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) raw FROM f, s), i AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM r) * 0.25 ELSE raw END idf FROM r),
 q AS (SELECT item_id query_id, term, count(*) times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) term FROM benchmark) GROUP BY 1, 2),
 h AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / ml))) score FROM p JOIN q USING (term) JOIN i USING (term), s GROUP BY 1, 2)"""


@query(_BM + " SELECT query_id, doc_id, round(score, 3) score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) rank FROM h WHERE score > 0 QUALIFY rank <= 10")
def r3_bm25(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(spread(read(spark, d, "documents")), q, 10).select("query_id", "doc_id", F.round("score", 3).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_CAND + """, w AS (SELECT *, round(score * CASE source WHEN 'semantic' THEN 0.7 ELSE 0.3 END, 8) ws FROM cand),
 g AS (SELECT *, CASE WHEN parent_id <> '' THEN 'p:' || parent_id ELSE 'c:' || chunk_id END grp FROM w), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, grp ORDER BY ws DESC, chunk_id, source) = 1)
 SELECT query_id, chunk_id, ws score, source, row_number() OVER (PARTITION BY query_id ORDER BY ws DESC, chunk_id) rank FROM b""")
def r9_weighted_fusion(spark, d):
    fused = search.weighted(_candidates(spark, d), {"semantic": 0.7, "keyword": 0.3}).withColumn("score", F.round("score", 8))
    return search.dedup(fused).select("query_id", "chunk_id", "score", "source", F.col("rank").cast("bigint").alias("rank"))


@query(_CAND + """ SELECT query_id, chunk_id, source, round(CASE source WHEN 'semantic' THEN 0.7 ELSE 0.3 END / (60 + row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id)), 8) score FROM cand""")
def r10_reciprocal_rank(spark, d):
    return search.reciprocal_rank(_candidates(spark, d), {"semantic": 0.7, "keyword": 0.3}).select("query_id", "chunk_id", "source", F.round("score", 8).alias("score"))


@query(_CAND + """, a AS (SELECT query_id, chunk_id, score FROM cand WHERE source = 'semantic'), b AS (SELECT query_id, chunk_id, score FROM cand WHERE source = 'keyword')
 SELECT a.query_id, a.chunk_id, round(0.7 * a.score + 0.3 * coalesce(b.score, 0), 8) rerank_score FROM a LEFT JOIN b USING (query_id, chunk_id)""")
def j5_rerank_blend(spark, d):
    c = _candidates(spark, d)
    part = lambda s: c.where(F.col("source") == s).select("query_id", "chunk_id", "score")
    return search.blend(part("semantic").select("query_id", "chunk_id"), part("semantic"), part("keyword")).select("query_id", "chunk_id", F.round("rerank_score", 8).alias("rerank_score"))


@query(_CAND + """, s AS (SELECT * FROM cand WHERE source = 'semantic'), x AS (SELECT query_id, chunk_id, score, min(score) OVER w lo, max(score) OVER w hi, avg(score) OVER w mu, stddev_pop(score) OVER w sd FROM s WINDOW w AS (PARTITION BY query_id)),
 y AS (SELECT *, exp((score - hi) / 0.5) e FROM x)
 SELECT query_id, chunk_id, round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 5) min_max, round(CASE WHEN hi = lo THEN 1 ELSE greatest(0, least(1, (score - mu) / (2 * sd) + 0.5)) END, 5) z_score, round(e / sum(e) OVER (PARTITION BY query_id), 5) softmax FROM y""")
def w5_w7_normalise(spark, d):
    rows = _candidates(spark, d).where("source = 'semantic'")
    return rows.select("query_id", "chunk_id", F.round(search.min_max(["query_id"]), 5).alias("min_max"), F.round(search.z_score(["query_id"]), 5).alias("z_score"), F.round(search.softmax(["query_id"], temperature=0.5), 5).alias("softmax"))


@query(_CAND + """, s AS (SELECT * FROM cand WHERE source = 'semantic'), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, chunk_id) turn, max(score) OVER (PARTITION BY query_id, section) top FROM s)
 SELECT query_id, chunk_id, section, turn, row_number() OVER (PARTITION BY query_id ORDER BY turn, top DESC, section) place FROM t QUALIFY place <= 5""")
def w11_round_robin(spark, d):
    rows = search.round_robin(_candidates(spark, d).where("source = 'semantic'"), "section", 5)
    return rows.select("query_id", "chunk_id", "section", F.col("turn").cast("bigint").alias("turn"), F.col("place").cast("bigint").alias("place"))


@query(_M + " SELECT env, count(*) n, round(quantile_cont(total_time_ms, 0.5), 4) p50, round(quantile_cont(total_time_ms, 0.95), 4) p95, round(avg(refused), 6) refused_rate, round(avg(hit), 6) hit_rate FROM m GROUP BY 1")
def a9_kpis(spark, d):
    k = metrics.kpis(_m(spark, d), "env")
    return k.select("env", "n", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round("refused_rate", 6).alias("refused_rate"), F.round("hit_rate", 6).alias("hit_rate"))


@query(_M + " SELECT 'k' AS stage, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) mean_ms, count(*) n FROM m")
def a10_stage_latency(spark, d):
    return metrics.stage_latency(_m(spark, d)).select("stage", F.round("mean_ms", 6).alias("mean_ms"), "n")


@query("""WITH g AS (SELECT source, avg(length(text)) v FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, source) rk FROM g)
 SELECT CASE WHEN rk <= 7 THEN source ELSE 'other' END source, round(sum(v), 4) v FROM r GROUP BY 1""")
def a11_top_and_other(spark, d):
    g = read(spark, d, "documents").groupBy("source").agg(F.avg(F.length("text")).alias("v"))
    return metrics.top_and_other(g, "source", "v").select("source", F.round("v", 4).alias("v"))


@query("""SELECT CASE WHEN grouping(l) = 0 THEN 'lang' ELSE 'source' END AS key, CASE WHEN grouping(l) = 0 THEN l ELSE s END AS value, round(avg(quality), 6) mean, count(*) n, count(quality) n_scored
 FROM (SELECT lang l, source s, quality FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((l), (s))""")
def a14_breakdown(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return metrics.breakdown(rows, "lang", "source", "quality").select("key", "value", F.round("mean", 6).alias("mean"), "n", "n_scored")


@query("""WITH v AS (SELECT 1 / (var_pop(l_quantity) + 1e-6) a, 1 / (var_pop(l_discount) + 1e-6) b, 1 / (var_pop(l_tax) + 1e-6) c FROM lineitem)
 SELECT round(0.7 / 3 + 0.3 * a / (a + b + c), 6) l_quantity, round(0.7 / 3 + 0.3 * b / (a + b + c), 6) l_discount, round(0.7 / 3 + 0.3 * c / (a + b + c), 6) l_tax FROM v""")
def a20_learned_weights(spark, d):
    f = ["l_quantity", "l_discount", "l_tax"]
    return metrics.learned_weights(read(spark, d, "lineitem"), f).select(*(F.round(x, 6).alias(x) for x in f))


@query(_M + """ SELECT id, user_id, count(*) OVER w requests, round(sum(total_time_ms) OVER w, 4) used FROM m
 WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)""")
def a19_rate_usage(spark, d):
    return metrics.usage(_m(spark, d)).select("id", "user_id", "requests", F.round("used", 4).alias("used"))


@query(_M + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) i FROM m), f AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY ts, id) island FROM n WHERE refused = 1)
 SELECT user_id, min(i) first_i, max(i) last_i, count(*) length FROM f GROUP BY user_id, island""")
def w4_incidents(spark, d):
    return metrics.incidents(_m(spark, d)).select("user_id", F.col("first_i").cast("bigint").alias("first_i"), F.col("last_i").cast("bigint").alias("last_i"), "length")


@query(_M + ", n AS (SELECT id, user_id, hit, sum(hit) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT nth FROM m) SELECT id, user_id, nth FROM n WHERE hit = 1 AND (nth - 1) % 5 = 0")
def w17_every_nth(spark, d):
    return metrics.sampled(_m(spark, d), 5).select("id", "user_id", "nth")


@query(_E + ", t AS (SELECT *, sum(length(content) // 4) OVER (PARTITION BY doc_id ORDER BY elem_idx ROWS UNBOUNDED PRECEDING)::BIGINT running FROM e) SELECT doc_id, elem_idx, running FROM t WHERE running <= 200")
def k7_token_budget(spark, d):
    rows = _e(spark, d).withColumn("tokens", T.token_count(F.col("content")))
    return context.within_budget(rows, "doc_id", [F.col("elem_idx")], "tokens", 200).select("doc_id", F.col("elem_idx").cast("bigint").alias("elem_idx"), "running")


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents), r AS (SELECT doc_id, list_filter(range(1, len(l) + 1), lambda i: i = 1 OR trim(l[i], ' ') = '' OR trim(l[i], ' ') <> trim(l[i - 1], ' ')) k, l FROM s)
 SELECT doc_id, md5(array_to_string(list_transform(k, lambda i: l[i]), chr(10))) text_md5 FROM r""")
def u5_repeated_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(context.drop_repeated_lines(F.col("text"))).alias("text_md5"))


@query("""SELECT c_mktsegment, n_name, count(*) n, round(sum(o_totalprice), 2) total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def j15_denormalise(spark, d):
    c, n, o = (read(spark, d, x) for x in ("customer", "nation", "orders"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3)).len()::BIGINT n_keywords FROM documents""".replace("length(w) >= 3", "length(w) >= 3 AND NOT list_contains([" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "], w)"))
def t3_keywords(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.keywords(F.col("text"))).cast("bigint").alias("n_keywords"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of every benchmark passage over the documents."""
    from fathomline.plans import ranking

    return ranking.r11_hybrid_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    from fathomline.plans import dialogue, further, generation, ingestion, ranking, storage  # noqa: F401, they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
