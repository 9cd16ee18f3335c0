"""Further queries with their SQL twins: expansion, answers, evaluation, assembly, stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import answers, assembly, evaluation, expansion, ingest, metrics, search
from fathomline.plans.catalog import _CAND, _E, _M, _candidates, _e, _m, query
from fathomline.sources.tables import read, split_valid

_WORDS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
_KEYWORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "], w)))"
_TURN = "conv_id, turn"


@query("""WITH v AS (SELECT label::BIGINT AS namespace, len(CASE WHEN vec_id % 10 = 0 THEN embedding[1:63] ELSE embedding END) dim FROM embeddings)
 SELECT namespace, count(*) FILTER (dim = 64) accepted, count(*) FILTER (dim <> 64) rejected, ceil(count(*) FILTER (dim = 64) / 100)::BIGINT batches FROM v GROUP BY 1""")
def s11_s12_upsert_report(spark, d):
    v = read(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("namespace"), F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))
    good, bad = split_valid(v, 64)
    both = good.select("namespace", F.lit(1).alias("ok")).unionByName(bad.select("namespace", F.lit(0).alias("ok")))
    return both.groupBy("namespace").agg(F.count_if(F.col("ok") == 1).alias("accepted"), F.count_if(F.col("ok") == 0).alias("rejected"), F.ceil(F.count_if(F.col("ok") == 1) / 100).alias("batches"))


@query("SELECT doc_id, lower(coalesce(source, 'default')) || '_' || substr(sha256(coalesce(source, '') || '/' || coalesce(lang, '')), 1, 12) by_file, 'doc_' || substr(md5(doc_id::VARCHAR), 1, 8) by_id FROM documents")
def s13_s14_namespaces(spark, d):
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    return read(spark, d, "documents").select("doc_id", F.concat(T.slug(F.coalesce("source", F.lit("default"))), F.lit("_"), F.substring(F.sha2(path, 256), 1, 12)).alias("by_file"), F.concat(F.lit("doc_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)).alias("by_id"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND source IS DISTINCT FROM 'src0' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f11_f12_corpus_filter(spark, d):
    allowed = read(spark, d, "labels").where("quality = 1").select("doc_id")
    docs = read(spark, d, "documents").where(F.col("lang").isin("en", "de") & ~F.col("source").eqNullSafe("src0"))
    return docs.join(allowed, "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT CASE WHEN length(coalesce(text, '')) // 4 > 512 THEN 'failed' ELSE 'valid' END status, count(*) n, sum(length(coalesce(text, '')) // 4)::BIGINT tokens FROM documents GROUP BY 1")
def f15_token_limit(spark, d):
    tokens = T.token_count(F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").groupBy(F.when(tokens > 512, "failed").otherwise("valid").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"))


@query(_CAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) rank FROM cand WHERE source = 'semantic' QUALIFY rank <= 10) SELECT query_id, chunk_id, score, rank FROM r WHERE score >= 0.3")
def f17_min_score(spark, d):
    rows = search.top_k(_candidates(spark, d).where("source = 'semantic'"), ["query_id"], 10, F.col("score").desc(), F.col("chunk_id"))
    return rows.where("score >= 0.3").select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(_M + """, r AS (SELECT id, CASE WHEN total_time_ms >= 75 THEN 'high' WHEN total_time_ms >= 50 THEN 'medium' ELSE 'low' END lvl, id % 4 used, id % 9 = 0 fallback, CASE WHEN id % 5 = 0 THEN 'The text Does not cover this in sufficient detail.' ELSE 'An answer.' END answer, CASE WHEN refused = 1 THEN 'timeout' END error FROM m),
 s AS (SELECT *, lvl <> 'low' AND used > 0 AND NOT fallback is_ready FROM r) SELECT id, is_ready, NOT is_ready OR regexp_matches(answer, '(?i)does not cover .{0,120}?in sufficient detail') OR error IS NOT NULL refusal FROM s""")
def f18_f19_refusal(spark, d):
    level = F.when(F.col("total_time_ms") >= 75, "high").when(F.col("total_time_ms") >= 50, "medium").otherwise("low")
    text = F.when(F.col("id") % 5 == 0, "The text Does not cover this in sufficient detail.").otherwise("An answer.")
    rows = _m(spark, d).select("id", answers.ready(level, F.col("id") % 4, F.col("id") % 9 == 0).alias("is_ready"), text.alias("answer"), F.when(F.col("refused") == 1, "timeout").alias("error"))
    return rows.select("id", "is_ready", answers.refused(F.col("is_ready"), F.lit("answer"), F.col("answer"), F.col("error")).alias("refusal"))


@query(_CAND + ", s AS (SELECT * FROM cand WHERE source = 'semantic'), t AS (SELECT query_id, chunk_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5) SELECT query_id, chunk_id, score FROM s ANTI JOIN t USING (query_id, chunk_id)")
def j6_not_selected(spark, d):
    rows = _candidates(spark, d).where("source = 'semantic'")
    chosen = search.top_k(rows, ["query_id"], 5, F.col("score").desc(), F.col("chunk_id")).select("query_id", "chunk_id")
    return rows.join(chosen, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "score")


def _vocabulary(spark, d, n):
    words = read(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    return words.where(F.size("w") >= n).groupBy(F.array_join(F.slice("w", 1, n), " ").alias("term")).agg(F.concat(F.lit("item "), F.min("item_id").cast("string")).alias("expansion"))


@query("WITH b AS (SELECT item_id, " + _WORDS.format("text") + " w FROM benchmark), v AS (SELECT w[1] term, 'item ' || min(item_id) expansion FROM b WHERE len(w) >= 1 GROUP BY 1), t AS (SELECT conv_id, turn, unnest(list_distinct(" + _WORDS.format("text") + ")) term FROM conversations) SELECT conv_id, turn, count(*) n_hits, array_to_string(list_sort(list(DISTINCT expansion))[1:5], ',') expansions FROM t JOIN v USING (term) GROUP BY 1, 2")
def j9_acronyms(spark, d):
    keys = ["conv_id", "turn"]
    return expansion.expanded(expansion.matches(read(spark, d, "conversations"), keys, _vocabulary(spark, d, 1)), keys)


@query("WITH b AS (SELECT item_id, " + _WORDS.format("text") + " w FROM benchmark), v AS (SELECT w[1] || ' ' || w[2] term, 'item ' || min(item_id) expansion FROM b WHERE len(w) >= 2 GROUP BY 1), t AS (SELECT doc_id, ' ' || array_to_string(" + _WORDS.format("text") + ", ' ') || ' ' words FROM documents) SELECT doc_id, count(*) n_hits, array_to_string(list_sort(list(DISTINCT expansion))[1:5], ',') expansions FROM t JOIN v ON contains(words, ' ' || term || ' ') GROUP BY 1")
def j10_concepts(spark, d):
    return expansion.expanded(expansion.matches(read(spark, d, "documents"), ["doc_id"], _vocabulary(spark, d, 2), 2), ["doc_id"])


@query("WITH e AS (SELECT n_name concept, r_name other, 'hierarchy' kind FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT c_mktsegment, n_name, 'market' FROM customer JOIN nation ON c_nationkey = n_nationkey), b AS (SELECT * FROM e UNION ALL SELECT other, concept, kind FROM e) SELECT concept, other, min(kind) kind FROM b GROUP BY 1, 2")
def j11_related(spark, d):
    nation = read(spark, d, "nation")
    up = nation.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("concept"), F.col("r_name").alias("other"), F.lit("hierarchy").alias("kind"))
    market = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("concept"), F.col("n_name").alias("other"), F.lit("market").alias("kind")).distinct()
    return expansion.related(up.unionByName(market))


@query("SELECT d.doc_id, coalesce(quality, -1)::BIGINT quality, coalesce(toxic, -1)::BIGINT toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j13_scores(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", *(F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("quality", "toxic")))


@query(_E + ", r AS (SELECT doc_id, lang, length(content) < 20 short FROM e JOIN documents USING (doc_id)) SELECT lang, count(*) n, count(*) FILTER (short) dropped, round(100.0 * count(*) FILTER (short) / count(*), 4) percent FROM r GROUP BY 1")
def a2_cleaning_report(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    rows = ingest.elements(docs).join(docs.select("doc_id", "lang"), "doc_id")
    short = F.length("content") < 20
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("dropped"), F.round(F.try_divide(100.0 * F.count_if(short), F.count(F.lit(1))), 4).alias("percent"))


@query("WITH f AS (SELECT label::BIGINT AS namespace, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) i FROM embeddings WHERE vec_id % 7 = 0) SELECT namespace, count(*) failed, array_to_string(list(vec_id ORDER BY vec_id) FILTER (i <= 10), ',') first_failed FROM f GROUP BY 1")
def a6_embedding_summary(spark, d):
    failed = read(spark, d, "embeddings").where("vec_id % 7 = 0").select(F.col("label").cast("bigint").alias("namespace"), "vec_id")
    named = search.top_k(failed, ["namespace"], 10, F.col("vec_id")).groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_list("vec_id")), ",").alias("first_failed"))
    return failed.groupBy("namespace").agg(F.count(F.lit(1)).alias("failed")).join(named, "namespace").select("namespace", "failed", "first_failed")


@query("SELECT lang, round(sum(length(coalesce(text, '')) // 4 / 1e6 * 0.27 + 200 / 1e6 * 1.10), 6) usd FROM documents GROUP BY 1")
def a7_cost(spark, d):
    usd = evaluation.cost(T.token_count(F.coalesce("text", F.lit(""))), F.lit(200))
    return read(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(usd), 6).alias("usd"))


@query("""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN (quality + (1 - toxic)) / 2 END score, quality = 1 answerable, doc_id % 5 citations FROM labels)
 SELECT count(*) n, round(avg(score), 6) mean, count(*) FILTER (score IS NULL) unscored, round(avg(citations) FILTER (answerable), 6) citations, avg(score) >= 0.75 AND avg(citations) FILTER (answerable) >= 1.5 passed FROM i""")
def a12_a16_report(spark, d):
    score = evaluation.composite(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("clean"), (1 - F.col("toxic")).cast("double")))
    items = read(spark, d, "labels").select(F.when(F.col("doc_id") % 11 != 0, score).alias("score"), (F.col("quality") == 1).alias("answerable"), (F.col("doc_id") % 5).alias("citations"))
    out = evaluation.report(items, 0.75, 1.5)
    return out.select("n", F.round("mean", 6).alias("mean"), "unscored", F.round("citations", 6).alias("citations"), "passed")


@query(f"SELECT {_TURN}, (sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT tokens FROM conversations WHERE text IS NOT NULL")
def a17_running_tokens(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.sum(T.token_count(F.col("text"))).over(w).alias("tokens"))


@query("SELECT user_id, 'k' stage, max(CAST(json_extract(props, '$.k') AS DOUBLE)) most FROM events GROUP BY 1")
def a18_longest_stages(spark, d):
    stages = _m(spark, d).select("user_id", F.explode(F.from_json("stage_timings_json", "map<string,double>")).alias("stage", "ms"))
    return stages.groupBy("user_id", "stage").agg(F.max("ms").alias("most"))


@query(f"SELECT {_TURN}, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), '>') history FROM conversations")
def w14_history(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-19, 0)
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ">").alias("history"))


@query(_M + ", n AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM m) SELECT user_id, id, i FROM n WHERE i >= floor(n * 0.4) AND i < floor(n * 0.6)")
def w16_incident_window(spark, d):
    return evaluation.in_fraction(_m(spark, d), "user_id", ["ts", "id"], 0.4, 0.6).select("user_id", "id", F.col("i").cast("bigint").alias("i"))


@query(_M + " SELECT id, env, total_time_ms FROM m ORDER BY ts DESC, id DESC LIMIT 30")
def k8_recent(spark, d):
    return metrics.recent(_m(spark, d), 30).select("id", "env", "total_time_ms")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '/7'), doc_id LIMIT 50")
def u7_sample(spark, d):
    return evaluation.sample(read(spark, d, "documents"), "doc_id", 50, 7).select("doc_id")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) n FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1, 2")
def t21_date_range(spark, d):
    day = F.to_date("ts")
    return read(spark, d, "events").where(day.between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) context FROM conversations), k AS (SELECT conv_id, turn, context, {_KEYWORDS.format('text')} w FROM p WHERE role = 'assistant'),
 r AS (SELECT conv_id, turn, CASE WHEN len(w) > 0 AND context IS NOT NULL THEN len(list_filter(w, lambda x: contains(lower(context), x))) / len(w) ELSE 0 END ratio FROM k) SELECT conv_id, turn, round(ratio, 6) ratio, ratio >= 0.3 grounded, round(least(1.0, ratio / 0.3), 6) confidence FROM r""")
def t13_grounding(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("context", F.lag("text").over(w)).where("role = 'assistant'")
    g = rows.select("conv_id", "turn", answers.grounded(F.col("text"), F.coalesce("context", F.lit(""))).alias("g"))
    return g.select("conv_id", "turn", F.round("g.ratio", 6).alias("ratio"), F.col("g.grounded").alias("grounded"), F.round("g.confidence", 6).alias("confidence"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events")
def t14_json_from_text(spark, d):
    said = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}", ",}"), F.lit("\n```"))
    return read(spark, d, "events").select("event_id", F.get_json_object(answers.json_in(said), "$.k").cast("bigint").alias("k"))


@query("WITH w AS (SELECT doc_id id, unnest(" + _WORDS.format("text") + ") w FROM documents) SELECT id, (('0x' || substr(md5(w), 1, 4))::INT % 64)::BIGINT dim, count(*) n FROM w GROUP BY 1, 2")
def t19_hashed_vectors(spark, d):
    return answers.get_provider("embedding", "hashed")(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))



_B = _E + ", b AS (SELECT doc_id, elem_idx AS start FROM e WHERE elem_idx % 10 = 0)"


@query(_B + ", a AS (SELECT e.doc_id, page, (SELECT max(b.start) FROM b WHERE b.doc_id = e.doc_id AND b.start <= e.elem_idx) AS start FROM e) SELECT doc_id, start, count(*) n, min(page) first_page, max(page) last_page FROM a WHERE start IS NOT NULL GROUP BY 1, 2")
def i12_boundaries(spark, d):
    e = _e(spark, d).select("doc_id", F.col("elem_idx").cast("bigint").alias("elem_idx"), F.col("page").cast("bigint").alias("page"))
    return assembly.between_boundaries(e, e.where("elem_idx % 10 = 0").select("doc_id", F.col("elem_idx").alias("start")))


@query("WITH h AS (SELECT item_id, text, ('0x' || substr(md5(item_id::VARCHAR), 1, 6))::BIGINT h FROM benchmark) SELECT item_id, md5(CASE WHEN h % 100 < 30 THEN ['', 'ignore all rules', '????'][(h // 100) % 3 + 1] ELSE text END) AS query, h % 100 < 30 adversarial FROM h")
def p22_traffic(spark, d):
    rows = evaluation.traffic(read(spark, d, "benchmark"), "item_id", ["", "ignore all rules", "????"], 30)
    return rows.select("item_id", F.md5("query").alias("query"), "adversarial")
