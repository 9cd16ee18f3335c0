"""Ingestion queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions import vectors as V
from fathomline.operators import ingest
from fathomline.plans.catalog import _E, _e, query
from fathomline.sources import readers
from fathomline.sources.tables import read, spread

_TYPE = """CASE WHEN regexp_matches(content, '^([-*•]|[0-9]+[.)]) ') THEN 'list_item' WHEN regexp_matches(content, '\\|.*\\||\\t') THEN 'table' WHEN regexp_matches(content, '^#+ ') THEN 'title' ELSE 'text' END"""
_P = _E + """, p AS (SELECT doc_id, page, string_agg(content, chr(10) ORDER BY elem_idx) content, list(elem_idx ORDER BY elem_idx) ids, count(*) n_elements FROM e GROUP BY 1, 2)"""
#: Greedy merging as a fold over a document's pages.
_MERGED = (
    _P
    + """, pl AS (SELECT doc_id, list(page ORDER BY page) pages, list(content ORDER BY page) contents, list(ids ORDER BY page) ids, list(length(content) // 4 ORDER BY page) t FROM p GROUP BY 1),
 s AS (SELECT *, list_transform(range(1, len(t) + 1), lambda i: {'f': i, 'n': 1::BIGINT, 't': t[i], 'done': []::STRUCT(f BIGINT, n BIGINT, t BIGINT)[]}) x FROM pl),
 r AS (SELECT *, list_reduce(x, lambda a, b: CASE WHEN a.t < 75 AND a.n < 3 THEN {'f': a.f, 'n': a.n + 1, 't': a.t + b.t, 'done': a.done} ELSE {'f': b.f, 'n': b.n, 't': b.t, 'done': list_append(a.done, {'f': a.f, 'n': a.n, 't': a.t})} END) z FROM s),
 m AS (SELECT doc_id, pages, contents, ids, CASE WHEN len(z.done) > 0 AND z.t < 75 AND z.done[-1].n + z.n <= 3
   THEN list_append(z.done[1:len(z.done) - 1], {'f': z.done[-1].f, 'n': z.done[-1].n + z.n, 't': z.done[-1].t + z.t}) ELSE list_append(z.done, {'f': z.f, 'n': z.n, 't': z.t}) END c FROM r),
 u AS (SELECT doc_id, pages, contents, ids, unnest(c) k, generate_subscripts(c, 1) - 1 i FROM m),
 c AS (SELECT doc_id, i, pages[k.f] first_page, pages[k.f + k.n - 1] last_page, k.n n_pages, k.t tokens, array_to_string(contents[k.f:k.f + k.n - 1], chr(10) || chr(10)) content, flatten(ids[k.f:k.f + k.n - 1]) element_ids FROM u)"""
)


def sentences_sql(text: str, blank: bool = False) -> str:
    parts = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return parts if blank else f"list_filter({parts}, lambda s: trim(s, ' ') <> '')"


def packed_sql(text: str, most: int) -> str:
    """Pieces of a text as a list."""
    start = "{'s': '', 'n': 0::BIGINT, 'cur': '', 'used': 0::BIGINT, 'out': []::VARCHAR[]}"
    rows = f"list_transform({sentences_sql(text)}, lambda s: {{'s': s, 'n': length(s) // 4, 'cur': '', 'used': 0::BIGINT, 'out': []::VARCHAR[]}})"
    full = f"(a.used + b.n > {most} OR b.n > {most})"
    out = f"CASE WHEN {full} AND a.cur <> '' THEN list_append(a.out, a.cur) ELSE a.out END"
    hard = f"list_transform(range(0, length(b.s), {most * 4}), lambda k: trim(b.s[k + 1:k + {most * 4}], ' '))"
    step = (
        f"{{'s': '', 'n': 0::BIGINT, 'cur': CASE WHEN b.n > {most} THEN '' WHEN {full} OR a.cur = '' THEN b.s ELSE a.cur || ' ' || b.s END,"
        f" 'used': CASE WHEN b.n > {most} THEN 0 WHEN {full} THEN b.n ELSE a.used + b.n END, 'out': CASE WHEN b.n > {most} THEN list_concat({out}, {hard}) ELSE {out} END}}"
    )
    fold = f"list_reduce(list_prepend({start}, {rows}), lambda a, b: {step})"
    return f"CASE WHEN length({text}) // 4 > {most} THEN list_transform([{fold}], lambda z: CASE WHEN z.cur <> '' THEN list_append(z.out, z.cur) ELSE z.out END)[1] ELSE [{text}] END"


def _docs(spark, d):
    return spread(read(spark, d, "documents"))


@query("""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') h FROM pages),
 r AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '>([^<>]+)<', 1), lambda x: trim(x, ' ')), lambda x: x <> '') x FROM b) SELECT page_id, len(x)::BIGINT n, md5(array_to_string(x, chr(10))) runs_md5 FROM r WHERE len(x) > 0""")
def s2_page_text_runs(spark, d):
    rows = readers.text_runs(spread(read(spark, d, "pages"))).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("i", "content"))).alias("x"))
    return rows.select("page_id", F.size("x").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("x", lambda r: r["content"]), "\n")).alias("runs_md5"))


@query(_E + f", p AS (SELECT doc_id, max(page) total_pages FROM e GROUP BY 1) SELECT e.doc_id, elem_idx, content, page, total_pages, {_TYPE} AS type FROM e JOIN p ON e.doc_id IS NOT DISTINCT FROM p.doc_id")
def s3_elements(spark, d):
    return _e(spark, d)


@query("SELECT n_name, coalesce(map {'Title': 'title', 'NarrativeText': 'text', 'ListItem': 'list_item', 'Table': 'table', 'Image': 'image_caption', 'Header': 'title', 'Footer': 'text'}[c], 'text') AS type FROM (SELECT n_name, ['Title', 'NarrativeText', 'ListItem', 'Table', 'Image', 'Header', 'Footer', 'Formula', NULL][n_nationkey % 9 + 1] c FROM nation)")
def s4_category_map(spark, d):
    names = F.array(*(F.lit(x) for x in ("Title", "NarrativeText", "ListItem", "Table", "Image", "Header", "Footer", "Formula", None)))
    return read(spark, d, "nation").select("n_name", ingest.element_type(F.get(names, (F.col("n_nationkey") % 9).cast("int"))).alias("type"))


@query(_E + f", t AS (SELECT doc_id, {_TYPE} AS type, count(*) n FROM e GROUP BY 1, 2) SELECT doc_id, sum(n)::BIGINT n, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) kinds FROM t GROUP BY 1")
def a1_element_summary(spark, d):
    return ingest.element_summary(_e(spark, d))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([a-z,])\\n([a-z])', '\\1 \\2', 'g'), '([a-z,])\\n([a-z])', '\\1 \\2', 'g')) joined_md5 FROM documents")
def i4_broken_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.join_broken_lines(F.col("text"))).alias("joined_md5"))


@query("""SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') cleaned
 FROM (SELECT event_id, '  ' || event_type || chr(7) || '   x ' || chr(9) || chr(10) || repeat(chr(10), (event_id % 4)::INT) || 'fi' || chr(13) || '1' || user_id || ' ' AS x FROM events)""")
def i1_i3_cleaning(spark, d):
    """Control characters, blanks, empty lines, and compatibility characters (a ligature, a full-width digit)."""
    text = F.concat(F.lit("  "), F.col("event_type"), F.lit("\x07   x \t\n"), F.repeat(F.lit("\n"), (F.col("event_id") % 4).cast("int")), F.lit("ﬁ\r１"), F.col("user_id").cast("string"), F.lit(" "))
    return read(spark, d, "events").select("event_id", ingest.cleaned(text).alias("cleaned"))


@query(_P + ", s AS (SELECT doc_id, string_agg(chr(10) || '[Page ' || page || ']' || chr(10) || content, chr(10) ORDER BY page) x FROM p GROUP BY 1) SELECT doc_id, md5(x[1:4000]) sample_md5, length(x[1:4000]) n FROM s")
def i5_metadata_sample(spark, d):
    rows = ingest.metadata_sample(_docs(spark, d)).where("sample <> ''")
    return rows.select("doc_id", F.md5("sample").alias("sample_md5"), F.length("sample").cast("bigint").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderstatus ELSE 'Unknown' END course, CASE WHEN o_orderkey % 4 = 3 THEN 'Document: ' || o_orderkey WHEN o_orderkey % 4 = 2 THEN 'No context available.' ELSE o_orderpriority END context,
 CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 0 END::BIGINT n_topics, CASE o_orderkey % 4 WHEN 0 THEN 0.5 ELSE 0 END::DOUBLE confidence FROM orders""")
def i6_metadata_parse(spark, d):
    """JSON in a fence with a trailing comma; within prose; without most keys; none at all."""
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    whole = F.concat(F.lit('```json\n{"course_name": '), q("o_orderstatus"), F.lit(', "global_context": '), q("o_orderpriority"), F.lit(', "key_topics": ["a", "b"], "confidence": 0.5,}\n```'))
    prose = F.concat(F.lit('Here: {"course_name": '), q("o_orderstatus"), F.lit(', "global_context": '), q("o_orderpriority"), F.lit(', "key_topics": "none", "confidence": "high"} as asked'))
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, whole).when(k == 1, prose).when(k == 2, '{"chapter_title": "x"}').otherwise("I cannot tell.")
    m = ingest.metadata_from(said, F.col("o_orderkey").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m.course_name").alias("course"), F.col("m.global_context").alias("context"), F.size("m.key_topics").cast("bigint").alias("n_topics"), F.col("m.extraction_confidence").alias("confidence"))


@query(_P + " SELECT doc_id, page, md5(content) content_md5, n_elements, (length(content) // 4)::BIGINT tokens FROM p")
def i8_page_chunks(spark, d):
    return ingest.page_chunks(_docs(spark, d)).select("doc_id", "page", F.md5("content").alias("content_md5"), "n_elements", "tokens")


@query(_MERGED + " SELECT doc_id, i, first_page, last_page, n_pages, tokens, md5(content) content_md5, md5(array_to_string(element_ids, ',')) ids_md5 FROM c")
def i9_merge_small(spark, d):
    rows = ingest.merge_small(_docs(spark, d))
    return rows.select("doc_id", "i", "first_page", "last_page", "n_pages", "tokens", F.md5("content").alias("content_md5"), F.md5(F.array_join(F.col("element_ids").cast("array<string>"), ",")).alias("ids_md5"))


@query(
    _MERGED
    + f""", z AS (SELECT *, {packed_sql("content", 512)} pieces FROM c), y AS (SELECT doc_id, i, first_page, last_page, len(pieces) > 1 OR length(content) // 4 > 512 split, unnest(pieces) piece, generate_subscripts(pieces, 1) j FROM z)
 SELECT doc_id || '_chunk_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::VARCHAR, 4, '0') chunk_id, first_page, last_page, CASE WHEN split THEN 'slide_split' ELSE 'slide' END chunk_type, md5(piece) content_md5, length(piece) // 4 tokens,
  CASE WHEN split THEN doc_id || '_' || lpad(i::VARCHAR, 4, '0') ELSE '' END parent_chunk_id FROM y WHERE doc_id IS NOT NULL"""
)
def i7_chunks(spark, d):
    rows = ingest.chunks(_docs(spark, d)).where("doc_id is not null")
    return rows.select("chunk_id", "first_page", "last_page", "chunk_type", F.md5("content").alias("content_md5"), "tokens", "parent_chunk_id")


@query(
    _E
    + """, el AS (SELECT doc_id, list(elem_idx ORDER BY elem_idx) ids, list(length(content) // 4 ORDER BY elem_idx) t FROM e GROUP BY 1),
 x AS (SELECT doc_id, ids, list_prepend({'s': 0::BIGINT, 'k': 0::BIGINT, 'i': 0::BIGINT, 'out': []::BIGINT[]}, list_transform(range(1, len(t) + 1), lambda i: {'s': t[i], 'k': 0::BIGINT, 'i': i, 'out': []::BIGINT[]})) x FROM el),
 r AS (SELECT doc_id, ids, list_reduce(x, lambda a, b: {'s': CASE WHEN a.s + b.s >= 512 THEN 0 ELSE a.s + b.s END, 'k': a.k + (a.s + b.s >= 512 AND b.i > 1)::BIGINT, 'i': b.i, 'out': list_append(a.out, a.k + (a.s + b.s >= 512 AND b.i > 1)::BIGINT)}).out o FROM x)
 SELECT doc_id, unnest(ids) elem_idx, unnest(o) topic FROM r"""
)
def i11_transitions(spark, d):
    return ingest.transitions(_docs(spark, d))


@query(f"WITH x AS (SELECT doc_id, {packed_sql('text', 512)} pieces FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(pieces)::BIGINT n, md5(array_to_string(pieces, chr(1))) pieces_md5, list_max(list_transform(pieces, lambda p: length(p)))::BIGINT longest FROM x")
def i13_sentence_packing(spark, d):
    rows = _docs(spark, d).where("text is not null").select("doc_id", ingest.packed(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "\x01")).alias("pieces_md5"), F.array_max(F.transform("p", F.length)).cast("bigint").alias("longest"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'General,General,General' WHEN 1 THEN 'a,General,General' WHEN 2 THEN 'a,b,c' ELSE 'General,General,General' END labels FROM part")
def i15_topic_labels(spark, d):
    k = F.col("p_size") % 4
    said = F.when(k == 0, "no list").when(k == 1, '```json\n["a"]\n```').when(k == 2, '["a", "b", "c", "d"]').otherwise("[1, 2")
    return read(spark, d, "part").select("p_partkey", F.array_join(ingest.topic_labels(said, F.lit(3)), ",").alias("labels"))


_PREFIX = """WITH r AS (SELECT doc_id, text, coalesce(source, 'Unknown') course, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE repeat(coalesce(lang, 'x') || ' ', (doc_id % 30)::INT) END chapter, doc_id % 4 first_page, doc_id % 4 + doc_id % 2 last_page, CASE WHEN doc_id % 5 = 0 THEN 'General' ELSE repeat('topic ', (doc_id % 20)::INT) END topic, doc_id % 2 = 0 slides FROM documents),
 f AS (SELECT *, list_filter([CASE WHEN course NOT IN ('', 'Unknown') THEN 'Course: ' || CASE WHEN length(course) > 50 THEN course[1:47] || '...' ELSE course END END, CASE WHEN chapter NOT IN ('', 'Unknown') THEN 'Chapter: ' || CASE WHEN length(chapter) > 50 THEN chapter[1:47] || '...' ELSE chapter END END,
  CASE WHEN slides THEN 'Slides: ' ELSE 'Pages: ' END || CASE WHEN first_page = last_page THEN first_page::VARCHAR ELSE first_page || '-' || last_page END, CASE WHEN topic NOT IN ('', 'General') THEN 'Topic: ' || CASE WHEN length(topic) > 50 THEN topic[1:47] || '...' ELSE topic END END], lambda x: x IS NOT NULL) parts FROM r),
 g AS (SELECT *, '[' || array_to_string(parts, ' | ') || ']' whole FROM f), h AS (SELECT *, CASE WHEN length(whole) > 200 THEN whole[1:197] || '...]' ELSE whole END prefix FROM g)"""


def _prefixed(spark, d):
    i, rep = F.col("doc_id"), lambda c, n: F.repeat(c, (F.col("doc_id") % n).cast("int"))
    rows = _docs(spark, d).select(
        "doc_id", "text", F.coalesce("source", F.lit("Unknown")).alias("course"), F.when(i % 3 == 0, "Unknown").otherwise(rep(F.concat(F.coalesce("lang", F.lit("x")), F.lit(" ")), 30)).alias("chapter"),
        (i % 4).alias("first_page"), (i % 4 + i % 2).alias("last_page"), F.when(i % 5 == 0, "General").otherwise(rep(F.lit("topic "), 20)).alias("topic"), (i % 2 == 0).alias("slides"),
    )
    return rows.withColumn("prefix", ingest.source_prefix(*(F.col(c) for c in ("course", "chapter", "first_page", "last_page", "topic", "slides"))))


@query(_PREFIX + " SELECT doc_id, prefix, md5(CASE WHEN starts_with(text, prefix) THEN text ELSE prefix || chr(10) || text END) enriched_md5 FROM h")
def i16_source_prefix(spark, d):
    rows = _prefixed(spark, d)
    return rows.select("doc_id", "prefix", F.md5(ingest.enriched(ingest.enriched(F.col("text"), F.col("prefix")), F.col("prefix"))).alias("enriched_md5"))


@query(_PREFIX + """, c AS (SELECT doc_id::VARCHAR chunk_id, CASE WHEN doc_id % 7 = 0 THEN text ELSE prefix || chr(10) || text END content, CASE WHEN doc_id % 11 = 0 THEN '' ELSE prefix END prefix, course, chapter, first_page, last_page FROM h),
 k AS (SELECT *, length(coalesce(content, '')) // 4 tokens FROM c),
 i AS (SELECT unnest(list_filter([CASE WHEN length(trim(coalesce(content, ''), ' ')) < 10 THEN 'error: too short' END, CASE WHEN prefix = '' THEN 'error: no prefix' END, CASE WHEN tokens = 0 THEN 'warning: no tokens' END, CASE WHEN course = 'Unknown' AND chapter = 'Unknown' THEN 'warning: nothing known' END,
  CASE WHEN first_page = 0 AND last_page = 0 THEN 'warning: no pages' END, CASE WHEN prefix <> '' AND NOT starts_with(coalesce(content, ''), prefix) THEN 'warning: prefix not at the start' END], lambda x: x IS NOT NULL)) issue FROM k) SELECT issue, count(*) n FROM i GROUP BY 1""")
def a5_validation_report(spark, d):
    i = F.col("doc_id")
    rows = _prefixed(spark, d).withColumn("content", F.when(i % 7 == 0, F.col("text")).otherwise(F.concat("prefix", F.lit("\n"), "text")))
    rows = rows.withColumns({"chunk_id": i.cast("string"), "prefix": F.when(i % 11 == 0, "").otherwise(F.col("prefix")), "tokens": T.token_count(F.coalesce("content", F.lit("")))})
    return ingest.issues(rows).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(_PREFIX + """ SELECT course, count(*) n, sum(length(coalesce(text, '')) // 4)::BIGINT tokens, round(avg(length(coalesce(text, '')) // 4), 4) mean_tokens, count(DISTINCT CASE WHEN chapter <> 'Unknown' THEN chapter END) chapters, count(DISTINCT CASE WHEN topic <> 'General' THEN topic END) topics,
 count(DISTINCT slides) file_types, count(*) FILTER (doc_id % 13 = 0) split_chunks, min(first_page) || '-' || max(last_page) page_range FROM h GROUP BY 1""")
def a3_enrichment_summary(spark, d):
    tokens = T.token_count(F.coalesce("text", F.lit("")))
    return _prefixed(spark, d).groupBy("course").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"), F.round(F.avg(tokens), 4).alias("mean_tokens"), F.countDistinct(F.when(F.col("chapter") != "Unknown", F.col("chapter"))).alias("chapters"),
        F.countDistinct(F.when(F.col("topic") != "General", F.col("topic"))).alias("topics"), F.countDistinct("slides").alias("file_types"), F.count_if(F.col("doc_id") % 13 == 0).alias("split_chunks"),
        F.concat_ws("-", F.min("first_page").cast("string"), F.max("last_page").cast("string")).alias("page_range"),
    )


@query(_PREFIX + " SELECT doc_id::VARCHAR chunk_id, md5(coalesce(text, '')) content_md5, course course_name, chapter chapter_title, first_page page_start, last_page page_end, topic, prefix source_prefix, '' parent_chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'pptx' ELSE 'pdf' END file_type, 20 n_columns FROM h")
def f13_metadata(spark, d):
    rows = _prefixed(spark, d).withColumnsRenamed({"course": "course_name", "chapter": "chapter_title", "first_page": "page_start", "last_page": "page_end", "prefix": "source_prefix", "text": "content"})
    more = {"chunk_id": F.col("doc_id").cast("string"), "raw_content": F.col("content"), "filename": F.col("doc_id").cast("string"), "file_type": F.when(F.col("slides"), "pptx").otherwise("pdf"), "subject_area": F.lit("Unknown"), "global_context": F.lit("")}
    more |= {"key_topics": F.array(F.col("topic")), "parent_chunk_id": F.lit(""), "chunk_type": F.lit("slide"), "token_count": T.token_count(F.col("content")), "enrichment_version": F.lit("1"), "metadata_version": F.lit("1"), "document_category": F.lit("notes")}
    out = ingest.to_metadata(rows.withColumns(more))
    names = ["course_name", "chapter_title", "page_start", "page_end", "topic", "source_prefix", "parent_chunk_id", "file_type"]
    return out.select("chunk_id", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), *names, F.lit(len(out.columns)).alias("n_columns"))


@query("""WITH w AS (SELECT doc_id, length(coalesce(text, '')) // 4 > 512 long, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 64) h FROM documents)
 SELECT doc_id, long OR len(h) = 0 failed, CASE WHEN NOT (long OR len(h) = 0) THEN len(h)::DOUBLE END total, CASE WHEN NOT (long OR len(h) = 0) THEN len(list_filter(h, lambda x: x = 7))::DOUBLE END seventh FROM w""")
def i19_i20_embeddings(spark, d):
    """Texts over the limit or without a word are flagged; the others' vectors are counts of hashed words."""
    rows = ingest.embedded(_docs(spark, d), 512)
    return rows.select("doc_id", "failed", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("embedding", F.lit(7)).alias("seventh"))


@query("SELECT count(*) FILTER (failed) failed, count(*) FILTER (NOT failed) embedded, round(sum(tokens) FILTER (NOT failed) / 2.5, 4) tokens_a_second FROM (SELECT length(coalesce(text, '')) // 4 tokens, length(coalesce(text, '')) // 4 > 512 OR len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) = 0 failed FROM documents)")
def a6_embedding_rates(spark, d):
    docs = _docs(spark, d)
    rows = ingest.embedded(docs, 512).join(docs.select(F.col("doc_id").alias("of"), T.token_count(F.coalesce("text", F.lit(""))).alias("tokens")), F.col("doc_id") == F.col("of"))
    ok = ~F.col("failed")
    return rows.agg(F.count_if("failed").alias("failed"), F.count_if(ok).alias("embedded"), F.round(F.sum(F.when(ok, F.col("tokens"))) / 2.5, 4).alias("tokens_a_second"))


assert V.DIM == 64
