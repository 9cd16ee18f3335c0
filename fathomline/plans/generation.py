"""Context, prompt, answer and citation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import answers, assembly, citations, context, prompts
from fathomline.plans.catalog import query
from fathomline.plans.ingestion import sentences_sql
from fathomline.sources.tables import read, spread

_KEYS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "], w)))"


@query("""SELECT o_orderkey, '[' || concat_ws(' | ', o_orderstatus, 'Unknown', CASE o_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN kind || n WHEN 2 THEN kind || n || '-' || (n + 2) ELSE 'N/A' END) || ']' citation
 FROM (SELECT *, o_custkey % 10 + 1 n, CASE WHEN o_orderkey % 2 = 0 THEN 'Slide ' ELSE 'Page ' END kind FROM orders)""")
def x2_x3_citations(spark, d):
    """Pages as numbers, as text with a fraction, as no number; slides and pages."""
    k, n = F.col("o_custkey") % 4, F.col("o_custkey") % 10 + 1
    page = F.when(k == 0, "").when(k == 1, n.cast("string")).when(k == 2, F.concat(n.cast("string"), F.lit(".0"))).otherwise("six")
    last = F.when(k == 2, n + 2).when(k == 1, n).cast("string")
    cited = context.citation(F.col("o_orderstatus"), F.lit(None).cast("string"), T.display_int(page), T.display_int(last), F.when(F.col("o_orderkey") % 2 == 0, "Slide").otherwise("Page"))
    return read(spark, d, "orders").select("o_orderkey", cited.alias("citation"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '[c]' || chr(10) || p_name ELSE '[c]' || chr(10) || 'pre' || p_name END shown FROM part")
def x4_display(spark, d):
    k = F.col("p_size") % 3
    content = F.when(k == 2, F.concat(F.lit("pre"), F.col("p_name"))).otherwise(F.concat(F.lit("pre "), F.col("p_name")))
    return read(spark, d, "part").select("p_partkey", assembly.display(content, F.when(k == 2, "other").otherwise("pre"), F.when(k == 0, "").otherwise("[c]")).alias("shown"))


_PAT = {k: "|".join(f"(?:{p})" for p in v) for k, v in assembly.PATTERNS.items()}


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'example' " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{k}'" for k, p in _PAT.items()) + " ELSE 'general' END section FROM documents")
def x1_sections(spark, d):
    kind = F.when(F.col("doc_id") % 9 == 0, "example").otherwise("slide")
    return spread(read(spark, d, "documents")).select("doc_id", assembly.section(F.col("text"), kind).alias("section"))


_FOLD = "list_reduce(list_prepend({{'n': 0::BIGINT, 'used': 0::BIGINT, 'k': 0::BIGINT, 'full': false}}, list_transform(ss, lambda s: {{'n': length(s) // 4, 'used': 0::BIGINT, 'k': 0::BIGINT, 'full': false}})), lambda a, b: {{'n': 0::BIGINT, 'used': CASE WHEN a.full OR a.used + b.n > {0} THEN a.used ELSE a.used + b.n END, 'k': CASE WHEN a.full OR a.used + b.n > {0} THEN a.k ELSE a.k + 1 END, 'full': a.full OR a.used + b.n > {0}}}).k"


@query(f"WITH s AS (SELECT doc_id, text, doc_id % 120 budget, {sentences_sql('text', True)} ss FROM documents WHERE text IS NOT NULL), k AS (SELECT *, {_FOLD.format('budget')} k FROM s) SELECT doc_id, md5(CASE WHEN budget <= 0 OR text = '' THEN '' WHEN k > 0 THEN array_to_string(ss[1:k], ' ') ELSE text[1:budget * 4] || '...' END) cut_md5 FROM k")
def x8_truncation(spark, d):
    rows = spread(read(spark, d, "documents")).where("text is not null")
    return rows.select("doc_id", F.md5(T.leading_sentences(F.col("text"), F.col("doc_id") % 120)).alias("cut_md5"))


@query("""WITH c AS (SELECT conv_id, turn chunk_id, ((conv_id * 31 + turn * 17) % 10) / 10.0 score, (['general', 'example', 'definition', 'formula'])[turn % 4 + 1] section, turn % 3 page FROM conversations),
 s AS (SELECT *, coalesce(nullif(list_position(['definition', 'explanation', 'example', 'formula', 'diagram', 'important_notes', 'general'], section), 0), 8) place FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, score DESC, chunk_id) sorted FROM s),
 g AS (SELECT *, min(sorted) OVER (PARTITION BY conv_id, page) first_use, row_number() OVER (PARTITION BY conv_id, page ORDER BY score DESC, sorted) round_ FROM o), m AS (SELECT *, max(first_use) OVER (PARTITION BY conv_id) = 1 single FROM g)
 SELECT conv_id, chunk_id, section, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN single THEN sorted ELSE round_ END, first_use) ord FROM m QUALIFY ord <= 5""")
def x5_x6_selection(spark, d):
    """Turns as chunks of a conversation: the template's order, spread over pages, five at most."""
    section = F.get(F.array(*map(F.lit, ("general", "example", "definition", "formula"))), (F.col("turn") % 4).cast("int"))
    rows = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("chunk_id"), (((F.col("conv_id") * 31 + F.col("turn") * 17) % 10) / 10.0).alias("score"), section.alias("section"), (F.col("turn") % 3).alias("page"), F.lit("").alias("chapter"), F.lit("").alias("chunk_type"))
    return assembly.selected(rows, "conv_id", "learning").select("conv_id", "chunk_id", "section", F.col("ord").cast("bigint").alias("ord"))


@query()
def x7_x13_context(spark, d):
    """The whole build of a context for each conversation."""
    turns = read(spark, d, "conversations")
    rows = turns.select("conv_id", F.col("turn").alias("chunk_id"), F.lit(1.0).alias("score"), F.coalesce("text", F.lit("")).alias("content"), F.lit("slide").alias("chunk_type"), F.lit("C").alias("course"), F.col("role").alias("chapter"), (F.col("turn") + 1).alias("page"), (F.col("turn") + 1).alias("page_end"), F.lit("pptx").alias("file_type"), F.lit("").alias("prefix"))
    return assembly.build(rows, "conv_id", "learning", 200)


@query("SELECT conv_id, (sum(length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+(\\n|$)', '\\1', 'g'), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) // 4) + length('Course: C | Chapter: Unknown Chapter') // 4)::BIGINT tokens FROM conversations GROUP BY 1")
def x9_x11_size(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("content"))
    return assembly.estimated_size(rows, "conv_id", assembly.metadata_header(F.lit("C"), F.lit("")))


_ANSWER = """SELECT o_orderkey answer_id, 'The ' || CASE WHEN o_orderkey % 2 = 0 THEN '<THINK>no</THINK>' ELSE '' END || 'order of ' || lower(o_orderpriority) || ' [' || o_orderstatus || ' | ' || o_orderpriority || ' | ' || ([' slides ' || n || '-' || (n + 1), 'Page: ' || n, 'Section ' || n, 'nowhere'])[o_orderkey % 4 + 1] || '] and [note] or [page ' || n || '] end.' AS text,
  o_orderstatus st, o_orderpriority pr, n, o_orderkey % 4 k FROM (SELECT *, o_custkey % 40 n FROM orders)"""


def _answers(spark, d):
    n, k = (F.col("o_custkey") % 40).cast("string"), F.col("o_orderkey") % 4
    place = F.when(k == 0, F.concat(F.lit(" slides "), n, F.lit("-"), (F.col("o_custkey") % 40 + 1).cast("string"))).when(k == 1, F.concat(F.lit("Page: "), n)).when(k == 2, F.concat(F.lit("Section "), n)).otherwise("nowhere")
    text = F.concat(F.lit("The "), F.when(F.col("o_orderkey") % 2 == 0, "<THINK>no</THINK>").otherwise(""), F.lit("order of "), F.lower("o_orderpriority"), F.lit(" ["), F.col("o_orderstatus"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" | "), place, F.lit("] and [note] or [page "), n, F.lit("] end."))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), text.alias("text"), "o_orderpriority")


@query(f"""WITH a AS ({_ANSWER}), c AS (SELECT answer_id, 1 i, st || ' | ' || pr || ' | ' || ([' slides ' || n || '-' || (n + 1), 'Page: ' || n, 'Section ' || n, 'nowhere'])[k + 1] raw, (['slide', 'page', 'section', 'unknown'])[k + 1] kind, CASE WHEN k = 3 THEN 0 ELSE n END AS first, CASE k WHEN 0 THEN n + 1 WHEN 3 THEN 0 ELSE n END AS last, text FROM a
 UNION ALL SELECT answer_id, 2, 'page ' || n, NULL, NULL, NULL, text FROM a)
 SELECT answer_id, i, raw, strpos(text, '[' || raw || ']') - 1 AS start, strpos(text, '[' || raw || ']') + length(raw) + 1 AS "end", kind, first, last FROM c""")
def t8_t9_citations(spark, d):
    rows = citations.scanned(_answers(spark, d), "answer_id")
    return rows.select("answer_id", "i", "raw", "start", "end", citations.parsed(F.col("raw")).alias("p")).select("answer_id", "i", "raw", "start", "end", "p.kind", "p.first", "p.last")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, (['page', 'slide', 'section', 'chapter', 'other'])[o_orderkey % 5 + 1] k, o_custkey % 9 AS first, o_custkey % 9 + o_custkey % 3 AS last FROM orders),
 p AS (SELECT *, CASE k WHEN 'page' THEN CASE WHEN last <> 0 AND last <> first THEN 'Pages ' || first || '-' || last ELSE 'Page ' || first END WHEN 'slide' THEN CASE WHEN last <> 0 AND last <> first THEN 'Slides ' || first || '-' || last ELSE 'Slide ' || first END WHEN 'section' THEN 'Section ' || first WHEN 'chapter' THEN 'Chapter ' || first ELSE 'Source' END w FROM o)
 SELECT o_orderkey, '[' || o_orderstatus || ' | ch | ' || w || ']' inline, o_orderstatus || ', ch, ' || w plain FROM p""")
def t10_citation_styles(spark, d):
    kind = F.get(F.array(*map(F.lit, ("page", "slide", "section", "chapter", "other"))), (F.col("o_orderkey") % 5).cast("int"))
    where = citations.place(kind, F.col("o_custkey") % 9, F.col("o_custkey") % 9 + F.col("o_custkey") % 3)
    return read(spark, d, "orders").select("o_orderkey", citations.formatted(F.col("o_orderstatus"), F.lit("ch"), where).alias("inline"), citations.formatted(F.col("o_orderstatus"), F.lit("ch"), where, "footnote").alias("plain"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ' ends' WHEN 1 THEN 'one' || repeat(chr(10), 3) || 'two' WHEN 2 THEN event_type WHEN 3 THEN 'aaaa bbbb cccc...' ELSE '' END cleaned FROM events""")
def t11_answer_cleaning(spark, d):
    """Hidden blocks, a rule at the end, empty lines and blanks, a cut at a word, nothing."""
    k, kind = F.col("event_id") % 5, F.col("event_type")
    text = (
        F.when(k == 0, F.concat(F.lit("<think>plan\nmore</think>[hide]x[/HIDE]"), kind, F.lit(" ends\n\n---\n"))).when(k == 1, "\n one  \n\n\n\n\n\ntwo \n \n".replace(" one", "one")).when(k == 2, F.concat(F.lit("  "), kind, F.lit("\n\n")))
        .when(k == 3, "aaaa bbbb cccc dddd")
    )
    return read(spark, d, "events").select("event_id", F.when(k == 3, answers.clean(text, 16)).otherwise(answers.clean(text)).alias("cleaned"))


_CHUNKS = """k AS (SELECT min(p_partkey) chunk_id, CASE p_size % 3 WHEN 0 THEN 'o' WHEN 1 THEN 'f' ELSE 'p' END course, CASE p_size % 2 WHEN 0 THEN '1-URGENT' ELSE '2-HIGH' END chapter, p_size AS start, p_size + 5 AS stop FROM part GROUP BY 2, 3, 4, 5)"""


@query(f"""WITH a AS ({_ANSWER}), {_CHUNKS}, c AS (SELECT *, replace(text, '<THINK>no</THINK>', '') clean, CASE WHEN k = 3 THEN 0 ELSE n END AS first, CASE k WHEN 0 THEN n + 1 WHEN 3 THEN 0 ELSE n END AS last FROM a),
 j AS (SELECT answer_id, chunk_id FROM c JOIN k ON lower(c.st) = k.course AND lower(c.pr) = lower(k.chapter) QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY CASE WHEN first >= start AND last <= stop THEN 0 ELSE 1 END, chunk_id) = 1),
 g AS (SELECT c.answer_id, clean, coalesce(chunk_id::VARCHAR, '-') chunk_ids, {_KEYS.format('clean')} w, 'an order of some priority ' || lower(pr) ctx FROM c LEFT JOIN j USING (answer_id)),
 r AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(ctx, x))) / len(w) ELSE 0 END ratio FROM g)
 SELECT answer_id, md5(clean) answer_md5, 1 n_citations, chunk_ids, ratio >= 0.3 is_grounded, round(least(1, ratio / 0.3), 4) grounding, (ratio < 0.3)::INT n_warnings FROM r""")
def p17_post_processing(spark, d):
    p = read(spark, d, "part")
    course = F.when(F.col("p_size") % 3 == 0, "o").when(F.col("p_size") % 3 == 1, "f").otherwise("p")
    chunks = p.groupBy(course.alias("course"), F.when(F.col("p_size") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("chapter"), F.col("p_size").alias("start"), (F.col("p_size") + 5).alias("end")).agg(F.min("p_partkey").alias("chunk_id"))
    said = _answers(spark, d)
    told = said.select("answer_id", F.concat(F.lit("an order of some priority "), F.lower("o_orderpriority")).alias("context"))
    rows = citations.post_processed(said.select("answer_id", "text"), chunks, told)
    return rows.select("answer_id", F.md5("answer").alias("answer_md5"), "n_citations", "chunk_ids", "is_grounded", "grounding", F.size("warnings").alias("n_warnings"))


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _rules(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_has(text, v)} THEN '{k}'" for k, v in rules.items()) + " END"


_BY_META = f"coalesce({_rules('lower(kind)', prompts.KEYWORDS)}, {_rules('lower(topic)', prompts.KEYWORDS)}, {_rules('lower(text[1:200])', prompts.KEYWORDS)}, 'general')"
_HEAD = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in prompts.HEADERS.items()) + "}"


@query(f"SELECT doc_id, {_BY_META} by_metadata, (['beginning', 'early', 'middle', 'late', 'conclusion'])[least(doc_id % 40 // 5, 4) + 1] by_position, coalesce({_rules('lower(text)', prompts.EXAM)}, 'evidence') by_argument FROM (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 6 = 0 THEN 'Worked Example' ELSE '' END kind, CASE WHEN doc_id % 4 = 0 THEN 'An overview' ELSE '' END topic FROM documents)")
def p13_classifiers(spark, d):
    rows = spread(read(spark, d, "documents")).withColumn("text", F.coalesce("text", F.lit("")))
    kind, topic = F.when(F.col("doc_id") % 6 == 0, "Worked Example").otherwise(""), F.when(F.col("doc_id") % 4 == 0, "An overview").otherwise("")
    return rows.select("doc_id", prompts.by_metadata(kind, topic, F.col("text")).alias("by_metadata"), prompts.by_position(F.col("doc_id") % 40).alias("by_position"), prompts.by_argument(F.col("text")).alias("by_argument"))


def _assembled_sql(section: str, order: str, budget: int) -> str:
    between = "chr(10) || chr(10) || '---' || chr(10) || chr(10)" if section == "'all'" else "chr(10) || chr(10)"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') content, CASE WHEN turn % 2 = 0 THEN '[C | ' || role || ' | Page 1]' ELSE '' END citation FROM conversations),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) ord FROM c), s AS (SELECT *, CASE WHEN citation = '' THEN content ELSE citation || chr(10) || content END shown, {section} section FROM o),
 r AS (SELECT *, sum(length(shown) // 4) OVER (PARTITION BY conv_id ORDER BY ord) running FROM s), k AS (SELECT * FROM r WHERE running <= {budget}),
 p AS (SELECT conv_id, section, min(ord) first, array_to_string(list(shown ORDER BY ord), {between}) body, sum(length(shown) // 4) t, count(*) n FROM k GROUP BY 1, 2),
 q AS (SELECT *, CASE WHEN section = 'all' THEN body ELSE coalesce({_HEAD}[section], '## ' || upper(section)) || chr(10) || chr(10) || body END whole FROM p)
 SELECT conv_id, md5(array_to_string(list(whole ORDER BY first), chr(10) || chr(10))) context_md5, sum(t)::BIGINT tokens, sum(n)::BIGINT n_chunks, string_agg(section, ',' ORDER BY first) sections FROM q GROUP BY 1"""


def _chunk_rows(spark, d):
    cited = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[C | "), F.col("role"), F.lit(" | Page 1]"))).otherwise("")
    return read(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("content"), cited.alias("citation"))


def _shown(rows):
    return rows.select("conv_id", F.md5("context").alias("context_md5"), "tokens", "n_chunks", "sections")


@query(_assembled_sql(f"coalesce({_rules('lower(content[1:200])', prompts.KEYWORDS)}, 'general')", "turn", 300))
def p14_standard_context(spark, d):
    none = F.lit("")
    return _shown(prompts.assembled(_chunk_rows(spark, d), "conv_id", prompts.by_metadata(none, none, F.col("content")), 300))


@query(_assembled_sql("'all'", "turn", 300))
def p14_minimal_context(spark, d):
    return _shown(prompts.assembled(_chunk_rows(spark, d), "conv_id", None, 300))


@query(_assembled_sql("(['beginning', 'early', 'middle', 'late', 'conclusion'])[least((turn * 7) % 30 // 5, 4) + 1]", "(turn * 7) % 30, turn", 300))
def p14_chronological_context(spark, d):
    return _shown(prompts.chronological(_chunk_rows(spark, d).withColumn("position", (F.col("ord") * 7) % 30), "conv_id", 300))


@query(_assembled_sql(f"coalesce({_rules('lower(content)', prompts.EXAM)}, 'evidence')", "turn", 300))
def p14_exam_context(spark, d):
    return _shown(prompts.assembled(_chunk_rows(spark, d), "conv_id", prompts.by_argument(F.col("content")), 300))


_SYS = "'You answer from the given context only and cite it.' || hints"
_USER = "header || chr(10) || chr(10) || 'ctx {query} of ' || item_id || chr(10) || chr(10) || 'Question: ' || text"


@query(f"""WITH r AS (SELECT item_id, coalesce(text, '') AS text, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '## ANSWER REQUIREMENTS' || chr(10) || 'short' || chr(10) || 'plain' || chr(10) ELSE chr(10) || '## ANSWER REQUIREMENTS' || chr(10) || 'plain' || chr(10) END hints, CASE WHEN item_id % 2 = 0 THEN 'Context from: C - ch' ELSE '' END header FROM benchmark),
 p AS (SELECT *, {_SYS} sys, {_USER} usr FROM r) SELECT item_id request_id, md5('[SYSTEM]' || chr(10) || sys || chr(10) || chr(10) || '[USER]' || chr(10) || usr) full_md5, length(sys) // 4 system_tokens, length(usr) // 4 user_tokens, md5(item_id || ':grounded') prompt_id FROM p""")
def p15_prompts(spark, d):
    """Values that look like placeholders are not filled in again; unknown placeholders stay."""
    i = F.col("item_id")
    hints = F.create_map(F.lit("length"), F.when(i % 3 == 1, "short").otherwise(""), F.lit("style"), F.when(i % 3 == 0, "").otherwise("plain"))
    rows = read(spark, d, "benchmark").select(i.alias("request_id"), F.coalesce("text", F.lit("")).alias("query"), F.concat(F.lit("ctx {query} of "), i.cast("string")).alias("context"), F.when(i % 2 == 0, "C").otherwise("").alias("course"), F.lit("ch").alias("chapter"), hints.alias("answer_hints"))
    return prompts.built(rows).select("request_id", F.md5("full_prompt").alias("full_md5"), "system_tokens", "user_tokens", "prompt_id")


@query(f"""WITH r AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE coalesce(text, '') END q, CASE WHEN item_id % 7 = 0 THEN '' ELSE coalesce(text, '') || ' Second one. Third one.' END ctx FROM benchmark), s AS (SELECT *, {sentences_sql('ctx')} ss FROM r)
 SELECT item_id request_id, CASE WHEN trim(q, ' ') = '' OR trim(ctx, ' ') = '' THEN '' ELSE array_to_string(ss[1:2], ' ') || ' ' END answer, CASE WHEN trim(q, ' ') = '' OR trim(ctx, ' ') = '' THEN 'empty' END error_type FROM s""")
def p16_p18_generation(spark, d):
    """Extractive answers; requests without a query or a context are rows of their own kind."""
    i, none = F.col("item_id"), F.lit("")
    text = F.coalesce("text", none)
    rows = read(spark, d, "benchmark").select(i.alias("request_id"), F.when(i % 5 == 0, "").otherwise(text).alias("query"), F.when(i % 7 == 0, "").otherwise(F.concat(text, F.lit(" Second one. Third one."))).alias("context"), none.alias("course"), none.alias("chapter"), F.create_map(F.lit("a"), none).alias("answer_hints"))
    return prompts.generate(rows).select("request_id", "answer", "error_type")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'timeout' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'error' END kind, CASE event_id % 5 WHEN 0 THEN (event_id % 60)::DOUBLE WHEN 2 THEN 1.5 END wait, coalesce(event_id % 5 = 2, false) daily FROM events")
def t17_retry_after(spark, d):
    k = F.col("event_id") % 5
    message = F.when(k == 0, F.concat(F.lit("429: retry after "), (F.col("event_id") % 60).cast("string"), F.lit("s"))).when(k == 1, "Timeout while reading").when(k == 2, "Quota per day exceeded, please retry in 1.5 s").when(k == 3, "broken pipe")
    return read(spark, d, "events").select("event_id", answers.error_kind(message).alias("kind"), answers.retry_after(message).alias("wait"), F.coalesce(answers.daily_quota(message), F.lit(False)).alias("daily"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[1, {\"a\": [2]}]' WHEN 1 THEN '[]' END found FROM events")
def t14_json_arrays(spark, d):
    k = F.col("event_id") % 3
    said = F.when(k == 0, 'So: ```json\n[1, {"a": [2,]},]\n``` done').when(k == 1, "[]").otherwise("nothing")
    return read(spark, d, "events").select("event_id", answers.json_array_in(said).alias("found"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN text[1:2000] || '... [truncated, ' || length(text) || ' chars total]' ELSE text END) payload_md5, CASE WHEN len(w) > 20 THEN array_to_string(w[1:20], ' ') || ' ... [' || (len(w) - 20) || ' more]' ELSE array_to_string(w, ' ') END items FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') w FROM documents)""")
def s22_t23_payloads(spark, d):
    text = F.coalesce("text", F.lit(""))
    return spread(read(spark, d, "documents")).select("doc_id", F.md5(T.truncated(text)).alias("payload_md5"), F.array_join(T.truncated_list(F.split(text, " ")), " ").alias("items"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE format('{:.4f}', l_discount::DOUBLE) END shown FROM lineitem")
def m3_score_text(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", answers.score_text(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount").cast("double"))).alias("shown"))
