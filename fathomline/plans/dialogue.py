"""Conversation queries with their SQL twins: state, rewriting, routing, expansion, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import answers, expansion
from fathomline.operators import rewriting as R
from fathomline.plans.catalog import query
from fathomline.sources.tables import read


def _list(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_BARE = "lower(regexp_replace(trim({}, ' '), '[?!.,;:\\s]+$', ''))"


def _matches(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


_INCOMPLETE = "CASE " + " ".join(f"WHEN regexp_matches({_BARE.format('text')}, '{p}') THEN '{k}'" for k, p in R.INCOMPLETE) + " END"
_FOLLOW = _matches(_BARE.format("text"), R.FOLLOW_UPS)
_COMPARES = f"(regexp_matches(lower(text), '{R.COMPARE}') OR regexp_matches(lower(text), '{R.DIFFER}'))"
def _n_terms(text: str) -> str:
    return f"len(list_filter({_list(R.TERMS)}, lambda t: contains(' ' || array_to_string({_TOK.format(text)}, ' ') || ' ', ' ' || t || ' ')))"


_ANY = "(?i)(^|[^\\p{{L}}\\p{{N}}_])({})($|[^\\p{{L}}\\p{{N}}_])"


def _swap(text: str, words: str, by: str) -> str:
    once = f"regexp_replace({text}, '{_ANY.format(words)}', '\\1' || {by} || '\\3', 'g')"
    return f"regexp_replace({once}, '{_ANY.format(words)}', '\\1' || {by} || '\\3', 'g')"


def _compared(text: str) -> str:
    def one(pattern: str) -> str:
        side = lambda k: f"regexp_replace(trim(regexp_extract({text}, '(?i){pattern}', {k}), ' '), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
        return f"WHEN {side(1)} <> '' AND {side(2)} <> '' THEN 'Compare ' || {side(1)} || ' and ' || {side(2)} || ' in detail. What are the key differences and similarities?'"

    return f"CASE {one(R.COMPARE)} {one(R.DIFFER)} END"


def _asks(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN replace('{t}', '{{concept}}', known)" for cond, t in pairs) + " END"


#: Turns with what is known before each.
_STATE = """WITH t AS (SELECT conv_id, turn, role, coalesce(trim(text, ' '), '') text, regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]{3,})', 1) caps, 'conv ' || (conv_id % 3) chapter FROM conversations),
 u AS (SELECT *, CASE WHEN role = 'assistant' THEN caps[1] END topic, CASE WHEN role = 'assistant' THEN caps[2] END concept, CASE WHEN role = 'assistant' THEN caps[3] END subconcept FROM t),
 v AS (SELECT *, last_value(topic IGNORE NULLS) OVER b known_topic, last_value(concept IGNORE NULLS) OVER b known_concept, last_value(subconcept IGNORE NULLS) OVER b known_subconcept, last_value(chapter IGNORE NULLS) OVER b known_chapter,
  coalesce(flatten(list(CASE WHEN role = 'assistant' THEN caps ELSE [] END) OVER h), []) ents, coalesce(list(concept) OVER h, []) cons, count(*) OVER h held FROM u
  WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 st AS (SELECT * EXCLUDE (ents), coalesce(known_subconcept, known_concept, known_topic, known_chapter) known, ents[greatest(len(ents) - 19, 1):len(ents)] ents, list_reverse(list_filter(cons, lambda x: x IS NOT NULL)) back FROM v)"""
_RECENT = "list_filter(list_transform(range(1, len(back) + 1), lambda i: CASE WHEN list_position(back, back[i]) = i THEN back[i] END), lambda x: x IS NOT NULL)[1:3]"
_SUMMARY = "coalesce(nullif(concat_ws(' | ', 'Chapter: ' || known_chapter, 'Topic: ' || known_topic, 'Concept: ' || known_concept, 'Subconcept: ' || known_subconcept), ''), 'No active context')"
_REWRITTEN = (
    _STATE
    + f""", w AS (SELECT *, {_n_terms('text')} n_terms, len({_WORDS.format('text')}) n_words, {_INCOMPLETE} inc, ents[greatest(len(ents) - 1, 1):len(ents)] two FROM st),
 x AS (SELECT *, CASE WHEN n_terms > 0 THEN 'contains_technical_term' WHEN n_words >= 8 THEN 'long_query' WHEN regexp_matches(text, '{_ANY.format("it|they|them|this|that|these|those")}') THEN 'contains_pronoun' WHEN inc IS NOT NULL THEN 'incomplete_pattern'
  WHEN n_words >= 5 THEN 'medium_query_no_pronouns' WHEN text LIKE '%?' AND n_words >= 4 THEN 'question_with_content' ELSE 'too_short_or_vague' END reason FROM w),
 y AS (SELECT *, reason IN ('contains_technical_term', 'long_query', 'medium_query_no_pronouns', 'question_with_content') sc,
  CASE WHEN known IS NULL THEN text ELSE replace(replace({_swap(_swap('text', 'they|them|these|those', 'chr(1)'), 'it|this|that', 'chr(2)')}, chr(1), CASE WHEN len(two) >= 2 THEN two[1] || ' and ' || two[2] WHEN len(two) = 1 THEN two[1] || ' and related concepts' ELSE known || ' and related concepts' END), chr(2), coalesce(two[1], known)) END pro FROM x),
 z AS (SELECT *, CASE WHEN NOT sc THEN coalesce(inc, CASE WHEN {_COMPARES} THEN 'comparison' END, CASE WHEN {_FOLLOW} THEN 'elaboration' END) END kind, {_compared('pro')} cmp FROM y),
 a AS (SELECT *, CASE WHEN kind = 'comparison' THEN 'Compare ' || coalesce(known, 'this') || ' and related concepts in detail.' WHEN known IS NOT NULL THEN {_asks([(f"kind = '{k}'", t) for k, t in R.ASKS.items()])} END asked,
  CASE WHEN {_FOLLOW} AND known IS NOT NULL THEN coalesce({_asks([(f"regexp_matches({_BARE.format('text')}, '{p}')", t) for p, t in R.FOLLOWED])}, 'Explain ' || known || ' further.') END followed FROM z),
 b AS (SELECT *, CASE WHEN sc THEN 'none' WHEN cmp IS NOT NULL THEN 'comparison' WHEN pro <> text THEN 'pronoun' WHEN asked <> text THEN 'intent' WHEN followed <> text THEN 'follow_up' ELSE 'none' END rt FROM a),
 c AS (SELECT *, CASE rt WHEN 'comparison' THEN cmp WHEN 'pronoun' THEN pro WHEN 'intent' THEN asked WHEN 'follow_up' THEN followed ELSE text END query FROM b),
 e AS (SELECT *, {_n_terms('query')} qt FROM c),
 f AS (SELECT *, CASE WHEN {_compared('query')} IS NOT NULL THEN 2 WHEN qt > 0 THEN least(2, qt) ELSE least(2, len(list_filter({_WORDS.format('query')}, lambda w: regexp_matches(w, '^\\p{{Lu}}.{{2,}}')))) END concepts FROM e),
 g AS (SELECT *, CASE WHEN sc THEN 1.0 ELSE round(least(0.95, 0.3 * (known IS NOT NULL)::INT + 0.25 * (rt = 'pronoun')::INT + 0.2 * (kind IS NOT NULL)::INT + 0.15 * concepts / 2 + 0.1 * least(1, len({_WORDS.format('query')}) / 8)), 6) END conf FROM f),
 rw AS (SELECT *, NOT sc AND (rt = 'none' OR (conf < 0.5 AND known IS NOT NULL)) agent FROM g)"""
)


def _turns(spark, d):
    caps = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Z][a-z]{3,})"), F.lit(1))
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(F.trim("text"), F.lit("")).alias("text"), caps.alias("entities"), F.concat(F.lit("conv "), (F.col("conv_id") % 3).cast("string")).alias("chapter"))
    return rows.withColumns({c: F.get("entities", F.lit(k)) for k, c in enumerate(("topic", "concept", "subconcept"))})


def _rewritten(spark, d):
    return R.rewritten(R.with_terms(R.state(_turns(spark, d))))


@query(_STATE + f" SELECT conv_id, turn, held, known \"primary\", array_to_string({_RECENT}, ',') recent_concepts, array_to_string(ents, ',') recent_entities, {_SUMMARY} summary FROM st")
def w13_w15_conversation_state(spark, d):
    rows = R.state(_turns(spark, d))
    return rows.select("conv_id", "turn", "held", "primary", F.array_join("recent_concepts", ",").alias("recent_concepts"), F.array_join("recent_entities", ",").alias("recent_entities"), R.summary().alias("summary"))


@query(_REWRITTEN + " SELECT conv_id, turn, reason, sc self_contained, kind intent FROM rw")
def p1_p4_understanding(spark, d):
    return _rewritten(spark, d).select("conv_id", "turn", "reason", "self_contained", "intent")


_ODD = {0: "Why?", 1: "give example", 2: "compare A and B", 3: "What is this about?", 4: "they differ", 5: "Explain paging tables", 6: "how so", 7: "pros", 8: "tell me more!"}
_ODD_SQL = _STATE.replace("FROM conversations)", "FROM (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN text ELSE (" + _list(_ODD.values()) + ")[(conv_id + turn) % 9 + 1] END AS text FROM conversations))")


@query(_REWRITTEN.replace(_STATE, _ODD_SQL) + " SELECT conv_id, turn, reason, kind intent, rt rewrite_type, query, conf confidence, agent needs_agent, CASE WHEN n_words <= 2 AND known IS NULL AND rt = 'none' THEN 'clarification' WHEN agent OR (conf < 0.5 AND known IS NOT NULL) THEN 'agent' ELSE 'direct' END route FROM rw WHERE role <> 'assistant'")
def p2_p9_rewriting(spark, d):
    """User turns as short follow-ups over the conversations' own answers: pronouns, comparisons, intents, routes."""
    texts = F.get(F.array(*(F.lit(x) for x in _ODD.values())), ((F.col("conv_id") + F.col("turn")) % 9).cast("int"))
    turns = _turns(spark, d).withColumn("text", F.when(F.col("role") == "assistant", F.col("text")).otherwise(texts))
    caps = F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1))
    turns = turns.withColumn("entities", caps).withColumns({c: F.get("entities", F.lit(k)) for k, c in enumerate(("topic", "concept", "subconcept"))})
    rows = R.route(R.rewritten(R.with_terms(R.state(turns)))).where("role <> 'assistant'")
    return rows.select("conv_id", "turn", "reason", "intent", "rewrite_type", "query", "confidence", "needs_agent", "route")


@query(_REWRITTEN + f", k AS (SELECT *, list_filter({_WORDS.format('lower(query)')}, lambda w: length(w) > 2 AND NOT list_contains({_list(R.STOP_WORDS)}, w)) kw FROM rw) SELECT conv_id, turn, CASE WHEN len(kw) > 0 THEN array_to_string(kw, ' ') ELSE query END keywords, md5(concat_ws('|', text, coalesce(known_concept, ''), coalesce(known_subconcept, ''), coalesce(known_topic, ''))) cache_key FROM k")
def t4_t6_keywords_and_keys(spark, d):
    return _rewritten(spark, d).select("conv_id", "turn", R.keywords(F.col("query")).alias("keywords"), R.cache_key().alias("cache_key"))


@query(_REWRITTEN + f" SELECT conv_id, turn, text original, query rewritten, known_topic topic, {_SUMMARY} summary, array_to_string({_RECENT}, ',') recent FROM rw")
def m24_agent_context(spark, d):
    rows = _rewritten(spark, d).select("conv_id", "turn", R.agent_context().alias("c"))
    return rows.select("conv_id", "turn", F.col("c.original_query").alias("original"), F.col("c.rewritten_query").alias("rewritten"), F.col("c.hierarchy.topic").alias("topic"), F.col("c.summary").alias("summary"), F.array_join("c.recent_concepts", ",").alias("recent"))


@query("SELECT conv_id, turn, md5(concat_ws(chr(10), string_agg(role || ': ' || text[1:200], chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 'query: ' || coalesce(text, ''))) prompt_md5 FROM conversations")
def m32_agent_prompt(spark, d):
    return R.agent_prompt(read(spark, d, "conversations")).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'decompose' WHEN 1 THEN 'clarify' ELSE 'direct_retrieve' END AS action, CASE event_id % 5 WHEN 0 THEN event_type ELSE 'q' END search_query, CASE event_id % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.7 WHEN 3 THEN 0.3 ELSE 0.4 END::DOUBLE confidence, CASE event_id % 5 WHEN 0 THEN 2 ELSE 0 END n_sub_queries FROM events""")
def p10_agent_decisions(spark, d):
    """A plan in a fence, a question, an unknown action, prose, and no answer in time."""
    k = F.col("event_id") % 5
    plan = F.concat(F.lit('```json\n{"action": "decompose", "search_query": "'), F.col("event_type"), F.lit('", "confidence": 0.9, "sub_queries": ["a", "b"],}\n```'))
    said = F.when(k == 0, plan).when(k == 1, 'I ask: {"action": "clarify"}').when(k == 2, '{"action": "dance"}').when(k == 3, "no idea")
    return read(spark, d, "events").select("event_id", R.decision(said, F.lit("q")).alias("p")).select("event_id", "p.*")


_ACRO = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in expansion.ACRONYMS.items()) + "}"
_BASE = "SELECT conv_id, turn, coalesce(trim(text, ' '), '') || (['', ' api cache', ' OS (old) | related: ml', ' encryption of a DB'])[turn % 4 + 1] text FROM conversations"
_BY_ACRO = f"array_to_string(list_transform({_WORDS.format('text')}, lambda w: CASE WHEN {_ACRO}[lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_/]', '', 'g'))] IS NULL THEN w ELSE w || ' (' || {_ACRO}[lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_/]', '', 'g'))] || ')' END), ' ')"
_GROUPS = [(c, t) for c, v in [*((c, v[:2]) for c, v in expansion.SYNONYMS.items()), *((c, expansion.neighbours(c)[:2]) for c in expansion.RELATIONS)] for t in v]
_ADDED = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(x), '{c}') AND NOT contains(lower(x), '{t}') THEN '{t}' END" for c, t in _GROUPS) + "], lambda t: t IS NOT NULL)"
_FIRST = "list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN list_position({0}, {0}[i]) = i THEN {0}[i] END), lambda t: t IS NOT NULL)"
_CLEAN = "trim(regexp_replace(replace(replace(replace({}, 'related:', ''), 'context:', ''), '|', ''), '\\([^)]*\\)', '', 'g'), ' ')"
_SPARSE = "list_transform(string_split_regex(lower(" + _CLEAN + "), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_/]', '', 'g'))"


@query(f"""WITH q AS ({_BASE}), a AS (SELECT *, {_BY_ACRO} x FROM q), l AS (SELECT *, {_ADDED} g FROM a), m AS (SELECT *, {_FIRST.format('g')}[1:5] added FROM l),
 s AS (SELECT *, CASE WHEN len(added) > 0 THEN x || ' (related: ' || array_to_string(added, ', ') || ')' ELSE x END said FROM m), e AS (SELECT *, CASE WHEN len(added) > 0 THEN {_CLEAN.format('said')} || ' | context: ' || array_to_string(added, ', ') ELSE {_CLEAN.format('said')} END expanded FROM s),
 k AS (SELECT *, list_filter({_SPARSE.format('expanded')}, lambda w: length(w) > 2 AND NOT list_contains({_list(T.STOP_WORDS)}, w)) kw FROM e)
 SELECT conv_id, turn, expanded, array_to_string(added, ',') added, CASE WHEN len(kw) > 0 THEN array_to_string({_FIRST.format('kw')}, ' ') ELSE expanded END keywords FROM k""")
def p11_p12_expansion(spark, d):
    """Acronyms, synonyms and neighbours of whole turns, some with marks of their own."""
    tail = F.get(F.array(*map(F.lit, ("", " api cache", " OS (old) | related: ml", " encryption of a DB"))), (F.col("turn") % 4).cast("int"))
    none = F.lit(None).cast("string")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce(F.trim("text"), F.lit("")), tail).alias("text"), none.alias("topic"), none.alias("concept"), none.alias("chapter"))
    return expansion.expand(rows).select("conv_id", "turn", "expanded", F.array_join("added", ",").alias("added"), "keywords")


_PARTS = "list_filter(list_transform(string_split_regex(coalesce(text, ''), '(?i)\\s+and\\s+|;'), lambda p: p), lambda p: trim(p, ' ') <> '')"


@query(f"WITH p AS (SELECT conv_id, turn, {_PARTS} x FROM (SELECT conv_id, turn, text || ' and more; last' AS text FROM conversations)) SELECT conv_id, turn, generate_subscripts(x, 1) - 1 part, trim(unnest(x), ' ') AS text, greatest(1, 10 // len(x)) k FROM p")
def p20_sub_queries(spark, d):
    rows = read(spark, d, "conversations").withColumn("text", F.concat("text", F.lit(" and more; last")))
    return expansion.sub_queries(rows, ["conv_id", "turn"], 10)


_SENT = "list_filter(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"
_KEYS = "list_distinct(list_filter(" + _TOK.format("s") + ", lambda w: length(w) >= 3 AND NOT list_contains(" + _list(T.STOP_WORDS) + ", w)))"


@query(f"""WITH r AS (SELECT conv_id || '/' || turn id, text answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) context FROM conversations), s AS (SELECT id, answer, context, {_SENT} ss FROM r),
 k AS (SELECT *, list_transform(ss, lambda s: {_KEYS}) ks FROM s), g AS (SELECT *, len(list_filter(ks, lambda k: len(k) > 0 AND len(list_filter(k, lambda w: contains(lower(context), w))) / len(k) >= 0.3)) good FROM k)
 SELECT id, CASE WHEN trim(coalesce(answer, ''), ' ') <> '' AND trim(coalesce(context, ''), ' ') <> '' THEN good / len(ss) END faithfulness FROM g""")
def m1_faithfulness(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("answer"), F.lag("text").over(w).alias("context"))
    return answers.get_provider("judge", "coverage")(rows)
