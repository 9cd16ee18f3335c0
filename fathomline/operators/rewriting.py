"""Query understanding: conversation state, rewriting by rules, routing. A turn is a row; its state is what came before."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

# Fixed values in this block: patterns of incomplete queries with the intent they show, in order of precedence;
# follow-ups; comparisons; what each intent asks; pronouns; words that make a query complete; stop words; weights.
INCOMPLETE = [
    ("explanation", r"^(why|how|when|where|what)$"),
    ("example", r"^(example|give example|show example|illustrate|demonstrate|sample)$"),
    ("comparison", r"^(difference|diff|compare|vs\.?|versus)$"),
    ("elaboration", r"^(explain|elaborate|describe|tell me more|go on)$"),
    ("repeat", r"^(again|repeat|re-explain|explain again|once more)$"),
    ("summary", r"^(summary|summarize|tldr|brief|in short|recap)$"),
    ("formula", r"^(formula|equation|math|calculation)$"),
    ("advantages", r"^(advantages|pros|benefits|merits|strengths)$"),
    ("disadvantages", r"^(disadvantages|cons|drawbacks|demerits|limitations|weaknesses)$"),
    ("applications", r"^(applications|uses|applied|real world|practical|usage)$"),
    ("definition", r"^(definition|define|meaning|what is)$"),
]
FOLLOW_UPS = [r"^why\s*(though|so|is that)?$", r"^how\s*(so|come)?$", INCOMPLETE[1][1], INCOMPLETE[2][1], INCOMPLETE[3][1], INCOMPLETE[4][1]]
COMPARE = r"compare\s+(.+?)\s+(?:and|vs\.?|versus|with)\s+(.+?)(?:\?|$|\.)"
DIFFER = r"(?:difference|diff)\s+(?:between\s+)?(.+?)\s+(?:and|vs\.?|versus)\s+(.+?)(?:\?|$|\.)"
ASKS = {
    "explanation": "Explain why {concept} works the way it does.",
    "example": "Provide a clear example of {concept}.",
    "elaboration": "Explain {concept} in detail.",
    "repeat": "Explain {concept} again with different examples.",
    "summary": "Summarize the key points of {concept}.",
    "formula": "Key formulas and equations for {concept}.",
    "advantages": "What are the main advantages of {concept}?",
    "disadvantages": "What are the main disadvantages of {concept}?",
    "applications": "What are the real-world applications of {concept}?",
    "definition": "Define {concept} clearly.",
}
FOLLOWED = [
    (r"^why", "Why does {concept} work the way it does?"), (r"^how", "How does {concept} work?"), (r"^example", "Provide a clear example of {concept}."),
    (r"^(difference|diff|compare)", "Compare {concept} with related concepts."), (r"^(explain|elaborate|describe)", "Explain {concept} in detail."), (r"^(again|repeat)", "Explain {concept} again with different examples."),
]
_WORD = r"(?i)(?<![\p{L}\p{N}_])(%s)(?![\p{L}\p{N}_])"
PRONOUNS, PLURAL, SINGULAR = _WORD % "it|they|them|this|that|these|those", _WORD % "they|them|these|those", _WORD % "it|this|that"
TERMS = [
    "deadlock", "scheduling", "paging", "segmentation", "virtual memory", "thread", "process", "semaphore", "mutex", "cache", "cpu", "memory", "disk", "file system", "interrupt", "system call", "kernel",
    "algorithm", "data structure", "network", "protocol", "tcp", "ip", "os", "operating system", "database", "sql", "transaction", "oop", "inheritance", "polymorphism", "encapsulation", "abstraction",
    "compiler", "parser", "lexer", "linked list", "tree", "graph", "hash table", "queue", "stack", "fcfs", "round robin", "priority scheduling", "shortest job first",
]
STOP_WORDS = "what why how when where does do is are the a an of to for with on at from can you me explain tell show give provide".split()
CONFIDENCE = {"context": 0.30, "pronoun": 0.25, "intent": 0.20, "terms": 0.15, "length": 0.10}
LEVELS = ["subconcept", "concept", "topic", "chapter", "module", "subject"]

def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def term_count(text: Column, vocabulary: list[str] | None = None) -> Column:
    """How many vocabulary terms the text has at word boundaries (a term inside a word does not count)."""
    low = F.concat(F.lit(" "), F.array_join(T.tokens(text), " "), F.lit(" "))
    known = F.array(*(F.lit(f" {t} ") for t in (TERMS if vocabulary is None else vocabulary)))
    return F.coalesce(T.bound(low, lambda x: F.size(F.filter(known, lambda t: F.contains(x, t)))), F.lit(0))


def with_terms(queries: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    return queries.withColumn("n_terms", term_count(F.col("text"), vocabulary))


def concept_count(query: Column) -> Column:
    """Concepts of a query, two at most: the sides of a comparison, else its terms, else its capitalised words."""
    named = F.size(F.filter(_words(query), lambda w: w.rlike(r"^\p{Lu}.{2,}")))
    return F.when(comparison(query).isNotNull(), 2).when(term_count(query) > 0, F.least(F.lit(2), term_count(query))).otherwise(F.least(F.lit(2), named))


def bare(text: Column) -> Column:
    """Lower case, without marks at the end: `Why?` is an incomplete query like `why`."""
    return F.lower(F.regexp_replace(F.trim(text), r"[?!.,;:\s]+$", ""))


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda rest, rule: F.when(text.rlike(rule[1]), rule[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def intent(text: Column) -> Column:
    """The first of eleven intents whose pattern is the whole query; a comparison within it; a follow-up; else null."""
    low = bare(text)
    either = F.lower(text).rlike(COMPARE) | F.lower(text).rlike(DIFFER)
    return F.coalesce(_first(low, INCOMPLETE), F.when(either, "comparison"), F.when(is_follow_up(text), "elaboration"))


def is_follow_up(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (bare(text).rlike(p) for p in FOLLOW_UPS))


def completeness(text: Column, n_terms: Column) -> Column:
    """Why a query stands by itself or does not: the first rule that holds."""
    words = F.size(_words(text))
    incomplete = _first(bare(text), INCOMPLETE).isNotNull()
    return (
        F.when(n_terms > 0, "contains_technical_term").when(words >= 8, "long_query").when(text.rlike(PRONOUNS), "contains_pronoun").when(incomplete, "incomplete_pattern")
        .when(words >= 5, "medium_query_no_pronouns").when(F.trim(text).endswith("?") & (words >= 4), "question_with_content").otherwise("too_short_or_vague")
    )


COMPLETE = ["contains_technical_term", "long_query", "medium_query_no_pronouns", "question_with_content"]


def state(turns: DataFrame, by: str = "conv_id", order: str = "turn", history: int = 20) -> DataFrame:
    """Turns with what is known before each: levels (the last said of each), primary, recent concepts and entities, turns held.

    turns: by, order, role, text, and for assistant turns topic, concept, subconcept, entities (array); optional
    columns subject, module, chapter. A turn's own content does not count for it.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    window = Window.partitionBy(by).orderBy(order).rowsBetween(-history, -1)
    said = F.col("role") == "assistant"
    rows = turns
    for c in ("subject", "module", "chapter"):
        rows = rows.withColumn(f"known_{c}", F.last(c, True).over(before) if c in turns.columns else F.lit(None).cast("string"))
    for c in ("topic", "concept", "subconcept"):
        rows = rows.withColumn(f"known_{c}", F.last(F.when(said, F.nullif(c, F.lit(""))), True).over(before))
    entities = F.flatten(F.collect_list(F.when(said, F.col("entities"))).over(window))
    concepts = F.array_distinct(F.reverse(F.collect_list(F.when(said, F.nullif("concept", F.lit("")))).over(window)))
    rows = rows.withColumn("held", F.count(F.lit(1)).over(window)).withColumn("recent_entities", F.reverse(F.slice(F.reverse(entities), 1, 20))).withColumn("recent_concepts", F.slice(concepts, 1, 3))
    return rows.withColumn("primary", F.coalesce(*(F.col(f"known_{c}") for c in LEVELS)))


def summary() -> Column:
    """The known levels, from the widest, as one line."""
    parts = [F.concat(F.lit(f"{c.capitalize()}: "), F.col(f"known_{c}")) for c in reversed(LEVELS)]
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("No active context"))


def resolved(text: Column, primary: Column, entities: Column) -> Column:
    """Pronouns replaced: plural ones by the last two entities or the concept and its relations, others by an entity or the concept."""
    last = F.reverse(F.slice(F.reverse(entities), 1, 2))
    many = F.when(F.size(last) >= 2, F.concat(F.get(last, F.lit(0)), F.lit(" and "), F.get(last, F.lit(1)))).when(F.size(last) == 1, F.concat(F.get(last, F.lit(0)), F.lit(" and related concepts"))).otherwise(F.concat(primary, F.lit(" and related concepts")))
    one = F.coalesce(F.get(last, F.lit(0)), primary)
    # plural first; what is put in is marked, so that a pronoun within it is not replaced again
    out = F.regexp_replace(F.regexp_replace(text, PLURAL, "\u0001"), SINGULAR, "\u0002")
    return F.when(primary.isNull(), text).otherwise(F.replace(F.replace(out, F.lit("\u0001"), many), F.lit("\u0002"), one))


def comparison(text: Column) -> Column:
    """The canonical sentence of a comparison in the text; null without one."""
    plain = lambda c: F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_\s]", "")
    out = F.lit(None).cast("string")
    for pattern in (DIFFER, COMPARE):
        a, b = (plain(F.regexp_extract(text, f"(?i){pattern}", k)) for k in (1, 2))
        said = F.concat(F.lit("Compare "), a, F.lit(" and "), b, F.lit(" in detail. What are the key differences and similarities?"))
        out = F.when((a != "") & (b != ""), said).otherwise(out)
    return out


def _asking(templates: list[tuple[Column, str]], concept: Column) -> Column:
    return reduce(lambda rest, t: F.when(t[0], F.concat(*(concept if k % 2 else F.lit(p) for k, p in enumerate(t[1].replace("{concept}", "\0{concept}\0").split("\0")) if p))).otherwise(rest), reversed(templates), F.lit(None).cast("string"))


def intent_query(text: Column, kind: Column, primary: Column) -> Column:
    """What the intent asks about the known concept; null where nothing is known (but a comparison can always be asked)."""
    about = _asking([(kind == k, t) for k, t in ASKS.items()], primary)
    compared = F.concat(F.lit("Compare "), F.coalesce(primary, F.lit("this")), F.lit(" and related concepts in detail."))
    return F.when(kind == "comparison", compared).otherwise(F.when(primary.isNotNull(), about))


def follow_up_query(text: Column, primary: Column) -> Column:
    low = bare(text)
    out = F.coalesce(_asking([(low.rlike(p), t) for p, t in FOLLOWED], primary), F.concat(F.lit("Explain "), primary, F.lit(" further.")))
    return F.when(is_follow_up(text) & primary.isNotNull(), out)


def keywords(text: Column) -> Column:
    """Words that are no stop words and of three characters or more, repeats included; the text itself without any."""
    kept = F.filter(_words(F.lower(text)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def rewritten(rows: DataFrame) -> DataFrame:
    """Rows of state() with n_terms: reason, self_contained, intent, query, rewrite_type, confidence, needs_agent, variants.

    The first of pronouns, comparison, intent and follow-up that changes an incomplete query rewrites it (a comparison
    overrides pronouns); an incomplete query that none changes needs an agent, and so does one of low confidence
    where something is known.
    """
    text = F.trim("text")
    out = rows.withColumn("text", text).withColumn("reason", completeness(F.col("text"), F.col("n_terms")))
    out = out.withColumn("self_contained", F.col("reason").isin(*COMPLETE)).withColumn("intent", F.when(~F.col("self_contained"), intent(F.col("text"))))
    out = out.withColumn("by_pronoun", resolved(F.col("text"), F.col("primary"), F.col("recent_entities")))
    out = out.withColumn("by_comparison", comparison(F.col("by_pronoun"))).withColumn("by_intent", intent_query(F.col("text"), F.col("intent"), F.col("primary"))).withColumn("by_follow_up", follow_up_query(F.col("text"), F.col("primary")))
    kind = (
        F.when(F.col("self_contained"), "none").when(F.col("by_comparison").isNotNull(), "comparison").when(F.col("by_pronoun") != F.col("text"), "pronoun")
        .when(F.col("by_intent") != F.col("text"), "intent").when(F.col("by_follow_up") != F.col("text"), "follow_up").otherwise("none")
    )
    out = out.withColumn("rewrite_type", kind)
    t = F.col("rewrite_type")
    out = out.withColumn("query", F.when(t == "comparison", F.col("by_comparison")).when(t == "pronoun", F.col("by_pronoun")).when(t == "intent", F.col("by_intent")).when(t == "follow_up", F.col("by_follow_up")).otherwise(F.col("text")))
    known, flag = F.col("primary").isNotNull(), lambda c: F.when(c, 1.0).otherwise(0.0)
    features = {"context": flag(known), "pronoun": flag(t == "pronoun"), "intent": flag(F.col("intent").isNotNull()), "terms": concept_count(F.col("query")) / 2.0, "length": F.least(F.lit(1.0), F.size(_words(F.col("query"))) / 8.0)}
    score = F.least(F.lit(0.95), sum((v * CONFIDENCE[k] for k, v in features.items()), F.lit(0.0)))
    out = out.withColumn("confidence", F.when(F.col("self_contained"), 1.0).otherwise(F.round(score, 6)))
    open_ = ~F.col("self_contained") & ((t == "none") | ((F.col("confidence") < 0.5) & known))
    words = keywords(F.col("query"))
    return out.withColumn("needs_agent", open_).withColumn("variants", F.array_distinct(F.array(F.col("text"), F.col("query"), words))).drop("by_pronoun", "by_comparison", "by_intent", "by_follow_up")


def route(rows: DataFrame, least_words: int = 2, least_confidence: float = 0.5) -> DataFrame:
    """clarification: very short and nothing known; agent: the rules gave up, or trust themselves little; else direct."""
    words, known = F.size(_words(F.col("text"))), F.col("primary").isNotNull()
    short = (words <= least_words) & ~known & (F.col("rewrite_type") == "none")
    return rows.withColumn("route", F.when(short, "clarification").when(F.col("needs_agent") | ((F.col("confidence") < least_confidence) & known), "agent").otherwise("direct"))


def agent_context() -> Column:
    """What an agent is given: the query before and after, the levels, recent concepts, a summary."""
    levels = F.struct(*(F.col(f"known_{c}").alias(c) for c in reversed(LEVELS)))
    return F.struct(F.col("text").alias("original_query"), F.col("query").alias("rewritten_query"), levels.alias("hierarchy"), "recent_concepts", summary().alias("summary"), F.col("reason"))


def cache_key() -> Column:
    """The key under which a rewrite may be kept: the query and what it depends on."""
    return F.md5(F.concat_ws("|", "text", *(F.coalesce(f"known_{c}", F.lit("")) for c in ("concept", "subconcept", "topic"))))


def agent_prompt(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """by, order, prompt: the turn after the last six, 200 characters each."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-6, -1)
    lines = F.collect_list(F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 200))).over(w)
    return turns.select(by, order, F.concat_ws("\n", lines, F.concat(F.lit("query: "), F.coalesce("text", F.lit("")))).alias("prompt"))


#: What an agent may decide.
ACTIONS = ("direct_retrieve", "decompose", "clarify", "suggest_pipeline", "no_retrieval")


def decision(said: Column, query: Column) -> Column:
    """struct(action, search_query, confidence, n_sub_queries) from an agent's JSON; no answer, or none that parses, retrieves directly."""
    from fathomline.operators.answers import json_in

    body = json_in(said)
    get = lambda key: F.get_json_object(body, f"$.{key}")
    action = F.when(get("action").isin(*ACTIONS), get("action")).otherwise("direct_retrieve")
    subs = F.coalesce(F.size(F.from_json(get("sub_queries"), "array<string>")), F.lit(0))
    return F.struct(
        action.alias("action"), F.coalesce(get("search_query"), query).alias("search_query"),
        F.when(said.isNull(), 0.4).when(body.isNull(), 0.3).otherwise(F.coalesce(get("confidence").try_cast("double"), F.lit(0.7))).alias("confidence"), F.greatest(subs, F.lit(0)).alias("n_sub_queries"),
    )


Planner = Callable[[DataFrame], DataFrame]
