"""Query expansion: vocabularies joined on words, variants, sub-queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T


def phrases(words: Column, n: int) -> Column:
    """All runs of n words, space-joined."""

    def runs(w: Column) -> Column:
        length = F.greatest(F.size(w) - (n - 1), F.lit(0))
        out = F.slice(w, F.lit(1), length)
        for i in range(1, n):
            out = F.zip_with(out, F.slice(w, F.lit(i + 1), length), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    return runs(words) if n == 1 else T.bound(words, runs)


def matches(queries: DataFrame, keys: list[str], vocabulary: DataFrame, n: int = 1) -> DataFrame:
    """keys, term, expansion: vocabulary terms of n words that stand in the text at word boundaries; an equi-join."""
    hits = queries.select(*keys, F.explode(F.array_distinct(phrases(T.tokens(F.col("text")), n))).alias("term"))
    return hits.join(vocabulary.select("term", "expansion"), "term")


def expanded(found: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """keys, n_hits, the first `most` distinct expansions in order of the terms' names, comma-joined."""
    rows = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"), F.collect_set("expansion").alias("all"))
    return rows.select(*keys, "n_hits", F.array_join(F.slice(F.array_sort("all"), 1, most), ",").alias("expansions"))


def related(edges: DataFrame) -> DataFrame:
    """concept, other, kind over relations read both ways, each once; of several kinds the first by name."""
    both = edges.select("concept", "other", "kind").unionByName(edges.select(F.col("other").alias("concept"), F.col("concept").alias("other"), "kind"))
    return both.where("concept <> other").groupBy("concept", "other").agg(F.min("kind").alias("kind"))


def without_marks(text: Column) -> Column:
    """An expanded query without labels, bars and parentheses."""
    out = F.regexp_replace(text, r"(?i)\b(related|context):", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\([^)]*\)", " "), r"\|", " "), r"\s+", " "))


def variants(*texts: Column) -> Column:
    """Distinct texts that are neither null nor blank, in order."""
    return F.array_distinct(F.filter(F.array(*(F.trim(t) for t in texts)), lambda t: t.isNotNull() & (t != "")))


def sub_queries(queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """A query split at ` and ` or `;`: keys, part, text, k of each part (evenly, at least 1)."""
    parts = F.filter(F.split("text", r"(?i)\s+and\s+|;"), lambda p: F.trim(p) != "")
    rows = queries.select(*keys, F.size(parts).alias("n"), F.posexplode(parts).alias("part", "piece"))
    return rows.select(*keys, F.col("part").cast("bigint").alias("part"), F.trim("piece").alias("text"), F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("n"))).cast("bigint").alias("k"))


# ---- expansion by a registry of concepts -------------------------------------------------------------------------

# Fixed values in this block: a small default registry, and strategy and terms by kind of question.
ACRONYMS = {
    "api": "application programming interface", "sdk": "software development kit", "ide": "integrated development environment", "ci": "continuous integration", "cd": "continuous deployment",
    "ai": "artificial intelligence", "ml": "machine learning", "dl": "deep learning", "nlp": "natural language processing", "llm": "large language model", "db": "database", "os": "operating system",
    "http": "hypertext transfer protocol", "json": "javascript object notation",
}
SYNONYMS = {
    "cache": ["cache memory", "caching", "cache hit", "cache miss"],
    "concurrency": ["parallelism", "multitasking", "race condition", "synchronization"],
    "encryption": ["cryptography", "cipher", "encoding", "decryption", "security"],
}
HIERARCHY = {"reliability": ["cache", "concurrency", "fault_tolerance"], "security": ["encryption", "authentication", "authorization"]}
RELATIONS = {"cache": ["concurrency", "performance"], "encryption": ["security", "authentication"]}
STRATEGIES = {"learning": ("balanced", 5), "revision": ("minimal", 2), "qa": ("balanced", 5), "planner": ("minimal", 2), "quiz": ("aggressive", 4)}


def neighbours(concept: str) -> list[str]:
    """Related concepts: relations, the others of its topic and the topic, synonyms; each once, in this order."""
    topic = [x for t, members in HIERARCHY.items() if concept in members for x in [*(m for m in members if m != concept), t]]
    return list(dict.fromkeys([*RELATIONS.get(concept, []), *topic, *SYNONYMS.get(concept, [])]))


def related_pairs() -> set[tuple[str, str]]:
    """Pairs of the registry's concepts that are related, both ways."""
    one = {(a, b) for a, v in (RELATIONS | SYNONYMS).items() for b in v} | {(a, b) for a, v in SYNONYMS.items() for b in RELATIONS.get(a, []) + v}
    one |= {(a, b) for members in HIERARCHY.values() for a in members for b in members if a != b} | {(a, t) for a, t in ACRONYMS.items()}
    return one | {(b, a) for a, b in one}


def acronyms_expanded(text: Column) -> Column:
    """`API key` becomes `API (application programming interface) key`."""
    known = F.create_map(*(F.lit(x) for kv in ACRONYMS.items() for x in kv))

    def one(w: Column) -> Column:
        full = F.try_element_at(known, F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_/]", "")))
        return F.when(full.isNull(), w).otherwise(F.concat(w, F.lit(" ("), full, F.lit(")")))

    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), one), " ")


def terms_added(text: Column, most: int) -> Column:
    """Terms the registry adds to a text: of each concept in it two synonyms, then two neighbours, that it does not have."""
    low = F.lower(text)
    groups = [(c, v[:2]) for c, v in SYNONYMS.items()] + [(c, neighbours(c)[:2]) for c in RELATIONS]
    found = [F.when(F.contains(low, F.lit(c)) & ~F.contains(low, F.lit(t)), F.lit(t)) for c, v in groups for t in v]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, most)


def concepts_in(text: Column) -> Column:
    known = list(dict.fromkeys([*SYNONYMS, *RELATIONS, *ACRONYMS]))
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(c)), F.lit(c)) for c in known)))


def context_added(concepts: Column, concept: Column, topic: Column, chapter: Column) -> Column:
    """struct(terms, confidence) of a conversation's levels that have to do with the query; an unrelated one lowers the confidence.

    Without a concept in the query only the topic is added, at 0.5; a chapter fills up under two terms, at 0.7.
    """
    pairs = F.array(*(F.lit(f"{a}|{b}") for a, b in sorted(related_pairs())))
    told = lambda c: F.coalesce(F.exists(concepts, lambda q: (q == F.lower(c)) | F.array_contains(pairs, F.concat(F.lower(c), F.lit("|"), q))), F.lit(False))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    near, wide = some(concept) & told(concept), some(topic) & ~topic.eqNullSafe(concept) & told(topic)
    held = F.array_compact(F.array(F.when(near, concept), F.when(wide, topic)))
    in_chapter = some(chapter) & told(chapter)
    filled = some(chapter) & ~in_chapter & (F.size(held) < 2)
    terms = F.slice(F.array_distinct(F.array_compact(F.array(F.when(near, concept), F.when(wide, topic), F.when(in_chapter | filled, chapter)))), 1, 3)
    factor = F.when(some(concept) & ~near, 0.8).otherwise(1.0) * F.when(some(topic) & ~topic.eqNullSafe(concept) & ~wide, 0.9).otherwise(1.0) * F.when(filled, 0.7).otherwise(1.0)
    alone = F.array_compact(F.array(F.when(some(topic), topic)))
    none = F.size(concepts) == 0
    return F.struct(F.when(none, alone).otherwise(terms).alias("terms"), F.when(none, F.when(some(topic), 0.5).otherwise(1.0)).otherwise(factor).alias("confidence"))


def unmarked(text: Column) -> Column:
    """Without labels, bars and parentheses; blanks stay as they are."""
    out = F.regexp_replace(F.regexp_replace(text, "related:", ""), "context:", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\|", ""), r"\([^)]*\)", ""))


def sparse_keywords(text: Column) -> Column:
    """Distinct words of over two characters (letters, digits, _ and /) that are no stop words, for keyword search; the text itself without any."""
    words = F.transform(F.split(F.lower(unmarked(text)), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_/]", ""))
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def expand(rows: DataFrame, strategy: str = "balanced", most: int = 5) -> DataFrame:
    """rows (text; topic, concept, chapter of the conversation) with expanded, keywords, query_variants, added, confidence.

    minimal keeps what the acronyms and terms gave, keywords_only its keywords; else marks and parentheses go again and
    added terms follow as context.
    """
    out = rows.withColumn("by_acronym", acronyms_expanded(F.col("text")))
    added = F.array().cast("array<string>") if strategy == "keywords_only" else terms_added(F.col("by_acronym"), most)
    out = out.withColumn("by_terms", added)
    out = out.withColumn("by_context", context_added(concepts_in(F.col("text")), F.col("concept"), F.col("topic"), F.col("chapter")))
    said = F.when(F.size("by_terms") > 0, F.concat("by_acronym", F.lit(" (related: "), F.array_join("by_terms", ", "), F.lit(")"))).otherwise(F.col("by_acronym"))
    more = F.col("by_terms") if strategy == "minimal" else F.concat("by_terms", "by_context.terms")
    if strategy == "minimal":
        expanded_ = said
    elif strategy == "keywords_only":
        expanded_ = sparse_keywords(said)
    else:
        expanded_ = F.when(F.size(more) > 0, F.concat(unmarked(said), F.lit(" | context: "), F.array_join(more, ", "))).otherwise(unmarked(said))
    out = out.withColumn("added", more).withColumn("expanded", expanded_).withColumn("keywords", sparse_keywords(F.col("expanded")))
    extra = [sparse_keywords(F.col("text"))] if strategy == "aggressive" else []
    out = out.withColumn("query_variants", F.array_distinct(F.array("text", "expanded", "keywords", *extra)))
    return out.withColumn("confidence", F.lit(1.0) if strategy == "minimal" else F.col("by_context.confidence")).drop("by_acronym", "by_terms", "by_context")


def expand_for(rows: DataFrame, preset: str) -> DataFrame:
    return expand(rows, *STRATEGIES.get(preset, ("balanced", 5)))
