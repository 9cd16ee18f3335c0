"""Prompts: section classifiers, context strategies, templates, and a generation run with its error rows."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import answers

# Fixed values in this block: what shows a section, in order of precedence, and how sections are headed.
KEYWORDS = {
    "definition": ["definition", "defines", "is defined as"],
    "example": ["example", "e.g.", "for example", "illustration"],
    "formula": ["formula", "equation", "calculation", "="],
    "key_points": ["key point", "important", "key takeaway"],
    "explanation": ["explanation", "explains", "overview"],
}
EXAM = {
    "thesis": ["this means", "in essence", "therefore", "thus"],
    "evidence": ["according to", "data shows", "research indicates"],
    "examples": ["example", "for instance", "case study"],
    "conclusion": ["in conclusion", "to summarize", "overall"],
}
PARTS = ["beginning", "early", "middle", "late", "conclusion"]
HEADERS = {
    "definition": "## DEFINITION", "explanation": "## EXPLANATION", "example": "## EXAMPLE", "formula": "## FORMULA", "key_points": "## KEY POINTS", "general": "## ADDITIONAL INFORMATION", "thesis": "## THESIS",
    "evidence": "## EVIDENCE", "conclusion": "## CONCLUSION", "beginning": "## INTRODUCTION", "early": "## EARLY CONTEXT", "middle": "## MAIN CONTENT", "late": "## LATER DEVELOPMENT",
}


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _class(text: Column, rules: dict[str, list[str]], none: Column) -> Column:
    return reduce(lambda rest, k: F.when(_has(text, rules[k]), k).otherwise(rest), reversed(rules), none)


def by_metadata(chunk_type: Column, topic: Column, content: Column, rules: dict[str, list[str]] = KEYWORDS) -> Column:
    """By the chunk's type, else its topic, else the first 200 characters of its content."""
    null = F.lit(None).cast("string")
    kinds = [_class(F.lower(F.coalesce(c, F.lit(""))), rules, null) for c in (chunk_type, topic, F.substring(content, 1, 200))]
    return F.coalesce(*kinds, F.lit("general"))


def by_position(position: Column) -> Column:
    """Five chunks to a part, the rest in the last."""
    return F.get(F.array(*map(F.lit, PARTS)), F.least(F.floor(position / 5).cast("int"), F.lit(len(PARTS) - 1)))


def by_argument(content: Column) -> Column:
    return _class(F.lower(content), EXAM, F.lit("evidence"))


def header(section: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in HEADERS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, section), F.concat(F.lit("## "), F.upper(section)))


def assembled(chunks: DataFrame, by: str, section: Column | None, budget: int, order: str = "ord") -> DataFrame:
    """by, context, tokens, n_chunks, sections from chunks (by, order, citation, content).

    Chunks are taken in order while their tokens fit the budget, and end at the first that does not. Without a section
    they follow each other (minimal); else they stand under their section's header, sections in order of first use.
    """
    cited = F.when(F.coalesce("citation", F.lit("")) == "", F.col("content")).otherwise(F.concat_ws("\n", "citation", "content"))
    rows = chunks.withColumn("section", F.lit("all") if section is None else section).withColumn("shown", cited)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("t", T.token_count(F.col("shown"))).withColumn("running", F.sum("t").over(w)).where(F.col("running") <= budget)
    parts = kept.groupBy(by, "section").agg(F.min(order).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "shown"))), lambda x: x["shown"]), "\n\n" if section is not None else "\n\n---\n\n").alias("body"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    body = F.col("body") if section is None else F.concat(header(F.col("section")), F.lit("\n\n"), F.col("body"))
    whole = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("first", "section", body.alias("body")))).alias("p"), F.sum("t").alias("tokens"), F.sum("n").alias("n_chunks"))
    join = lambda f, sep: F.array_join(F.transform("p", lambda x: x[f]), sep)
    return whole.select(by, join("body", "\n\n").alias("context"), "tokens", "n_chunks", join("section", ",").alias("sections"))


def chronological(chunks: DataFrame, by: str, budget: int) -> DataFrame:
    """In order of position (0 where unknown), in parts of five."""
    at = F.coalesce("position", F.lit(0))
    rows = chunks.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(at, "ord")))
    return assembled(rows, by, by_position(at), budget)


# ---- templates ---------------------------------------------------------------------------------------------------

TEMPLATES: dict[str, tuple[str, str, str]] = {
    "grounded": ("1.0.0", "You answer from the given context only and cite it.{answer_hints}", "{context_header}\n\n{context}\n\nQuestion: {query}"),
    "simple": ("1.0.0", "You explain in plain words, with an example, from the given context.{answer_hints}", "{context}\n\nExplain: {query}"),
}


def load_templates(path: str) -> None:
    """Adds templates of a JSON file: name to version, system and user. A missing file or an empty text is an error."""
    for name, t in json.loads(Path(path).read_text()).items():
        if not t.get("system") or not t.get("user"):
            raise ValueError(f"template {name!r} is empty")
        TEMPLATES[name] = (t.get("version", "1.0.0"), t["system"], t["user"])


def template(name: str) -> tuple[str, str, str]:
    if name not in TEMPLATES:
        raise KeyError(f"no template {name!r}; known: {sorted(TEMPLATES)}")
    return TEMPLATES[name]


def hints(values: Column) -> Column:
    """A block of requirements from a map of hints; nothing if all are empty."""
    lines = F.filter(F.map_values(values), lambda v: F.coalesce(v, F.lit("")) != "")
    block = F.concat(F.lit("\n## ANSWER REQUIREMENTS\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, block).otherwise("")


def built(requests: DataFrame, name: str = "grounded") -> DataFrame:
    """requests (request_id, query, context, course, chapter, answer_hints) with system_prompt, user_prompt, full_prompt and token counts."""
    version, system, user = template(name)
    known = F.coalesce("course", F.lit("")) != ""
    values = {
        "context": F.col("context"), "query": F.col("query"), "course": F.col("course"), "chapter": F.col("chapter"), "answer_hints": hints(F.col("answer_hints")),
        "context_header": F.when(known, F.concat(F.lit("Context from: "), F.col("course"), F.lit(" - "), F.coalesce("chapter", F.lit("")))).otherwise(""),
    }
    rows = requests.withColumn("system_prompt", T.filled(system, values)).withColumn("user_prompt", T.filled(user, values))
    count = lambda c: T.token_count(F.col(c))
    full = F.concat(F.lit("[SYSTEM]\n"), F.col("system_prompt"), F.lit("\n\n[USER]\n"), F.col("user_prompt"))
    return rows.withColumns({
        "template_version": F.lit(version), "system_tokens": count("system_prompt"), "user_tokens": count("user_prompt"), "total_tokens": count("system_prompt") + count("user_prompt"),
        "full_prompt": full, "prompt_id": F.md5(F.concat_ws(":", "request_id", F.lit(name))),
    })


#: Modes and what they ask for.
MODES = {
    "context_aware": {"template": "grounded", "max_context_tokens": 3000, "citation_style": "inline"},
    "simple_explanation": {"template": "simple", "max_context_tokens": 2500, "citation_style": "inline"},
}


def generate(requests: DataFrame, mode: str = "context_aware", provider: str = "extractive", max_tries: int = 4) -> DataFrame:
    """request_id, answer, error_type, retry_after, is_daily_quota, tries of every request; what fails is a row, not an exception.

    An unknown mode gives rows of error_type `config`; a request without context or query is refused as `empty`. A
    provider that reports errors (column error) of kinds that pass is asked again, only for these rows.
    """
    keep = ["request_id", "answer", "error", "tries"]
    if mode not in MODES:
        rows = requests.select("request_id", F.lit("").alias("answer"), F.lit(f"unknown mode {mode}").alias("error"), F.lit(0).alias("tries"))
        return _outcome(rows, F.lit("config"))
    prompts = built(requests, MODES[mode]["template"])
    usable = (F.coalesce(F.trim("query"), F.lit("")) != "") & (F.coalesce(F.trim("context"), F.lit("")) != "")
    empty = prompts.where(~usable).select("request_id", F.lit("").alias("answer"), F.lit("no query or no context").alias("error"), F.lit(0).alias("tries"))
    asked = prompts.where(usable).select(F.col("request_id").alias("id"), "context", F.col("full_prompt").alias("prompt"), F.lit("").alias("citation"))
    call, open_, out = answers.get_provider("answer", provider), asked, []
    for k in range(1, max_tries + 1):
        got = call(open_)
        got = got if "error" in got.columns else got.withColumn("error", F.lit(None).cast("string"))
        rows = got.select(F.col("id").alias("request_id"), F.coalesce("answer", F.lit("")).alias("answer"), "error", F.lit(k).alias("tries"))
        passing = answers.error_kind(F.col("error")).isin("rate_limit", "timeout") & ~answers.daily_quota(F.col("error"))
        again = F.coalesce(passing, F.lit(False)) & F.lit(k < max_tries)
        out.append(rows.where(~again).select(*keep))
        if "error" not in call(open_.limit(0)).columns:
            break
        open_ = open_.join(rows.where(again).select(F.col("request_id").alias("again_id")), F.col("id") == F.col("again_id"), "left_semi")
    every = reduce(DataFrame.unionByName, [*out, empty.select(*keep)])
    return _outcome(every, F.when(F.col("tries") == 0, "empty").otherwise(answers.error_kind(F.col("error"))))


def _outcome(rows: DataFrame, kind: Column) -> DataFrame:
    return rows.select("request_id", "answer", kind.alias("error_type"), answers.retry_after(F.col("error")).alias("retry_after"), F.coalesce(answers.daily_quota(F.col("error")), F.lit(False)).alias("is_daily_quota"), "tries")
