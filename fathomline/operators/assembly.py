"""Budgeted assembly of contexts, sections and their order, boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import context as C

CUT_MARK = "[...]"
# Fixed values in this block: the order of sections in a template, labels that differ from the section's name, and
# the patterns of each section, in order of precedence (^ is the start of the text).
ORDERS = {
    "learning": ["definition", "explanation", "example", "formula", "diagram", "important_notes", "general"],
    "revision": ["keyword", "formula", "important_notes", "definition", "general"],
    "qa": ["question", "answer", "marks", "explanation", "general"],
    "planner": ["topic", "weightage", "subtopics", "difficulty", "general"],
    "quiz": ["concept", "question", "answer", "distractors", "general"],
    "comparison": ["item_a", "item_b", "differences", "similarities", "general"],
    "raw": [],
}
LABELS = {
    "learning": {"important_notes": "KEY POINTS", "general": "ADDITIONAL INFORMATION"},
    "revision": {"keyword": "KEYWORDS", "formula": "FORMULAS", "important_notes": "KEY POINTS", "definition": "QUICK DEFINITION", "general": "NOTES"},
    "qa": {"marks": "MARK SCHEME", "general": "NOTES"},
    "planner": {"general": "NOTES"},
    "quiz": {"answer": "CORRECT ANSWER", "general": "NOTES"},
    "comparison": {"general": "NOTES"},
    "raw": {},
}
PATTERNS = {
    "definition": [r"^is a", r"^are", r"^refers to", r"^defined as", r"^means", r"is defined as"],
    "example": [r"^for example", r"^e\.g\.", r"^consider", r"^suppose", r"^example:"],
    "formula": [r"=", r"formula", r"equation", r"^[A-Z][a-z]+ ="],
    "important_notes": [r"^note:", r"^important:", r"^key point", r"^remember", r"exam tip"],
}


def section(content: Column, chunk_type: Column | None = None, patterns: dict[str, list[str]] = PATTERNS) -> Column:
    """The chunk's type if it is a section; else the first section with a pattern that the text has, ignoring case; else general."""
    out = F.lit("general")
    for name in reversed(patterns):
        out = F.when(content.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns[name])), name).otherwise(out)
    return out if chunk_type is None else F.when(chunk_type.isin(*patterns), chunk_type).otherwise(out)


def label(name: Column, template: str) -> Column:
    known = {**{k: k.upper().replace("_", " ") for k in ORDERS[template]}, **LABELS[template]}
    out = F.upper(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), name), out) if known else out


def precedence(name: Column, template: str) -> Column:
    """Place of a section in the template's order, after all of them if it has none."""
    order = ORDERS.get(template, [])
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), name), F.lit(0)), F.lit(len(order) + 1)) if order else F.lit(1).cast("bigint")


def display(content: Column, prefix: Column, citation: Column, strip: bool = True) -> Column:
    """The content without its source prefix, under its citation."""
    bare = F.when((F.coalesce(prefix, F.lit("")) != "") & content.startswith(prefix), F.trim(F.substr(content, F.length(prefix) + 1))).otherwise(content)
    return F.concat_ws("\n", F.nullif(citation, F.lit("")), bare if strip else content)


def metadata_header(course: Column, chapter: Column) -> Column:
    """Of the first chunk; nothing if neither is known."""
    known = (F.coalesce(course, F.lit("")) != "") | (F.coalesce(chapter, F.lit("")) != "")
    name = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    return F.when(known, F.concat(F.lit("Course: "), name(course, "Unknown Course"), F.lit(" | Chapter: "), name(chapter, "Unknown Chapter"))).otherwise("")


def estimated_size(chunks: DataFrame, by: str, header: Column) -> DataFrame:
    """by, tokens: of the header and all contents; separators add nothing."""
    rows = chunks.groupBy(by).agg(F.sum(T.token_count(T.tidy(F.col("content")))).alias("t"), F.first(header).alias("h"))
    return rows.select(by, (F.col("t") + T.token_count(F.col("h"))).alias("tokens"))


def selected(chunks: DataFrame, by: str, template: str, most: int = 5) -> DataFrame:
    """chunks (by, chunk_id, score, section, page, chapter, chunk_type) sorted for a template, spread over sources, cut at `most`.

    Column ord: the best of each source in turn (a source is a page, else a chapter, else a type; in order of first
    use); within one source the template's order and then the score.
    """
    w = Window.partitionBy(by).orderBy(precedence(F.col("section"), template), F.col("score").desc(), "chunk_id")
    rows = chunks.withColumn("sorted", F.row_number().over(w))
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = rows.withColumn("origin", F.coalesce(F.concat(F.lit("page_"), blank("page")), F.concat(F.lit("chapter_"), blank("chapter")), F.concat(F.lit("type_"), blank("chunk_type")), F.lit("unknown")))
    g = Window.partitionBy(by, "origin")
    rows = rows.withColumn("first_use", F.min("sorted").over(g)).withColumn("turn", F.row_number().over(g.orderBy(F.col("score").desc(), "sorted")))
    groups = F.max("first_use").over(Window.partitionBy(by)) == 1
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.when(F.col("single"), F.col("sorted")).otherwise(F.col("turn")), "first_use"))
    return rows.withColumn("single", groups).withColumn("ord", place).where(F.col("ord") <= most).drop("sorted", "first_use", "turn", "single")


def _leading(text: str, budget: int) -> str:
    if budget <= 0 or not text:
        return ""
    kept: list[str] = []
    used = 0
    for s in re.split(T.SENTENCE_END, text):
        if used + len(s) // 4 > budget:
            break
        kept.append(s)
        used += len(s) // 4
    return " ".join(kept) if kept else text[: budget * 4] + "..."


def _assembled(items: list[dict], header: str, budget: int, separator: str) -> dict:
    """The context of one query's chunks, at most a few."""
    if len(header) // 4 > budget:
        return {"context": "", "used": 0, "n_chunks": 0, "truncated": True}
    parts, used, n, cut = [header] if header else [], len(header) // 4, 0, False
    sections: dict[str, list[dict]] = {}
    for x in items:
        sections.setdefault(x["section"], []).append(x)
    for chunks in sections.values():
        head = f"## {chunks[0]['label']}"
        size = len(head) // 4
        if used + size > budget:
            cut = True
            break
        held = [head]
        for x in chunks:
            if size + len(x["content"]) // 4 > budget - used:
                piece = _leading(x["content"], budget - used - size)
                if piece:
                    held.append(piece)
                    size += len(piece) // 4
                    n, cut = n + 1, True
                break
            held.append(x["content"])
            size += len(x["content"]) // 4
            n += 1
        if len(held) > 1:
            parts.append("\n".join(held))
            used += size
    return {"context": separator.join(parts) + CUT_MARK * cut, "used": used, "n_chunks": n, "truncated": cut}


def assemble(chunks: DataFrame, by: str, header: str, budget: int, template: str = "raw", separator: str = "\n\n") -> DataFrame:
    """by, context, used, n_chunks, truncated from chunks (section_ord, ord, section, content), a bounded number a query.

    A header beyond the budget gives an empty context. Sections carry their label; one whose label does not fit ends
    the context. A chunk that does not fit is cut at a sentence and ends its section; later sections are still tried.
    A mark follows a context that was cut. Separators are not counted.
    """

    @F.pandas_udf("context string, used long, n_chunks long, truncated boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_assembled(list(x), header, budget, separator) for x in batch], columns=["context", "used", "n_chunks", "truncated"])

    items = F.array_sort(F.collect_list(F.struct("section_ord", "ord", "section", label(F.col("section"), template).alias("label"), "content")))
    rows = chunks.groupBy(by).agg(items.alias("items"))
    return rows.select(by, run("items").alias("a")).select(by, "a.*")


def build(chunks: DataFrame, by: str, template: str = "learning", budget: int = 4000, most: int = 5) -> DataFrame:
    """The whole build: sections, order and spread, citations, cleaning, assembly; with citations and sections used.

    chunks: by, chunk_id, score, content, chunk_type, course, chapter, page, page_end, file_type, prefix.
    """
    rows = chunks.withColumn("section", section(F.col("content"), F.col("chunk_type")))
    first, last = T.display_int(F.col("page")), T.display_int(F.col("page_end"))
    rows = rows.withColumn("citation", C.citation(F.nullif("course", F.lit("")), F.nullif("chapter", F.lit("")), first, last, F.when(F.col("file_type") == "pptx", "Slide").otherwise("Page")))
    chosen = selected(rows, by, template, most)
    shown = T.tidy(display(F.col("content"), F.col("prefix"), F.col("citation")))
    chosen = chosen.withColumn("content", C.drop_repeated_lines(shown)).withColumn("place", precedence(F.col("section"), template))
    chosen = chosen.withColumn("section_ord", F.min(F.struct("place", "ord")).over(Window.partitionBy(by, "section")))
    context = assemble(chosen, by, "", budget, template)
    told = chosen.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "citation"))), lambda x: x["citation"]), ";").alias("citations"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"), F.count(F.lit(1)).alias("chunks_used"))
    return context.join(told, by)


def between_boundaries(parts: DataFrame, starts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Elements dealt to boundaries: by, start, n, first and last page; a boundary holds until the next one."""
    marked = parts.select(by, "elem_idx", "page", F.lit(None).cast("bigint").alias("start")).unionByName(starts.select(by, F.col("start").alias("elem_idx"), F.lit(None).cast("bigint").alias("page"), "start"))
    w = Window.partitionBy(by).orderBy("elem_idx", F.col("start").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = marked.withColumn("at", F.last("start", True).over(w)).where("start is null and at is not null")
    return dealt.groupBy(by, F.col("at").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
