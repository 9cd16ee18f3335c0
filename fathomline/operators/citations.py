"""Citations in answers: scan, parse, format; and the whole post-processing of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators import answers
from fathomline.operators import context as C

_MARK = r"\[[^\]]+\]"
#: Fixed value: how a place is named in a citation; a colon may stand after the name.
_PLACE = r"{}s?:?\s*(\d+)(?:\s*[-–]\s*(\d+))?"


def scanned(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, i, raw, start, end: bracketed strings with a bar or a page or slide number, and where they stand (characters, from 0)."""
    marks, gaps = F.regexp_extract_all(text_col, F.lit(f"({_MARK})"), F.lit(1)), F.split(text_col, _MARK)
    found = rows.select(id_col, F.posexplode(F.transform(marks, lambda m, i: F.struct(m.alias("m"), (_lengths(gaps, i + 1) + _lengths(marks, i)).alias("at")))).alias("n", "x"))
    out = found.select(id_col, "n", F.substring("x.m", 2, 1 << 30).alias("rest"), F.col("x.at").alias("start"), F.length("x.m").alias("length"))
    out = out.select(id_col, "n", F.substr("rest", F.lit(1), F.col("length") - 2).alias("raw"), F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("length")).cast("bigint").alias("end"))
    kept = out.where(F.col("raw").contains("|") | F.col("raw").rlike(r"(?i)(slide|page)s?\s*\d+"))
    w = Window.partitionBy(id_col).orderBy("n")
    return kept.withColumn("i", F.row_number().over(w).cast("bigint")).drop("n")


def _lengths(texts: Column, n: Column) -> Column:
    return F.aggregate(F.slice(texts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))


def parsed(raw: Column) -> Column:
    """struct(course, chapter, kind, first, last) of a citation of three parts; null for fewer.

    A page overrides a slide, a section either; a section ends where it starts.
    """
    parts = F.transform(F.split(raw, r"\|"), lambda x: F.trim(x))
    place = F.lower(F.get(parts, F.lit(2)))

    def number(name: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(place, _PLACE.format(name), k), F.lit("")).cast("bigint")

    kinds = [(k, number(k, 1), F.coalesce(number(k, 2), number(k, 1)) if k != "section" else number(k, 1)) for k in ("section", "page", "slide")]
    pick = lambda f, none: F.coalesce(*(F.when(first.isNotNull(), f(k, first, last)) for k, first, last in kinds), F.lit(none))
    return F.when(
        F.size(parts) >= 3,
        F.struct(F.get(parts, F.lit(0)).alias("course"), F.get(parts, F.lit(1)).alias("chapter"), pick(lambda k, a, b: F.lit(k), "unknown").alias("kind"), pick(lambda k, a, b: a, 0).alias("first"), pick(lambda k, a, b: b, 0).alias("last")),
    )


def place(kind: Column, first: Column, last: Column) -> Column:
    """`Pages 1-2`, `Slide 3`, `Section 4`, `Chapter 5`, `Source`."""
    span = (last.isNotNull()) & (last != 0) & (last != first)
    def many(one: str) -> Column:
        return F.when(span, F.concat(F.lit(f"{one}s "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit(f"{one} "), first.cast("string")))
    return (
        F.when(kind == "page", many("Page")).when(kind == "slide", many("Slide")).when(kind == "section", F.concat(F.lit("Section "), first.cast("string")))
        .when(kind == "chapter", F.concat(F.lit("Chapter "), first.cast("string"))).otherwise("Source")
    )


def formatted(course: Column, chapter: Column, where: Column, style: str = "inline") -> Column:
    if style == "none":
        return F.lit("")
    if style == "inline":
        return F.concat(F.lit("["), course, F.lit(" | "), chapter, F.lit(" | "), where, F.lit("]"))
    return F.concat_ws(", ", course, chapter, where)


def post_processed(generated: DataFrame, chunks: DataFrame, context: DataFrame, least: float = 0.3) -> DataFrame:
    """answer_id, answer, n_citations, chunk_ids (of the citations in order, `-` unmatched), is_grounded, grounding, warnings.

    generated: answer_id, text; chunks: chunk_id, course, chapter, start, end; context: answer_id, context. The chain:
    clean, scan and parse citations, match them to chunks, measure grounding, warn.
    """
    clean = generated.select("answer_id", answers.clean(F.col("text")).alias("answer"))
    found = scanned(clean, "answer_id", "answer").withColumn("p", parsed(F.col("raw"))).where("p is not null")
    numbered = found.select("answer_id", "i", F.concat_ws("/", F.col("answer_id").cast("string"), F.col("i").cast("string")).alias("cite_id"), "p.*")
    matched = C.match_citations(numbered.select("cite_id", "course", "chapter", "first", "last"), chunks)
    named = numbered.join(matched.select("cite_id", "chunk_id"), "cite_id", "left").select("answer_id", F.struct("i", F.coalesce(F.col("chunk_id").cast("string"), F.lit("-")).alias("c")).alias("x"))
    cites = named.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_citations"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), ",").alias("chunk_ids"))
    rows = clean.join(cites, "answer_id", "left").join(context, "answer_id", "left")
    ground = answers.grounded(F.col("answer"), F.coalesce("context", F.lit("")), least)
    rows = rows.withColumn("g", ground).withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    unsure = F.concat(F.lit("Answer may not be fully grounded in context (confidence: "), F.format_number("g.confidence", 2), F.lit(")"))
    warnings = F.array_compact(F.array(F.when(F.col("n_citations") == 0, "No citations found in generated answer"), F.when(~F.col("g.grounded"), unsure)))
    return rows.select("answer_id", "answer", "n_citations", F.coalesce("chunk_ids", F.lit("")).alias("chunk_ids"), F.col("g.grounded").alias("is_grounded"), F.round("g.confidence", 4).alias("grounding"), warnings.alias("warnings"))
