"""Quality rules (operator 9): adaptive thresholds from mergeable quantile sketches, native.

Measures of each text are taken in one scan and stored. KLL sketches of them, over texts that pass the base rules,
are aggregated for each language and source, and merged for each language and for the whole table. A fence stands
GAP spreads beyond the quartiles. The spread is the interquartile range; of the shares, which most texts have at
zero, the distance from the median to the quantile TAIL, where that is more. A spread is at least a small EPSILON, so
that a group in which a measure does not vary does not reject for nothing. The fence of a group of n texts is its own
with the weight n / (n + PRIOR) and its language's with the rest, and that of a language likewise its own and the
whole table's: small groups lean on their language, without a size at which the rule changes. High fences, which are
positive, are averaged as logarithms. Without any text there is no fence. Texts outside a fence are not kept.

Words stand between white space. A window of 5 words counts as found again by the 64-bit hash of its words.

Null texts have no words; they and texts under 10 words fail the base rules. A null language or source is a group
of its own. Repeated rows get repeated results; columns beside the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .line_dedup import spaced

WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
PRIOR, GAP, TAIL, SKETCH_K = 20, 4.0, 0.9, 200
#: Measure: the least spread, and whether it is a share (the tail counts as spread; no lower fence).
EPSILON = {"symbol_share": (0.01, True), "dup_line_share": (0.01, True), "repeat_share": (0.01, True), "mean_word": (0.1, False)}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id, also, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, *also, text.alias("text"), spaced(text).alias("flat"))
    lines = F.filter(F.split("flat", "\n"), lambda x: F.trim(x) != "")
    symbols = F.when(F.col("text").rlike(r"[#*$%&|<>]"), F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).otherwise(0)
    one = F.replace("flat", F.lit("\n"), F.lit(" "))
    # lines are compared as they are: "flat" differs from the text only where white space does
    raw_lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(id_col, *also, symbols.cast("bigint").alias("n_symbols"), F.when(F.col("text") == F.col("flat"), lines).otherwise(raw_lines).alias("lines"), one.alias("flat"))
    rows = rows.select(
        id_col, *also, "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length(F.replace("flat", F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
        F.array_remove(F.split("flat", " "), "").alias("w"),
    )
    at = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))))
    rows = rows.select(id_col, *also, "n_symbols", "n_dup_lines", "word_chars", F.size("w").cast("bigint").alias("n_words"), hashes.alias("h"))
    again = F.size(F.array_distinct("h")) < F.size("h")
    # only texts with a repeated window go on: windows sorted by hash show their equals as neighbours
    pairs = F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(id_col, *also, "n_symbols", "n_dup_lines", "word_chars", "n_words", pairs.alias("s"))
    starts = F.sort_array(F.transform(F.filter("s", lambda x, k: (F.get("s", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("s", F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))), lambda x: x["i"]))
    rows = rows.select(id_col, *also, "n_symbols", "n_dup_lines", "word_chars", "n_words", starts.alias("p"))
    steps = F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW))).cast("bigint"))
    covered = F.when(F.col("p").isNull(), F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return rows.select(id_col, *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def _shares() -> dict[str, Column]:
    words = F.col("n_words").cast("double")
    return {"symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars").cast("double"), F.lit(1.0)), "dup_line_share": F.col("n_dup_lines") / F.greatest(words, F.lit(1.0)) * 10, "repeat_share": F.col("n_repeat_words") / F.greatest(words, F.lit(1.0)), "mean_word": F.col("word_chars") / F.greatest(words, F.lit(1.0))}


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def thresholds(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """group_lang, group_source, low_*, high_*: fences of each language and source, null where no text passes the base rules."""
    good = ~_base_failed()
    sketched = measured.groupBy(F.col(lang_col).alias("group_lang"), F.col(source_col).alias("group_source"))
    by = cut(sketched.agg(F.count_if(good).alias("n"), *(F.kll_sketch_agg_double(F.when(good, c), F.lit(SKETCH_K)).alias(m) for m, c in _shares().items())), "sketches")

    def merged(prefix: str) -> list[Column]:
        return [F.sum("n").alias(f"{prefix}_n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(f"{prefix}_{m}") for m in EPSILON)]

    lang = by.groupBy(F.col("group_lang").alias("of")).agg(*merged("lang"))
    rows = by.join(lang, F.col("group_lang").eqNullSafe(F.col("of"))).crossJoin(F.broadcast(by.agg(*merged("all"))))
    rows = rows.select("group_lang", "group_source", *(F.when(F.col(f"{p}n") > 0, F.col(f"{p}n")).alias(f"{p}n") for p in ("", "lang_", "all_")), *(_fences(m, p) for m in EPSILON for p in ("", "lang_", "all_")))
    out = []
    for m in EPSILON:
        own, wider, whole = (F.col(f"{p}{m}") for p in ("", "lang_", "all_"))
        for side, to, back in (("high", F.log, F.exp), ("low", lambda x: x, lambda x: x)):
            near = _leaning(to(wider[side]), to(whole[side]), F.col("lang_n"))
            out.append(back(_leaning(to(own[side]), near, F.col("n"))).alias(f"{side}_{m}"))
    return rows.select("group_lang", "group_source", *out)


def _fences(measure: str, prefix: str) -> Column:
    """Of one sketch: struct of high and low; null where it is of no text."""
    least, share = EPSILON[measure]
    sketch = F.when(F.col(f"{prefix}n") > 0, F.col(f"{prefix}{measure}"))
    q1, q2, q3, tail = (F.kll_sketch_get_quantile_double(sketch, F.lit(x)) for x in (0.25, 0.5, 0.75, TAIL))
    spread = F.greatest(q3 - q1, F.lit(least), *([tail - q2] if share else []))
    low = F.lit(float("-inf")) if share else q1 - spread * GAP
    return F.struct((q3 + spread * GAP).alias("high"), low.alias("low")).alias(f"{prefix}{measure}")


def _leaning(own: Column, wider: Column, n: Column) -> Column:
    """own with the weight n / (n + PRIOR), wider with the rest; without n all of wider."""
    return F.when(n.isNull(), wider).otherwise((own * n + wider * PRIOR) / (n + PRIOR))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the measures, base_failed, kept, failed (measures outside their fences)."""
    measured = cut(measures(docs, id_col, text_col, (lang_col, source_col)), "measures")
    fences = thresholds(measured, lang_col, source_col)
    rows = measured.join(fences, F.col(lang_col).eqNullSafe(F.col("group_lang")) & F.col(source_col).eqNullSafe(F.col("group_source")), "left")
    out = {m: F.when((c > F.col(f"high_{m}")) | (c < F.col(f"low_{m}")), F.lit(m)) for m, c in _shares().items()}
    rows = rows.withColumn("failed", F.array_compact(F.array(*out.values())))
    base = _base_failed()
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"))
