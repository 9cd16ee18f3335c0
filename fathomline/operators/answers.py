"""Answers: cleaning, refusal, grounding, structured text from models, providers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Fixed value: the wording of a refusal.
REFUSAL = r"(?i)does not cover .{0,120}?in sufficient detail"

Provider = Callable[[DataFrame], DataFrame]
_PROVIDERS: dict[tuple[str, str], Provider] = {}


def provider(kind: str, name: str) -> Callable[[Provider], Provider]:
    """Registers a function from rows to rows as an embedding, answer or judge provider."""

    def register(f: Provider) -> Provider:
        _PROVIDERS[kind, name] = f
        return f

    return register


def get_provider(kind: str, name: str) -> Provider:
    if (kind, name) not in _PROVIDERS:
        raise KeyError(f"no {kind} provider {name!r}; known: {sorted(n for k, n in _PROVIDERS if k == kind)}")
    return _PROVIDERS[kind, name]


@provider("embedding", "hashed")
def hashed_vectors(rows: DataFrame, dim: int = 64) -> DataFrame:
    """id, dim, n: how many words of the text hash (MD5) to each dimension; a deterministic stand-in for a model."""
    words = rows.select("id", F.explode(T.tokens(F.col("text"))).alias("w"))
    at = F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("bigint") % dim
    return words.groupBy("id", at.alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@provider("answer", "extractive")
def extractive(rows: DataFrame, most: int = 2) -> DataFrame:
    """id, answer: the first sentences of the context, then its citation."""
    first = F.array_join(F.slice(T.sentences(F.col("context")), 1, most), " ")
    return rows.select("id", F.concat_ws(" ", first, F.col("citation")).alias("answer"))


@provider("judge", "coverage")
def faithfulness(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """id, faithfulness: share of the answer's sentences whose keywords the context covers; null without either."""
    context = F.lower("context")
    said = T.sentences(F.col("answer"))
    good = F.filter(said, lambda s: F.coalesce(T.covered_share(T.keywords(s), context), F.lit(0.0)) >= least)
    blank = (F.coalesce(F.trim("answer"), F.lit("")) == "") | (F.coalesce(F.trim("context"), F.lit("")) == "")
    return rows.select("id", F.when(~blank, F.size(good) / F.size(said)).alias("faithfulness"))


def ready(level: Column, used: Column, fallback: Column) -> Column:
    return (level != "low") & (used > 0) & ~fallback


def refused(is_ready: Column, action: Column, text: Column, error: Column) -> Column:
    return ~is_ready | (action == "low_confidence") | F.coalesce(text.rlike(REFUSAL), F.lit(False)) | error.isNotNull()


#: Blocks a model hides from its answer.
_HIDDEN = (r"(?is)\[HIDE\].*?\[/HIDE\]", r"(?is)<THINK>.*?</THINK>", r"(?is)<thinking>.*?</thinking>")


def clean(text: Column, most: int | None = None) -> Column:
    """No hidden blocks, no rule at the end, no blanks at line ends, at most two empty lines; cut at a word if longer than `most`."""
    out = F.coalesce(text, F.lit(""))
    for pattern in _HIDDEN:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"\n*---\s*$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+(\n|$)", "$1"), r"\n{4,}", "\n\n\n")
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    if most is None:
        return out
    short = F.regexp_replace(F.substring(out, 1, most), r" [^ ]*$", "")
    return F.when(F.length(out) > most, F.concat(short, F.lit("..."))).otherwise(out)


def grounded(answer: Column, context: Column, least: float = 0.3) -> Column:
    """struct(ratio, grounded, confidence): share of the answer's keywords that occur in the context."""
    ratio = F.coalesce(T.covered_share(T.keywords(answer), F.lower(context)), F.lit(0.0))
    return F.struct(ratio.alias("ratio"), (ratio >= least).alias("grounded"), F.least(F.lit(1.0), ratio / max(least, 0.1)).alias("confidence"))


def json_in(text: Column) -> Column:
    """The outermost {...} of a model's text, without commas before a closing bracket; null if there is none."""
    found = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.regexp_replace(found, r",\s*([}\]])", "$1")


def error_kind(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike("429|quota|rate limit"), "rate_limit").when(low.contains("timeout") | low.contains("timed out"), "timeout").when(message.isNotNull(), "error")


def daily_quota(message: Column) -> Column:
    """Whether a message says that a day's quota is used up: waiting seconds does not help then."""
    return F.lower(message).rlike(r"per ?day|daily|quota.{0,40}day")


def json_array_in(text: Column) -> Column:
    """The outermost [...] of a model's text, without commas before a closing bracket; null if there is none."""
    found = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    return F.regexp_replace(found, r",\s*([}\]])", "$1")


#: Dimensions, prices of a million tokens and most tokens of embedding models; `hashed` is the local default.
EMBEDDING_MODELS = {"hashed": {"dim": 64, "usd": 0.0, "max_tokens": 8191}}


def embedding_model(name: str) -> dict:
    if name not in EMBEDDING_MODELS:
        raise KeyError(f"no embedding model {name!r}; known: {sorted(EMBEDDING_MODELS)}")
    return EMBEDDING_MODELS[name]


def score_text(value: Column) -> Column:
    """Four digits, or n/a."""
    return F.coalesce(F.format_number(value, 4), F.lit("n/a"))


def retry_after(message: Column) -> Column:
    """Seconds in `retry after 12s`, `retry in 1.5 s`; null without."""
    return F.nullif(F.regexp_extract(message, r"(?i)retry (?:after|in) (\d+(?:\.\d+)?) ?s", 1), F.lit("")).cast("double")


def payload(value: Column, chars: int = 2000) -> Column:
    return F.substring(value, 1, chars)
