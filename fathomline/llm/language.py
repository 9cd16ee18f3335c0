"""Language identification (operator 7): interpolated Kneser-Ney character models.

One model of order ORDER per language. Counts of the highest order come from every training text; the lower orders
count the distinct characters before an n-gram, as Kneser-Ney wants it. A model is a set of sorted hash arrays, one
for each order, whose rows hold the interpolated log-probability (or the interpolation weight of a context) of
every language side by side: a character costs one search for all languages; only n-grams that no language has
go on to the next lower order. A text goes to the language of the lowest cross-entropy per character.

Calibration reads every training text: it sets the slope that turns differences of cross-entropy into a probability,
and per language the cross-entropy beyond which a text is not accepted.

Every n-gram of the training texts is in the model, however rare; the model grows with the variety of the input.

Null texts and texts without a letter are `und`; without training rows all are; repeated rows score alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, bounded_batches, crc_mod, map_batches

ORDER = 4
#: The slopes of which calibration takes the best.
SLOPES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
HOLD_OUT, FOLDS = 2, 4
#: Characters that are scored at once.
CHUNK = 1 << 18
_SPACE = 32


def _letter_codes() -> np.ndarray:
    """Code unit of each code point: letters up to 0xFFFF stand for themselves, the rest is space.

    Letters beyond share the 0x2100 units from 0xD800 on, where no letter of one unit stands.
    """
    out = np.full(sys.maxunicode + 1, _SPACE, np.uint16)
    letters = np.array([c for c in range(sys.maxunicode + 1) if chr(c).isalpha()])
    out[letters] = np.where(letters <= 0xFFFF, letters, 0xD800 + letters % 0x2100)
    return out


_CODES: np.ndarray | None = None


def codes(text: str) -> np.ndarray:
    """Lower-cased letters with single spaces between words; empty without a letter."""
    global _CODES
    if _CODES is None:
        _CODES = _letter_codes()
    raw = _CODES[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    space = raw == _SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    raw = raw[keep]
    if len(raw) and raw[-1] == _SPACE:
        raw = raw[:-1]
    return raw[1:] if len(raw) and raw[0] == _SPACE else raw


def grams(code: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A key for each character: itself and the order - 1 before it, 16 bits each; spaces pad the start."""
    padded = np.concatenate([np.full(order - 1, _SPACE, np.uint16), code, np.full(1, _SPACE, np.uint16)]).astype(np.uint64)
    out = np.zeros(len(code) + 1, np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | padded[k : k + len(out)]
    return out


def count(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n over all rows; a task sends each n-gram once."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def merge(lang: str) -> None:
            keys = np.concatenate([k for k, _ in held[lang]])
            n = np.concatenate([x for _, x in held[lang]])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[lang], sizes[lang] = [(keys[first], np.add.reduceat(n, first))], 0

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(lang_col).to_pylist(), as_texts(batch, text_col), strict=True):
                code = codes(text)
                if len(code):
                    texts.setdefault(lang, []).append(grams(code))
            for lang, some in texts.items():
                keys, n = np.unique(np.concatenate(some), return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                sizes[lang] = sizes.get(lang, 0) + len(keys)
                if sizes[lang] > 2_000_000:
                    merge(lang)
        for lang in held:
            merge(lang)
            keys, n = held[lang][0]
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))], names=["lang", "gram", "n"])

    rows = docs.select(lang_col, text_col).mapInArrow(run, "lang string,gram bigint,n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (sorted input), their sums and numbers of rows."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n, np.diff(np.append(first, len(keys)))


@dataclass
class Orders:
    """A language by order: n-grams with discounted shares, contexts with interpolation weights."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def kneser_ney(keys: np.ndarray, n: np.ndarray, order: int = ORDER) -> Orders:
    """keys sorted. Index 0 is the lowest order."""
    levels = [(keys, n.astype(np.float64))]
    for k in range(order - 1, 0, -1):
        shorter = np.sort(levels[0][0] & np.uint64((1 << (16 * k)) - 1))
        distinct, total, _ = _runs(shorter, np.ones(len(shorter)))
        levels.insert(0, (distinct, total))
    out = Orders()
    for k, (gram, c) in enumerate(levels):
        ones, twos = (c == 1).sum(), (c == 2).sum()
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = gram >> np.uint64(16)
        at, total, kinds = _runs(context, c)
        row = np.searchsorted(at, context)
        out.grams.append((gram, np.maximum(c - d, 0) / total[row]))
        out.contexts.append((at, d * kinds / total))
        if k == 0:  # below it lies the uniform distribution
            out.contexts[0] = (np.zeros(1, np.uint64), np.array([d * len(gram) / c.sum()]))
    return out


def _look(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


def _value(table: tuple[np.ndarray, np.ndarray], sought: np.ndarray, missing: float) -> np.ndarray:
    at, found = _look(table[0], sought)
    return np.where(found, table[1][at] if len(table[1]) else missing, missing)


def _probability(model: Orders, gram: np.ndarray, order: int) -> np.ndarray:
    """Interpolated probability of n-grams of this order (1 the lowest)."""
    if order == 0:
        return np.full(len(gram), 1 / 65536)
    low = gram & np.uint64((1 << (16 * (order - 1))) - 1) if order > 1 else gram
    rest = _probability(model, low, order - 1)
    share = _value(model.grams[order - 1], gram, 0.0)
    return share + _value(model.contexts[order - 1], gram >> np.uint64(16) if order > 1 else np.zeros(len(gram), np.uint64), 1.0) * rest


@dataclass
class Model:
    """grams[k], contexts[k]: sorted keys and, per language, log-probabilities or log-weights; of order k + 1."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    slope: float = 20.0
    limits: list[float] = field(default_factory=list)

    def logs(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probabilities, a column per language."""
        if order == 0:
            return np.full((len(gram), len(self.languages)), -np.log(65536), np.float32)
        keys, values = self.grams[order - 1]
        at, found = _look(keys, gram)
        out = values[at] if len(keys) else np.zeros((len(gram), len(self.languages)), np.float32)
        if not found.all():
            lost = np.flatnonzero(~found)
            g = gram[lost]
            below = self.logs(g & np.uint64((1 << (16 * (order - 1))) - 1) if order > 1 else g, order - 1)
            ck, cv = self.contexts[order - 1]
            cat, cfound = _look(ck, g >> np.uint64(16) if order > 1 else np.zeros(len(g), np.uint64))
            out[lost] = below + np.where(cfound[:, None], cv[cat] if len(ck) else 0.0, np.float32(0))
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character, nats, a row per text; nan without a letter."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            keys = np.concatenate([g for _, g in held])
            ends = np.cumsum([len(g) for _, g in held])
            sums = np.zeros((len(held), len(self.languages)))
            for a in range(0, len(keys), CHUNK):
                part = self.logs(keys[a : a + CHUNK]).astype(np.float64)
                owner = np.searchsorted(ends, np.arange(a, a + len(part)), side="right")
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sums[owner[first]] += np.add.reduceat(part, first, axis=0)
            for (i, g), s in zip(held, sums, strict=True):
                out[i] = -s / len(g)
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            code = codes(text)
            if len(code):
                held.append((i, grams(code)))
                size += len(code)
                if size >= CHUNK:
                    settle()
        if held:
            settle()
        return out


def build(counts: DataFrame) -> Model:
    """The model from lang, gram, n."""
    by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    table = counts.where(F.col("lang").isNotNull()).toArrow()
    lang = table.column("lang").to_pylist()
    gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    names = sorted(set(lang))
    where = np.array([names.index(x) for x in lang], np.int32) if lang else np.zeros(0, np.int32)
    for i, name in enumerate(names):
        k, c = gram[where == i], n[where == i]
        order = np.argsort(k)
        by[name] = (k[order], c[order])
    models = [kneser_ney(*by[name]) for name in names]
    grams_, contexts = [], []
    for k in range(ORDER if names else 0):
        union = np.unique(np.concatenate([m.grams[k][0] for m in models]))
        grams_.append((union, np.log(np.stack([_probability(m, union, k + 1) for m in models], axis=1)).astype(np.float32)))
        union = np.unique(np.concatenate([m.contexts[k][0] for m in models]))
        contexts.append((union, np.log(np.stack([_value(m.contexts[k], union, 1.0) for m in models], axis=1)).astype(np.float32)))
    return Model(names, grams_, contexts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From all rows with a language that are not held out."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, FOLDS) != HOLD_OUT))
    model = build(count(usable, text_col, lang_col))
    if model.languages:
        calibrate(model, usable, text_col, lang_col)
    return model


def calibrate(model: Model, usable: DataFrame, text_col: str, lang_col: str) -> None:
    """The slope of the least mean loss, and per language mean, spread and so limit of the cross-entropy, over every training text.

    A batch sends sums, a row a language; the driver gets one row a language.
    """
    shared = usable.sparkSession.sparkContext.broadcast(model)
    losses = [f"loss_{k}" for k in range(len(SLOPES))]

    def run(batch: pa.RecordBatch) -> dict | None:
        h = shared.value.entropies(as_texts(batch, text_col))
        at = {name: i for i, name in enumerate(shared.value.languages)}
        # a language none of whose texts has a letter is not in the model
        truth = np.array([at.get(x, -1) for x in batch.column(lang_col).to_pylist()])
        known = (truth >= 0) & ~np.isnan(h[:, 0])
        if not known.any():
            return None
        h, truth = h[known], truth[known]
        rows, own = np.arange(len(h)), h[np.arange(len(h)), truth]
        kinds, of = np.unique(truth, return_inverse=True)
        out: dict = {"lang": pa.array(kinds.astype(np.int64)), "n": pa.array(np.bincount(of)), "own": pa.array(np.bincount(of, own)), "squares": pa.array(np.bincount(of, own**2))}
        for name, slope in zip(losses, SLOPES, strict=True):
            z = -slope * (h - h.min(axis=1, keepdims=True))
            out[name] = pa.array(np.bincount(of, np.log(np.exp(z).sum(axis=1)) - z[rows, truth]))
        return out

    sums = map_batches(usable.select(lang_col, text_col), run, "lang bigint,n bigint,own double,squares double," + ",".join(f"{x} double" for x in losses))
    found = sums.groupBy("lang").agg(*(F.sum(x).alias(x) for x in ("n", "own", "squares", *losses))).collect()
    if not found:
        return
    model.slope = SLOPES[min(range(len(SLOPES)), key=lambda k: sum(r[losses[k]] for r in found))]
    model.limits = [float("inf")] * len(model.languages)
    for r in found:
        mean = r.own / r.n
        model.limits[r.lang] = mean + 4 * max(r.squares / r.n - mean * mean, 0.0) ** 0.5 + 0.1


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted (its cross-entropy is usual for that language), cross_entropy."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m, texts = shared.value, as_texts(batch, text_col)
        out: dict[str, list] = {k: [] for k in ("lang_pred", "score", "accepted", "cross_entropy")}
        for h in m.entropies(texts) if m.languages else [None] * len(texts):
            known = h is not None and not np.isnan(h[0])
            best = int(np.argmin(h)) if known else 0
            share = float(1 / np.exp(-m.slope * (h - h[best])).sum()) if known else 0.0
            for k, v in (("lang_pred", m.languages[best] if known else "und"), ("score", share), ("accepted", bool(known and (not m.limits or h[best] <= m.limits[best]))), ("cross_entropy", float(h[best]) if known else None)):
                out[k].append(v)
        return out | {id_col: batch.column(id_col)}

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} bigint,lang_pred string,score double,accepted boolean,cross_entropy double")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HOLD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")
