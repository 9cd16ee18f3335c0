"""Toxicity (operator 2): a factorization machine over hashed terms.

Terms are the distinct words of a text and their first PREFIXES characters, hashed into 2^BITS buckets. The
machine is fitted on a bounded sample of labelled rows: at most MAX_LABELLED, the ones of least id hash. It learns
every bucket that tells the classes apart beyond chance (chi-square of CHI_SQUARE or more, the level of 0.1 %) and,
since terms can matter in pairs that tell nothing alone, every bucket in the share COMMON or more of the sample; their
number has no bound of its own. Beside a weight each bucket has a RANK-vector; their inner products weigh pairs of
terms, so that a pair can matter that neither term alone reveals. Everything that is scored is scored whole, one scan,
with the model shipped as one small table.

Null or empty texts score by the bias alone; rows without id are never learned from; several labels of an id count
once each; of buckets of equal chi-square all are taken; without any label every score is 0; repeated rows of an id
are learned from as often as they stand; repeated rows score alike; columns beside the named ones are not
read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, filter_batches, map_batches, plain_words

BITS, PREFIXES, RANK = 20, (4, 5, 6), 4
MAX_LABELLED, CHI_SQUARE, COMMON = 16_000, 10.83, 0.1
#: Passes over the sample: EPOCHS, and as many as give STEPS steps.
EPOCHS, STEPS, BATCH, RATE, L2 = 8, 1500, 128, 0.05, 1e-5
HOLD_OUT, FOLDS = 0, 5


def term_buckets(word: bytes) -> set[int]:
    mask = (1 << BITS) - 1
    out = {zlib.crc32(b"w" + word) & mask}
    text = word.decode("utf-8", "replace")
    for n in PREFIXES:
        if len(text) >= n:
            out.add(zlib.crc32(b"%d" % n + text[:n].encode()) & mask)
    return out


@dataclass
class Model:
    """columns: bucket to its row in weights and vectors."""

    columns: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def terms(self, text: bytes) -> list[int]:
        """Rows of the model for the terms of a text."""
        if len(self.known) > 200_000:
            self.known.clear()
        found: set[int] = set()
        known = self.known
        for w in set(plain_words(text)):
            rows = known.get(w)
            if rows is None:
                rows = known[w] = tuple(self.columns[b] for b in term_buckets(w) if b in self.columns)
            if rows:
                found.update(rows)
        return sorted(found)

    def score(self, text: bytes) -> float:
        rows = self.terms(text)
        z = self.bias
        if rows:
            v = self.vectors[rows]
            z += float(self.weights[rows].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_matrix(rows: list[np.ndarray], y: np.ndarray, n: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss, both classes weighing the same overall within a factor of 4."""
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(n, np.float32), rng.normal(0, 0.01, (n, RANK)).astype(np.float32), 0.0
    gw, gv, gb = np.full(n, 1e-6, np.float32), np.full((n, RANK), 1e-6, np.float32), 1e-6
    rise = min(4.0, max(1.0, (len(y) - y.sum()) / max(1, y.sum())))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = np.zeros((len(some), n), np.float32)
            for i, r in enumerate(some):
                x[i, rows[r]] = 1
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            sums = x @ v[used]
            z = b + x @ w[used] + 0.5 * (sums**2 - x @ v[used] ** 2).sum(axis=1)
            t = y[some]
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * np.where(t == 1, rise, 1.0) / len(some)).astype(np.float32)
            dw = x.T @ g + L2 * w[used]
            dv = x.T @ (g[:, None] * sums) - v[used] * (x.T @ g)[:, None] + L2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += float(g.sum()) ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            b -= RATE * float(g.sum()) / gb**0.5
    return b, w, v


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    spark = docs.sparkSession
    usable = labels.where(F.col(label_col).isNotNull() & (crc_mod(id_col, FOLDS) != HOLD_OUT)).select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("y"))
    # at most max_labelled rows of two numbers: a proven bound for the broadcast
    chosen = usable.orderBy(F.xxhash64("of"), "of", "y").limit(max_labelled)

    def read(batch: pa.RecordBatch) -> dict:
        return {"y": batch.column("y"), "terms": [sorted(set().union(*map(term_buckets, set(plain_words(t))))) for t in as_bytes(batch, text_col)]}

    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("of"))
    terms = map_batches(rows.select("y", text_col), read, "y int,terms array<bigint>").persist()
    try:
        totals = {r["y"]: r["n"] for r in terms.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        pos, neg = totals.get(1, 0), sum(n for y, n in totals.items() if y != 1)
        if not pos or not neg:
            return Model({}, 40.0 if pos else -40.0, np.zeros(0, np.float32), np.zeros((0, RANK), np.float32))
        counted = terms.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("q"))
        p, q, rows_n = F.col("p"), F.col("q"), float(pos + neg)
        spread = F.pow(p * F.lit(float(neg)) - q * F.lit(float(pos)), F.lit(2)) * rows_n
        chi = F.try_divide(spread, (p + q) * (F.lit(rows_n) - p - q) * F.lit(float(pos) * float(neg)))
        told = counted.where((chi >= CHI_SQUARE) | (p + q >= COMMON * rows_n) | (p + q == rows_n))
        best = sorted(r["t"] for r in told.select("t").collect())
        columns = {t: i for i, t in enumerate(best)}
        shared = spark.sparkContext.broadcast(frozenset(columns))

        def slim(batch: pa.RecordBatch) -> dict:
            return {"y": batch.column("y"), "terms": [[t for t in x if t in shared.value] for x in batch.column("terms").to_pylist()]}

        got = map_batches(terms, slim, "y int,terms array<bigint>").toArrow()
    finally:
        terms.unpersist()
    bias, weights, vectors = fit_matrix(*_sample(got, np.array(best, np.int64)), len(columns))
    return Model(columns, bias, weights, vectors)


def _sample(got: pa.Table, best: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of the model for each text, and whether its label is 1; in the order of labels, then terms. The terms, sorted as best is, stay
    numbers of Arrow: as objects of Python those of MAX_LABELLED rows took more of the driver than all else there."""
    y = got.column("y").combine_chunks().to_numpy()
    lists = got.column("terms").combine_chunks()
    found = np.searchsorted(best, lists.flatten().to_numpy()).astype(np.int32)
    ends = np.cumsum(lists.value_lengths().to_numpy())
    rows = np.split(found, ends[:-1])
    # numbers of one width, the highest byte first, compare as lists of them do
    order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i].astype(">i4").tobytes()))
    return [rows[i] for i in order], (y[order] == 1).astype(np.float32)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = [shared.value.score(t) for t in as_bytes(batch, text_col)]
        return {id_col: batch.column(id_col), "score": found, "predicted": [int(x >= 0.5) for x in found]}

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} bigint,score double,predicted int")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HOLD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_batches(docs, lambda batch: [shared.value.score(t) < 0.5 for t in as_bytes(batch, text_col)])
