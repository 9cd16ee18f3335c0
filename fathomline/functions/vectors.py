"""Vectors: a deterministic embedding, and exact nearest neighbours as block products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

DIM = 64
#: Bytes of one block of query vectors; each block is shipped to the executors and is one scan of the vectors.
QUERY_BYTES = 32 << 20
#: Digits of a score by which neighbours are ranked; equal ones go by id.
DIGITS = 9
#: Queries and vectors that are multiplied at once, rows that wait to be sorted in, and rows of one batch of a result.
TILE, PENDING, ROWS_OUT = 1024, 1 << 20, 1 << 16
#: Rows and bytes of one Arrow batch: together they bound what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of no more than BATCH_ROWS rows and about BATCH_BYTES; smaller settings stay. Spark reads them when a plan runs."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


@lru_cache(maxsize=200_000)
def _dimension(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % DIM


def embed(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """vec_id, embedding: how many words of the text hash (MD5) to each dimension. Texts without a word have none.

    It stands in for a model, is deterministic and can be written as SQL; a provider of real vectors has its schema.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w")
            # a word becomes a Python object once a batch, however often it stands there
            coded = words.flatten().dictionary_encode()
            dims = np.array([_dimension(w) for w in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
            out = np.bincount(row * DIM + dims[coded.indices.to_numpy()], minlength=batch.num_rows * DIM).astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * DIM, DIM, dtype=np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), values], names=["vec_id", "embedding"])

    bounded_batches(rows.sparkSession)
    words = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), T.tokens(text).alias("w")).where(F.size("w") > 0)
    return words.mapInArrow(run, "vec_id bigint, embedding array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Top:
    """The k best of each of n queries, by score, then id. Holds k a query and about PENDING rows that are not sorted in yet."""

    def __init__(self, n: int, k: int):
        self.k, self.pending = k, 0
        #: Score and id of the k-th row of each query.
        self.least, self.last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]

    def add(self, query: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        least = self.least[query]
        better = (score > least) | ((score == least) & (own < self.last[query]))
        self.held.append((query[better], score[better], own[better]))
        self.pending += int(better.sum())
        if self.pending > PENDING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, own = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((own, -score, query))
        query, score, own = query[order], score[order], own[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        query, score, own, place = query[keep], score[keep], own[keep], place[keep]
        full = place == self.k - 1
        self.least[query[full]], self.last[query[full]] = score[full], own[full]
        self.held, self.pending = [(query, score, own)], 0
        return self.held[0]


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    rows: list[list[float]] = []
    size = 0
    for q, v in queries.toLocalIterator():
        ids.append(q)
        rows.append(v)
        size += 8 * len(v)
        if size >= QUERY_BYTES:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def scan(batches: Iterable[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, q_norm: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, score: the k best of these vectors for each query, TILE by TILE."""
    top = _Top(len(ids), k)
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            v, own = _matrix(part.column("embedding")), part.column("vec_id").to_numpy()
            norm = np.sqrt((v**2).sum(axis=1))
            for a in range(0, len(ids), TILE):
                raw = q[a : a + TILE] @ v.T
                raw /= q_norm[a : a + TILE, None] * norm + 1e-6
                floor = top.least[a : a + TILE]
                if len(own) > k and np.isinf(floor).any():
                    floor = np.maximum(floor, np.partition(raw, len(own) - k, axis=1)[:, len(own) - k])
                # scores that are equal when rounded differ by less than a unit of the last digit
                i, j = np.nonzero(raw >= (floor - 2 * 10.0**-DIGITS)[:, None])
                top.add(i + a, np.round(raw[i, j], DIGITS), own[j])
            if np.isinf(top.least).any():
                top.settle()
    query, score, own = top.settle()
    for a in range(0, len(query), ROWS_OUT):
        part = slice(a, a + ROWS_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(ids[query[part]]), pa.array(own[part]), pa.array(score[part])], names=["query_id", "vec_id", "score"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors of the largest cosine for every query, exact.

    queries (query_id, embedding) is a stated set, taken in blocks of bounded bytes; the vectors (vec_id, embedding)
    are scanned once a block, multiplied as matrices of TILE rows, and every task keeps k a query: what a task holds
    follows QUERY_BYTES and k, not the vectors. All of one dimension; null vectors are left out.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    found = []
    for ids, matrix in _blocks(queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>"))):
        shared = spark.sparkContext.broadcast((ids, matrix, np.sqrt((matrix**2).sum(axis=1))))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from scan(batches, *shared.value, k)

        some = vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
        found.append(some.mapInArrow(run, "query_id bigint, vec_id bigint, score double"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
