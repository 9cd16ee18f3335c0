"""Benchmark decontamination (operator 1): prefix-filtered set join, exact over item-sized windows.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. A window
occurs only where all its shingles do, so for exact containment the necessary prefix is its one rarest shingle.
Shingles (SHINGLE words, or the whole of a shorter window) are ordered by their count in the documents, windows
are filed under their rarest one, and a document meets a window only through that shingle. Length and position
then bound the place (it must start `offset` words before and end within the document), and the words are
compared.

The item side is processed in blocks of about BLOCK_WINDOWS windows, each shipped to the executors as one table of
proven size; the document side is scanned map-side and never shuffled. A benchmark of one block takes one scan. Of
more blocks each is a scan of its own, in which a worker holds that block only and returns the hits of the few
documents that have any; they are joined at the end, on 128 bits of id and text.

Null texts have no words; documents without words are not hit; repeated items count under each item_id; repeated
documents give repeated rows; an empty benchmark hits nothing; a null item_id counts in n_items and stands as null in
item_ids (and not in a text made of them); columns beside the named ones are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, filter_batches, map_batches, plain_words, row_key

WIDTH, SHINGLE = 10, 2
#: Windows of one block: under 100 MB as a table in a Python worker.
BLOCK_WINDOWS = 100_000


def windows_of(items: Iterable[tuple[int, bytes]], width: int) -> dict[bytes, list[int]]:
    """Window text, words joined by a space, with the items that have it."""
    out: dict[bytes, set[int]] = {}
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            out.setdefault(b" ".join(words[i : i + width]), set()).add(item)
    return {w: sorted(s, key=str) for w, s in out.items()}


def _blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> Iterator[dict[bytes, list[int]]]:
    held: list[tuple[int, bytes]] = []
    n = 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = row[1].encode()
        n += max(1, len(plain_words(text)))
        held.append((row[0], text))
        if n >= BLOCK_WINDOWS:
            yield windows_of(held, width)
            held, n = [], 0
    if held:
        yield windows_of(held, width)


def _shingles(window: bytes) -> list[tuple[int, tuple[bytes, ...]]]:
    words = window.split(b" ")
    n = min(SHINGLE, len(words))
    return [(i, tuple(words[i : i + n])) for i in range(len(words) - n + 1)]


def corpus_counts(docs: DataFrame, shingles: set[tuple[bytes, ...]], text_col: str) -> dict[tuple[bytes, ...], int]:
    """How often these shingles stand in all documents; at most one row a shingle and task is sent."""
    if not shingles:
        return {}
    spark = docs.sparkSession
    singles = {s[0] for s in shingles if len(s) == 1}
    pairs = {s for s in shingles if len(s) == 2}
    heads = {s[0] for s in pairs} | singles
    shared = spark.sparkContext.broadcast((singles, pairs, heads))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles, pairs, heads = shared.value
        found: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch, text_col):
                words = plain_words(text)
                if singles:
                    found.update((w,) for w in words if w in singles)
                found.update(p for p in zip(words, words[1:], strict=False) if p in pairs)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k) for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["shingle", "n"])

    bounded_batches(spark)
    rows = docs.select(text_col).mapInArrow(run, "shingle binary,n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator()
    return {tuple(bytes(r[0]).split(b" ")): r[1] for r in rows}


def build_index(windows: dict[bytes, list[int]], counts: dict[tuple[bytes, ...], int]) -> dict:
    """Windows by their rarest shingle: (offset of that shingle, number of words, words, items)."""
    by: dict[tuple[bytes, ...], list] = {}
    for window, items in windows.items():
        offset, key = min(_shingles(window), key=lambda s: (counts.get(s[1], 0), s[1], s[0]))
        if counts.get(key, 0):  # a shingle that no document has: neither has one the window
            by.setdefault(key, []).append((offset, window.count(b" ") + 1, tuple(window.split(b" ")), items))
    return {"pairs": {k: v for k, v in by.items() if len(k) == 2}, "singles": {k[0]: v for k, v in by.items() if len(k) == 1}}


def match(words: list[bytes], index: dict) -> tuple[np.ndarray | None, set[int]]:
    """Hit words as a mask (None: none) and the items with occurring windows."""
    pairs, singles = index["pairs"], index["singles"]
    places = [(i, pairs[p]) for i, p in enumerate(zip(words, words[1:], strict=False)) if p in pairs] if pairs else []
    if singles:
        places += [(i, singles[w]) for i, w in enumerate(words) if w in singles]
    hit, items, n = None, set(), len(words)
    for i, filed in places:
        for offset, length, window, ids in filed:
            start = i - offset
            if start >= 0 and start + length <= n and tuple(words[start : start + length]) == window:
                if hit is None:
                    hit = np.zeros(n, bool)
                hit[start : start + length] = True
                items.update(ids)
    return hit, items


def _indexes(docs: DataFrame, benchmark: DataFrame, width: int, text_col: str, item_col: str, item_text: str) -> Iterator:
    """The index of each block of items, broadcast; the next is made when it is asked for."""
    for windows in _blocks(benchmark, width, item_col, item_text):
        counts = corpus_counts(docs, {s for w in windows for _, s in _shingles(w)}, text_col)
        yield docs.sparkSession.sparkContext.broadcast(build_index(windows, counts))


def _spans(hit: np.ndarray | None) -> list[int]:
    """Starts and ends of the runs of hit words, in turn."""
    if hit is None:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edges.tolist()


def _joined(spans: list[int]) -> int:
    """Words in the union of spans."""
    total = reach = 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


_COLUMNS = "n_words bigint,n_hit bigint,n_items bigint,item_ids array<bigint>,contaminated boolean"


def _row(out: dict[str, list], n_words: int, n_hit: int, items: Iterable) -> None:
    ids = sorted(items, key=str)
    for k, v in (("n_words", n_words), ("n_hit", n_hit), ("n_items", len(ids)), ("item_ids", ids), ("contaminated", n_hit > 0)):
        out.setdefault(k, []).append(v)


def _hits(keyed: DataFrame, block, name: str) -> DataFrame:
    """row, spans, items of the documents that a block hits, stored. keyed: row, text."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"row": [], "spans": [], "items": []}
        for row, text in zip(batch.column("row").to_pylist(), as_bytes(batch, "text"), strict=True):
            hit, items = match(plain_words(text), block.value)
            if hit is not None:
                for k, v in (("row", row), ("spans", _spans(hit)), ("items", sorted(items, key=str))):
                    out[k].append(v)
        return out

    return cut(map_batches(keyed, run, "row string,spans array<bigint>,items array<bigint>"), name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (array, sorted as strings), contaminated; a row per document."""
    blocks = _indexes(docs, benchmark, width, text_col, item_col, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {}
            for text in as_bytes(batch, text_col):
                words = plain_words(text)
                hit, items = match(words, first.value) if first else (None, set())
                _row(out, len(words), 0 if hit is None else int(hit.sum()), items)
            return out | {id_col: batch.column(id_col)}

        return map_batches(docs.select(id_col, text_col), run, f"{id_col} bigint,{_COLUMNS}")

    keyed = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    hits = [_hits(keyed, block, f"block_hits_{k}") for k, block in enumerate(chain([first, second], blocks))]
    # a row of each block and document with hits; equal rows of docs have equal hits
    every = reduce(DataFrame.unionByName, hits).groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    every = every.select(F.col("row").alias("of_row"), "spans", "items")

    def merge(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {}
        for n, spans, items in zip(*(batch.column(c).to_pylist() for c in ("n", "spans", "items")), strict=True):
            _row(out, n, _joined(spans or []), set(items or []))
        return out | {id_col: batch.column(id_col)}

    def count(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(id_col), "row": batch.column("row"), "n": [len(plain_words(t)) for t in as_bytes(batch, "text")]}

    sized = map_batches(docs.select(id_col, row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")), count, f"{id_col} bigint,row string,n bigint")
    joined = sized.join(every, F.col("row") == F.col("of_row"), "left").select(id_col, "n", "spans", "items")
    return map_batches(joined, merge, f"{id_col} bigint,{_COLUMNS}")


def digest(result: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.col("item_ids").cast("array<string>"))
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window occurs. Of several blocks each is a filter of its own,
    stored, so that a worker holds one at a time."""
    blocks = _indexes(docs, benchmark, width, text_col, item_col, item_text)
    held, later = next(blocks, None), next(blocks, None)
    if held is None:
        return docs
    while True:
        docs = filter_batches(docs, functools.partial(_untouched, held, text_col))
        if later is None:
            return docs
        docs = cut(docs, "untouched")
        held, later = later, next(blocks, None)


def _untouched(block, text_col: str, batch: pa.RecordBatch) -> list[bool]:
    return [match(plain_words(text), block.value)[0] is None for text in as_bytes(batch, text_col)]
