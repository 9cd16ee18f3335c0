"""BPE encoding and decoding (operator 8).

A word's parts and the ranks of its adjacent pairs lie in two contiguous arrays. A step scans the ranks for
their (leftmost) minimum, deletes the boundary there and refreshes the two neighbouring ranks. Words of one
length share a matrix, a row each: every step takes one boundary from every unfinished row, so the matrix stays
rectangular. Words longer than LONG_WORD use the same steps with a heap, where a scan for each step would be
quadratic.

Nulls count as empty texts; an empty text has no ids; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_texts, map_batches

LONG_WORD = 192
#: Words kept with their ids by a Python worker; beyond, the table starts anew. Bounds memory, not results.
CACHE_WORDS = 500_000
_NONE = np.int32(2**31 - 1)
#: White space as the tokenizer's \s has it (fixed values).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


@functools.lru_cache(maxsize=3)
def _classes(top: int) -> tuple[str, str]:
    """Letters and numbers up to a code point by general category, as ranges for a character class."""
    out = {"L": [], "N": []}
    for c in range(top + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in out:
            runs = out[kind]
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return tuple("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out[k]) for k in "LN")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        if spec["decoder"] is not None or model["type"] != "BPE" or not end:
            raise ValueError("a BPE file with word ends and without decoder is needed")
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = text
        self.token_bytes = [x.encode() for x in tokens]
        self.ids_type = "<u2" if self.size <= 65536 else "<u4"
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.uint32 if self.size <= 65536 else np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        chars = _byte_chars()
        self.first_ids = np.array([vocab[c] for c in chars], np.int32)
        self.end_ids = np.array([vocab[c + end] for c in chars], np.int32)
        # a character class is a bit set only where it is small, so texts of a narrow range get a narrow pattern
        self.find = [re.compile("[{0}]+|[{1}]|'(?:s|t|re|ve|m|ll|d)|[^{2}{0}{1}]+".format(*_classes(top), _SPACE)).findall for top in (0xFF, 0xFFFF, sys.maxunicode)]
        self.controls = re.compile("[\x1c-\x1f]").search  # white space to str.split alone
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(self.keys.dtype) * self.keys.dtype.type(self.size) + right.astype(self.keys.dtype)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_rows(self, parts: np.ndarray) -> list[bytes]:
        """Packed ids of words that have the same number of parts, a row each."""
        out, size = [b""] * len(parts), np.dtype(self.ids_type).itemsize
        rows = np.arange(len(parts))
        ranks = np.full(parts.shape, _NONE, np.int32)
        if parts.shape[1] > 1:
            ranks[:, :-1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        while len(parts):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(parts)), at]
            done = least == _NONE
            if done.any():
                packed, step = parts[done].astype(self.ids_type).tobytes(), parts.shape[1] * size
                for k, r in enumerate(rows[done].tolist()):
                    out[r] = packed[k * step : k * step + step]
                go = ~done
                parts, ranks, rows, at, least = parts[go], ranks[go], rows[go], at[go], least[go]
                if not len(parts):
                    break
            n, every = parts.shape[1], np.arange(len(parts))
            parts[every, at] = self.merged[least]
            keep = np.ones(parts.shape, bool)
            keep[every, at + 1] = False
            parts = parts[keep].reshape(-1, n - 1)
            keep[every, at + 1] = True
            keep[every, at] = False
            ranks = ranks[keep].reshape(-1, n - 1)
            # ranks[at] is now that of the deleted right neighbour: refresh it and the one before
            inner = at < n - 2
            i, j = every[inner], at[inner]
            ranks[i, j] = self.pair_ranks(parts[i, j], parts[i, j + 1])
            ranks[every[~inner], at[~inner]] = _NONE
            before = at > 0
            i, j = every[before], at[before]
            ranks[i, j - 1] = self.pair_ranks(parts[i, j - 1], parts[i, j])
        return out

    def merge_long(self, parts: list[int]) -> bytes:
        n = len(parts)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        found = self.pair_ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(found) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = int(self.merged[rank]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r = int(self.pair_ranks(np.array([parts[x]]), np.array([parts[y]]))[0])
                    if r != _NONE:
                        heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p, ok in zip(parts, alive, strict=True) if ok], self.ids_type).tobytes()

    def learn(self, words: list[str]) -> None:
        """Put the ids of these words, which hold no line feed, into the table."""
        text = "\n".join([*words, ""]).encode("utf-8", "surrogatepass")
        raw = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            n = int(lengths[group[0]])
            rows = raw[starts[group][:, None] + np.arange(n)]
            parts = self.first_ids[rows]
            parts[:, -1] = self.end_ids[rows[:, -1]]
            ids = self.merge_rows(parts) if n <= LONG_WORD else [self.merge_long(p.tolist()) for p in parts]
            self.cache.update(zip(map(words.__getitem__, group.tolist()), ids, strict=True))

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case of each character by itself (the pattern skips white space)."""
        if text.isascii():
            return text.lower()
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def finder(self, text: str):
        try:
            text.encode("latin-1")
            return self.find[0]
        except UnicodeEncodeError:
            return self.find[2 if self.beyond(text) else 1]

    def chunks(self, text: str) -> list[str]:
        """Runs between white space: no word reaches over it, so ids are kept by run."""
        text = self.normal(text)
        return self.finder(text)(text) if self.controls(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as ids_type."""
        docs: list[list] = []
        for text in texts:
            if self.special and any(s in text for s in self.special):
                docs.append([x for piece in self.split(text) for x in ([self.special[piece]] if piece in self.special else self.chunks(piece))])
            else:
                docs.append(self.chunks(text))
        out, size, cache = [], np.dtype(self.ids_type).itemsize, self.cache
        for at in range(0, len(docs), 256):
            some = docs[at : at + 256]
            if len(cache) > CACHE_WORDS:
                cache.clear()
            fresh = set().union(*some).difference(cache)
            cache.update((i, i.to_bytes(size, "little")) for i in fresh if isinstance(i, int))
            words = [x for x in fresh if isinstance(x, str) and x.isalpha()]
            mixed = {x: self.finder(x)(x) for x in fresh.difference(words, cache)}
            if words := list(set().union(words, *mixed.values()).difference(cache)):
                self.learn(words)
            cache.update([(x, b"".join(map(cache.__getitem__, parts))) for x, parts in mixed.items()])
            out += [b"".join(map(cache.__getitem__, runs)) for runs in some]
        return out

    def decode(self, packed: bytes) -> bytes:
        """Tokens joined by one space, as a file without decoder has it; UTF-8."""
        return b" ".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, self.ids_type).tolist()))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def wide(packed: bytes, kind: str) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(packed, kind).astype("<u4").tobytes()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, unsigned 32-bit little-endian; only with_ids), ids_sha256, decoded_sha256."""

    def run(batch: pa.RecordBatch) -> dict:
        bpe = load(tokenizer)
        packed = bpe.encode_batch(as_texts(batch, text_col))
        ids = [wide(x, bpe.ids_type) for x in packed]
        out = {id_col: batch.column(id_col), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in packed]}
        return out | ({"ids": ids} if with_ids else {})

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} bigint,n_tokens bigint," + ("ids binary," if with_ids else "") + "ids_sha256 string,decoded_sha256 string")
