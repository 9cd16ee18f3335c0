"""Token-id / binary output (operator 10): directly addressable codes.

Ids are split into chunks of CHUNK_BITS bits, lowest first. Level 0 holds the lowest chunk of every id, level k
the k-th chunk of those ids that have one. A bitmap per level marks the ids that continue, and a rank directory
(ones before each block of BLOCK bits) gives an id's place in the next level, so any token is read by at most one
directory look-up and one popcount a level; no block is decoded.

A segment is a self-contained byte string in the format below; segments are the rows of a Parquet table in the
shared folder, which gives atomic, retried writes by executors and reads from any store Spark knows. The table is not
compressed, so that a segment's bytes lie in the file as they are.

    magic "FDAC1\\0", u2 chunk bits | u8 documents | u8 tokens | u8 levels
    i8 doc id x documents | u1 id is null x documents | u8 end of each document in tokens
    per level: u8 entries | chunks (u1 or u2 each) | bitmap, 8 bytes a word | u8 ones before each block

Nulls count as empty texts and a null id comes first; an empty text has its end id only; repeated ids keep
together, ordered by text. Order within equal rows makes no difference.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import as_texts, bounded_batches, map_batches, shared_path

MAGIC, CHUNK_BITS, BLOCK = b"FDAC1\0", 8, 512
#: Tokens after which a segment is closed; one document is never split.
SEGMENT_TOKENS = 1 << 20
_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode_levels(ids: np.ndarray, bits: int = CHUNK_BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap bytes and rank directory of each level."""
    kind, out, rest = ("<u1" if bits <= 8 else "<u2"), [], ids.astype(np.uint64)
    while True:
        chunk, rest = (rest & np.uint64((1 << bits) - 1)).astype(kind), rest >> np.uint64(bits)
        more = rest > 0
        bitmap = np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little")
        ones = _POP[bitmap].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        out.append((chunk, bitmap, (np.cumsum(ones) - ones).astype("<u8")))
        rest = rest[more]
        if not len(rest):
            return out


def pack_segment(doc_ids: list[int | None], docs: list[np.ndarray], bits: int = CHUNK_BITS) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    levels = encode_levels(ids, bits)
    out = [MAGIC, struct.pack("<HQQQ", bits, len(docs), len(ids), len(levels))]
    out += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), np.cumsum([len(d) for d in docs], dtype="<u8").tobytes()]
    for chunk, bitmap, directory in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bitmap.tobytes(), directory.tobytes()]
    return b"".join(out)


class Segment:
    """Random access to the tokens and documents of a segment."""

    def __init__(self, blob: bytes):
        if blob[:6] != MAGIC:
            raise ValueError("not a segment")
        self.bits, n_docs, self.n_tokens, n_levels = struct.unpack_from("<HQQQ", blob, 6)
        at = 6 + struct.calcsize("<HQQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        raw, null, self.ends = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)
        self.doc_ids = [None if z else x for x, z in zip(raw.tolist(), null.tolist(), strict=True)]
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunk = take("<u1" if self.bits <= 8 else "<u2", n)
            blocks = -(-n // BLOCK)
            self.levels.append((chunk, take("u1", blocks * BLOCK // 8), take("<u8", blocks)))

    def get(self, at: np.ndarray) -> np.ndarray:
        """Tokens at these places, each found by itself through the rank directories."""
        place = np.asarray(at, np.int64)
        out, on = np.zeros(len(place), np.uint64), np.arange(len(place))
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            out[on] |= chunk[place].astype(np.uint64) << np.uint64(self.bits * k)
            byte, bit = place >> 3, (place & 7).astype(np.uint8)
            more = (bitmap[byte] >> bit) & 1 == 1
            on, place, byte, bit = on[more], place[more], byte[more], bit[more]
            if not len(on):
                break
            first, wide = place // BLOCK, BLOCK // 8
            if len(place) * wide <= len(bitmap):  # few places: only their blocks are read
                ahead = np.arange(wide) < (byte % wide)[:, None]
                inside = np.where(ahead, _POP[bitmap.reshape(-1, wide)[first]], 0).sum(axis=1, dtype=np.int64)
            else:
                before = np.concatenate([[0], np.cumsum(_POP[bitmap], dtype=np.int64)])
                inside = before[byte] - before[first * wide]
            place = directory[first].astype(np.int64) + inside + _POP[bitmap[byte] & ((1 << bit.astype(np.uint16)) - 1).astype(np.uint8)]
        return out.astype("<u4")

    def one(self, place: int) -> int:
        """One token: a directory entry and the popcount of part of a block for each level."""
        out = 0
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            out |= int(chunk[place]) << (self.bits * k)
            if not bitmap[place >> 3] >> (place & 7) & 1:
                break
            start = place // BLOCK * (BLOCK // 8)
            ones = int(_POP[bitmap[start : place >> 3]].sum()) + int(_POP[bitmap[place >> 3] & ((1 << (place & 7)) - 1)])
            place = int(directory[place // BLOCK]) + ones
        return out

    def document(self, i: int) -> np.ndarray:
        return self.get(np.arange(self.ends[i - 1] if i else 0, self.ends[i]))


_SEGMENTS = "part int,seg int,n_docs bigint,n_tokens bigint,first_token bigint,blob binary"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode all texts and write them as segments in ascending id order: range partition, part, segment."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part = load(tokenizer), TaskContext.get().partitionId()
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = first = seg = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seg, pa.int32()), (len(ids), pa.int64()), (held, pa.int64()), (first, pa.int64()), (pack_segment(ids, tokens), pa.binary()))], names=["part", "seg", "n_docs", "n_tokens", "first_token", "blob"])

        for batch in batches:
            for doc, packed in zip(batch.column(id_col).to_pylist(), bpe.encode_batch(as_texts(batch, text_col)), strict=True):
                ids.append(doc)
                tokens.append(np.append(np.frombuffer(packed, bpe.ids_type), np.array(end_id, bpe.ids_type)))
                held += len(tokens[-1])
                if held >= SEGMENT_TOKENS:
                    yield close()
                    first, seg, held, ids, tokens = first + held, seg + 1, 0, [], []
        if ids:
            yield close()

    dealt = docs.select(id_col, text_col).repartitionByRange(n, F.col(id_col)).sortWithinPartitions(id_col, text_col)
    dealt.mapInArrow(run, _SEGMENTS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Each document from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("part", id_col, "in_part", "n_tokens", "ids_crc32")}
        for part, first, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "first_token", "blob")), strict=True):
            seg, start = Segment(blob), 0
            every = seg.get(np.arange(seg.n_tokens))
            for doc, end in zip(seg.doc_ids, seg.ends.tolist(), strict=True):
                for k, v in (("part", part), (id_col, doc), ("in_part", first + start), ("n_tokens", end - start), ("ids_crc32", zlib.crc32(every[start:end].tobytes()))):
                    out[k].append(v)
                start = end
        return out

    # one row a range partition, whatever the input: a window over them all stays small
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select(F.col("part").alias("of_part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    rows = map_batches(segments.select("part", "first_token", "blob"), run, f"part int,{id_col} bigint,in_part bigint,n_tokens bigint,ids_crc32 bigint")
    return rows.join(F.broadcast(bases), F.col("part") == F.col("of_part")).select(id_col, (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, end_id, id_col, text_col)
    return read(docs.sparkSession, path, id_col)
