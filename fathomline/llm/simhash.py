"""SimHash near-duplicates (operator 5): multi-index hashing.

A fingerprint is the bit-wise majority of the 64-bit hashes of a text's SHINGLE-word shingles, repeats included.
Two fingerprints at 3 or fewer differing bits have 1 or fewer in one of their two 32-bit segments. So each
fingerprint files itself in a table under either segment and looks up the Hamming ball of radius 1 around it.
Of two segments that differ in one bit one has that bit set, and only it looks up: a ball shrinks to the segment
and its copies with one set bit cleared, and no pair is lost.

Equal fingerprints are one entry. What a bucket holds is not paired off: first every entry is compared with the
bucket's least fingerprint, and the components of these links are taken; then only entries of buckets that still
hold several components are compared, across components and where a quarter of their other segment is equal (three
bits cannot change all four). Both verify the complete distance.

Null or wordless texts have the fingerprint zero and link like others; texts of fewer words than a shingle are one
shingle; repeated rows and ids fall together; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, fresh, map_batches, row_key, unshipped
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a text's UTF-8, A-Z lower-cased; unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    h = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.array([h(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, other columns (strings), fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, shingle) for t in as_bytes(batch, text_col)], np.uint64)
        return {c: batch.column(c) for c in (id_col, *also)} | {"fp": pa.array(found.view(np.int64))}

    return map_batches(docs.select(id_col, *also, text_col), run, f"{id_col} bigint," + "".join(f"{c} string," for c in also) + "fp bigint")


def _entries(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table entries (key, fp) and look-ups (key, fp); a key is a segment and its number."""
    segments = [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)]
    def key(k, value):
        return value.bitwiseOR(F.lit(k << 32))

    def ball(k, s):
        bits = F.filter(F.array(*(F.lit(1 << i) for i in range(32))), lambda b: s.bitwiseAND(b) != 0)
        return F.transform(bits, lambda b: key(k, s.bitwiseXOR(b)))

    own = distinct.select("fp", F.explode(F.array(*(key(k, s) for k, s in enumerate(segments)))).alias("key"))
    return own, distinct.select("fp", F.explode(F.concat(*(ball(k, s) for k, s in enumerate(segments)))).alias("key"))


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(distinct: DataFrame) -> DataFrame:
    """fp, label for each distinct fingerprint that has a link; label is the same within a component."""
    own, balls = _entries(distinct)
    tables = own.groupBy("key").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("n"))
    # keys of random look-ups rarely meet a table, so what is left is small
    met = cut(
        own.withColumn("filed", F.lit(True)).unionByName(balls.withColumn("filed", F.lit(False)))
        .join(unshipped(tables), "key").where(~(F.col("filed") & (F.col("n") == 1))).select("key", "fp", "filed", "leader"),
        "buckets",
    )
    stars = met.where((F.col("fp") != F.col("leader")) & _near("fp", "leader", DISTANCE)).select(F.col("fp").alias("a"), F.col("leader").alias("b"))
    first = components(stars)
    labelled = met.join(unshipped(first), F.col("fp") == F.col("node"), "left").select("key", "fp", "filed", F.coalesce("label", "fp").alias("label"))
    labelled = cut(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    # what a bucket still holds differs in the other segment, in DISTANCE bits at most: one of DISTANCE + 1 parts is equal
    other = F.when(F.shiftrightunsigned("key", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    open_ = labelled.join(unshipped(mixed), "key").withColumn("other", other)
    width = 32 // (DISTANCE + 1)
    parts = [F.shiftleft(F.lit(k).cast("bigint"), 32).bitwiseOR(F.shiftright("other", width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(DISTANCE + 1)]
    open_ = open_.select("key", "fp", "label", "filed", F.explode(F.array(*parts)).alias("part"))
    x = open_.select("key", "part", F.col("fp").alias("a"), F.col("label").alias("la"))
    y = open_.where("filed").select(F.col("key").alias("key2"), F.col("part").alias("part2"), F.col("fp").alias("b"), F.col("label").alias("lb"))
    same = (F.col("key") == F.col("key2")) & (F.col("part") == F.col("part2"))
    rest = x.join(unshipped(y), same & (F.col("la") != F.col("lb")) & _near("a", "b", DISTANCE)).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    second = components(rest).select(F.col("node").alias("old"), F.col("label").alias("new"))
    named = first.unionByName(second.select(F.col("old").alias("node"), F.col("old").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    return named.join(unshipped(second), F.col("label") == F.col("old"), "left").select(F.col("node").alias("fp"), F.coalesce("new", "label").alias("label"))


def _classes(marks: DataFrame, *least) -> DataFrame:
    """fp2 and the least of each component, by any aggregates named least_*."""
    distinct = cut(marks.groupBy("fp").agg(*(f(c).alias(n) for n, f, c in least)), "distinct")
    labels = cut(links(distinct.select("fp")), "components").select(F.col("fp").alias("fp2"), "label")
    named = distinct.join(unshipped(labels), F.col("fp") == F.col("fp2"), "left").drop("fp2").withColumn("label", F.coalesce("label", "fp"))
    tops = labels.select("label").distinct().join(unshipped(named.select(F.col("label").alias("of"), *(n for n, _, _ in least))), F.col("label") == F.col("of")).groupBy("of").agg(*(f(n).alias(f"top_{n}") for n, f, _ in least))
    return named.join(unshipped(tops), F.col("label") == F.col("of"), "left").select(F.col("fp").alias("fp2"), *(F.when(F.col("of").isNull(), F.col(n)).otherwise(F.col(f"top_{n}")).alias(n) for n, _, _ in least))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach), a row per document."""
    marks = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    by_fp = _classes(marks, ("component_id", F.min, id_col))
    return marks.join(unshipped(by_fp), F.col("fp") == F.col("fp2")).select(id_col, "fp", "component_id")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def take(docs: DataFrame, key: Column, marks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents whose key is a chosen doc, with all columns; of rows with equal keys one. marks: a row per document."""
    rows = marks.groupBy(F.col("doc").alias("doc2")).agg(F.count(F.lit(1)).alias("n"))
    kept = cut(chosen.join(unshipped(rows), F.col("doc") == F.col("doc2")).select("doc", (F.col("n") > 1).alias("again")), "kept")
    own, again = fresh(docs, "row_key"), fresh(docs, "row_again")
    found = docs.withColumn(own, key).join(unshipped(kept.select(F.col("doc").alias(own), F.col("again").alias(again))), own)
    out = found.where(~F.col(again)).select(*docs.columns)
    if kept.where("again").limit(1).count():
        out = out.unionByName(found.where(F.col(again)).dropDuplicates([own]).select(*docs.columns))
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, that of the least id, with all columns; of rows with equal id and text one."""
    key = row_key(id_col, text_col)
    marks = cut(fingerprints(docs.select(F.col(id_col).alias("id"), key.alias("doc"), F.col(text_col).alias("text")), "id", "text", shingle, ("doc",)), "fingerprints")
    chosen = _classes(marks.select("fp", F.struct("id", "doc").alias("row")), ("row", F.min, "row")).select("row.*").distinct()
    return take(docs, key, marks, chosen)
