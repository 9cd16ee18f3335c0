"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: together they bound what a Python worker holds, also of very long texts.
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A temp folder stands in for it only where
    both are one process; on a cluster without the setting this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dir()
    return found.rstrip("/")


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="fathomline-")


def bounded_batches(spark: SparkSession) -> None:
    """The session's Arrow batches hold no more than BATCH_ROWS rows and about BATCH_BYTES; smaller settings stay.

    Spark reads these settings when a plan runs, so they remain set.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """Write to the shared folder and read again: ends the lineage, survives lost executors. plain: without dictionaries."""
    path = shared_path(df.sparkSession, name)
    # hashes hardly repeat: a dictionary of them is built in vain
    df.write.option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unshipped(df: DataFrame) -> DataFrame:
    """A side of a join that both sides are shuffled and sorted for, at any size. Spark would broadcast a stored table by the
    size of its compressed files, and tables that grow with the input then outgrow the driver long before that limit."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut wrote and that nothing reads any more; whatever was made from them is written by now."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, not when the driver happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with bounded batches; fn returns columns by name."""
    bounded_batches(df.sparkSession)
    names = [x.name for x in _arrow_schema(df.sparkSession, schema)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _types(schema)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((out[n], types[n]) for n in names)], names=names)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """Rows, with all their columns, for which keep says so."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


@functools.lru_cache(maxsize=64)
def _types(schema: str) -> dict[str, pa.DataType]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    return {a: kinds[b] for a, b in (x.strip().split(" ", 1) for x in schema.split(","))}


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def as_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


#: All bytes but 0-9, a-z and those of 0x80 and above become a space; A-Z become a-z.
_TO_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return text.translate(_TO_WORDS).split()


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for a row's id and text; nulls differ from empty strings."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return F.md5(F.concat(part(id_col), F.lit("\x00"), part(text_col)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
