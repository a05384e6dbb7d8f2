"""Shared pieces of the training-data operators: reading, checkpoints, and whole-batch text arithmetic in numpy."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract of this package: blank and the five ASCII controls from tab to carriage return.
WS_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS_BYTES)] = True

U64 = np.uint64
#: An odd base, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in that of spark.checkpoint.dir, which driver and executors share. Where that is unset a
    local one is made and set, but only if driver and executors are one process, as in tests. `cleared` deletes it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    application = spark.sparkContext.applicationId
    if application not in _applications:
        _applications.add(application)
        atexit.register(_cleared_at_exit, spark)
    return f"{folder}/llm-{application}"


_applications: set[str] = set()
_tables: set[str] = set()


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleared(spark: SparkSession) -> None:
    """Deletes all intermediate results of this package in this application: call it when the results of its operators have
    been written. It is called when the driver ends, too."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    _deleted(spark, shared_folder(spark))


def _cleared_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the application may have been stopped
        cleared(spark)


#: Spark's own switch: an execution's shuffle files go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def without_leftovers(spark: SparkSession):
    """What is executed here leaves no shuffle files; nothing reads them after the result is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read from there: lineage ends, and a lost executor costs only its
    running tasks."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The most rows, and bytes of keys, that `looked_up` broadcasts.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def looked_up(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """`rows` joined with `small`, which has one row for each of the string `keys` and is broadcast if counting shows that it
    is small enough. Else both sides are dealt by key and salt, so that no task gets a hot key whole. `small` is saved."""
    n, size = small.agg(F.count(F.lit(1)), F.sum(sum((F.octet_length(k) for k in keys), F.lit(0)).cast("long"))).first()
    if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), keys, how)
    dealt = rows.withColumn("_salt", F.floor(F.rand(1) * salts).cast("int"))
    return dealt.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], how).drop("_salt")


def table_of(df: DataFrame, keys, buckets: int) -> DataFrame:
    """`df` as a bucketed table in the warehouse, which all executors share: later joins by its key need not move it again."""
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    _tables.add(name)
    shared_folder(spark)
    with without_leftovers(spark):
        df.write.bucketBy(buckets, *keys).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- whole batches of texts


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each starts (one more offset than texts). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Slices of a batch of about `most` bytes of text each (a longer text stands alone), so that memory is bounded."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A 64-bit number for each byte.
BYTE_CODES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, 1 << 64))
        have += more
    return out[:n]


class Rolling:
    """Fingerprints of any stretch of a sequence of 64-bit codes in constant time each: polynomial sums modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(codes * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, INVERSE)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U64) * U64(BASE))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and the index of each document's first word (one more than documents)."""
    dark = ~_IS_WS[data]
    before = np.empty_like(dark)
    before[:1] = False
    before[1:] = dark[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(dark & ~before)
    after = np.empty_like(dark)
    after[-1:] = False
    after[:-1] = dark[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(dark & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    if not len(starts):
        return np.zeros(0, U64)
    roll = Rolling(BYTE_CODES[data])
    return roll(starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def repository_of_tokenizers(name: str) -> str:
    """Where the public vocabulary file stands; TOKENIZERS_DIR names another folder."""
    if own := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)
