"""Helpers shared by the operators: scratch tables, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one is set only where none is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Bytes of an Arrow batch that goes to a Python worker: rows may hold long texts, so their number says little.
BATCH = "8m"


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: str = BATCH):
    """Arrow batches of at most `size` for what is planned within."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written under the shared folder, which cut lineage and outlive executors.

    ``drop`` deletes a table whose readers are done; those that a lazy result
    still reads go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        self.write(df, path)
        return self.read(path, df.schema)

    def path(self) -> str:
        """Of a new table, for those that are written in parts, in folders name=value of it."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame, path: str, *by: str) -> None:
        with batch_bytes(self.spark):
            (df.write.partitionBy(*by) if by else df.write).parquet(path)

    def read(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def drop_part(self, table: DataFrame, part: str) -> None:
        self._delete(f"{table._scratch_path}/{part}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is already gone
            pass


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all its tasks."""
    home = sys.modules.setdefault("_tessera_worker_store", types.ModuleType("_tessera_worker_store"))
    return home.__dict__.setdefault(name, {})


class WordHash(dict):
    """word -> 64-bit hash, kept for words seen lately."""

    limit = 600_000

    def __missing__(self, w: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def hash_words(words: list[str], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(b: pa.RecordBatch, text_at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about the same, at most about `size` bytes of text; a longer text is a slice of its own, never cut."""
    total = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(text_at)), 0)).cumsum(dtype=np.int64)
    at = 0
    if b.num_rows:
        size = 1 + int(1.05 * total[-1] / max(1, -(-int(total[-1]) // size)))
    while at < b.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + size, side="right")))
        yield b.slice(at, end - at)
        at = end


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(slice of a batch, its texts), as cut() makes them."""
    for b in batches:
        for part in cut(b, text_at, chars):
            yield part, part.column(text_at).to_pylist()
    release()


def release() -> None:
    """Gives memory that is free back to the system: workers live on between tasks, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, each token's place among them, tokens of each text) as str.split() has them; a null has none."""
    lists = pa.compute.utf8_split_whitespace(pa.compute.fill_null(texts, ""))
    ends, flat = np.asarray(lists.offsets), lists.flatten()
    real = np.asarray(pa.compute.binary_length(flat)) > 0
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(real)])
    flat = flat.filter(pa.array(real)).dictionary_encode()
    return flat.dictionary.cast(pa.binary()).to_pylist(), np.asarray(flat.indices), np.diff(before[ends - ends[0]])


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    z = zstandard.ZstdCompressor(level=1)
    return pickle.dumps({k: (a.dtype.str, z.compress(np.ascontiguousarray(a).tobytes())) for k, a in arrays.items()})


def unpack(data: bytes) -> dict[str, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    return {k: np.frombuffer(z.decompress(b), t) for k, (t, b) in pickle.loads(data).items()}


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written; else those of all steps pile up."""
    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def same(a: Column, b: Column) -> Column:
    """Equality that holds between nulls; Spark still joins on it by hash or sort."""
    return a.eqNullSafe(b)


def seeded_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the seed and the columns, the same in any SQL that has md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
