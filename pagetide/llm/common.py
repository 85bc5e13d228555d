"""What several operators share: ASCII words, 64-bit word hashes, tables between steps."""

from __future__ import annotations

import ctypes
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ODD = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
#: Words that a task keeps in a dictionary before it starts a new one; only memory depends on it.
CACHE_WORDS = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8; bytes.split() parts at exactly these six bytes."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case; bytes.lower() changes no other byte."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


LIBC = ctypes.CDLL(None)
#: Caches that a worker keeps from task to task; other operators' tasks let go of them, since workers are shared.
KEPT: list[dict] = []


def trim() -> None:
    """Gives memory that is free back to the system: Arrow's, then the C library's (where it is glibc)."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def release() -> None:
    """Empties what earlier tasks of other operators have left in this worker."""
    for kept in KEPT:
        kept.clear()
    trim()


class WordHashes(dict):
    """word -> 64-bit hash, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where it is unset, a session on one
    machine (tests) gets a folder of its own; on a cluster that would be another one on each machine, so it is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"/tmp/spark-{uuid.uuid4().hex[:12]}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. Workers map its files, so the shared folder must be mounted on every machine."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped into memory: spark.checkpoint.dir must be a mounted folder, not {url.scheme}://")
    os.makedirs(path := f"{url.path.rstrip('/')}/{name}-{uuid.uuid4().hex}", exist_ok=True)
    return path


class Scratch:
    """Tables of Parquet that one operator writes between its steps, in the shared folder. A step that reads one depends
    on its files alone, so a lost executor costs no more than that step; those that no later step reads are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/pagetide-{uuid.uuid4().hex}"
        self.at: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df and reads it back. A table of that name stays until the new one is written."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.at[name] = path
        self.sweep()
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.at.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep_only(self, *names: str) -> None:
        self.drop(*[n for n in self.at if n not in names])

    def sweep(self) -> None:
        """Lets the driver drop what plans have left that nothing holds any more, and Spark their shuffle files."""
        self.spark._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """One table that stays."""
    return Scratch(df.sparkSession).put("table", df)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def crc_mod(col: str, n: int):
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))
