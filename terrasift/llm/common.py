"""What the text operators share: words, hashes and tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: whole texts travel in them, so they are kept small.
BATCH_ROWS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that the contracts name: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as rows hold whole documents."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or where that is unset and all runs on this machine, a local one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_terrasift_dir", None)
    if made is None:
        made = f"file://{tempfile.mkdtemp(prefix='terrasift-')}"
        spark.sparkContext._terrasift_dir = made
        spark.sparkContext.setCheckpointDir(made)
    return made


_tables: list[tuple[SparkSession, str]] = []


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/terrasift-{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*frames: DataFrame) -> None:
    """Remove the files of stored tables that no later plan reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            root = path.split("/batch=")[0]
            if "/terrasift-" in root:
                drop_path(df.sparkSession, root)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are done: it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """The tables that calls of a function store, to be dropped once its result has been written."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def of(self, f: Callable[[], DataFrame]) -> DataFrame:
        mark = len(_tables)
        out = f()
        self.paths += _tables[mark:]
        return out

    def drop(self, docs: DataFrame) -> None:
        """Drop the tables but for those that docs reads."""
        if not self.paths:
            return
        read = docs.inputFiles()
        for entry in list(self.paths):
            name = entry[1].rsplit("/", 1)[1]
            if not any(f"/{name}/" in f for f in read):
                drop_path(*entry)
                self.paths.remove(entry)
                if entry in _tables:
                    _tables.remove(entry)
        release(docs.sparkSession)


@atexit.register
def _tidy() -> None:
    for spark, path in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone when Python ends
            return


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same where all is ASCII, and is faster there."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids count as the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def count_words(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


# In Python workers


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a text column, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept while there are few enough."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = WordHashes()
_kept: dict[str, Callable[[], None]] = {}


def keep_only(name: str, clear: Callable[[], None]) -> None:
    """In a worker that operators take turns in: what the others keep goes, what `name` keeps can be cleared by `clear`."""
    for other in [x for x in _kept if x != name]:
        _kept.pop(other)()
    _kept[name] = clear
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX2
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; of the whole sequence where it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n - k + 1]) * _MIX
        out ^= out >> np.uint64(31)
    return mixed(out)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a lower-cased text."""
    return np.unique(windows(word_hashes(text.lower().split()), k))
