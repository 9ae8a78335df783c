"""Helpers shared by the training-data operators: scratch tables, word and shingle hashing, graph components.

Words follow one rule everywhere unless an operator says otherwise: A-Z are lower-cased and a word is a run of
bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
_MASK = (1 << 64) - 1


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a fresh local one only in a local session without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as a table in the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/folio-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound and then started anew."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", seed=i) | 1 for i in range(SHINGLE_WORDS)], np.uint64)
_LENGTHS = np.array([xxhash.xxh64_intdigest(b"length", seed=i) for i in range(SHINGLE_WORDS + 1)], np.uint64)


def shingle_set(text: bytes | None, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, no words none."""
    words = words_of(text)
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = cache.of(words)
    width = min(n, SHINGLE_WORDS)
    count = n - width + 1
    total = np.full(count, _LENGTHS[width], np.uint64)
    for k in range(width):
        total += h[k : k + count] * _FACTORS[k]
    return np.unique(mix64(total))


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of texts that are hashed together (one longer text counts alone); words above so many bytes are hashed one by one.
TOGETHER_BYTES, LONG_WORD = 250_000, 64


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of data, which begins and ends with white space: eight bytes of all words at a time."""
    padded = data + bytes(8)
    blank = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix64(size.astype(np.uint64) * _FACTORS[0] ^ (eight[start] & _FIRST_BYTES[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        h[at] = mix64(h[at] ^ (eight[start[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return start, h


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles, as in shingle_set but of other word hashes; many texts at a time."""
    texts, out, at = [t or b"" for t in texts], [], 0
    while at < len(texts):
        end, held = at + 1, len(texts[at])
        while end < len(texts) and held + len(texts[end]) <= TOGETHER_BYTES:
            held += len(texts[end])
            end += 1
        start, h = _word_hashes(b"\n".join([b"", *texts[at:end], b""]).lower())
        first = np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts[at:end])])).tolist()
        whole = np.full(max(0, len(h) - SHINGLE_WORDS + 1), _LENGTHS[SHINGLE_WORDS], np.uint64)
        for k in range(SHINGLE_WORDS):
            whole += h[k : k + len(whole)] * _FACTORS[k]
        whole = mix64(whole)
        for lo, hi in zip(first, first[1:]):
            if hi - lo >= SHINGLE_WORDS:
                x = whole[lo : hi - SHINGLE_WORDS + 1]
                x = np.sort(x)
                out.append(x[np.append(True, x[1:] != x[:-1])])
            elif hi > lo:
                out.append(mix64(_LENGTHS[hi - lo : hi - lo + 1] + (h[lo:hi] * _FACTORS[: hi - lo]).sum(dtype=np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges.

    Alternating large-star and small-star steps; each step is two aggregations and joins, its result is written to
    the scratch folder, and the loop ends when every node hangs on one root only. Only nodes that have edges appear.
    """
    e = materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        last, e = e, materialize(small)
        release(last)
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
        if ends.groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least")).filter("ups > least").isEmpty():
            break  # a node has one edge up, or it is a root and has none
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def trim_memory() -> None:
    """Give memory that a fit on the driver needed back to the system: Arrow's pool and the allocator keep it otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(task):
    """A task over batches that gives its worker's memory back when it ends; workers outlive their tasks."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            trim_memory()

    return run


def trimmed_group(task):
    """The same for a task over one group or batch."""

    @functools.wraps(task)
    def run(pdf):
        out = task(pdf)
        trim_memory()
        return out

    return run
