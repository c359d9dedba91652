"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20
#: Bytes whose hashes are computed at once: no table or prefix sum is longer, however long a text is.
HASH_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; on a
    cluster that is an error, as executors would not see a folder of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_FOLDERS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # the JVM may be gone already at the end of the program
        pass


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage is cut, lost executors cost nothing.

    The files go with discard(), or when the program ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_clean, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that written() returned and nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._written)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that has an edge (u, v): component is the smallest id reachable.

    Alternating large and small stars (Kiveris et al., 2014); each round is written, nothing comes to the driver but two sums. Minima are
    written before they are joined, so a join's sides are plain shuffles and a hub with most of the edges can be split by Spark.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v")))
        old, edges = edges, written(small.distinct())
        discard(old, least, large, lower)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def trimmed(run):
    """run (a generator of batches), after which the worker gives the memory it has freed back: idle workers stay small."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, sizes: pa.Array | None = None):
    """batch in runs of rows with at most `most` bytes in the column (or of the sizes given); a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0) if sizes is None else sizes
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the offsets of its rows."""
    a = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """64-bit polynomial hashes of substrings of HASH_BYTES at most, from prefix sums modulo 2**64 (the base is odd, so it has an inverse)."""

    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    _up = _down = None

    def __init__(self, data: np.ndarray):
        if Rolling._up is None:
            for name, b in (("_up", self.BASE), ("_down", self.INVERSE)):
                steps = np.full(HASH_BYTES + 1, b, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        x = data.astype(np.uint64)
        x += np.uint64(1)
        x *= Rolling._up[: len(data)]
        np.cumsum(x, out=self.prefix[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * Rolling._down[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """of() for all substrings of `width` bytes, in order."""
        x = self.prefix[width:] - self.prefix[:-width]
        x *= Rolling._down[: len(x)]
        x += np.uint64(width)
        return mix(x)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each of the segments data[start:end], which lie in order and don't overlap, in chunks of HASH_BYTES."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        stop = int(np.searchsorted(ends, base + HASH_BYTES, "right"))
        if stop > at:
            out[at:stop] = Rolling(data[base : ends[stop - 1]]).of(starts[at:stop] - base, ends[at:stop] - base)
        else:  # a longer segment, piece by piece
            stop, end, total = at + 1, int(ends[at]), 0
            for a in range(base, end, HASH_BYTES):
                own = data[a : min(a + HASH_BYTES, end)]
                total += int(Rolling(own).raw(np.zeros(1, np.int64), np.array([len(own)]))[0]) * pow(Rolling.BASE, a - base, 1 << 64)
            out[at] = mix(np.array([(total + end - base) % (1 << 64)], np.uint64))[0]
        at = stop
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words [^\\x20\\x09-\\x0D]+; words never cross rows."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(data), HASH_BYTES):
        hi = min(lo + HASH_BYTES, len(data))
        solid = np.zeros(hi - lo + 2, bool)  # with a neighbour on each side
        a, b = max(lo - 1, 0), min(hi + 1, len(data))
        solid[a - lo + 1 : b - lo + 1] = ~SPACE[data[a:b]]
        first = np.zeros(hi - lo + 1, bool)
        first[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
        starts.append(np.flatnonzero(solid[1:-1] & (first[:-1] | ~solid[:-2])) + lo)
        ends.append(np.flatnonzero(solid[1:-1] & (first[1:] | ~solid[2:])) + lo + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    out, has = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) > 0
    if has.any():
        out[has] = np.add.reduceat(flags, offsets[:-1][has], dtype=np.int64)
    return out


def shingles(word: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words inside one row, and the index of each window's first word."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word[at + k]
    return mix(h), at
