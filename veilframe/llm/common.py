"""Helpers shared by the corpus operators: word spans, hashes, shared tables.

All word work happens on the UTF-8 bytes of an Arrow batch with numpy, inside
tasks that Spark partitions.  Rows of a batch are taken in slices of a few MB,
so that memory stays flat whatever a batch or a document holds.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SALTS = 16

#: Bytes between words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The low k bytes of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes go to a library hash, one by one.
LONG_WORD = 2048


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about SLICE_BYTES; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """start, end (bytes), 64-bit hash and row of each word of the rows that ``offs`` delimits."""
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n and not SPACE[data[end]]:  # a long text is cut between words
            gap = np.flatnonzero(SPACE[data[end : end + 65536]])
            end = end + int(gap[0]) if len(gap) else min(n, end + 65536)
        inner = offs[(offs >= at) & (offs <= end)] - at
        parts.append([x + at if i < 2 else x for i, x in enumerate(_words(data[at:end], inner, lower))])
        at = end
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    start, stop, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    row = np.searchsorted(offs, start, "right") - 1
    return start, stop, h, row


def _words(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    edge[0] = edge[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, word_hashes(data, start, stop)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time through a mixer that is not linear, begun with the length."""
    size = stop - start
    padded = bytes(data) + bytes(8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = size
    h = mixed((size.astype(np.uint64) * _ODD) ^ (eight[start] & _LOW[np.minimum(left, 8)]))
    own = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at, left = start[own] + 8, size[own] - 8
    while len(own):
        h[own] = mixed((h[own] + _ODD) ^ (eight[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(padded[start[k] : stop[k]], digest_size=8).digest(), "little")
    return h


def joined(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one blank after each, and where each begins (and the end)."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start + 1, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    own = np.ones(len(out), bool)
    own[at[1:] - 1] = False
    out[own] = data[~SPACE[data]]
    return out.tobytes(), at


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the runs of k hashes, one at each position that has k left."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, c = np.full(n, seed, np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        out = (out ^ h[j : j + n]) * c
        out ^= out >> np.uint64(29)
    return mixed(out + np.uint64(k))


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """First word of each row, and the end."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(flat: np.ndarray, sizes: np.ndarray | list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def text_key(text: Column) -> tuple[Column, Column]:
    """Two longs that stand for a whole text: equal texts share them, whatever their ids are."""
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary one, but only in local mode, as in tests.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and outlives executors.

    Goes with drop(), or when the driver's process ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if top not in _tops:
        _tops.add(top)
        atexit.register(remove, spark, top)
    return out


_tops: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark writes to; silent if it, or the JVM, is gone."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes what table() wrote, once nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def meet(many: DataFrame, one: DataFrame, keys: list[str] | str, spread: str, how: str = "inner", small_rows: int = 50_000) -> DataFrame:
    """``many`` joined to the one row of each key in ``one``, a table() of narrow rows.

    Its rows are counted first (from file footers): up to ``small_rows`` of them are broadcast, so
    that no key can be hot; more are copied over salts, dealt by ``spread``, and merge-joined.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if small_rows and one.count() <= small_rows:
        return many.join(F.broadcast(one), keys, how)
    salts = one.withColumn("salt", every_salt()).hint("merge")
    return many.withColumn("salt", salted(F.col(spread))).join(salts, [*keys, "salt"], how).drop("salt")


def salted(key: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def every_salt(salts: int = SALTS) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(salts)]))
