"""Shared helpers of the training-data operators: shared-folder tables, Arrow blocks and vectorised hashing.

Texts are handled as blocks: one flat ``uint8`` buffer of UTF-8 bytes plus ``int64`` offsets, one entry a
document.  Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``.  Hashes are 64-bit polynomial hashes
over random byte values, mixed at the end; they depend on the string alone, so they agree on every executor.
"""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the numpy kernels; bounds their scratch memory (about 100 bytes a text byte).
BLOCK_BYTES = 1 << 20

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    Without a cluster (a master ``local``) any folder is shared, and the warehouse lies on the same disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-scratch"
    return found.rstrip("/")


#: What this process has written and not yet released: folders, and tables of the session's catalog.
_FOLDERS: list[str] = []
_TABLES: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return f"{folder}/{name}"


def release(spark: SparkSession) -> None:
    """Removes all scratch tables and folders that this process has written; call it when their results are consumed."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _FOLDERS:
        delete(spark, _FOLDERS.pop())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_shuffles_go(spark: SparkSession) -> None:
    """Spark removes a shuffle's files when the driver's garbage collector finds that nothing refers to it any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns the written table: lineage ends there."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd") -> DataFrame:
    """Writes df in the shared folder as a table bucketed by key: later joins and groupings by key read it in place."""
    spark, table = df.sparkSession, f"tessera_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", codec).option("path", scratch(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    _TABLES.append(table)
    return spark.table(table)


def buckets_for(df: DataFrame, mb: int = 24) -> int:
    return int(min(1 << 16, max(8, input_bytes(df) // (mb << 20))))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df (of a plain scan: its files); where it knows none, 32 MB a shuffle partition."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 25


def parts_for(df: DataFrame, mb: float, least: int = 8) -> int:
    """How many parts keep each at about ``mb`` MB of df's stored size."""
    return int(max(least, input_bytes(df) / (mb * 1e6)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``mod`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


# ---------------------------------------------------------------- Arrow blocks
def text_block(col) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and offsets of a string or binary Arrow column; null is the empty text."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def sub_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer document is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blocks(batch_col, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a column, in bounded blocks."""
    buf, off = text_block(batch_col)
    for i, j in sub_blocks(off, most):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


# ---------------------------------------------------------------- hashing
def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^0..M^n and its inverses modulo 2^64; kept between calls up to the block size."""
    have = _POW.get("p")
    if have is None or len(have) <= n:
        size = max(n + 1, (1 << 20) + 1)
        up, down = np.full(size, _MULT, _U), np.full(size, _MULT_INV, _U)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if size > 2 * BLOCK_BYTES:
            return up, down
        _POW["p"], _POW["q"] = up, down
    return _POW["p"], _POW["q"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of v(b_j) M^j over j < i, modulo 2^64."""
    s = np.zeros(len(buf) + 1, _U)
    np.cumsum(_byte_values()[buf] * _powers(len(buf))[0][: len(buf)], out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end of the block that S belongs to."""
    return mix((s[end] - s[start]) * _powers(len(s))[1][start] + (end - start).astype(_U) * _U(0x9DDFEA08EB382D69))


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, 9, 10, 11, 12, 13]] = False


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document row of every word; words never cross documents."""
    n = len(buf)
    w = np.zeros(n + 1, bool)
    w[:n] = _WORD_BYTE[buf]
    edge = w.copy()
    edge[1:] &= ~w[:-1]
    cuts = off[:-1][off[:-1] < n]
    edge[cuts] = w[cuts]
    starts = np.flatnonzero(edge)
    stop = ~w
    stop[cuts] = True
    stop[1:] &= w[:-1]
    stop[0] = False
    return starts, np.flatnonzero(stop), np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(buf), starts, ends)


def gram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word runs and the word index of each start; runs never cross documents."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    g = np.zeros(len(at), _U)
    for j in range(n):
        g = (g + h[at + j]) * _U(0xB492B66FBE98F273 + 2 * j)
    return mix(g), at


# ---------------------------------------------------------------- packed rows
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, which Spark's own codec shrinks: one shuffled row carries many entries."""
    n = len(arrays[0])
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes() for a in arrays)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    sizes = [np.dtype(d).itemsize for d in dtypes]
    n = len(raw) // sum(sizes)
    out, at = [], 0
    for d, k in zip(dtypes, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).reshape(-1).view(d) if n else np.zeros(0, d))
        at += n * k
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts as ranges of the hash, so that sorted hashes fall into parts in order."""
    return ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def part_cuts(sorted_hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts present, their first entries with the end appended)."""
    own = part_of(sorted_hashes, parts)
    at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[at], np.append(at, len(own))
