"""Shared pieces of the corpus operators: shared storage, byte buffers, word hashing.

Texts travel as Arrow buffers; a task works on slices of a bounded number of
bytes (a slice holds at least one whole text), so memory follows the slice and
the longest single text, never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64
#: multiplier of the polynomial hash and its inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` when the cluster names one; where it is unset in local
    mode (tests) a temporary folder is made and set once a session. On a cluster a
    machine's own folder would lose rows, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_lodestone_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if tables:
        released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has forgotten their plans."""
    gc.collect()
    spark._jvm.System.gc()


def given_back() -> None:
    """A Python worker outlives its task: memory that it has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, giving memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        given_back()

    return run


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_ranges(df: DataFrame, size: int, least: int = 8) -> int:
    """How many key ranges to deal ``df`` into: one for ``size`` bytes of what its plan reads, ``least`` a shuffle partition at least."""
    read = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(max(least * n_partitions(df.sparkSession), min(int(str(read)) // size, 1 << 17)))


BITS = 26


def bit_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) * U64(BASE) + U64(17)) >> U64(64 - BITS)


def bitmap(df: DataFrame, col: str) -> Broadcast:
    """Bits of the hashes of a bigint column, of fixed size (2**BITS), broadcast; at most 2**(BITS - 6) words reach the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(bit_of(b.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int32)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], names=["w", "bits"])

    got = df.select(F.col(col).cast("bigint").alias("k")).mapInArrow(words, "w int, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), U64)
    out[got["w"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the bitmap (never wrong about those that are)."""
    at = bit_of(keys)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)


def among(bits: Broadcast, key: Column) -> Column:
    """Whether a bigint key, not null, may be among those of the bitmap; rows are told so where they are."""

    @F.pandas_udf("boolean")
    def hit(k: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, k.to_numpy()))

    return hit(key)


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def crc_mod_np(ids: np.ndarray, m: int) -> np.ndarray:
    return np.array([zlib.crc32(str(int(i)).encode()) % m for i in ids], dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker while small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, U64(base), dtype=U64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if not len(off):
        off = np.zeros(1, np.int64)
    return data, off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a slice of texts: maximal runs without ASCII white space, A-Z lowered.

    start, end: byte range of each word in ``buf``; first: for each text, the
    index of its first word (n+1 entries); hash: a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, blank: np.ndarray = SPACE):
        n = j - i
        lens = off[i + 1 : j + 1] - off[i:j]
        at = np.zeros(n + 1, np.int64)
        np.cumsum(lens + 1, out=at[1:])
        buf = np.full(int(at[-1]) + 1, 0x20, np.uint8)
        src = data[off[i] : off[j]]
        # every text is followed by one blank
        dest = np.arange(len(src), dtype=np.int64) + np.repeat(np.arange(n, dtype=np.int64), lens)
        buf[dest] = src
        self.buf = buf = LOWER[buf]
        self.at = at
        word = ~blank[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, at)
        self.n = n
        self._sum = None

    @property
    def doc(self) -> np.ndarray:
        """The text (0..n-1) of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sum is None:
            s = np.zeros(len(self.buf) + 1, U64)
            np.cumsum(BYTE_CODE[self.buf] * powers(BASE, len(self.buf)), out=s[1:])
            self._sum = s
        raw = (self._sum[end] - self._sum[start]) * powers(BASE_INV, len(self.buf) + 1)[start]
        return mix(raw + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    @property
    def hash(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)


def word_hash(word: str) -> int:
    """The hash that :class:`Words` gives a single word."""
    w = word.encode()
    d = np.frombuffer(w, np.uint8)
    return int(Words(d, np.array([0, len(d)]), 0, 1).hash[0])


def added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; one of the same name is replaced."""
    keep = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + list(columns.values()), names=keep + list(columns))


def added_schema(df: DataFrame, columns: str) -> str:
    """DDL of ``df`` with columns (name type, comma-separated) added as by :func:`added`."""
    from pyspark.sql.types import StructField, StructType

    new = StructType.fromDDL(columns)
    names = set(new.names)
    return StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in names] + list(new.fields))
