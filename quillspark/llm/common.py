"""Shared pieces of the text operators: shared tables, Arrow text buffers and vectorised word hashing.

Texts are handled as UTF-8 bytes in chunks of about ``CHUNK_BYTES``, so memory in a
Python worker depends on the longest single text, never on the size of a partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
U = np.uint64
#: Separators of words in the contracts: space and the controls 09 to 0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_WORD = ~SPACES
#: Maps A-Z to a-z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(found)
    return found


_OWN: dict[str, str] = {}


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: the lineage ends there,
    so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    key = spark.sparkContext.applicationId
    root = _OWN.get(key) or _OWN.setdefault(key, shared_dir(spark))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``table`` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t._quill_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls become empty texts."""
    if pa.types.is_string_view(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, off = buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray, word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes marked in ``word`` inside one text), and for each text
    the number of words before it, with the total last."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    b = off[:-1][off[:-1] < n]
    first[b] = w[b]
    e = off[1:][off[1:] > 0] - 1
    last[e] = w[e]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, self.n * 2)
            self.p, self.q = (np.concatenate([np.ones(1, U), np.cumprod(np.full(self.n, b, U))]) for b in (self.base, self.inverse))
        return self.p[:n], self.q[:n]


WORDS = Powers(0xD6E8FEB86659FD93)


def _sums(x: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    p, q = powers.upto(len(x) + 1)
    out = np.zeros(len(x) + 1, U)
    np.cumsum(x * p[: len(x)], out=out[1:])
    return out, q


#: Masks of the first n bytes of a little-endian block, and keys of two independent hashes of words.
_FIRST = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], U)
_KEYS = (U(0x2545F4914F6CDD1D), U(0xD1342543DE82EF95))


def symbols(data: np.ndarray, s: np.ndarray, e: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit symbol for each word, equal for equal words. Each block of eight bytes is mixed with its place before the blocks are
    added up, so the sum has no algebra that a text could follow. The two lanes together make 128 bits."""
    if len(s) == 0:
        return np.zeros(0, U)
    n, buf = e - s, np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", buf, 0, (1,))
    key = _KEYS[lane]

    def mixed(at, left, place):
        x = blocks[at] & _FIRST[np.minimum(left, 8)]
        return mix(mix(x + key) ^ (place * U(0x9E3779B97F4A7C15) + key))

    out = mixed(s, n, U(1))
    long = np.flatnonzero(n > 8)
    if len(long):
        more = (n[long] - 1) // 8
        first = np.cumsum(more) - more
        k = np.arange(more.sum()) - np.repeat(first, more) + 1
        h = mixed(np.repeat(s[long], more) + 8 * k, np.repeat(n[long], more) - 8 * k, (k + 1).astype(U))
        out[long] += np.add.reduceat(h, first)
    return mix(out + n.astype(U) * U(0xA0761D6478BD642F))


def word_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Numbers of words that are equal for equal words and for no others, within this call."""
    if len(s) == 0:
        return np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s] = 1
    inside[e] -= 1
    ends = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=ends[1:])
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    told = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return told.indices.to_numpy().astype(np.int64)


def run_ids(ids: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the runs of ``size`` neighbours that begin at each place, equal for equal runs and for no others."""

    def paired(a, b):
        a, b = a[: len(b)], b[: len(a)]
        return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]

    if len(ids) < size:
        return np.zeros(0, np.int64)
    power, k, out, done = ids, 1, None, 0
    while True:
        if size & k:
            out, done = (power, k) if out is None else (paired(out, power[done:]), done + k)
        k *= 2
        if k > size:
            return out[: len(ids) - size + 1]
        power = paired(power, power[k // 2 :])


def chained(sym: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of the ``size`` symbols from each place of ``at`` on, with a multiplier for each place of the run."""
    factor = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, size, dtype=np.uint64) * U(2) + U(1)
    out = np.zeros(len(at), U)
    for j in range(size):
        x = sym[at + j] * factor[j]
        out += x ^ (x >> U(32))
    return mix(out)


class Grams:
    """Hashes of runs of symbols, each from two prefix sums. They serve to find candidates; what they find is compared by other means."""

    def __init__(self, sym: np.ndarray):
        self.sums, self.q = _sums(sym, WORDS)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.q[a] + (b - a).astype(U) * U(0xE7037ED1A0B428DB))

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.q[:n] + U(k * 0xE7037ED1A0B428DB % (1 << 64)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for helpers that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def row_key():
    """Tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64("text")


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers that Spark reuses keep none of a task's."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
    pa.default_memory_pool().release_unused()


def trimmed(run):
    """``run`` over batches, with ``trim`` at the end of the task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def complete(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition that is sorted by ``keys``, in batches that part no run of equal (or null) keys. The last run of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.ones(b.num_rows, bool)
        fits = bool(held)
        for k in keys:
            col = b.column(k)
            last = col[b.num_rows - 1]
            same = pc.equal(col, last) if last.is_valid else pc.is_null(col)
            ends &= pc.fill_null(same, False).to_numpy(zero_copy_only=False)
            fits = fits and held[-1].column(k)[held[-1].num_rows - 1].as_py() == col[0].as_py()
        begun = b.num_rows - int(np.append(~ends[::-1], True).argmax())
        if held and not fits:
            yield joined(held)
            held = []
        if begun:
            yield joined([*held, b.slice(0, begun)])
            held = []
        held.append(b.slice(begun))
    if held:
        yield joined(held)
