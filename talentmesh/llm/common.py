"""Helpers shared by the operators: table reading, written intermediates,
Arrow text access and vectorised word scanning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.session import shared_folder, small_batches, written  # noqa: F401

CHUNK_BYTES = 1 << 19
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a key of each row, and the key's name: for rows
    whose ids may be null or repeated."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def held_out(doc_id: Column | str) -> Column:
    """The fifth of the rows whose labels no model may see."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Labelled rows outside the held-out fifth: (doc_id, text, y), about
    ``max_rows`` at most, picked by a hash of the id.  Labels that contradict each other for one id count as their maximum;
    null labels and null ids are left out."""
    y = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
         .where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    n = y.count()
    if n > max_rows:
        keep = int(max_rows * 1_000_000 // n)
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < keep)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(y), "doc_id").dropDuplicates(["doc_id"]))


def text_chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES):
    """Cuts a column of strings (or large binaries) into runs of whole texts of about ``max_bytes``:
    yields (first row, last row + 1, bytes, offsets of the rows in them).
    Nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_binary(texts.type):
        texts = texts.fill_null(b"")
    else:
        texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        inv = pow(_BASE, -1, 1 << 64)
        for key, b in (("up", _BASE), ("down", inv)):
            x = np.full(size, np.uint64(b), np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM_SEPARATORS = np.zeros(256, bool)
ALNUM_SEPARATORS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def scan_words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray):
    """Words (runs of non-separator bytes, A-Z lower-cased) of concatenated
    texts: (start, end, 64-bit hash of each word, words before each row)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    low = LOWER[buf]
    word = ~separators[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offs[1:-1]
    inner = inner[inner < len(buf)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= first[1:] | ~word[1:]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    up, down = _powers(len(buf) + 1)
    acc = np.empty(len(buf) + 1, np.uint64)
    acc[0] = 0
    np.cumsum(_BYTE_CODES[low] * up[:len(buf)], out=acc[1:])
    h = mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64) * _MIX1)
    return s, e, h, np.searchsorted(s, offs)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes ``scan_words`` gives to whole words."""
    buf = b" ".join(words)
    data = np.frombuffer(buf, np.uint8)
    return scan_words(data, np.array([0, len(data)]), SPACES)[2]


def shingle_hashes(h: np.ndarray, before: np.ndarray, k: int = 5):
    """For each row the sorted distinct 64-bit hashes of its k-word shingles;
    a row of fewer words, but not none, has its whole sequence as one."""
    n = len(h)
    codes = [mix64(np.full(1, i + 1, np.uint64) * np.uint64(_BASE))[0] | np.uint64(1) for i in range(k)]
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            acc += h[i:n - k + 1 + i] * codes[i]
        acc = mix64(acc)
    out = []
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
        m = hi - lo
        if m >= k:
            x = np.sort(acc[lo:hi - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif m:
            x = np.uint64(m)
            with np.errstate(over="ignore"):
                for i in range(m):
                    x = x + h[lo + i] * codes[i]
                out.append(mix64(np.array([x ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            out.append(h[:0])
    return out


def flat_lists(parts: list[np.ndarray], dtype, arrow_type) -> pa.Array:
    lens = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    offs = np.concatenate(([0], np.cumsum(lens)))
    flat = np.concatenate(parts).astype(dtype, copy=False) if parts and offs[-1] else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat, arrow_type))
