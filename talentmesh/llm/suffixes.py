"""Suffix-array dedup by distributed prefix doubling.

Every 50-byte string of the corpus is a suffix cut at the threshold.  Ranks
are names: equal strings get equal 64-bit names, built by doubling - the name
of a string is made from those of two shorter ones at a growing offset
(8, 16, 24, 32 and 50 bytes).  Spark partitions and sorts positions by the
ranks, and drops those that have become unique; what is left is reranked at
the next length.

Round 1 ranks at 24 bytes.  Each window of 50 bytes is represented by its
least 24-byte name, so equal windows meet under one name, and neighbouring
windows mostly share it: such a run of windows (a cell) is one row, with a
second rank for all its bytes.  Equal cells of a smaller document settle all
their windows at once; a name with one cell only is unique and dropped.
Round 2 ranks the windows of the cells left, one row for each, at 50 bytes.

Rows travel packed by bucket of their rank.  Of equal rows of one task only
that of the smallest document travels on; the others are settled where they
are.  So a passage in a third of all documents makes no hot row group.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_chunks, written
from .manifest import placed_in_order

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
SLICE = 1 << 20
#: Bytes of text after which a task packs and sends its rows.
FLUSH_BYTES = 8 << 20
#: Bytes of text for a bucket of ranks: what one sort holds at once.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 256
_U = np.uint64
_A, _B, _C, _D = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at every position, as one number (a view)."""
    return np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))


def _first_name(x: np.ndarray) -> np.ndarray:
    return mix64(x + _A)


def window_names(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the 50-byte strings at some positions."""
    e = _eights(buf)

    def sixteen(o):
        return _first_name(e[at + o]) * _B + _first_name(e[at + o + 8])

    return (sixteen(0) * _C + sixteen(16)) * _D + (sixteen(18) * _C + sixteen(34))


def _slice_cells(buf: np.ndarray, valid: np.ndarray):
    """Cells of one slice: (name, rank of the bytes, first and last window)."""
    n = len(buf) - LENGTH + 1
    h8 = _first_name(_eights(buf))
    h16 = h8[:-8] * _B + h8[8:]
    least = mix64(h16[:-8] * _A + h8[16:])[:n + SPAN - 1]
    h32 = h16[:-16] * _C + h16[16:]
    h50 = h32[:-18] * _D + h32[18:]
    span = 1
    while 2 * span <= SPAN:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < SPAN:
        least = np.minimum(least[:span - SPAN], least[SPAN - span:])
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    p1, p2 = np.flatnonzero(first), np.flatnonzero(last)
    parts = (p2 - p1) // SPAN + 1
    if len(parts) and parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(p2, parts)
        p1 = np.repeat(p1, parts) + k * SPAN
        p2 = np.minimum(p1 + SPAN - 1, end)
    name = least[p1] * _A
    rank = mix64(h50[p1] * _B + h50[p2] + (p2 - p1).astype(_U))
    return name ^ (name >> _U(29)), rank, p1, p2


def cells(buf: np.ndarray, offs: np.ndarray):
    """Cells of concatenated texts: (name, rank, row, first window, last
    window, first window of the first equal cell of the row)."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), np.zeros(0, _U), z, z, z, z
    step = np.zeros(len(buf) + 1, np.int32)
    np.add.at(step, np.maximum(offs[:-1], offs[1:] - LENGTH + 1), 1)
    np.add.at(step, offs[1:], -1)
    valid = np.cumsum(step)[:n] == 0
    out = []
    for s in range(0, n, SLICE):
        e = min(n, s + SLICE)
        name, rank, p1, p2 = _slice_cells(buf[s:e + LENGTH - 1], valid[s:e])
        out.append((name, rank, p1 + s, p2 + s))
    name, rank, p1, p2 = (np.concatenate(x) for x in zip(*out))
    row = np.searchsorted(offs, p1, side="right") - 1
    return name, rank, row, p1, p2, _first_equal(row, name, rank, p1)


def _first_equal(row, name, rank, at):
    """For each element the least ``at`` of the equal ones in its row."""
    order = np.lexsort((at, rank, name, row))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        new[1:] = (row[a] != row[b]) | (name[a] != name[b]) | (rank[a] != rank[b])
    heads = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(at[order[heads]], np.diff(np.append(heads, len(order))))
    return out


def _open_windows(buf, offs, row, p1, p2, is_open):
    """Windows of the open cells: (row, position, name, first equal position)."""
    n = (p2 - p1 + 1)[is_open]
    at = np.repeat(p1[is_open], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    r = np.repeat(row[is_open], n)
    h = mix64(window_names(buf, at)) if len(at) else np.zeros(0, _U)
    return r, at, h, _first_equal(r, h, h, at)


# ---- packed rows

def _low_bytes(x: np.ndarray, k: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k]).tobytes()


def _from_low(data: bytes, k: int) -> np.ndarray:
    out = np.zeros((len(data) // k, 8), np.uint8)
    out[:, :k] = np.frombuffer(data, np.uint8).reshape(-1, k)
    return out.view("<u8").reshape(-1)


def pack(name, rank, doc, pos) -> bytes:
    """Rows of one bucket: 40 bits of the name (the bucket holds more), 48 of
    the rank, positions, and ids as steps of the smallest fitting width."""
    order = np.argsort(doc, kind="stable")
    name, rank, doc, pos = name[order], rank[order], doc[order], pos[order]
    gap = np.diff(doc, prepend=doc[0])
    most = int(gap.max())
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return b"".join((np.array([len(doc), doc[0], width], np.int64).tobytes(), _low_bytes(name, 5), _low_bytes(rank, 6),
                     _low_bytes(gap.astype(_U), width), _low_bytes(pos.astype(_U), 2), _low_bytes(pos.astype(_U) >> _U(16), 2)))


def unpack(data: bytes):
    n, first, width = np.frombuffer(data, np.int64, 3).tolist()
    at = 24
    out = []
    for k in (5, 6, width, 2, 2):
        out.append(_from_low(data[at:at + n * k], k))
        at += n * k
    return out[0], out[1], np.cumsum(out[2].astype(np.int64)) + first, (out[3] | (out[4] << _U(16))).astype(np.int64)


class _Sender:
    """Collects rows of a task, settles equal ones, sends the rest by bucket.
    Rows (bucket, settled, data); settled rows only pass through."""

    def __init__(self, buckets: int, shift: int):
        self.buckets, self.shift = buckets, shift
        self.clear()

    def clear(self):
        self.rows, self.size = [], 0

    def add(self, name, rank, doc, pos, size):
        self.rows.append((name, rank, doc, pos))
        self.size += size
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self):
        rows, self.size = self.rows, 0
        self.rows = []
        if not rows:
            return
        name, rank, doc, pos = (np.concatenate(x) for x in zip(*rows))
        if not len(name):
            return
        order = np.lexsort((doc, rank, name))
        name, rank, doc, pos = name[order], rank[order], doc[order], pos[order]
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | (rank[1:] != rank[:-1])
        least = np.repeat(doc[head], np.diff(np.append(np.flatnonzero(head), len(doc))))
        settled = (doc >> self.shift) > (least >> self.shift)
        bucket = (name % _U(self.buckets)).astype(np.int64)
        out_b, out_s, out_d = [], [], []
        for which, keys in ((settled, doc % self.buckets), (~settled, bucket)):
            k = np.flatnonzero(which)
            k = k[np.argsort(keys[k], kind="stable")]
            for part in np.split(k, np.flatnonzero(np.diff(keys[k])) + 1):
                if len(part):
                    out_b.append(int(keys[part[0]]))
                    out_s.append(which is settled)
                    out_d.append(pack(name[part] // _U(self.buckets), rank[part], doc[part], pos[part]))
        for lo in range(0, len(out_b), 128):
            yield pa.RecordBatch.from_arrays([pa.array(out_b[lo:lo + 128], pa.int32()), pa.array(out_s[lo:lo + 128]),
                                              pa.array(out_d[lo:lo + 128], pa.binary())], names=["bucket", "settled", "data"])


def _receive(batches, shift: int):
    """Sorts each bucket by rank.  Rows (doc_id, code): code = 2 * position,
    plus 1 for a cell that is still open (equal names, other bytes)."""

    def emit(doc, code):
        for lo in range(0, len(doc), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo:lo + 50_000]), pa.array(code[lo:lo + 50_000])], names=["doc_id", "code"])

    def settle(blobs):
        name, rank, doc, pos = (np.concatenate(x) for x in zip(*(unpack(b) for b in blobs)))
        order = np.lexsort((doc, rank, name))
        name, rank, doc, pos = name[order], rank[order], doc[order], pos[order]
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | (rank[1:] != rank[:-1])
        least = np.repeat(doc[head], np.diff(np.append(np.flatnonzero(head), len(doc))))
        done = (doc >> shift) > (least >> shift)
        # cells under a name that has several ranks
        start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        several = np.add.reduceat(head, start) > 1
        still = np.repeat(several, np.diff(np.append(start, len(name)))) & ~done
        yield from emit(np.concatenate((doc[done], doc[still])), np.concatenate((2 * pos[done], 2 * pos[still] + 1)))

    have, blobs = None, []
    for b in batches:
        for bucket, settled, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            if settled:
                _, _, doc, pos = unpack(data)
                yield from emit(doc, 2 * pos)
                continue
            if bucket != have and blobs:
                yield from settle(blobs)
                blobs = []
            have = bucket
            blobs.append(data)
    if blobs:
        yield from settle(blobs)


_PACKED = "bucket int, settled boolean, data binary"


def _pressed(batches):
    """Texts compressed for their way through the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress((t or "").encode("utf-8", "surrogatepass"))
                                                                 for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "pressed"])


def _texts(column) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x) for x in column.to_pylist()], pa.large_binary())


def _settled(packed: DataFrame, shift: int) -> DataFrame:
    return (packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_receive, shift=shift), "doc_id long, code long")
            .groupBy("doc_id").agg(F.collect_list("code").alias("codes")))


def _codes(column, offs, lo, hi):
    """(row, position in the chunk, open) of the codes of some rows."""
    lists = [np.array(x or [], np.int64) for x in column.slice(lo, hi - lo).to_pylist()]
    row = np.repeat(np.arange(hi - lo), [len(x) for x in lists])
    code = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return row, offs[row] + code // 2, code % 2 == 1


def _member(at: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(at), bool)
    of = np.sort(of)
    k = np.searchsorted(of, at)
    k[k == len(of)] = 0
    return of[k] == at


def _row_keys(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (id, text) with a key ``doc_id`` for each row, and the number
    of its low bits that tell rows of one id apart: keys that differ above
    them are in the order of the ids.  Ids that are unique are their own keys."""
    again = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.max("n")).first()[0]
    if again is None:
        return rows.withColumn("doc_id", F.col("id")), 0
    placed = written(placed_in_order(rows.withColumn("tree", F.lit("")), ["tree", "id"]).select("id", "text", "at"), "suffix-rows")
    first = placed.groupBy("id").agg(F.min("at").alias("first"))
    shift = int(again).bit_length()
    return placed.join(first, "id").select("id", "text", (F.shiftleft("first", shift) + F.col("at") - F.col("first")).alias("doc_id")), shift


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Takes out every byte that a 50-byte string covers which also starts in
    a document with a smaller id.  One row per document row: (id, n_bytes,
    n_removed, spans, kept_sha256[, kept]); ``spans`` are the maximal removed
    runs (first byte, length), ``kept`` the bytes that stay.

    Texts are UTF-8 bytes; null and shorter texts lose nothing; matches never
    cross documents, repeats within one document stay.  Rows of one id are
    documents of their own that take nothing from each other.  A row without
    an id has no smaller one: it loses nothing and takes nothing."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, shift = _row_keys(rows.where("id IS NOT NULL"))
    ids = base.select(F.col("doc_id").alias("row"), "id")
    base = base.select("doc_id", "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))

    def send_cells(batches):
        sender = _Sender(buckets, shift)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, offs in text_chunks(b.column(1)):
                name, rank, row, p1, _, first = cells(buf, offs)
                k = p1 == first
                yield from sender.add(name[k], rank[k] >> _U(16), ids[lo:hi][row[k]], (p1 - offs[row])[k], len(buf))
        yield from sender.flush()

    def send_windows(batches):
        sender = _Sender(buckets, shift)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, offs in text_chunks(_texts(b.column(1))):
                _, code_at, code_open = _codes(b.column(2), offs, lo, hi)
                if not code_open.any():
                    continue
                name, rank, row, p1, p2, first = cells(buf, offs)
                r, at, h, same = _open_windows(buf, offs, row, p1, p2, _member(first, code_at[code_open]))
                k = at == same
                yield from sender.add(h[k] >> _U(16), h[k] & _U(0xFFFF), ids[lo:hi][r[k]], (at - offs[r])[k], 16 * int(k.sum()))
        yield from sender.flush()

    def take_out(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(_texts(b.column(1))):
                _, code_at, code_open = _codes(b.column(2), offs, lo, hi)
                step = np.zeros(len(buf) + 1, np.int32)
                if len(code_at):
                    _, _, row, p1, p2, first = cells(buf, offs)
                    gone = _member(first, code_at[~code_open])
                    np.add.at(step, p1[gone], 1)
                    np.add.at(step, p2[gone] + LENGTH, -1)
                    _, at, _, same = _open_windows(buf, offs, row, p1, p2, _member(first, code_at[code_open]) & ~gone)
                    _, window_at, more = _codes(b.column(3), offs, lo, hi)
                    at = at[_member(same, window_at[~more])]
                    np.add.at(step, at, 1)
                    np.add.at(step, at + LENGTH, -1)
                out = np.cumsum(step)[:-1] > 0
                kept, spans, sizes = [], [], np.diff(offs)
                for i in range(hi - lo):
                    x = out[offs[i]:offs[i + 1]]
                    t = buf[offs[i]:offs[i + 1]]
                    if x.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], x, [False])).astype(np.int8)))
                        spans.append([{"first": int(s), "n": int(e - s)} for s, e in zip(edge[::2], edge[1::2])])
                        t = t[~x]
                    else:
                        spans.append([])
                    kept.append(t.tobytes())
                cols = [b.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(sizes - np.array([len(k) for k in kept])),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["row", "n_bytes", "n_removed", "spans", "kept_sha256"]
                if keep_text:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    pressed = "doc_id long, pressed binary"
    cell_codes = _settled(base.mapInArrow(send_cells, _PACKED), shift)
    # texts and codes are shuffled by document once and used twice
    met = base.mapInArrow(_pressed, pressed).join(cell_codes, "doc_id", "left")
    window_codes = _settled(met.select("doc_id", "pressed", "codes").mapInArrow(send_windows, _PACKED), shift).withColumnRenamed("codes", "windows")
    none = F.lit(None).cast("array<bigint>")
    columns = "row long, n_bytes long, n_removed long, spans array<struct<first:bigint,n:bigint>>, kept_sha256 string" + ", kept binary" * keep_text
    got = met.join(window_codes, "doc_id", "left").select("doc_id", "pressed", "codes", "windows").mapInArrow(take_out, columns)
    if shift:
        got = got.join(ids, "row").withColumn("row", F.col("id")).drop("id")
    nameless = rows.where("id IS NULL").select(F.col("id").alias("doc_id"), "text").mapInArrow(_pressed, pressed)
    whole = nameless.select("doc_id", "pressed", none.alias("codes"), none.alias("windows")).mapInArrow(take_out, columns)
    return got.unionByName(whole).withColumnRenamed("row", id_col)
