"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex: every code point has a class, every class is
a transition function over a few scanner states, and an associative scan of
these functions (composition is a table lookup) gives the state before each
code point of a whole chunk of texts at once; state, class and next class
say where a piece begins.  The pieces' bytes are looked up in a cache of
merged pieces; those not met before are merged together, vectorised.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, text_chunks

# Classes of code points.
SINGLE, R, V, ELL, E, LETTER, NUMBER, APOSTROPHE, OTHER, SPACE, WHITE = range(11)
N_CLASSES = 11
# Scanner states: what the last code point was part of.
START, IN_L, IN_N, IN_O, SP, WS, AP, DONE, AP_R, AP_V, AP_L = range(11)
N_STATES = 11
# Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MAX_PIECES = 400_000
_NONE = np.int64(1 << 40)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
LONG_PIECE = 48


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, from the Unicode categories."""
    t = np.full(0x110000, OTHER, np.uint8)
    cats = "".join([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    first = np.frombuffer(cats.encode(), np.uint8)
    t[first == ord("L")] = LETTER
    t[first == ord("N")] = NUMBER
    t[WHITE_SPACE] = WHITE
    for c, k in (*((x, SINGLE) for x in "stmd"), ("r", R), ("v", V), ("l", ELL), ("e", E), ("'", APOSTROPHE), (" ", SPACE)):
        t[ord(c)] = k
    return t


def _next_state(s: int, c: int) -> int:
    if c == SPACE:
        return SP
    if c == WHITE:
        return WS
    if c == NUMBER:
        return IN_N
    if c == OTHER:
        return IN_O
    if c == APOSTROPHE:
        # a contraction can only begin where a piece begins
        return IN_O if s in (SP, IN_O, AP) else AP
    if s == AP:
        return {SINGLE: DONE, R: AP_R, V: AP_V, ELL: AP_L}.get(c, IN_L)
    if (s, c) in ((AP_R, E), (AP_V, E), (AP_L, ELL)):
        return DONE
    return IN_L


def _begins(s: int, c: int, nxt: int) -> bool:
    """Does a piece begin at a code point of class ``c``, after state ``s``?
    ``nxt``: class of the following code point, N_CLASSES at a text's end."""
    letter = c <= LETTER
    if s == START:
        return True
    if c in (SPACE, WHITE):
        return s not in (SP, WS) or nxt < SPACE
    if s == SP:
        return False
    if s == AP and letter:
        return not (c == SINGLE or (c in (R, V) and nxt == E) or (c == ELL and nxt == ELL))
    if s in (IN_L, AP_R, AP_V, AP_L):
        return not letter
    if s == IN_N:
        return c != NUMBER
    if s in (IN_O, AP):
        return c not in (OTHER, APOSTROPHE)
    return True


@lru_cache(1)
def monoid():
    """The transition functions that classes compose to.  Returns (function of
    each class and of each class at a text's start, composition table,
    application table, piece-begin table)."""
    basic = [tuple(_next_state(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
    basic += [tuple([_next_state(START, c)] * N_STATES) for c in range(N_CLASSES)]
    every = {tuple(range(N_STATES)): 0}
    todo = [tuple(range(N_STATES))]
    while todo:
        f = todo.pop()
        for g in basic:
            h = tuple(g[f[s]] for s in range(N_STATES))
            if h not in every:
                every[h] = len(every)
                todo.append(h)
    fs = list(every)
    table = np.array(fs, np.uint8)
    comp = np.array([[every[tuple(table[j][table[i]].tolist())] for j in range(len(fs))] for i in range(len(fs))], np.uint16)
    begins = np.array([[[_begins(s, c, n) for n in range(N_CLASSES + 1)] for c in range(N_CLASSES)] for s in range(N_STATES)])
    return np.array([every[f] for f in basic], np.uint16), comp, table, begins


def scan_states(f: np.ndarray, block: int = 128) -> np.ndarray:
    """State before each element of a sequence of transition functions."""
    _, comp, apply, _ = monoid()
    n = len(f)
    if n <= block:
        out = np.empty(n, np.uint8)
        s = START
        for i, x in enumerate(f.tolist()):
            out[i] = s
            s = apply[x, s]
        return out
    rows = -(-n // block)
    g = np.zeros(rows * block, np.uint16)
    g[:n] = f
    g = np.ascontiguousarray(g.reshape(rows, block).T)
    for j in range(1, block):
        g[j] = comp[g[j - 1], g[j]]
    enter = scan_states(g[-1], block)
    out = np.empty((block, rows), np.uint8)
    out[0] = enter
    out[1:] = apply[g[:-1], enter]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte at which each begins) of UTF-8 bytes."""
    if not len(buf) or buf.max() < 0x80:
        return buf.astype(np.int32), np.arange(len(buf))
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    pad = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int32)
    b = pad[at]
    cp = b.copy()
    for lead, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        k = np.flatnonzero((b >= lead) & (b < {1: 0xE0, 2: 0xF0, 3: 0x100}[more]))
        v = b[k] & mask
        for j in range(1, more + 1):
            v = (v << 6) | (pad[at[k] + j] & 0x3F)
        cp[k] = v
    return np.minimum(cp, 0x10FFFF), at


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes at which pieces begin in concatenated texts."""
    if not len(buf):
        return np.zeros(0, np.int64)
    cp, at = code_points(buf)
    c = class_table()[cp]
    functions, _, _, begins = monoid()
    first = np.searchsorted(at, offs[:-1][np.diff(offs) > 0])
    f = functions[c]
    f[first] = functions[c[first] + N_CLASSES]
    state = scan_states(f)
    state[first] = START
    nxt = np.full(len(c), N_CLASSES, np.uint8)
    nxt[:-1] = c[1:]
    nxt[first[first > 0] - 1] = N_CLASSES
    return at[begins[state, c, nxt]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Merges pieces by rank and keeps what it merged; at most
    ``MAX_PIECES`` pieces stay in memory (then it starts anew)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values()) + 1
        tokens = [b""] * n
        for t, i in ranks.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, ids = [], []
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    ids.append(i)
        # pairs in an open table, an eighth full at most
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int64)
        self.table_id = np.zeros(1 << bits, np.int64)
        homes = (np.array(keys, np.int64).astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        for k, i, h in zip(keys, ids, homes.tolist()):
            while self.table[h] >= 0 and self.table[h] != k:
                h = (h + 1) & ((1 << bits) - 1)
            self.table[h], self.table_id[h] = k, i
        self._reset()

    def _reset(self):
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece, with a heap over its neighbours."""
        n = len(piece)
        end = list(range(1, n + 1))
        prev, alive = list(range(-1, n - 1)), [True] * n
        get = self.ranks.get
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if prev[i] >= 0 and (r := get(piece[prev[i]:stop])) is not None:
                heapq.heappush(heap, (r, prev[i], i, stop))
        return np.array([self.ranks[piece[i:end[i]]] for i in range(n) if alive[i]], np.int32)

    def _pair_ids(self, key: np.ndarray) -> np.ndarray:
        """Id of each pair's token, ``_NONE`` where there is none."""
        h = (key.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        out = np.full(len(key), _NONE)
        rest = np.arange(len(key))
        while len(rest):
            have = self.table[h]
            hit = have == key
            out[rest[hit]] = self.table_id[h[hit]]
            on = ~hit & (have >= 0)
            rest, key, h = rest[on], key[on], (h[on] + 1) & (len(self.table) - 1)
        return out

    def _merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many short pieces at once; each round does each piece's best merge.
        Returns (ids of all pieces, their number by piece)."""
        sym = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        pid = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        ready_sym, ready_pid = [], []
        while len(sym):
            r = np.full(len(sym), _NONE)
            inner = np.flatnonzero(pid[:-1] == pid[1:])
            r[inner] = self._pair_ids((sym[inner] << 20) | sym[inner + 1])
            start = np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1])))
            count = np.diff(np.concatenate((start, [len(sym)])))
            best = np.minimum.reduceat(r, start)
            done = np.repeat(best == _NONE, count)
            ready_sym.append(sym[done])
            ready_pid.append(pid[done])
            hit = np.flatnonzero((r == np.repeat(best, count)) & ~done)
            if not len(hit):
                break
            hit = hit[np.concatenate(([True], pid[hit[1:]] != pid[hit[:-1]]))]
            sym[hit] = r[hit]
            keep = ~done
            keep[hit + 1] = False
            sym, pid = sym[keep], pid[keep]
        sym, pid = np.concatenate(ready_sym), np.concatenate(ready_pid)
        return sym[np.argsort(pid, kind="stable")], np.bincount(pid, minlength=len(pieces))

    def _keep(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        used, k = int(self.at[len(self.slot)]), len(self.slot)
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), used + len(ids)))
        if k + len(pieces) + 1 > len(self.at):
            self.at = np.resize(self.at, max(2 * len(self.at), k + len(pieces) + 1))
        self.ids[used:used + len(ids)] = ids
        self.at[k + 1:k + len(pieces) + 1] = used + np.cumsum(counts)
        self.slot.update(zip(pieces, range(k, k + len(pieces))))

    def _learn(self, pieces: list[bytes]) -> None:
        whole = [p for p in pieces if p in self.ranks]
        rest = [p for p in pieces if p not in self.ranks]
        short = [p for p in rest if len(p) <= LONG_PIECE]
        if whole:
            self._keep(whole, np.array([self.ranks[p] for p in whole], np.int32), np.ones(len(whole), np.int64))
        if short:
            self._keep(short, *self._merge_many(short))
        for p in rest:
            if len(p) > LONG_PIECE:
                x = self._merge_long(p)
                self._keep([p], x, np.array([len(x)]))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text)."""
        starts = piece_starts(buf, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        raw = buf.tobytes()
        cut = starts.tolist()
        cut.append(len(raw))
        pieces = [raw[a:b] for a, b in zip(cut, cut[1:])]
        if len(self.slot) > MAX_PIECES:
            self._reset()
        get = self.slot.get
        slots = list(map(get, pieces))
        if None in slots:
            self._learn(list(dict.fromkeys([p for p, s in zip(pieces, slots) if s is None])))
            slots = list(map(get, pieces))
        slots = np.array(slots)
        at = self.at
        n = at[slots + 1] - at[slots]
        before = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(at[slots] - before[:-1], n) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offs)]

    def offsets(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Byte of its text at which each token begins."""
        size = self.size[ids]
        at = np.concatenate(([0], np.cumsum(size)))
        return at[:-1] - np.repeat(at[before[:-1]], np.diff(before))

    def decode(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bytes before each text)."""
        size = self.size[ids]
        at = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[np.repeat(self.begin[ids] - at[:-1], size) + np.arange(at[-1])], at[before]


_CODECS: list = []


def _codec(ranks: dict[bytes, int]) -> Codec:
    """A worker keeps the codec of the last vocabulary it was given."""
    if not _CODECS or _CODECS[0].ranks is not ranks and _CODECS[0].ranks != ranks:
        _CODECS[:] = [Codec(ranks)]
    return _CODECS[0]


def _binary(data: np.ndarray, before: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(before) - 1,
                                 [None, pa.py_buffer(before.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _lists(ids: np.ndarray, before: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids.astype(np.int32), pa.int32()))


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
           with_offsets: bool = True, with_decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep`` columns, ids[, offsets][, decoded]) of every row, without
    special tokens.

    ``offsets`` are the bytes of the text at which the tokens begin;
    ``decoded`` the bytes that the ids give back.  Null and empty texts have
    no ids; repeated rows are encoded each for itself."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary
    carried = (id_col, *keep)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    names = [*carried, "ids"] + ["offsets"] * with_offsets + ["decoded"] * with_decoded

    def run(batches):
        codec = _codec(shared.value)
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column(len(carried)), CHUNK_BYTES):
                ids, before = codec.encode(buf, offs)
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(carried))] + [_lists(ids, before)]
                if with_offsets:
                    cols.append(_lists(codec.offsets(ids, before), before))
                if with_decoded:
                    cols.append(_binary(*codec.decode(ids, before)))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        codec._reset()  # the worker may go on to other work

    return docs.select(*carried, text_col).mapInArrow(
        run, f"{fields}, ids array<int>" + ", offsets array<int>" * with_offsets + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of every row of ids; null is an empty list.  An id that
    the vocabulary lacks is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                before = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                data, at = codec.decode(np.concatenate(lists) if len(lists) else np.zeros(0, np.int64), before)
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(data, at)], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
