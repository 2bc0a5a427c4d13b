"""Benchmark decontamination by positions.

Windows (runs of item words) are indexed by their rarest term - rarest by
counts over all documents.  Documents are scanned forward, a chunk at a time:
where a rarest term stands, the words at the offsets of the window's other
terms are compared, rarest first.  What is left are exact phrase matches.  No
postings of the documents are stored.  Test items come in blocks of bounded
size, one pass each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, keyed, scan_words, text_chunks, written

WINDOW = 13
#: Bytes of item text in a block of test items: bounds what is broadcast.
BLOCK_BYTES = 16 << 20
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))


@dataclass
class Windows:
    """Distinct windows of a block of items.  ``terms`` are sorted word
    hashes; a window is a row of term numbers, padded by -1; ``anchor`` is
    the offset of its rarest term, ``order`` its offsets from rare to common."""

    terms: np.ndarray
    rows: np.ndarray
    sizes: np.ndarray
    items: list[np.ndarray]
    order: np.ndarray | None = None
    by_anchor: np.ndarray | None = None
    first: np.ndarray | None = None


#: Stands for the id of items that have none: their words count as hit, but
#: no id is listed.
NO_ID = -(1 << 63)


def cut_windows(item_ids: list[int], texts: list[str | None], size: int = WINDOW) -> Windows:
    """Runs of ``size`` words of each item; a shorter item, if not empty, is
    one window.  Equal windows are kept once with all their items."""
    found: dict[bytes, list] = {}
    pieces = []
    for lo, hi, buf, offs in text_chunks(pa.array(texts, pa.string())):
        _, _, h, before = scan_words(buf, offs, ALNUM_SEPARATORS)
        for i, (a, b) in enumerate(zip(before[:-1], before[1:])):
            w = h[a:b]
            pieces.append(w)
            for j in range(max(1, len(w) - size + 1) if len(w) else 0):
                found.setdefault(w[j:j + size].tobytes(), []).append(item_ids[lo + i])
    terms = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)
    rows = np.full((len(found), size), -1, np.int32)
    sizes = np.zeros(len(found), np.int32)
    for r, key in enumerate(found):
        w = np.frombuffer(key, np.uint64)
        sizes[r] = len(w)
        rows[r, :len(w)] = np.searchsorted(terms, w)
    return Windows(terms, rows, sizes, [np.unique(v) for v in found.values()])


def plan_lookups(w: Windows, counts: np.ndarray) -> None:
    """Orders each window's offsets by its terms' counts (ties: leftmost)."""
    c = np.where(w.rows >= 0, counts[w.rows] if len(counts) else 0, np.iinfo(np.int64).max)
    w.order = np.argsort(c, axis=1, kind="stable").astype(np.int32)
    anchor = w.rows[np.arange(len(w.rows)), w.order[:, 0]]
    w.by_anchor = np.argsort(anchor, kind="stable")
    w.first = np.searchsorted(anchor[w.by_anchor], np.arange(len(w.terms) + 1))


def term_numbers(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Number of each word among the terms, -1 for others."""
    if not len(terms):
        return np.full(len(h), -1, np.int32)
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    return np.where(terms[at] == h, at, -1).astype(np.int32)


def find_phrases(ids: np.ndarray, doc: np.ndarray, w: Windows):
    """(window, first word) of every occurrence within one document of the
    shard.  ``ids``: term number of each word, ``doc``: its row."""
    anchored = np.diff(w.first)
    pos = np.flatnonzero(ids >= 0)
    pos = pos[anchored[ids[pos]] > 0]
    n = anchored[ids[pos]]
    which = w.by_anchor[np.repeat(w.first[ids[pos]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    start = np.repeat(pos, n) - w.order[which, 0]
    end = start + w.sizes[which] - 1
    ok = (start >= 0) & (end < len(ids))
    which, start, end = which[ok], start[ok], end[ok]
    ok = doc[start] == doc[end]
    which, start = which[ok], start[ok]
    for k in range(1, w.rows.shape[1]):
        if not len(which):
            break
        off = w.order[which, k]
        term = w.rows[which, off]
        ok = term < 0
        live = np.flatnonzero(~ok)
        ok[live] = ids[start[live] + off[live]] == term[live]
        which, start = which[ok], start[ok]
    return which, start


def find_near(ids: np.ndarray, doc: np.ndarray, w: Windows, slop: int):
    """(window, first word, last word) where all distinct terms of a window
    occur, in any order, within size + ``slop`` words around its rarest term
    and not already as a phrase."""
    out = []
    post: dict[int, np.ndarray] = {}
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]

    def postings(t):
        if t not in post:
            a, b = np.searchsorted(sorted_ids, [t, t + 1])
            post[t] = order[a:b]
        return post[t]

    exact = set(zip(*(x.tolist() for x in find_phrases(ids, doc, w))))
    for r in range(len(w.rows)):
        terms = w.rows[r, w.order[r, :w.sizes[r]]]
        span = int(w.sizes[r]) + slop
        uniq = list(dict.fromkeys(terms.tolist()))
        for p in postings(uniq[0]).tolist():
            near = [(p, 0)]
            for i, t in enumerate(uniq[1:], 1):
                q = postings(t)
                a, b = np.searchsorted(q, [p - span + 1, p + span])
                q = q[a:b][doc[q[a:b]] == doc[p]]
                if not len(q):
                    break
                near += [(int(x), i) for x in q]
            else:
                near.sort()
                have: dict[int, int] = {}
                for x, i in near:
                    have[i] = x
                    if len(have) == len(uniq) and max(have.values()) - min(have.values()) < span:
                        lo, hi = min(have.values()), max(have.values())
                        if lo <= p <= hi and (r, lo) not in exact:
                            out.append((r, lo, hi))
                            break
    return out


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Test items in blocks of bounded text; an item longer than a block is
    one block of its own."""
    sized = items.select(F.coalesce("item_id", F.lit(NO_ID)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [sized.where(F.pmod(F.xxhash64("item_id", F.lit(3)), F.lit(n)) == i) for i in range(n)]


def _term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        t = shared.value
        have = np.zeros(len(t), np.int64)
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column(0)):
                ids = term_numbers(scan_words(buf, offs, ALNUM_SEPARATORS)[2], t)
                have += np.bincount(ids[ids >= 0], minlength=len(t))
        k = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(have[k])], names=["t", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int | None = None,
         block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id, n_words, n_hit, spans, items, near).

    ``spans`` are the maximal runs of hit words (first word, length), ``items``
    the sorted ids of items with an occurring window, ``near`` - only with
    ``slop`` - the items matched by proximity alone.  Null and empty texts have
    no words; items without words match nothing; the windows of an item without
    an id count, but it is in no list; repeated rows and rows without an id each
    give a row, whatever the number of blocks.
    """
    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    blocks = _blocks(items, block_bytes)
    if len(blocks) == 1:
        return _scan_block(base, _lookup(base, blocks[0], size), slop)
    base, key = keyed(base)
    return _scan_blocks(base.select(key, id_col, "text"), blocks, size, slop).drop(key)


def _scan_blocks(base: DataFrame, blocks: list[DataFrame], size: int, slop: int | None) -> DataFrame:
    """The results of all blocks, one at a time, by row.  The first column of
    ``base`` is the row's key, the last one its text."""
    carried = base.columns[:-1]
    parts = []
    for block in blocks:
        got = _scan_block(base, _lookup(base, block, size), slop)
        # every row is in the first part
        parts.append(written(got.where("n_hit > 0 OR size(near) > 0") if parts else got, "phrases"))
    whole = reduce(DataFrame.union, parts)

    def lists(c):
        return F.flatten(F.collect_list(c)).alias(c)

    whole = whole.groupBy(carried[0]).agg(*[F.first(c).alias(c) for c in carried[1:]], F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"),
                                          lists("spans"), *[F.array_sort(F.array_distinct(lists(c))).alias(c) for c in ("items", "near")])
    whole = whole.select(*parts[0].columns)
    at = [whole.columns.index(c) for c in ("n_hit", "spans")]

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            spans = [_joined(x) for x in cols[at[1]].to_pylist()]
            cols[at[0]] = pa.array([sum(s["n"] for s in x) for x in spans], pa.int64())
            cols[at[1]] = pa.array(spans, SPANS)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return whole.mapInArrow(run, whole.schema)


def _joined(spans: list[dict]) -> list[dict]:
    """The maximal runs of spans that overlap or touch."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["first"] + out[-1]["n"]:
            out[-1]["n"] = max(out[-1]["n"], s["first"] + s["n"] - out[-1]["first"])
        else:
            out.append(dict(s))
    return out


def _lookup(base: DataFrame, block: DataFrame, size: int) -> Windows:
    rows = sorted((r["item_id"], r["text"]) for r in block.collect())
    w = cut_windows([i for i, _ in rows], [t for _, t in rows], size)
    plan_lookups(w, _term_counts(base, w.terms))
    return w


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that are not contaminated, each
    judged for itself.  With one block of items nothing is shuffled; with
    several, rows meet their results by a key of their own."""
    blocks = _blocks(items, block_bytes)
    if len(blocks) > 1:
        rows, key = keyed(docs)
        got = _scan_blocks(rows.select(key, F.col(text_col).alias("text")), blocks, size, None)
        bad = got.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(key)
        return rows.join(bad, key, "left_anti").select(*docs.columns)
    looked = _lookup(docs.select(F.col(text_col).alias("text")), blocks[0], size)
    shared = docs.sparkSession.sparkContext.broadcast(looked)
    at = docs.columns.index(text_col)

    def run(batches):
        w = shared.value
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for lo, hi, buf, offs in text_chunks(b.column(at)):
                *_, n_words, n_hit = _match(buf, offs, w)
                clean[lo:hi] = ~((n_hit > 0) & (20 * n_hit >= n_words))
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _match(buf: np.ndarray, offs: np.ndarray, w: Windows):
    """Occurrences in a chunk of texts, hit words, and their numbers by row."""
    _, _, h, before = scan_words(buf, offs, ALNUM_SEPARATORS)
    ids = term_numbers(h, w.terms)
    n_words = np.diff(before)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    which, start = find_phrases(ids, doc, w)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + w.sizes[which], -1)
    hit = np.cumsum(step)[:len(ids)] > 0
    return ids, before, doc, which, start, hit, n_words, np.bincount(doc[hit], minlength=len(n_words))


def _scan_block(base: DataFrame, windows: Windows, slop: int | None) -> DataFrame:
    """Results beside the columns of ``base``, of which the last is the text."""
    shared = base.sparkSession.sparkContext.broadcast(windows)
    carried = base.columns[:-1]

    def run(batches):
        w = shared.value
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column(len(carried))):
                ids, before, doc, which, start, hit, n_words, n_hit = _match(buf, offs, w)
                spans = [[] for _ in range(hi - lo)]
                items = [set() for _ in range(hi - lo)]
                near = [set() for _ in range(hi - lo)]
                border = doc[1:] != doc[:-1]
                begin = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | border))) if len(hit) else hit
                end = np.flatnonzero(hit & np.concatenate((~hit[1:] | border, [True]))) if len(hit) else hit
                for a, e in zip(begin.tolist(), end.tolist()):
                    spans[doc[a]].append({"first": int(a - before[doc[a]]), "n": e - a + 1})
                for r, s in zip(which.tolist(), start.tolist()):
                    items[doc[s]].update(w.items[r].tolist())
                if slop is not None:
                    for r, a, _ in find_near(ids, doc, w, slop):
                        near[doc[a]].update(w.items[r].tolist())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(len(carried))), pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                     pa.array(spans, SPANS), pa.array([sorted(x - {NO_ID}) for x in items], pa.list_(pa.int64())),
                     pa.array([sorted(x - y - {NO_ID}) for x, y in zip(near, items)], pa.list_(pa.int64()))],
                    names=[*carried, "n_words", "n_hit", "spans", "items", "near"])

    kinds = "".join(f"`{c}` {base.schema[c].dataType.simpleString()}, " for c in carried)
    return base.mapInArrow(run, f"{kinds}n_words long, n_hit long, "
                                "spans array<struct<first:bigint,n:bigint>>, items array<bigint>, near array<bigint>")


def contaminated(n_hit, n_words):
    """The contract's rule: some hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
