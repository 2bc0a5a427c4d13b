"""Ranked lexical search by sequential reads only (NRA, no random access).

Texts are scanned once for the words of the asked items; the counts over all
documents give each word's weight, and each (word, document) an integer
impact.  An index shard holds some thousand documents: for each word its
postings by falling impact.  For an item the lists of its words are read from
the top, a run of postings at a time.  What was read of a document is its
lower bound; the impacts at which the unread lists stand add up to its upper
bound.  A document whose upper bound is under the k-th lower one is out.
Reading goes on until nothing unseen can come in and each document left has
equal bounds, so that membership, order, ties and scores are final.

Shards are searched for themselves and merged exactly, since weights and mean
length are global.  The k-th score of a sixteenth of the shards is a floor for
the others, which lets most of their lists go unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, LOWER, flat_lists, hash_words, keyed, scan_words, text_chunks, written

#: Bytes of distinct words of the items that are searched at a time.
BLOCK_BYTES = 8 << 20
#: Postings of an index shard (a document's are never parted).
SHARD_POSTINGS = 500_000
#: Postings first read of each list; every further run is twice as long.
FIRST_RUN = 128
FLOOR_SHARE = 16
_NONE = np.iinfo(np.int64).max


@dataclass
class Words:
    """The items' distinct words: sorted by hash, with their bytes."""

    hashes: np.ndarray
    data: np.ndarray
    offs: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        h = hash_words(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        words = [words[i] for i in order.tolist()]
        return cls(h[order], np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64))))

    def find(self, low: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given words, its number here): by hash, then byte by byte."""
        which, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.hashes):
            return which[0], number[0]
        at = np.searchsorted(self.hashes, h)
        live = np.arange(len(h))
        while len(live):  # a second turn only where two words share a hash
            live = live[at[live] < len(self.hashes)]
            live = live[self.hashes[at[live]] == h[live]]
            same = live[self._equal(low, s[live], e[live], at[live])]
            which.append(same)
            number.append(at[same])
            at = at + 1
        return np.concatenate(which), np.concatenate(number)

    def _equal(self, low, s, e, at):
        n = e - s
        ok = n == self.offs[at + 1] - self.offs[at]
        if not ok.any():
            return ok
        k = np.flatnonzero(ok)
        n, first = n[k], np.concatenate(([0], np.cumsum(n[k])[:-1]))
        step = np.arange(n.sum()) - np.repeat(first, n)
        differ = low[np.repeat(s[k], n) + step] != self.data[np.repeat(self.offs[at[k]], n) + step]
        ok[k[np.add.reduceat(differ, first) > 0]] = False
        return ok


def distinct_words(items: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, words): the distinct words of each text that has any."""

    def run(batches):
        for b in batches:
            keys, words = [], []
            for lo, hi, buf, offs in text_chunks(b.column(1)):
                s, e, _, before = scan_words(buf, offs, ALNUM_SEPARATORS)
                low = LOWER[buf].tobytes()
                for r in range(hi - lo):
                    span = slice(before[r], before[r + 1])
                    found = {low[i:j] for i, j in zip(s[span].tolist(), e[span].tolist())}
                    if found:
                        keys.append(b.column(0)[lo + r].as_py())
                        words.append(sorted(found))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.binary()))], names=["key", "words"])

    return items.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, "key long, words array<binary>")


def item_blocks(words: DataFrame, block_bytes: int):
    """Lists of (key, words) of bounded size, one at a time; an item of more
    words than that is a block of its own."""
    block, size = [], 0
    for r in words.toLocalIterator(prefetchPartitions=False):
        found = [bytes(w) for w in r["words"]]
        n = sum(map(len, found)) + 64 * len(found)
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["key"], found))
        size += n
    if block:
        yield block


def _forward(words: Words):
    """Per document: id, its number of words, the items' words in it and how
    often they occur."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column(1)):
                s, e, h, before = scan_words(buf, offs, ALNUM_SEPARATORS)
                which, number = words.find(LOWER[buf], s, e, h)
                row = np.searchsorted(before, which, side="right") - 1
                k, tf = np.unique(row * max(1, len(words.hashes)) + number, return_counts=True)
                row, number = np.divmod(k, max(1, len(words.hashes)))
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = [(number[i:j], tf[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(before), pa.int64()),
                     flat_lists([x[0] for x in lists], np.int32, pa.int32()), flat_lists([x[1] for x in lists], np.int32, pa.int32())],
                    names=["doc_id", "n", "words", "tf"])

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, rows' first places) of a column of lists."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = a.offsets.to_numpy()
    return a.values.to_numpy()[offs[0]:offs[-1]], offs - offs[0]


def _frequency(n_words: int):
    """(word, documents that hold it), summed up by each task."""

    def run(batches):
        df = np.zeros(n_words, np.int64)
        for b in batches:
            df += np.bincount(_flat(b.column("words"))[0], minlength=n_words)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(df[k])], names=["word", "df"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Counts:
    """Documents with a word, their words, and the weight of each word."""

    n_docs: int
    n_words: int
    weights: np.ndarray


_SHARD = "ids array<bigint>, words array<int>, first array<int>, docs array<int>, impacts array<bigint>"


def _shard(ids, n, words, tf, rows, counts: Counts):
    """The index row of some documents: for each word its postings by falling
    impact, equal ones by place."""
    m = 50 + (50 * n * counts.n_docs) // counts.n_words
    impact = counts.weights[words] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[rows]))
    order = np.lexsort((rows, -impact, words))
    order = order[impact[order] > 0]
    words, rows, impact = words[order], rows[order], impact[order]
    held, first = np.unique(words, return_index=True)
    one = [(ids, np.int64, pa.int64()), (held, np.int32, pa.int32()), (np.append(first, len(words)), np.int32, pa.int32()),
           (rows, np.int32, pa.int32()), (impact, np.int64, pa.int64())]
    return pa.RecordBatch.from_arrays([flat_lists([np.asarray(v)], d, t) for v, d, t in one], names=["ids", "words", "first", "docs", "impacts"])


def _indexer(counts: Counts):
    def run(batches):
        held, size = [], 0
        for b in batches:
            words, offs = _flat(b.column("words"))
            if not len(words):
                continue
            ids = b.column("doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False)
            tf, n = _flat(b.column("tf"))[0].astype(np.int64), b.column("n").to_numpy().astype(np.int64)
            lo = 0
            while lo < len(ids):
                hi = int(np.searchsorted(offs, offs[lo] + SHARD_POSTINGS - size, side="right")) - 1
                hi = min(len(ids), max(hi, lo if held else lo + 1))
                if hi > lo:
                    held.append((ids[lo:hi], n[lo:hi], words[offs[lo]:offs[hi]].astype(np.int64), tf[offs[lo]:offs[hi]], np.diff(offs[lo:hi + 1])))
                    size += int(offs[hi] - offs[lo])
                lo = hi
                if lo < len(ids):
                    yield _joined(held, counts)
                    held, size = [], 0
        if held:
            yield _joined(held, counts)

    return run


def _joined(held, counts: Counts):
    ids, n, words, tf, each = (np.concatenate(x) for x in zip(*held))
    return _shard(ids, n, words, tf, np.repeat(np.arange(len(ids)), each), counts)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, floor: int = 0, reads: list | None = None):
    """(documents, scores) of the k best with at least ``floor`` and above 0,
    best first, equal scores by the lesser id.

    ``lists`` are (documents, impacts) by falling impact; they are only read
    on from where they stand.  Sums stay below 2 ** 53, so they are exact.
    ``reads`` receives the number of postings read."""
    n_docs, n_lists = len(ids), len(lists)
    lower = np.zeros(n_docs)
    seen = np.zeros((n_docs, n_lists), np.float32)
    stand, front = np.zeros(n_lists, np.int64), np.array([x[1][0] if len(x[1]) else 0 for x in lists], np.float64)
    ends = np.array([len(x[0]) for x in lists], np.int64)
    out = np.zeros(n_docs, bool)  # documents whose upper bound is too low
    run, total = FIRST_RUN, 0
    while True:
        for t in np.flatnonzero(stand < ends).tolist():
            docs, impacts = lists[t]
            lo, hi = int(stand[t]), int(min(stand[t] + run, ends[t]))
            lower[docs[lo:hi]] += impacts[lo:hi]  # a list holds a document once
            seen[docs[lo:hi], t] = 1
            stand[t], front[t] = hi, impacts[hi - 1] if hi < ends[t] else 0
            total += hi - lo
        run *= 2
        rest = front.sum()
        live = np.flatnonzero((lower > 0) & ~out)
        need = max(floor, 1)
        if len(live) >= k:
            need = max(need, np.partition(lower[live], len(live) - k)[len(live) - k])
        upper = lower[live] + rest - seen[live] @ front
        weak = upper < need
        out[live[weak]] = True
        live, upper = live[~weak], upper[~weak]
        if rest < need and (upper == lower[live]).all():
            break
    if reads is not None:
        reads.append(total)
    best = live[np.lexsort((ids[live], -lower[live]))[:k]]
    return best, lower[best].astype(np.int64)


def _searcher(items: list[tuple[int, np.ndarray]], k: int, floors: np.ndarray):
    """Index rows -> (key, doc_id, score) of the k best of each shard."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in b.schema.names}
                ids, first, docs, impacts = row["ids"], row["first"], row["docs"], row["impacts"].astype(np.float64)
                keys, found, scores = [], [], []
                for (key, words), floor in zip(items, floors.tolist()):
                    at = np.searchsorted(row["words"], words)
                    at = at[at < len(row["words"])]
                    at = at[np.isin(row["words"][at], words)]
                    lists = [(docs[first[t]:first[t + 1]], impacts[first[t]:first[t + 1]]) for t in np.unique(at).tolist()]
                    if not lists or sum(x[1][0] for x in lists) < floor:
                        continue
                    best, score = nra(lists, ids, k, floor)
                    keys.append(np.full(len(best), key))
                    found.append(ids[best])
                    scores.append(score)
                if keys:
                    found = np.concatenate(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys), pa.int64()), pa.array(found, pa.int64(), mask=found == _NONE), pa.array(np.concatenate(scores), pa.int64())],
                        names=["key", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_index(docs: DataFrame, words: Words) -> DataFrame:
    """The written index of ``docs`` (doc_id, text) over the given words."""
    fwd = written(docs.mapInArrow(_forward(words), "doc_id long, n long, words array<int>, tf array<int>"), "ranked-forward")
    fwd = fwd.where("n > 0")
    n_docs, n_words = fwd.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(words.hashes), np.int64)
    df = fwd.select("words").mapInArrow(_frequency(len(weights)), "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    for r in df.toLocalIterator():  # one row for each word of the block
        weights[r["word"]] = weight(n_docs, r["df"])
    return written(fwd.where(F.size("words") > 0).mapInArrow(_indexer(Counts(n_docs, n_words, weights)), _SHARD), "ranked-index")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, id, score): for each row of ``items`` the k best rows of
    ``docs`` with a score above 0.

    Words are runs of letters, digits and bytes beyond ASCII, only A-Z lower-cased.  Null and wordless
    texts match nothing and do not count.  Ranks are unique: equal scores by
    the lesser id, rows without an id last, rows of one id in any order.
    Repeated items, also without an id, are answered each.  Extra columns are
    ignored.  Items are taken in blocks of ``block_bytes`` of words, so what
    is broadcast is bounded; the texts are scanned once for each block."""
    rows, key = keyed(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    best = None
    for block in item_blocks(written(distinct_words(rows, key, "text"), "ranked-words"), block_bytes):
        words = Words.of(sorted({w for _, ws in block for w in ws}))
        number = {words.data[a:b].tobytes(): i for i, (a, b) in enumerate(zip(words.offs[:-1].tolist(), words.offs[1:].tolist()))}
        asked = [(i, np.sort(np.array([number[w] for w in ws], np.int64))) for i, ws in block]
        index = build_index(base, words)
        part = F.pmod(F.xxhash64(F.element_at("ids", 1), F.size("docs")), F.lit(FLOOR_SHARE))
        found = _searched(index, part == 0, asked, k, np.zeros(len(asked), np.int64))
        floors = np.zeros(len(asked), np.int64)
        place = {i: n for n, (i, _) in enumerate(asked)}
        for r in _best(found, k).where(F.col("rank") == k).select("key", "score").toLocalIterator():
            floors[place[r["key"]]] = r["score"]
        found = found.unionByName(_searched(index, part != 0, asked, k, floors))
        found = written(_best(found, k), "ranked-best")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = docs.sparkSession.createDataFrame([], "key long, doc_id long, score long, rank int")
    return best.join(rows.select(F.col(key).alias("key"), "item_id"), "key").select(
        F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def _searched(index: DataFrame, part: Column, asked, k: int, floors: np.ndarray) -> DataFrame:
    return written(index.where(part).mapInArrow(_searcher(asked, k, floors), "key long, doc_id long, score long"), "ranked-found")
