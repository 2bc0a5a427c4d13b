"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

``fold`` undoes homoglyphs and digit substitutions and turns everything that
is not a letter into a blank, so that an entry `` word`` starts at a word
start and `` word `` is a whole word.  ``fit_lexicon`` learns entries (whole
words and word starts, so inflected forms are met too) from labelled texts;
``score`` sums the weights of the matches, takes off those inside exception
phrases, divides by the length and maps the density to 0..1.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts, and digits and signs, that are
# written in place of Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ӏ": "l", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "not stupid", "circus clown")


class _Fold(dict):
    """Code point -> folded text; filled as code points occur.  Signs that
    stand for letters do so only through ``fold`` (inside a word)."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if c in INVISIBLE:
            out = ""
        else:
            c = unicodedata.normalize("NFKC", c).lower()
            out = "".join(HOMOGLYPHS.get(x, x) if x.isalpha() else x if x in SUBSTITUTES else " " for x in c)
        self[cp] = out
        return out


_FOLD = _Fold()
_SUBST = str.maketrans(SUBSTITUTES)
_BLANK = str.maketrans(dict.fromkeys(SUBSTITUTES, " "))


def fold(text: str | None) -> str:
    """Blank-padded folded text of the same words; null is an empty text."""
    text = (text or "").translate(_FOLD)
    if not text.isalpha():
        # a sign stands for a letter only in a word that has letters
        words = text.split()
        text = " ".join([w if w.isalpha() else w.translate(_SUBST) if any(map(str.isalpha, w)) and not w[-3:].isdigit()
                         else w.translate(_BLANK) for w in words])
    return f" {text} "


@dataclass
class Lexicon:
    """Weighted entries over folded text, phrases in which they are harmless,
    and the line that maps a text's density to a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    offset: float = 0.0
    pad_words: float = 200.0
    _auto: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}

    def automaton(self):
        if self._auto is None:
            auto = ahocorasick.Automaton()
            for e, w in self.weights.items():
                auto.add_word(e, (len(e), w, False))
            for p in self.exceptions:
                auto.add_word(f" {p} ", (len(p) + 2, 0.0, True))
            if len(auto):
                auto.make_automaton()
            self._auto = auto
        return self._auto

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text; of entries that begin at
        the same place the heaviest counts, none inside an exception."""
        auto = self.automaton()
        if not len(auto):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (n, w, exc) in auto.iter(folded):
            s = end - n + 1
            if exc:
                spared.append((s, end + 1))
            elif s not in best or w > best[s][1]:
                best[s] = (end + 1, w)
        return [(s, e, w) for s, (e, w) in sorted(best.items())
                if not any(a <= s and e <= b for a, b in spared)]

    def density(self, folded: str) -> tuple[float, int]:
        hits = self.matches(folded)
        if not hits:
            return 0.0, 0
        return sum(w for _, _, w in hits) / math.sqrt(self.pad_words + folded.count(" ")), len(hits)

    def score(self, text: str | None) -> tuple[float, int]:
        """0 to 1; a text without a match (an empty one too) scores below
        every text with one."""
        d, n = self.density(fold(text))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * (math.log(d + 1e-3) + self.offset))))), n


def word_starts(folded: str, least: int = 3, most: int = 8) -> set[str]:
    """Entries that a text could give: its words and the starts of them."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in range(least, min(most, len(w)) + 1):
            out.add(" " + w[:k])
    return out


def _count_entries(batches):
    for b in batches:
        tox: dict[str, int] = {}
        ok: dict[str, int] = {}
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            into = tox if y else ok
            for e in word_starts(fold(t)):
                into[e] = into.get(e, 0) + 1
        keys = list(tox.keys() | ok.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tox.get(k, 0) for k in keys], pa.int64()),
                                          pa.array([ok.get(k, 0) for k in keys], pa.int64())], names=["entry", "tox", "ok"])


def _sketch(batches):
    """A key that near copies share (least hash of three-word runs)."""
    for b in batches:
        keys = []
        for t in b.column(1).to_pylist():
            w = (t or "").split()
            keys.append(min((hash_text(" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.int64())],
                                         names=["doc_id", "text", "y", "k"])


def hash_text(s: str) -> int:
    import zlib

    b = s.encode()
    return (zlib.crc32(b) << 31) ^ zlib.adler32(b)


def fit_lexicon(sample: DataFrame, min_support: int | None = None, max_rate: float = 0.1, max_entries: int = 2000, cover: int = 4,
                exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from ``sample`` (doc_id, text, y), a bounded table.  Entries are
    counted by class in Spark, copies once.  Taken are, by falling cover times log odds, the
    entries that meet at least ``min_support`` (by default a hundredth, 3 to 5)
    toxic texts not yet met ``cover`` times
    and at most ``max_rate`` as large a share of the others as of the toxic.  Without both
    classes the lexicon is empty.  The driver receives candidate entries (the
    50 * ``max_entries`` met most often, at most) and which of them each toxic
    text of the sample has."""
    from .common import written

    keyed = sample.mapInArrow(_sketch, "doc_id long, text string, y int, k long")
    once = written(keyed.groupBy("k", "y").agg(F.min_by("text", "doc_id").alias("text")).select("text", "y"), "toxicity-fit")
    n = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t_all, o_all = n.get(1, 0), n.get(0, 0)
    if not t_all or not o_all:
        return Lexicon({}, exceptions)
    if min_support is None:
        min_support = max(3, min(5, t_all // 100))
    counts = (once.mapInArrow(_count_entries, "entry string, tox long, ok long")
              .groupBy("entry").agg(F.sum("tox").alias("tox"), F.sum("ok").alias("ok"))
              .where((F.col("tox") >= min_support) & (F.col("ok") * t_all <= max_rate * F.col("tox") * o_all)))
    cand = {r["entry"]: (r["tox"], r["ok"]) for r in counts.orderBy(F.desc("tox"), "entry").limit(50 * max_entries).collect()}
    # a longer entry that is as common as its own start adds nothing
    cand = {e: c for e, c in cand.items()
            if not (len(e) > 4 and cand.get(e.rstrip()[:-1], (0, 0)) == c) and not (e[-1] == " " and cand.get(e.rstrip()) == c)}
    names = list(cand)
    where = {e: i for i, e in enumerate(names)}

    def _incidence(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([[where[e] for e in word_starts(fold(t)) if e in where] for t in b.column(0).to_pylist()],
                          pa.list_(pa.int32()))], names=["hits"])

    rows = [r["hits"] for r in once.where("y = 1").select("text").mapInArrow(_incidence, "hits array<int>").collect()]
    by = [[] for _ in names]
    for d, hits in enumerate(rows):
        for i in hits:
            by[i].append(d)
    by = [np.array(x, np.int64) for x in by]
    odds = {e: math.log((t + 0.5) / (t_all + 1)) - math.log((o + 0.5) / (o_all + 1)) for e, (t, o) in cand.items()}
    met = np.zeros(len(rows), np.int64)
    taken, left = {}, set(range(len(names)))
    gain = {i: len(by[i]) for i in left}
    while left and len(taken) < max_entries:
        # lazy greedy: gains only fall
        i = max(left, key=lambda j: (gain[j] * odds[names[j]], -len(names[j]), names[j]))
        now = int((met[by[i]] < cover).sum())
        if now < gain[i]:
            gain[i] = now
            if now < min_support:
                left.discard(i)
            continue
        left.discard(i)
        if now >= min_support:
            taken[names[i]] = odds[names[i]]
            met[by[i]] += 1
    lex = Lexicon(taken, exceptions)
    # the line of the score
    def _densities(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lex.density(fold(t))[0] for t in b.column(0).to_pylist()], pa.float64()),
                                              b.column(1)], names=["d", "y"])

    got = once.mapInArrow(_densities, "d double, y int").collect()
    x = np.log(np.array([r["d"] for r in got]) + 1e-3)
    y = np.array([r["y"] for r in got])
    cuts = np.unique(x)
    mids = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    if len(mids) > 512:
        mids = mids[np.linspace(0, len(mids) - 1, 512).astype(int)]
    tpr = np.array([(x[y == 1] > m).mean() for m in mids])
    fpr = np.array([(x[y == 0] > m).mean() for m in mids])
    best = np.flatnonzero(tpr - fpr >= (tpr - fpr).max() - 1e-12)
    # of equally good cuts that at half the density of the least toxic text
    # above them, so that a chance match of little weight stays below
    low, high = x[x <= mids[best[0]]], x[x > mids[best[-1]]]
    low, high = (low.max() if len(low) else mids[best[0]]), (high.min() if len(high) else mids[best[-1]])
    cut = high - math.log(2)
    lex.offset = -float(cut if cut > low else (low + high) / 2)
    return lex


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_hits) of every row; null texts are empty, and an empty
    text has the least score.  Repeated rows are scored each for itself."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # max_entries entries at most
    kind = docs.schema[id_col].dataType

    def run(batches):
        lex = shared.value
        for b in batches:
            got = [lex.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()),
                                              pa.array([g[1] for g in got], pa.int32())], names=[id_col, "score", "n_hits"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double, n_hits int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, cut: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that score below ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index(text_col)

    def run(batches):
        lex = shared.value
        for b in batches:
            yield b.filter(pa.array([lex.score(t)[0] < cut for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
