"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentmesh.llm import ranked

from .helpers import frame, lower, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(lower(t))


def expected(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, t in items:
        found = []
        for i, c, size in docs:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(t)) if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    out = [(i, prose(r, r.randint(1, 60))) for i in range(n)]
    out += [(n + i, out[3][1]) for i in range(12)]                      # copies: ties
    out += [(n + 20, None), (n + 21, ""), (n + 22, " .,"), (None, out[5][1]), (None, out[5][1]), (7, out[7][1].upper()), (n + 23, "é E É e a"),
            (n + 24, prose(r, 30_000))]
    r.shuffle(out)
    return out


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,postings,run", [(1, 40, 1), (2, 500_000, 128), (3, 300, 4)])
def test_search(spark, monkeypatch, seed, postings, run):
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ranked, "FIRST_RUN", run)
    rows = corpus(seed, 150)
    r = random.Random(seed)
    items = [(i, prose(r, r.randint(1, 40)))
             for i in range(12)]
    items += [(50, rows[0][1]), (51, None), (52, " "), (53, "É é"), (54, "zzzzzzzzzz"), (55, "a a A"), (None, "e a i"), (None, "e a i")]
    got = rows_of(ranked.search(frame(spark, rows).withColumn("rank", F.lit(1)), frame(spark, items, "item_id long, text string"), k=5))
    assert got == expected(rows, items, 5)


def test_items_in_several_blocks(spark):
    rows, items = corpus(4, 60), [(i, prose(random.Random(i), 12)) for i in range(9)]
    got = rows_of(ranked.search(frame(spark, rows), frame(spark, items, "item_id long, text string"), k=4, block_bytes=2000))
    assert got == expected(rows, items, 4)


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b")])
    items = frame(spark, [(1, "a")], "item_id long, text string")
    assert ranked.search(none, items).collect() == []
    assert ranked.search(some, frame(spark, [], "item_id long, text string")).collect() == []
    assert rows_of(ranked.search(some, items)) == [(1, 1, 1, expected([(1, "a b")], [(1, "a")], 1)[0][3])]


def random_lists(r, n_docs, n_lists):
    out = []
    for _ in range(n_lists):
        size = int(r.integers(0, n_docs + 1))
        docs = r.choice(n_docs, size, replace=False)
        imp = np.sort(r.integers(1, 30, size))[::-1].astype(float)
        out.append((docs, imp))
    return out


def test_intervals_end_exact_and_reads_stop_early(monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_RUN", 2)
    r = np.random.default_rng(0)
    for _ in range(300):
        n, k = int(r.integers(1, 60)), int(r.integers(1, 8))
        lists = random_lists(r, n, int(r.integers(1, 7)))
        ids = r.permutation(n)
        score = np.zeros(n)
        for d, i in lists:
            score[d] += i
        floor = int(r.choice([0, 0, np.sort(score)[-min(k, n)]]))
        want = [d for d in np.lexsort((ids, -score)).tolist() if score[d] >= max(1, floor)][:k]
        best, got = ranked.nra(lists, ids, k, floor)
        assert best.tolist() == want and got.tolist() == score[want].tolist()
    reads = []
    top = (np.arange(1000), np.concatenate(([1000.0], np.ones(999))))
    ranked.nra([top, top], np.arange(1000), 1, 0, reads)
    assert reads[0] < 50


def test_words_of_one_hash_are_told_apart():
    words = ranked.Words.of([b"alpha", b"beta", b"gamma"])
    words.hashes[:] = words.hashes[0]
    text = np.frombuffer(b"beta gamma delta", np.uint8)
    s, e = np.array([0, 5, 11]), np.array([4, 10, 16])
    which, number = words.find(text, s, e, np.full(3, words.hashes[0]))
    found = {int(w): words.data[words.offs[i]:words.offs[i + 1]].tobytes() for w, i in zip(which, number)}
    assert found == {0: b"beta", 1: b"gamma"}
