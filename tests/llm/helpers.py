"""Plain-Python twins and small fixtures for the operators' tests."""

import random
import re
from collections import Counter, defaultdict


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def shingles(t, k=5):
    w = blank_words(t)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def link_components(rows):
    """{id: (set size, least id reachable)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed(rows, n=50):
    """{id: (bytes, removed, spans, kept)} by a table of all n-byte strings."""
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p:p + n], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < i:
                gone[p:p + n] = [True] * n
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def benchmark_hits(rows, items, size=13):
    """{id: (words, hit words, items)}."""
    windows = defaultdict(set)
    for item, t in items:
        w = alnum_words(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[j:j + size])].add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for i, t in rows:
        w = alnum_words(t)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                k = tuple(w[p:p + n])
                if k in windows:
                    hit.update(range(p, p + n))
                    found |= windows[k]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def bm25(rows, queries, k):
    """{query: [(id, score)]} by scoring every document."""
    import math

    docs = [(i, Counter(alnum_words(t))) for i, t in rows if i is not None]
    n = len(docs)
    df = Counter(w for _, c in docs for w in c)
    mean = sum(sum(c.values()) for _, c in docs) / max(1, n)
    out = {}
    for q, t in queries:
        scores = []
        for i, c in docs:
            length = sum(c.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean))
                    for w in set(alnum_words(t)) if w in c)
            if s > 0:
                scores.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def word(r):
    return "".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 7)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def corpus(seed=1, n=120):
    """Documents with copies, near copies, shared passages, short, empty and
    null texts, a long one, and repeats within a text."""
    r = random.Random(seed)
    base = [prose(r, r.randint(1, 90)) for _ in range(n)]
    line = prose(r, 20)
    out = []
    for i, t in enumerate(base):
        kind = i % 8
        if kind == 1:
            t = base[i - 1].upper()
        elif kind == 2:
            w = base[r.randrange(n)].split()
            w[r.randrange(len(w))] = word(r)
            t = " ".join(w)
        elif kind == 3:
            t = f"{prose(r, 30)}\n{line}\n{prose(r, 5)}"
        elif kind == 4:
            t = prose(r, 3) + " " + " ".join(["one two"] * r.randint(1, 60))
        elif kind == 5:
            t = " ".join([*base[0].split()[:r.randint(1, 12)], prose(r, r.randint(1, 3))])
        out.append((i, t))
    out += [(n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, base[0]), (n + 4, prose(r, 9000)), (n + 5, "é" * 80), (n + 6, "é" * 80 + "x")]
    r.shuffle(out)
    return out


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    """The rows with extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).repartition(parts)
    for c in ("score", "token", "cls", "n", "sig", "codes", "bucket", "label", "y", "ids", "x", "k"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df
