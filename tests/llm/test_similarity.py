"""Jaccard join, suffix dedup, decontamination and search against brute force."""

import hashlib
import random

import pytest

from talentmesh.llm import decontaminate, jaccard, suffixes, topk

from .helpers import benchmark_hits, bm25, corpus, frame, link_components, prose, removed


def jaccard_rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = corpus(seed)
    assert jaccard_rows(frame(spark, rows)) == link_components(rows)


def test_large_group_of_near_copies_and_small_sets(spark):
    r = random.Random(4)
    base = prose(r, 60).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    tiny = [prose(r, 6).split() for _ in range(5)]
    for i in range(150, 330):
        w = list(tiny[i % 5]) * r.randint(1, 3)
        rows.append((i, " ".join(w[:r.randint(4, len(w))])))
    assert jaccard_rows(frame(spark, rows, parts=4)) == link_components(rows)


def test_light_boundary_and_frequent_order_do_not_change_links(spark, monkeypatch):
    rows = corpus(5, 80)
    want = link_components(rows)
    for light in (2, 9, 40):
        monkeypatch.setattr(jaccard, "choose_light", lambda *_: light)
        assert jaccard_rows(frame(spark, rows)) == want


@pytest.mark.parametrize("spans,block", [(((1, 2), (2, 4), (4, 1 << 62)), 6), (((1, 3), (3, 1 << 62)), 1 << 20)])
def test_rounds_and_cut_lists_lose_no_link(spark, monkeypatch, spans, block):
    """Copies around the threshold: most pairs of one group are no links."""
    monkeypatch.setattr(jaccard, "SPANS", spans)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    r = random.Random(11)
    rows = []
    for g in range(3):
        base = prose(r, 70 + 30 * g).split()
        for _ in range(45):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"y{r.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    assert jaccard_rows(frame(spark, rows, parts=4)) == link_components(rows)


def scan_table(n, groups):
    """Sets of one size that share 40 lists, as the scan gets them."""
    import numpy as np
    import pyarrow as pa

    cls = np.arange(1, n + 1)
    rows = [(t, c, t % 7) for t in range(1, 41) for c in cls.tolist()]
    k = len(rows)
    table = {"token": [x[0] for x in rows], "kind": [1] * k, "a": [0] * k, "b": [0] * k, "n": [200] * k, "pos": [0] * k, "cls": [x[1] for x in rows],
             "block": [0] * k, "sig": [bytes(64)] * k, "h0": [1] * k, "h1": [2] * k, "h2": [3] * k, "h3": [4] * k, "label": [x[1] % groups for x in rows]}
    return pa.RecordBatch.from_pydict(table)


def test_pairs_are_brought_up_once_and_rows_grow_with_the_sets():
    made = {}
    for n in (100, 500):
        out = [b for b in jaccard._candidates(19, 0)(iter([scan_table(n, 1)]))]
        made[n] = sum(b.num_rows for b in out if not b.column("more")[0].as_py())
        assert sum(b.num_rows for b in out if b.column("more")[0].as_py()) == 40
    assert made == {100: 4 * 100 - 10, 500: 4 * 500 - 10}
    same = [b for b in jaccard._candidates(19, 1)(iter([scan_table(200, 1)])) if not b.column("more")[0].as_py()]
    assert same == []


def test_jaccard_empty_table_null_ids_and_repeated_rows(spark):
    assert jaccard.link_components(frame(spark, [])).collect() == []
    text = "a b c d e f g h"
    got = jaccard.link_components(frame(spark, [(3, text), (3, text), (None, text), (None, "")])).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"], r["n_copies"]) for r in got))) == [
        "(3, 3, 3)", "(3, 3, 3)", "(None, 3, 3)", "(None, None, 1)"]


def suffix_rows(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffixes.remove_repeats(df).collect()}


@pytest.mark.parametrize("seed", [1, 7])
def test_removed_bytes(spark, seed):
    rows = corpus(seed)
    assert suffix_rows(frame(spark, rows)) == removed(rows)


def test_removed_bytes_of_edits_and_periods(spark):
    r = random.Random(9)
    base = prose(r, 60)
    rows = [(0, "ab" * 40), (1, "ba" * 60), (2, "a" * 200), (3, "a" * 49), (4, "a" * 50), (5, base)]
    for i in range(6, 40):
        p, q = sorted(r.randrange(len(base)) for _ in range(2))
        rows.append((i, base[:p] + r.choice(["", "X", prose(r, 3)]) + base[q:] + base[p:q] * r.randint(0, 2)))
    assert suffix_rows(frame(spark, rows)) == removed(rows)


def test_small_slices_and_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(11, 40)
    import pyarrow as pa

    from talentmesh.llm.common import text_chunks

    _, _, buf, offs = next(text_chunks(pa.array([t for _, t in rows], pa.string()), 1 << 30))
    whole = suffixes.cells(buf, offs)
    monkeypatch.setattr(suffixes, "SLICE", 97)
    cut = suffixes.cells(buf, offs)
    assert (cut[4] - cut[3] + 1).sum() == (whole[4] - whole[3] + 1).sum()


def test_suffix_empty_table_and_repeated_rows(spark):
    assert suffixes.remove_repeats(frame(spark, [])).collect() == []
    t = "z" * 30 + "y" * 30
    got = suffixes.remove_repeats(frame(spark, [(1, t), (1, t), (2, t), (None, t)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert got[0]["kept_sha256"] in {hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()}


def test_rows_of_one_id_are_judged_each_for_itself(spark):
    r = random.Random(5)
    first, other, more = prose(r, 30)[:80], "p" * 90, prose(r, 40)[:120]
    rows = [(1, first), (2, "ab" + first[:68]), (2, other), (2, other), (3, other + "x"), (-4, more), (None, more), (9, more), (9, "!" + more), (9, None)]
    got = sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"]) for x in suffixes.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([("1", 80, 0), ("2", 70, 68), ("2", 90, 0), ("2", 90, 0), ("3", 91, 90), ("-4", 120, 0), ("None", 120, 0), ("9", 120, 120),
                          ("9", 121, 120), ("9", 0, 0)])


def planted(seed=3):
    r = random.Random(seed)
    items = [(i, prose(r, n)) for i, n in enumerate([30, 20, 13, 12, 5, 1, 40])] + [(7, ""), (8, None), (9, "!!")]
    items += [(10, items[0][1]), (11, items[2][1].upper())]
    rows = []
    for i in range(60):
        w = prose(r, r.randint(0, 50)).split()
        if i % 3:
            _, t = r.choice(items[:7])
            x = t.split()
            a = r.randint(0, max(0, len(x) - 13))
            w[len(w) // 2:len(w) // 2] = x[a:a + r.randint(1, 30)]
        rows.append((i, r.choice([" ", ", ", " -\n"]).join(w)))
    return rows + [(60, None), (61, ""), (62, " ".join(t or "" for _, t in items) * 2)], items


def test_benchmark_hits(spark):
    rows, items = planted()
    df, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    want = benchmark_hits(rows, items)
    for block_bytes in (1 << 20, 200):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(df, bench, block_bytes=block_bytes).collect()}
        assert got == want
        kept = {r["doc_id"] for r in decontaminate.keep_clean(df, bench, block_bytes=block_bytes).collect()}
        assert kept == {i for i, (n, h, _) in want.items() if not (h > 0 and 20 * h >= n)}


def test_spans_and_proximity(spark):
    items = [(1, "alpha beta gamma delta")]
    rows = [(1, "x alpha beta gamma delta y"), (2, "alpha x beta gamma delta"), (3, "delta x gamma beta alpha"), (4, "alpha beta gamma"), (5, None)]
    got = {r["doc_id"]: r for r in decontaminate.scan(frame(spark, rows), frame(spark, items, "item_id long, text string"), slop=2).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(1, 4)] and got[1]["items"] == [1]
    assert got[2]["items"] == [] and got[2]["near"] == [1] and got[3]["near"] == [1] and got[4]["near"] == []


def test_decontamination_of_empty_tables(spark):
    rows, items = planted()
    none = frame(spark, [], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.scan(frame(spark, rows), none).collect()} == {0}
    assert decontaminate.scan(frame(spark, []), frame(spark, items, "item_id long, text string")).collect() == []


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontamination_judges_each_row_by_itself(spark, block_bytes):
    items = [(i, prose(random.Random(i), 15)) for i in range(12)] + [(12, "left1 left2 left3 " + " ".join(f"both{i}" for i in range(12)))]
    items.append((13, " ".join(f"both{i}" for i in range(2, 12)) + " right1 right2 right3"))
    clean, hit, other = "nothing to find here", items[0][1], items[1][1]
    both = items[12][1] + " right1 right2 right3 " + hit
    rows = [(None, clean), (None, hit), (None, None), (None, f"{hit} {other}"), (1, clean), (1, hit), (2, other), (2, other), (3, clean), (3, clean), (4, ""), (5, both)]
    want = sorted((str(i), *benchmark_hits([(0, t)], items)[0]) for i, t in rows)
    df, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    got = decontaminate.scan(df, bench, block_bytes=block_bytes).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    assert [[tuple(s) for s in r["spans"]] for r in got if r["doc_id"] == 5] == [[(0, 33)]]
    kept = decontaminate.keep_clean(df, bench, block_bytes=block_bytes)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == sorted((str(i), t) for i, t in rows if t == clean)
    assert sum(not r["text"] for r in kept.collect()) == 2


@pytest.mark.parametrize("shard_docs", [16_384, 7])
def test_search(spark, monkeypatch, shard_docs):
    rows = corpus(6, 150) + [(None, "left out")]
    queries = [(i, t) for i, t in rows if i is not None and i % 5 == 0] + [(1000, "one"), (1001, "zzzz"), (1002, None)]
    asked = frame(spark, queries, "query_id long, text string")
    want = {q: v for q, v in bm25(rows, queries, 4).items() if v}
    for block_terms in (1 << 20, 300):
        got = {}
        for r in topk.search(frame(spark, rows), asked, 4, block_terms=block_terms).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert got.keys() == want.keys()
        for q in want:
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
            ties = len({round(s, 9) for _, s in want[q]}) < len(want[q])
            assert ties or [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_pruned_search_equals_full_scores():
    import numpy as np

    rows = corpus(8, 140)
    texts = [t for _, t in rows]
    import pyarrow as pa

    from talentmesh.llm.common import ALNUM_SEPARATORS, scan_words, text_chunks

    _, _, buf, offs = next(text_chunks(pa.array(texts, pa.string())))
    terms = np.unique(scan_words(buf, offs, ALNUM_SEPARATORS)[2])
    part, lengths = topk.postings(buf, offs, terms)
    df = np.bincount(part[0], minlength=len(terms))
    q = topk.Queries([], terms, np.log(1 + (len(rows) - df + 0.5) / (df + 0.5)), terms, np.zeros(1, int), np.zeros(1), lengths.mean())
    shard = topk.Shard(np.arange(len(rows)), [part], lengths, q)
    r = np.random.default_rng(0)
    for _ in range(200):
        t = r.choice(len(terms), r.integers(1, 30), replace=False)
        docs, score = shard.top(t, 5, 0.0)
        if len(docs) == 5:
            again, same = shard.top(t, 5, float(score[-1]))
            assert again.tolist() == docs.tolist() and same.tolist() == score.tolist()


def test_search_over_empty_tables(spark):
    asked = frame(spark, [(1, "one")], "query_id long, text string")
    assert topk.search(frame(spark, []), asked, 3).collect() == []
    assert topk.search(frame(spark, [(1, "one")]), asked.limit(0), 3).collect() == []


def test_items_without_an_id_count_but_are_not_listed(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = [(1, text), (2, "other " * 30), (3, text + " tail" * 3)]
    items = [(None, text), (None, text), (5, " ".join(text.split()[:13]))]
    for block in (decontaminate.BLOCK_BYTES, 10):
        got = {r["doc_id"]: r for r in decontaminate.scan(frame(spark, docs), frame(spark, items, "item_id long, text string"), block_bytes=block).collect()}
        assert (got[1]["n_hit"], got[1]["items"]) == (20, [5]) and got[2]["n_hit"] == 0 and got[3]["n_hit"] == 20
        kept = decontaminate.keep_clean(frame(spark, docs), frame(spark, items, "item_id long, text string"), block_bytes=block).collect()
        assert [r["doc_id"] for r in kept] == [2]


def test_very_long_text_with_many_runs(spark):
    """A document of 200,000 words with 5,000 separate runs takes no time of
    the square of its length."""
    import time

    window = " ".join(f"w{i}" for i in range(13))
    text = " ".join(f"{window} {'x ' * 27}" for _ in range(5000))
    began = time.time()
    got = decontaminate.scan(frame(spark, [(1, text)]), frame(spark, [(1, window)], "item_id long, text string")).first()
    assert (got["n_hit"], len(got["spans"])) == (65_000, 5000) and got["spans"][1] == (40, 13)
    assert time.time() - began < 60
