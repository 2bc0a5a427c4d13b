import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talentmesh.llm import bpe
from talentmesh.llm.common import text_chunks

from .helpers import corpus, frame

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS)


def ids_of(texts):
    out = []
    for _, _, buf, offs in text_chunks(pa.array(texts, pa.string())):
        ids, before = CODEC.encode(buf, offs)
        data, at = CODEC.decode(ids, before)
        begins = CODEC.offsets(ids, before)
        for a, b, c, d in zip(before[:-1], before[1:], at[:-1], at[1:]):
            out.append((ids[a:b].tolist(), data[c:d].tobytes(), begins[a:b].tolist()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("'strevmld \n\t\u00a0\u0085!1aZ")), st.characters(exclude_categories=["Cs"])), max_size=40),
                min_size=1, max_size=5))
def test_ids_are_tiktokens_and_decode(texts):
    for t, (ids, data, begins) in zip(texts, ids_of(texts)):
        assert ids == WANT.encode_ordinary(t)
        assert data == t.encode()
        assert begins == np.cumsum([0] + [len(WANT.decode_single_token_bytes(i)) for i in ids])[:-1].tolist()


def test_classes_of_all_code_points_agree():
    for lo in range(0, 0x30000, 0x800):
        cps = [c for c in range(lo, lo + 0x800) if not 0xD800 <= c <= 0xDFFF]
        if cps:
            t = "".join(f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}!" for c in cps)
            assert ids_of([t])[0][0] == WANT.encode_ordinary(t)


def test_long_pieces_and_full_cache(monkeypatch):
    texts = ["=" * 5000, "x" * 3000, "ab" * 2000, " " * 4000, "'" * 999, "don't we'll I'VE it''s"]
    assert [i for i, _, _ in ids_of(texts)] == [WANT.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    again = texts + ["one two three four five six seven eight"] * 2
    for _ in range(3):
        assert [i for i, _, _ in ids_of(again)] == [WANT.encode_ordinary(t) for t in again]


def test_scan_equals_stepping_through_the_states():
    r = np.random.default_rng(1)
    functions, _, apply, _ = bpe.monoid()
    f = functions[r.integers(0, 2 * bpe.N_CLASSES, 5000)]
    s, want = bpe.START, []
    for x in f:
        want.append(s)
        s = apply[x, s]
    assert bpe.scan_states(f).tolist() == want


def test_operator_round_trip(spark):
    rows = corpus(3, 60) + [(5, "again"), (5, "again")]
    df = frame(spark, rows)
    got = bpe.encode(df, RANKS, with_decoded=True).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted((i, tuple(WANT.encode_ordinary(t or ""))) for i, t in rows)
    back = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in back) == sorted((i, (t or "").encode()) for i, t in rows)
    assert all(hashlib.sha256(bytes(r["decoded"])).digest() for r in got)
    assert bpe.encode(df.limit(0), RANKS).count() == 0
