"""Batched encoding equals one text at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentmesh.operators import encode as E
from talentmesh.operators.embed import text_key

TEXTS = ["a b c", "", None, "Unknown", "one", "b a", "word " * 700, "x " * 511 + "y z", "A B C", "é ü", "  \t"]


def single(text, dim=4):
    tokenize, encode = E.seeded_token_vectors(dim)()
    ids = tokenize(text or "")[:512]
    return encode(np.array([ids]), None)[0].mean(0) if ids else np.zeros(dim)


def test_pooling_masks_padding():
    r = np.random.default_rng(0)
    table = r.normal(size=(50, 3))
    seen = []

    def encode(ids, mask):
        seen.append(ids.shape)
        out = table[ids].copy()
        out[~mask] = np.nan   # what a model makes of padding must not count
        return out

    lists = [r.integers(0, 50, n) for n in [5, 1, 0, 9, 9, 2, 7, 1, 30]]
    got = E.mean_pooled(lists, encode, batch_tokens=20)
    for ids, v in zip(lists, got):
        assert (v is None) == (len(ids) == 0)
        if len(ids):
            assert np.allclose(v, table[ids].mean(0))
    assert all(n * length <= 20 or n == 1 for n, length in seen) and len(seen) < 8


def test_distinct_texts_of_all_columns_in_one_pass(spark):
    a = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    b = spark.createDataFrame([("b a",), ("only b",), (None,)], "u string")
    coder = E.TokenEncoder(E.seeded_token_vectors(4), 4, "test-4")
    got = {r["key"]: (r["n_tokens"], r["vector"]) for r in coder.encode_distinct([(a, "t"), (b, "u")]).collect()}
    texts = {t or "" for t in TEXTS} | {"only b"}
    keys = {r["k"]: r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_key("t").alias("k")).collect()}
    assert set(got) == set(keys)
    for k, (n, v) in got.items():
        assert np.allclose(v, single(keys[k])) and n == min(512, len(keys[k].split()))


def test_attach_and_common_texts_are_not_joined(spark):
    rows = [(i, "Unknown" if i % 3 else TEXTS[i % len(TEXTS)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("key", F.lit("clash")).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    coder = E.TokenEncoder(E.seeded_token_vectors(4), 4, "test-4").prepare((df, "t"))
    out = coder.attach(df, "t", "v")
    got = out.collect()
    assert len(got) == 300 and out.columns == [*df.columns, "v"]
    for r in got:
        assert np.allclose(r["v"], single(r["t"]))
    # the join's keys of the common texts are spread, one for each row
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "common " in plan and "xxhash64" in plan
    assert np.allclose(coder.attach(df.limit(1), "t", "w").first()["w"], single(rows[0][1]))


def test_wrong_dimension_is_refused(spark):
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="not of 7 dimensions"):
        E.TokenEncoder(E.seeded_token_vectors(4), 7, "test-7").encode_distinct([(df, "t")]).collect()


def test_scores_with_the_encoder(spark):
    """The encoder serves as a provider of the scoring job."""
    from talentmesh.config import MatchOptions
    from talentmesh.operators.rank import rank_members_for_job
    from talentmesh.plans import standin as S

    t = S.Tables(spark, "/root/testdata/sf0.001")
    m, j = S.scoring_members(t), S.jobs(t, only_ids=[3])
    coder = E.TokenEncoder(E.seeded_token_vectors(4), 4, "test-4").prepare((m, "Education"), (m, "Experience"), (j, "Qualifications"), (j, "Key_Responsibilities"))
    got = rank_members_for_job(m, j, 3, coder, MatchOptions(threshold=None)).collect()
    assert len(got) == m.count() and all(0 <= r["Similarity"] <= 100 for r in got)
