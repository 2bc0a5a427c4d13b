"""The encoder reads a frame once, and its model has no growing vocabulary."""

from hashlib import md5

import numpy as np

from talentmesh.operators import encode as E


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_token_ids_need_no_vocabulary():
    """An id is the token's own, whatever was seen before it."""
    one, _ = E.seeded_token_vectors(4)()
    two, encode = E.seeded_token_vectors(4)()
    assert two("x y Z")[2] == one("z")[0]
    h = md5(b"z").hexdigest()
    assert np.allclose(encode(np.array([one("z")]), None)[0, 0], [int(h[4 * d:4 * d + 4], 16) / 65535.0 for d in range(4)])


def test_columns_of_one_frame_are_read_together(spark):
    df = spark.createDataFrame([("a", "b"), ("b", None)], "t string, u string")
    got = E.TokenEncoder(E.seeded_token_vectors(4), 4, "test-4").distinct_texts([(df, "t"), (df, "u")])
    assert "Union" not in plan_of(got)
    assert sorted(r.text for r in got.collect()) == ["", "a", "b"]
