"""P4-P7 normalisation, V2 cosine, character profiles, V1 distinct embedding, X9."""

import datetime as dt
import decimal
import math

import numpy as np
from pyspark.sql import functions as F

import pytest

from models import hashed_bag_of_words
from talentmesh.functions.normalize import normalize_row_values
from talentmesh.functions.text import preprocess_text
from talentmesh.functions.vectors import char_profile, cosine
from talentmesh.operators.embed import (
    CharProfileEmbedder,
    ModelEmbedder,
    VectorTableEmbedder,
    text_key,
)


def test_normalize(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 3, 4, 5, 999999), dt.date(2024, 1, 2), decimal.Decimal("1.25"),
          bytearray(b"ok\xff\xfe-\xc3\xa9"), "x", None)],
        "ts timestamp, d date, dec decimal(10,2), b binary, s string, n int")
    r = normalize_row_values(df).collect()[0]
    assert r.ts == "2024-01-02 03:04:05"
    assert r.d == dt.date(2024, 1, 2)           # a date is not a timestamp: unchanged
    assert r.dec == 1.25 and isinstance(r.dec, float)
    assert r.b == b"ok\xff\xfe-\xc3\xa9".decode("utf-8", errors="ignore")
    assert (r.s, r.n) == ("x", None)


def test_bytes_decode_like_python_ignore(spark):
    """Random bytes, truncated and overlong forms, surrogates, genuine and
    escaped marks."""
    from talentmesh.functions.normalize import bytes_text

    r = np.random.default_rng(0)
    bits = [b"\xef\xbf\xbd", b"\xee\x80\x80", b"0", b"1", b"\xe2\x82\xac", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xf0\x9f\x98", b"\xc0\x80", b"\xed\xa0\x80",
            b"\xf4\x90\x80\x80", b"\xf8\x88\x80\x80\x80", b"\xff", b"\x80", b"a", b"\xc3\xa9", b"\xc3", b"\xef", b"\xef\xbf", b"\xe0\x80\xaf", b"\xfc"]
    rows = [b"".join(bits[i] for i in r.integers(0, len(bits), r.integers(0, 9))) for _ in range(1500)]
    rows += [r.integers(0, 256, r.integers(0, 12), dtype=np.uint8).tobytes() for _ in range(1500)] + [b"", b"\xef\xbf\xbd", b"\xef\xbf\xbd\xff"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows)] + [(-1, None)], "i int, b binary")
    got = {x.i: x.t for x in df.select("i", bytes_text("b").alias("t")).collect()}
    assert got[-1] is None
    wrong = [(b, got[i]) for i, b in enumerate(rows) if got[i] != b.decode("utf-8", errors="ignore")]
    assert wrong == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]),
                                (None, [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert got[0] == 0.0 and math.isclose(got[1], 1.0) and got[2] == 0.0 and got[3] == 0.0


def test_char_profile_engines_agree(spark):
    texts = ["Hello World 42", "", None, "ÉCOLE – naïve café 9", "a" * 3000 + "Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    jvm = [r.v for r in df.select(char_profile("t").alias("v")).collect()]
    arrow = [r.v for r in df.select(CharProfileEmbedder().vector("t").alias("v")).collect()]
    assert jvm == arrow
    assert jvm[0][0] == 0 and jvm[0][ord("l") - ord("a")] == 3 and jvm[0][26 + 4] == 1


def test_model_embedder_embeds_distinct_texts(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "t string")
    emb = ModelEmbedder(hashed_bag_of_words(8), 8, "t8")
    vecs = emb.embed_distinct(df, "t")
    assert vecs.count() == 3
    out = emb.attach(df, "t", "v").collect()
    assert len(out) == 4 and all(len(r.v) == 8 for r in out)
    a = [r.v for r in out if r.t == "a b"]
    assert np.allclose(a[0], a[1])


def test_vector_table_embedder(spark):
    table = spark.createDataFrame([("x", [1.0, 2.0])], "text string, vector array<double>").select(
        text_key("text").alias("key"), "vector")
    df = spark.createDataFrame([("x",), ("y",)], "t string")
    got = {r.t: r.v for r in VectorTableEmbedder(table).attach(df, "t", "v").collect()}
    assert got == {"x": [1.0, 2.0], "y": None}


def test_preprocess_text(spark):
    df = spark.createDataFrame([("  Hello\t World \n",)], "t string")
    assert df.select(preprocess_text("t").alias("c")).collect()[0].c == " ".join("  Hello\t World \n".lower().split())


def test_incremental_vector_table(spark, tmp_path):
    path = str(tmp_path / "vecs")
    emb = ModelEmbedder(hashed_bag_of_words(8), 8, "t8b")
    first = spark.createDataFrame([("a b",), ("c",)], "t string")
    emb.refresh_table(first, "t", path)
    more = spark.createDataFrame([("c",), ("d e",), ("a b",)], "t string")
    provider = emb.refresh_table(more, "t", path)
    assert spark.read.parquet(path).count() == 3          # 'c' and 'a b' not embedded twice
    got = provider.attach(more, "t", "v").collect()
    assert all(r.v is not None and len(r.v) == 8 for r in got)


def test_table_source_reads_parquet(spark):
    from talentmesh.sources.tables import TableSource
    src = TableSource(spark, root="/root/testdata/sf0.001")
    assert src.table("nation").count() == 25 and src.has("region") and not src.has("no_such_table")


def test_sizing_conf():
    from talentmesh.session import sizing_conf
    c = sizing_conf(2**40)
    assert int(c["spark.sql.shuffle.partitions"]) == 2**40 // (256 << 20)
    assert int(sizing_conf(10 << 20)["spark.sql.shuffle.partitions"]) == 200


def test_nan_cosine_counts_as_missing(spark):
    df = spark.createDataFrame([([1.0, float("nan")], [1.0, 1.0]), ([1.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [0.0, 1.0, 0.0]


def test_repeated_vector_keys_do_not_multiply_rows(spark):
    from talentmesh.operators.embed import VectorTableEmbedder, text_key
    t = spark.createDataFrame([("x", [1.0]), ("x", [1.0])], "t string, vector array<double>").select(text_key("t").alias("key"), "vector")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    got = VectorTableEmbedder(t).attach(df, "t", "v").collect()
    assert sorted((r.id, r.v) for r in got) == [(1, [1.0]), (2, None)]


def test_only_an_absent_path_counts_as_absent(spark, tmp_path):
    from talentmesh.sources.tables import TableSource, path_exists
    assert not path_exists(spark, str(tmp_path / "none")) and path_exists(spark, str(tmp_path))
    with pytest.raises(Exception):
        path_exists(spark, "nosuchscheme://x/y")
    assert not TableSource(spark, str(tmp_path)).has("missing")


def test_jdbc_reads_are_partitioned_or_said_not_to_be(spark):
    from talentmesh.sources.tables import TableSource
    with pytest.raises(ValueError, match="no partitioning"):
        TableSource(spark, fmt="jdbc", jdbc_options={"url": "jdbc:none:"}).table("Member")


def test_sizing_bounds_the_shuffle_blocks():
    from talentmesh.session import MAX_SHUFFLE_PARTITIONS, sizing_conf
    c = sizing_conf(100 * 2**40)
    assert int(c["spark.sql.shuffle.partitions"]) == MAX_SHUFFLE_PARTITIONS
    assert int(c["spark.sql.files.maxPartitionBytes"]) > 256 << 20
