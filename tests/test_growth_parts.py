"""Pairs and requests of many line items are made by parts of the members."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from talentmesh import session
from talentmesh.operators.rank import global_rank
from talentmesh.plans import catalog as C
from talentmesh.plans import standin as S


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders that stand twice, of two members, of unknown or null members,
    without lines; lines of no order; requests of every odd kind."""
    d = str(tmp_path_factory.mktemp("parts"))
    segments, names = ("BUILDING", "MACHINERY", "FURNITURE"), ("almond puff", "azure, blush", "green  dim", "plum")
    orders = [(k, k % 9 + 1, "FOP"[k % 3], "1-URGENT") for k in range(90, 122)] + [(90, 1, "F", "2-HIGH"), (95, 5, "O", "3"), (95, 6, "O", "3"), (95, 7, "O", "3"),
                                                                                    (130, 99, "F", "4"), (131, None, "F", "4"), (None, 2, "F", "4")]
    lines = [(o, p, n, "AN"[n % 2], datetime.date(1995, 1, 1 + n)) for o in [*range(90, 118), 130, 131, 999] for n, p in enumerate((o % 6 + 1, 3, o % 6 + 1, 7))]
    rows = {
        "region": ([(i, x) for i, x in enumerate(("AFRICA", "ASIA", "EUROPE"))], "r_regionkey int, r_name string"),
        "nation": ([(i, f"NATION{i}", i % 3) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"Customer#{i}", segments[i % 3], float(5 - i), i % 5) for i in range(1, 11)] + [(None, "nobody", "BUILDING", 0.0, 1)],
                     "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, c_nationkey int"),
        "part": ([(i, names[i % 4], f"Brand#{i % 3}", ("PROMO", "STANDARD TIN")[i % 2], i, 900.0 + i) for i in range(1, 7)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": (lines + [(None, 1, 1, "A", None)], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_shipdate date"),
    }
    for name, (r, schema) in rows.items():
        spark.createDataFrame(r, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


NAMES = ("skill_points", "payload_nested_flat", "document_quarantine")


@pytest.mark.parametrize("name", NAMES)
def test_parts_give_the_rows_of_the_whole(spark, tables, monkeypatch, name):
    whole = rows_of(C.QUERIES[name](spark, tables))
    monkeypatch.setattr(S, "PART_LINES", 70)
    made = []
    keep = S.MemberPart.__init__
    monkeypatch.setattr(S.MemberPart, "__init__", lambda self, *a: made.append(a) or keep(self, *a))
    df = C.QUERIES[name](spark, tables)
    assert len(made) == 2 and len(whole) > 1
    assert rows_of(df) == whole


def test_a_member_is_in_one_part_with_all_its_lines(spark, tables):
    parts = S.member_parts(S.Tables(spark, tables), 3)
    keys = [[r[0] for r in p("customer").select("c_custkey").collect()] for p in parts]
    assert sorted(map(str, sum(keys, []))) == sorted(map(str, [*range(1, 11), None])) and sum(map(bool, keys)) > 1
    at = {k: i for i, part in enumerate(keys) for k in part}
    for i, p in enumerate(parts):
        o = p("orders").where("o_custkey < 99").collect()
        assert all(at[r.o_custkey] == i for r in o)
        assert {r.l_orderkey for r in p("lineitem").collect()} >= {r.o_orderkey for r in o if r.o_orderkey and r.o_orderkey < 118}
    assert S.shared_order_keys(S.Tables(spark, tables), 3) == (len({at[5], at[6], at[7]}) > 1 or at[1] != at[90 % 9 + 1])


def size(path):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(path) for f in files)


def test_what_a_part_writes_and_shuffles_is_gone(spark, monkeypatch):
    seen = []

    def part(i):
        kept = session.written(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "kept")
        seen.append((kept.inputFiles()[0].removeprefix("file:").replace("///", "/"), session.shared_folder(spark)))
        return kept.withColumn("part", F.lit(i)).repartition(2, "k")

    df = session.written_in_parts(spark, ((lambda i=i: part(i)) for i in range(3)), "whole")
    assert df.count() == 21 and len({f for _, f in seen}) == 3
    assert not any(os.path.exists(f) for f, _ in seen)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    session.written(spark.range(1000).repartition(3, "id"), "kept")
    assert tracker.shuffleStatuses().size() <= before
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


def test_ranks_are_kept_compressed(spark):
    """The rows are written twice as Parquet, not as plain checkpoints."""
    rows = spark.range(20_000).select(F.lit("the same long text of many rows " * 4).alias("t"), (F.col("id") % 50).cast("double").alias("Similarity"), F.col("id").alias("MemberId"))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = size(folder)
    got = global_rank(rows)
    assert size(folder) - before < 1_000_000
    assert got.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()[:] == (1, 20_000, 20_000)
    assert got.where("rank = 401").first()["MemberId"] == 48
