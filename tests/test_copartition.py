"""Bucketed extract tables: same rows, no shuffle, one bucket for one member."""

import re

from talentmesh.operators import profiles as P
from talentmesh.plans import standin as S

SF = "/root/testdata/sf0.001"


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if re.search(r"Exchange (hash|range)partitioning", x)], plan


def test_extract_shuffles_neither_members_nor_elements(spark):
    t = S.Tables(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")   # as if the lists were large
    try:
        df = S.copartitioned_members(t, 8)
        found, plan = shuffles(df)
        # dimensions are checked for repeated ids; nothing is dealt by member
        assert not any("MemberId" in x for x in found), found
        assert plan.count("Bucketed: true") == 2 and "SortMergeJoin [MemberId" in plan
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = S.members(t)
    assert sorted(map(repr, rows)) == sorted(map(repr, plain.select(*df.columns).collect()))


def test_one_member_is_read_from_one_bucket(spark):
    t = S.Tables(spark, SF)
    one = P.member_by_id(S.copartitioned_members(t, 8), 42)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan and "SelectedBucketsCount: 8" not in plan
    assert [r["MemberId"] for r in one.collect()] == [42]
