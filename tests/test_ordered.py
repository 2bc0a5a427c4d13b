"""Ordered concatenation: equal to a string aggregate, spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from talentmesh.config import CATEGORIES
from talentmesh.operators import ordered
from talentmesh.operators import profiles as P

SCHEMA = "g long, h string, k long, v string, w string"


def rows_of(seed, n):
    r = random.Random(seed)
    out = [(r.choice([0, 0, 0, 1, 2, None]), r.choice(["a", "b", None]), r.choice([None, *range(40)]), r.choice([None, "", "x", "é", "yy"]), r.choice([None, "w"]))
           for _ in range(n)]
    return out + [(9, "a", 1, None, None), (9, "a", 2, None, None), (8, "a", 5, "one", None), (8, "a", 5, "one", None)]


def expected(rows, delims):
    groups = {}
    for g, h, k, v, w in rows:
        groups.setdefault((g, h), []).append((k is not None, k or 0, v is not None, v or "", w is not None, w or "", v, w))
    out = {}
    for key, els in groups.items():
        els.sort(key=lambda e: e[:6])
        d = delims(key)
        out[key] = tuple(d.join(x[i] for x in els if x[i] is not None) if any(x[i] is not None for x in els) else None for i in (6, 7))
    return out


@pytest.mark.parametrize("chunk,n", [(1, 60), (3, 400), (1000, 3000)])
def test_equals_a_sorted_join(spark, chunk, n):
    rows = rows_of(chunk, n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("run", F.lit("clash")).repartition(3)
    delim = F.when(F.col("h") == "b", ", ").otherwise("; ")
    got = ordered.concat_in_order(df.drop("run"), ["g", "h"], ["k", "v", "w"], ["v", "w"], delim, chunk).collect()
    want = expected(rows, lambda key: ", " if key[1] == "b" else "; ")
    assert {(r["g"], r["h"]): (r["v"], r["w"]) for r in got} == want and len(got) == len(want)


def test_empty_table(spark):
    assert ordered.concat_in_order(spark.createDataFrame([], SCHEMA), ["g", "h"], ["k"], ["v"], F.lit(",")).collect() == []


def hot_long_form(spark, n=40_000):
    """Member 0 owns half of the rows, all of one list."""
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("MemberId"),
        F.when(F.col("id") % 2 == 0, CATEGORIES[0][0]).otherwise("Education").alias("cat"),
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), F.concat(F.lit("n"), "id").alias("v1"), F.lit(None).cast("string").alias("v2"))


def test_a_hot_member_is_spread_over_tasks(spark):
    """No partition sorts or joins more than its share of the hot list."""
    rows = hot_long_form(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # the rows are few
    try:
        keys = ["MemberId", "cat", "k", "v1", "v2"]
        sizes = [r["count"] for r in rows.repartitionByRange(*keys).sortWithinPartitions(*keys).groupBy(F.spark_partition_id().alias("p"), "MemberId").count()
                 .where("MemberId = 0").collect()]
        runs = ordered.in_runs(rows, ["MemberId", "cat"], ["k", "v1", "v2"], ["v1"], F.lit("; "), chunk=500).where("MemberId = 0").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 8_000
    assert sum(r["v1"].count("; ") + 1 for r in runs) == 20_000
    assert max(r["v1"].count("; ") + 1 for r in runs) <= 500 and len(runs) >= 40


def test_member_lists_both_ways(spark):
    rows = hot_long_form(spark, 4_000)
    more = spark.createDataFrame([(3, "OtherSkills", None, "b", None), (3, "OtherSkills", None, "a", None), (3, "OtherSkills", None, None, None),
                                  (4, "Education", None, None, None), (5, CATEGORIES[3][0], 7, "n7", "d7"), (5, CATEGORIES[3][0], 7, "n7", "d7"),
                                  (5, CATEGORIES[3][0], 2, None, "d2")], "MemberId long, cat string, k long, v1 string, v2 string")
    lf = rows.unionByName(more)
    one = sorted(map(repr, P.aggregate_lists(lf).collect()))
    two = sorted(map(repr, P.aggregate_lists(lf, spread=True).collect()))
    assert one == two
    five = P.aggregate_lists(lf, spread=True).where("MemberId = 5").first()
    assert (five[CATEGORIES[3][-2]], five[CATEGORIES[3][-1]]) == ("n7; n7", "d2; d7; d7")
