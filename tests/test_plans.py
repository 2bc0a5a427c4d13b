"""Plan shape checks: the plans we rely on for scale."""

import json
import re

from pyspark.sql import functions as F

from talentmesh.operators.embed import CharProfileEmbedder
from talentmesh.operators.rank import rank_members_for_job, score_jobs_for_member
from talentmesh.operators.sinks import write_extract
from talentmesh.plans import standin as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_of_the_line_items_per_job_build(spark):
    p = _plan(S.jobs(S.Tables(spark, SF)))
    assert p.count("lineitem.parquet") == 1 and "Window" not in p


def test_single_job_ranking_has_no_pairing_join(spark):
    t = S.Tables(spark, SF)
    p = _plan(rank_members_for_job(S.members(t), S.jobs(t, only_ids=[3]), 3, CharProfileEmbedder()))
    assert "NestedLoopJoin" not in p and "Cartesian" not in p
    assert "Subquery" in p   # the job is one scalar subquery


def test_single_side_does_not_grow_the_plan(spark):
    """A member with 100,000 tokens is no larger in the plan than one with ten."""
    def plan(n):
        one = spark.range(1).select(F.lit(1).cast("long").alias("MemberId"), F.concat_ws(" ", F.transform(
            F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("skill"), i.cast("string")))).alias("TechnicalSkillNames"))
        return _plan(score_jobs_for_member(one, S.jobs(S.Tables(spark, SF)), 1, CharProfileEmbedder()))

    assert abs(len(plan(100_000)) - len(plan(10))) < 2000


def test_prepared_columns_and_components_are_evaluated_once(spark):
    t = S.Tables(spark, SF)
    df = rank_members_for_job(S.scoring_members(t), S.jobs(t, only_ids=[3]), 3, CharProfileEmbedder())
    p = df._jdf.queryExecution().optimizedPlan().toString()
    # one for each of the member's two skill columns and the job's three lists
    assert len(re.findall(r"split\(", p)) == 5
    filters = [x for x in p.splitlines() if re.match(r"[\s:+-]*Filter", x)]
    assert not any("aggregate(" in x or "split(" in x for x in filters)


def test_payload_is_parsed_once(spark):
    from talentmesh.plans import catalog as C
    from talentmesh.plans.flows import rank_payloads
    p = rank_payloads(C._valid_payloads(spark, SF, "rank"), CharProfileEmbedder())._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("from_json(") == 1


def test_matches_are_never_the_build_side(spark):
    """200 chunks of one job: an inner join that spreads, whatever is broadcast."""
    from talentmesh.operators.sinks import nested_ranking
    jobs = S.jobs(S.Tables(spark, SF), only_ids=[3])
    ranked = spark.range(2000).select(F.lit(3).cast("long").alias("JobId"), F.col("id").alias("MemberId"), *[
        F.lit("x").alias(c) for c in ("MemberFirstName", "MemberLastName", "MemberEmail", "City")],
        F.lit(90.0).alias("Similarity"), (F.col("id") + 1).alias("rank"))
    docs = nested_ranking(ranked, jobs, chunk_size=10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # the rows are few
    try:
        spread = docs.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread > 1
    assert docs.count() == 200
    p = _plan(docs)
    assert "BuildLeft" not in p and "NestedLoop" not in p


def test_member_lists_are_gathered_per_list(spark):
    p = _plan(S.members(S.Tables(spark, SF)))
    # one collect_list per member and list (partial + final)
    assert p.count("collect_list") == 2 and "cat" in p


def test_single_job_reads_only_its_lines(spark):
    p = _plan(S.jobs(S.Tables(spark, SF), only_ids=[3]))
    assert "In(l_partkey, [3])" in p or "EqualTo(l_partkey,3)" in p


def test_extract_sink_counts_rows(spark, tmp_path):
    from talentmesh.plans.flows import extract_for_job
    t = S.Tables(spark, SF)
    bundle = extract_for_job(S.jobs(t), S.members(t), 3)      # E1 / S6: lazy bundle
    counts = write_extract(bundle, str(tmp_path))
    assert counts == {"jobpost": 1, "member": 150}
    line = (next((tmp_path / "jobpost").glob("part-*.json"))).read_text().splitlines()[0]
    assert "CreatedDate" in json.loads(line)   # null fields are kept


def test_unused_lists_are_never_computed(spark):
    """Left join to the per-member aggregate is removed when no list column
    is read: a head-column query never scans the bridges."""
    p = _plan(S.members(S.Tables(spark, SF)).select("MemberId", "Headline", "CityName"))
    assert "collect_list" not in p and "lineitem" not in p


def test_per_request_top_k_is_pre_limited(spark):
    from talentmesh.config import MatchOptions
    from talentmesh.plans import catalog as C
    from talentmesh.plans.flows import rank_payloads
    valid = C._valid_payloads(spark, SF, "rank")
    p = _plan(rank_payloads(valid, CharProfileEmbedder(), MatchOptions(threshold=None, top_k=3)))
    import re
    # partial (before the shuffle) and final limits partitioned by the request
    assert len(re.findall(r"WindowGroupLimit \[request_key", p)) == 2
