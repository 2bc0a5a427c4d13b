"""Cross-checks on the stand-in tables (sf0.001): different plans for the
same scores must agree exactly."""

from pyspark.sql import functions as F

from talentmesh.config import MatchOptions
from talentmesh.operators.embed import CharProfileEmbedder
from talentmesh.operators.rank import rank_members_for_job, score_jobs_for_member, score_pairs
from talentmesh.operators.score import attach_job_vectors, attach_member_vectors, prepare_jobs, prepare_members
from talentmesh.plans import standin as S

SF = "/root/testdata/sf0.001"
E = CharProfileEmbedder()


def test_pruned_equals_brute_force_on_whole_table(spark):
    t = S.Tables(spark, SF)
    m, j = S.scoring_members(t), S.jobs(t)
    for jid in (0, 3, 9):
        pruned = rank_members_for_job(m, j, jid, E, MatchOptions(prune=True)).collect()
        brute = (rank_members_for_job(m, j, jid, E, MatchOptions(threshold=None, prune=False))
                 .where("Similarity >= 85").collect())
        assert sorted(map(tuple, pruned)) == sorted(map(tuple, brute))


def test_three_paths_give_the_same_scores(spark):
    t = S.Tables(spark, SF)
    m, j = S.scoring_members(t), S.jobs(t)
    mid = 7
    single = {r.JobId: r.score for r in score_jobs_for_member(m, j, mid, E).collect()}
    assert len(single) == j.count()
    mp = attach_member_vectors(prepare_members(m.where(F.col("MemberId") == mid)), E)
    jp = attach_job_vectors(prepare_jobs(j), E).withColumnRenamed("Id", "JobId")
    # pairs via an equi-join on the member id carried by every job row
    jp2 = jp.select(F.lit(mid).cast("bigint").alias("MemberId"), "JobId",
                    *[c for c in jp.columns if c.startswith("j_")])
    pairs = jp2.join(mp.select("MemberId", *[c for c in mp.columns if c.startswith("m_")]), "MemberId")
    via_pairs = {r.JobId: r.Similarity for r in score_pairs(pairs, E).collect()}
    assert via_pairs == single
    ranked = {r.MemberId: r.Similarity
              for r in rank_members_for_job(m, j, 3, E, MatchOptions(threshold=None)).collect()}
    assert ranked[mid] == single[3]
