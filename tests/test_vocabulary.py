"""Vocabulary matching equals testing each token against each fragment."""

import random

from pyspark.sql import functions as F

from talentmesh.functions.skills import job_fragments, skill_points, skill_points_inside, whitespace_tokens
from talentmesh.operators import vocabulary as V
from talentmesh.operators.rank import cheap_pairs
from talentmesh.operators.score import attach_vocabulary, prepare_jobs, prepare_members
from talentmesh.plans import catalog


def word(r, top=7):
    return "".join(r.choice("abcé ") for _ in range(r.randint(0, top)))


def test_tokens_inside(spark):
    r = random.Random(1)
    frags = [word(r, 12) for _ in range(150)] + ["", None, "x" * 300 + "abca", "abc"]
    toks = [w for w in (word(r).replace(" ", "") for _ in range(120))] + ["", None, "abc", "abca", "x" * 200, "é"]
    f, t = spark.createDataFrame([(x,) for x in frags], "k string"), spark.createDataFrame([(x,) for x in toks], "t string")
    got = [(x["k"], x["t"]) for x in V.tokens_inside(f, t).collect()]
    want = {(k, t) for k in frags if k for t in toks if t and t in k}
    assert set(got) == want and len(got) == len(want)


def test_points_equal_the_direct_form(spark):
    r = random.Random(2)
    jobs = [(i, r.choice([None, "", ",".join(word(r, 9) for _ in range(r.randint(1, 5)))]), r.choice([None, ",".join(word(r) for _ in range(r.randint(1, 4)))]))
            for i in range(40)]
    members = [(i, r.choice([None, "", "; ".join(word(r) for _ in range(r.randint(1, 6)))]), ", ".join(word(r) for _ in range(r.randint(0, 5))) or None)
               for i in range(40)]
    j = prepare_jobs(spark.createDataFrame(jobs, "Id long, Required_Skills string, PreferredSkills string"))
    m = prepare_members(spark.createDataFrame(members, "MemberId long, TechnicalSkillNames string, OtherSkills string"))
    both = attach_vocabulary(j, m).drop("Required_Skills").join(m, F.col("Id") % 5 == F.col("MemberId") % 5)
    cols = []
    for name, text, frag, required in (("ts", "req", "req_frag", True), ("ts", "pref", "pref_frag", False), ("os", "fused", "fused_frag", False)):
        lower, toks = F.col(f"m_{name}_lc"), F.col(f"m_{name}_tok")
        cols += [skill_points(lower, whitespace_tokens(lower), job_fragments(F.col(f"j_{text}")), F.col(f"j_{text}"), required).alias(f"a_{frag}"),
                 skill_points_inside(lower, toks, F.col(f"j_{frag}_in"), F.col(f"j_{text}"), required).alias(f"b_{frag}")]
    rows = both.select(*cols).collect()
    assert len(rows) == 320 and any(x["a_req_frag"] for x in rows)
    assert all(x[f"a_{f}"] == x[f"b_{f}"] for x in rows for f in ("req_frag", "pref_frag", "fused_frag"))


def test_pairs_run_no_lambda_inside_a_lambda_and_cheap_queries_no_vectors(spark):
    pairs = catalog._pairs(spark, "/root/testdata/sf0.001", vectors=False)
    plan = cheap_pairs(pairs)._jdf.queryExecution().optimizedPlan().toString()
    points = [x for x in plan.splitlines() if "AS required_skills" in x or "_s_required_skills" in x]
    assert points and not any("exists(" in x for x in points)
    for q in (catalog.q_skill_points, catalog.q_categorical_points):
        executed = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in executed


def test_empty_sides(spark):
    j = prepare_jobs(spark.createDataFrame([(1, "a,b", "c")], "Id long, Required_Skills string, PreferredSkills string"))
    m = prepare_members(spark.createDataFrame([], "MemberId long, TechnicalSkillNames string, OtherSkills string"))
    row = attach_vocabulary(j, m).first()
    assert [f["inside"] for f in row["j_req_frag_in"]] == [[], []]
