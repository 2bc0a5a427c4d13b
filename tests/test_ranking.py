"""J5, F3, O1, O2, M10, M11, K2, K3, S7, S8, F4 on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from talentmesh.config import MatchOptions
from talentmesh.operators.embed import CharProfileEmbedder
from talentmesh.operators.rank import global_rank, rank_members_for_job, score_jobs_for_member, top_matches
from talentmesh.operators.sinks import last_wins, nested_ranking, score_map
from talentmesh.plans.flows import rank_payload_documents, rank_payloads, score_payloads
from talentmesh.sources.payload import parse_payloads, payload_schema, rejected, read_payloads, split_valid

E = CharProfileEmbedder()

MEMBER_SCHEMA = ("MemberId long, MemberFirstName string, MemberLastName string, MemberEmail string, "
                 "CityName string, Headline string, TechnicalSkillNames string, OtherSkills string, "
                 "Education string, Experience string")
JOB_SCHEMA = ("Id long, JobTitle string, JobCode string, CityName string, JobLocation string, "
              "EmploymentTypeName string, PostedDate string, Deadline_for_Applications string, IsActive boolean, "
              "Salary_Range_Start double, Salary_Range_End double, Qualifications string, PreferredSkills string, "
              "Required_Skills string, Key_Responsibilities string, Industry string, Role string")


@pytest.fixture(scope="module")
def data(spark):
    members = spark.createDataFrame([
        (1, "A", "a", "a@x", "Paris", "Engineer", "Java; SQL", "Go, Rust", "BSc CS", "Dev at Acme"),
        (2, "B", "b", "b@x", "Paris", "Engineer", "Java; SQL", "Go, Rust", "BSc CS", "Dev at Acme"),  # tie with 1
        (3, "C", "c", "c@x", None, None, "Cobol", "Unknown", "Unknown", "Unknown"),
        (4, "D", "d", "d@x", "Lyon", "Engineer", "Java; SQL; Python", "Go", "MSc CS", "Lead at Acme"),
    ], MEMBER_SCHEMA)
    jobs = spark.createDataFrame([
        (10, "Engineer", "J10", "Paris", "Paris", "Full", "2024-01-01 00:00:00", None, True, 1.0, 2.0,
         "BSc CS", "Python", "Java, SQL", "Dev at Acme", "Software", "Engineer"),
        (11, "Chef", "J11", "Rome", "Rome", "Part", None, None, False, None, None,
         "Cooking", "Pasta", "Knife", "Cook", "Food", "Chef"),
    ], JOB_SCHEMA)
    return members, jobs


def test_rank_threshold_and_order(data):
    members, jobs = data
    r = rank_members_for_job(members, jobs, 10, E)
    all_ = rank_members_for_job(members, jobs, 10, E, MatchOptions(threshold=None))
    assert r.count() == all_.where("Similarity >= 85").count()
    ranked = global_rank(r).orderBy("rank").collect()
    sims = [x.Similarity for x in ranked]
    assert sims == sorted(sims, reverse=True)
    # ties broken by MemberId ascending; ranks are 1..n
    assert [x.rank for x in ranked] == list(range(1, len(ranked) + 1))
    ids = [(x.Similarity, x.MemberId) for x in ranked]
    assert ids == sorted(ids, key=lambda t: (-t[0], t[1]))
    assert {1, 2} <= {x.MemberId for x in ranked}


def test_pruning_is_lossless(data):
    members, jobs = data
    for jid in (10, 11):
        a = rank_members_for_job(members, jobs, jid, E, MatchOptions(prune=True)).collect()
        b = rank_members_for_job(members, jobs, jid, E, MatchOptions(prune=False)).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_missing_job_gives_no_rows(data):
    members, jobs = data
    assert rank_members_for_job(members, jobs, 999, E).count() == 0


def test_nested_ranking_keeps_job_without_matches(data):
    members, jobs = data
    r = global_rank(rank_members_for_job(members, jobs, 11, E))
    doc = nested_ranking(r, jobs.where("Id = 11"), chunk_size=2).collect()
    assert len(doc) == 1 and doc[0]["Matched Members"] == [] and doc[0]["Job Details"]["Job Id"] == 11
    r10 = global_rank(rank_members_for_job(members, jobs, 10, E, MatchOptions(threshold=None)))
    docs = nested_ranking(r10, jobs.where("Id = 10"), chunk_size=3).orderBy("chunk").collect()
    flat = [m for d in docs for m in d["Matched Members"]]
    assert [len(d["Matched Members"]) for d in docs] == [3, 1]
    assert [m["Member Id"] for m in flat] == [x.MemberId for x in r10.orderBy("rank").collect()]


def test_global_rank_many_partitions(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("MemberId"), (F.col("id") % 13).cast("double").alias("Similarity"))
    got = global_rank(df, partitions=7).orderBy("rank").select("MemberId").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 13), i))
    assert [r.MemberId for r in got] == want


def test_top_matches(data):
    members, jobs = data
    t = top_matches(rank_members_for_job(members, jobs, 10, E, MatchOptions(threshold=None)), 2).collect()
    assert len(t) == 2


def test_score_jobs_and_map(data):
    members, jobs = data
    s = score_jobs_for_member(members, jobs, 1, E)
    assert s.count() == 2
    m = score_map(s, chunk_size=11).collect()   # ids 10 and 11 fall in chunks 0 and 1
    assert len(m) == 2 and all(len(x.scores) == 1 for x in m)
    m1 = score_map(s, chunk_size=100).collect()
    assert len(m1) == 1 and set(m1[0].scores) == {"10", "11"}


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 10, 0, 1.0), (1, 10, 3, 2.0), (1, 11, 1, 5.0)],
                               "MemberId long, JobId long, pos int, score double")
    got = sorted(map(tuple, last_wins(df, ["MemberId", "JobId"], "pos").collect()))
    assert got == [(1, 10, 2.0), (1, 11, 5.0)]


def test_payloads(spark, data):
    members, jobs = data
    schema = payload_schema(jobs.schema, members.schema)
    m = [r.asDict() for r in members.collect()]
    j = [r.asDict() for r in jobs.collect()]
    texts = [
        json.dumps({"request_id": "r1", "data": {"jobpost": [j[0], j[1]], "member": m}}),
        json.dumps({"request_id": "r2", "data": {"jobpost": [j[1], j[0], j[1]], "member": [m[0], m[1]]}}),
        json.dumps({"request_id": "bad1", "data": {"member": m}}),
        json.dumps({"request_id": "bad2"}),
        json.dumps({"request_id": "bad3", "data": {"jobpost": [], "member": m}}),
    ]
    df = parse_payloads(spark.createDataFrame([(t,) for t in texts], "p string"), "p", schema)
    valid, bad = split_valid(df)
    assert sorted(r.request_id for r in valid.collect()) == ["r1", "r2"]
    assert sorted((r.request_id, r.error) for r in bad.collect()) == [
        ("bad1", "missing jobpost"), ("bad2", "missing data"), ("bad3", "empty list")]
    # scoring needs a member, not a job
    valid_s, bad_s = split_valid(df, "score")
    assert sorted(r.request_id for r in valid_s.collect()) == ["bad3", "r1", "r2"]
    assert sorted(r.request_id for r in bad_s.collect()) == ["bad1", "bad2"]
    # rank direction: jobpost[0] only
    rp = rank_payloads(valid, E, MatchOptions(threshold=None)).collect()
    assert {(r.request_id, r.JobId) for r in rp} == {("r1", 10), ("r2", 11)}
    direct = {r.MemberId: r.Similarity for r in
              rank_members_for_job(members, jobs, 10, E, MatchOptions(threshold=None)).collect()}
    assert {r.MemberId: r.Similarity for r in rp if r.request_id == "r1"} == direct
    # score direction: member[0] vs every job; duplicate job id keeps one row
    sp = score_payloads(valid, E).collect()
    assert sorted((r.request_id, r.JobId) for r in sp) == [("r1", 10), ("r1", 11), ("r2", 10), ("r2", 11)]
    direct_s = {r.JobId: r.score for r in score_jobs_for_member(members, jobs, 1, E).collect()}
    assert {r.JobId: r.score for r in sp if r.request_id == "r1"} == direct_s


def test_top_k_option(spark, data):
    members, jobs = data
    full = rank_members_for_job(members, jobs, 10, E, MatchOptions(threshold=None))
    top2 = rank_members_for_job(members, jobs, 10, E, MatchOptions(threshold=None, top_k=2)).collect()
    want = [(r.Similarity, r.MemberId) for r in full.orderBy(F.desc("Similarity"), "MemberId").limit(2).collect()]
    assert sorted((r.Similarity, r.MemberId) for r in top2) == sorted(want)
    schema = payload_schema(jobs.schema, members.schema)
    m = [r.asDict() for r in members.collect()]
    j = [r.asDict() for r in jobs.collect()]
    df = parse_payloads(spark.createDataFrame(
        [(json.dumps({"request_id": "r1", "data": {"jobpost": [j[0]], "member": m}}),)], "p string"), "p", schema)
    valid, _ = split_valid(df)
    got = rank_payloads(valid, E, MatchOptions(threshold=None, top_k=2)).collect()
    assert sorted((r.Similarity, r.MemberId) for r in got) == sorted(want)


def test_null_job_fields_score_as_empty(spark, data):
    members, _ = data
    jobs = spark.createDataFrame([(20, None, "J20", None, None, None, None, None, None, None, None,
                                   None, None, "Java", None, None, None)], JOB_SCHEMA)
    got = {r.MemberId: r.Similarity
           for r in rank_members_for_job(members, jobs, 20, E, MatchOptions(threshold=None)).collect()}
    assert set(got) == {1, 2, 3, 4}
    # member 1: 'java' hits required (3); other skills 'go, rust' share nothing with 'java' (0);
    # role '' inside headline -> 2; location 'paris' not inside '' -> 0; industry '' == '' -> 3;
    # null texts -> zero vectors -> cosine 0
    want = round(min((3 * .15 + 0 * .15 + 0 * .25 + 0 + 0 + 3 * .05 + 2 * .05 + 0 * .05) * 100, 100), 2)
    assert got[1] == want
    # member 3 has no headline and no city: role '' == '' -> 3, location '' == '' -> 2
    assert got[3] == round((0 + 0 + 0 + 0 + 0 + 3 * .05 + 3 * .05 + 2 * .05) * 100, 2)


def _parsed(spark, data, texts):
    members, jobs = data
    schema = payload_schema(jobs.schema, members.schema)
    return parse_payloads(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, p string"), "p", schema, "k")


def test_validity_depends_on_the_direction(spark, data):
    members, jobs = data
    m, j = [r.asDict() for r in members.collect()], [r.asDict() for r in jobs.collect()]
    texts = [json.dumps({"data": {"jobpost": j, "member": []}}), json.dumps({"data": {"jobpost": [], "member": m}}),
             '{"data": {"jobpost": [', "", None, json.dumps({"data": {"jobpost": j}}), json.dumps({"data": None})]
    df = _parsed(spark, data, texts)
    valid, bad = split_valid(df, "rank")
    assert [r.request_key for r in valid.collect()] == ["0"]
    got = {r.request_key: (r.error, r.payload) for r in bad.collect()}
    assert got == {"1": ("empty list", None), "2": ("malformed", texts[2]), "3": ("malformed", ""), "4": ("malformed", ""),
                   "5": ("missing member", None), "6": ("missing data", None)}
    valid, bad = split_valid(df, "score")
    assert [r.request_key for r in valid.collect()] == ["1"]
    assert score_payloads(valid, E).count() == 0
    # a request without members still has its document
    docs = rank_payload_documents(split_valid(df, "rank")[0], E).collect()
    assert [(d.request_key, d.JobId, d["Matched Members"]) for d in docs] == [("0", 10, [])]
    assert docs[0]["Job Details"]["Job Id"] == 10


def test_requests_without_or_with_equal_client_ids_stay_apart(spark, data):
    members, jobs = data
    m, j = [r.asDict() for r in members.collect()], [r.asDict() for r in jobs.collect()]
    body = {"data": {"jobpost": [j[0], j[1], j[0]], "member": m[:2]}}
    df = _parsed(spark, data, [json.dumps(body), json.dumps(body), json.dumps({"request_id": "r", **body}), json.dumps({"request_id": "r", **body})])
    s = score_payloads(split_valid(df, "score")[0], E).collect()
    assert sorted((r.request_key, r.JobId) for r in s) == [(str(i), k) for i in range(4) for k in (10, 11)]
    docs = rank_payload_documents(split_valid(df, "rank")[0], E, MatchOptions(threshold=None)).collect()
    assert sorted((d.request_key, len(d["Matched Members"])) for d in docs) == [(str(i), 2) for i in range(4)]
    maps = score_map(score_payloads(split_valid(df, "score")[0], E), 1000, ("request_key", "MemberId")).collect()
    assert sorted((r.request_key, sorted(r.scores)) for r in maps) == [(str(i), ["10", "11"]) for i in range(4)]


def test_later_duplicate_job_counts(spark, data):
    members, jobs = data
    m, j = [r.asDict() for r in members.collect()], [r.asDict() for r in jobs.collect()]
    other = {**j[1], "Id": j[0]["Id"]}
    df = _parsed(spark, data, [json.dumps({"data": {"jobpost": [j[0], other], "member": m[:1]}}), json.dumps({"data": {"jobpost": [other, j[0]], "member": m[:1]}}),
                               json.dumps({"data": {"jobpost": [j[1]], "member": m[:1]}}), json.dumps({"data": {"jobpost": [j[0]], "member": m[:1]}})])
    got = {r.request_key: r.score for r in score_payloads(split_valid(df, "score")[0], E).collect()}
    assert len(got) == 4 and got["0"] == got["2"] and got["1"] == got["3"]


def test_later_entry_wins_in_the_map_and_is_asked_for(spark, data):
    members, jobs = data
    m, j = [r.asDict() for r in members.collect()], [r.asDict() for r in jobs.collect()]
    other = {**j[1], "Id": j[0]["Id"]}
    df = _parsed(spark, data, [json.dumps({"data": {"jobpost": [j[0], other], "member": m[:1]}}), json.dumps({"data": {"jobpost": [other, j[0]], "member": m[:1]}})])
    valid = split_valid(df, "score")[0]
    every = score_payloads(valid, E, positions=True)
    assert sorted((r.request_key, r.pos) for r in every.collect()) == [("0", 0), ("0", 1), ("1", 0), ("1", 1)]
    maps = score_map(every, 1000, ("request_key", "MemberId"), pos_col="pos").collect()
    want = {r.request_key: r.score for r in score_payloads(valid, E).collect()}
    assert {r.request_key: r.scores for r in maps} == {k: {"10": v} for k, v in want.items()} and want["0"] != want["1"]
    with pytest.raises(Exception, match="scored twice"):
        score_map(every, 1000, ("request_key", "MemberId")).collect()


def test_wrongly_typed_fields_cost_the_field(spark, data):
    members, jobs = data
    m, j = [r.asDict() for r in members.collect()], [r.asDict() for r in jobs.collect()]
    odd = {**j[0], "Salary_Range_Start": "on request", "JobTitle": 5, "Unknown_Field": {"a": [1]}}
    texts = [json.dumps({"request_id": 12, "data": {"jobpost": [odd], "member": [{**m[0], "MemberId": str(m[0]["MemberId"])}]}}),
             json.dumps({"data": {"jobpost": [j[0]], "member": "nobody"}}), json.dumps({"data": {"jobpost": {"Id": 1}, "member": m}}),
             json.dumps({"data": [1]}), json.dumps([1]), json.dumps({"data": {"jobpost": [j[0]], "member": None}}),
             json.dumps({"data": {"jobpost": [7, j[0]], "member": m[:1]}}), '{"data": {"jobpost": [], "jobpost": [{"Id": "x"}], "member": [{"MemberId": "3"}]}}']
    df = _parsed(spark, data, texts)
    valid = {r.request_key: r for r in split_valid(df, "rank")[0].collect()}
    assert set(valid) >= {"0", "6"}
    first = valid["0"].data.jobpost[0]
    assert (first.Id, first.JobTitle, first.Salary_Range_Start, valid["0"].request_id) == (j[0]["Id"], "5", None, "12")
    assert valid["0"].data.member[0].MemberId == m[0]["MemberId"]
    assert [x.Id for x in valid["6"].data.jobpost] == [None, j[0]["Id"]]
    bad = {(r.direction, r.request_key): (r.error, r.payload) for r in rejected(df).collect()}
    assert {k: v for (d, k), v in bad.items() if d == "rank" and k != "7"} == {
        "1": ("member is not a list", None), "2": ("jobpost is not a list", None), "3": ("data is not an object", None), "4": ("malformed", "[1]"),
        "5": ("missing member", None)}
    for d in ("rank", "score"):
        assert {(r.request_key, r.error) for r in split_valid(df, d)[1].collect()} == {(k, v[0]) for (x, k), v in bad.items() if x == d}


def test_both_directions_come_from_one_parse(spark):
    from talentmesh.plans import catalog

    plan = catalog.q_payload_quarantine(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_chunks_are_exact_beyond_doubles(spark):
    big = 2**53
    s = spark.createDataFrame([(1, big + 1, 1.0), (1, big + 2, 2.0), (1, -1, 3.0)], "MemberId long, JobId long, score double")
    assert {r.chunk: sorted(r.scores) for r in score_map(s, 2).collect()} == {
        big // 2: [str(big + 1)], big // 2 + 1: [str(big + 2)], -1: ["-1"]}


def test_read_payload_files(spark, data, tmp_path):
    members, jobs = data
    m, j = [r.asDict() for r in members.collect()], [r.asDict() for r in jobs.collect()]
    line = json.dumps({"data": {"jobpost": j, "member": m}})
    (tmp_path / "a.json").write_text(line + "\n" + line + "\n\n{bad\n")
    (tmp_path / "b.json").write_text(line + "\n")
    df = read_payloads(spark, str(tmp_path), payload_schema(jobs.schema, members.schema))
    valid, bad = split_valid(df)
    assert valid.select("request_key").distinct().count() == 3
    assert [(r.error, r.payload) for r in bad.collect()] == [("malformed", "{bad")]
