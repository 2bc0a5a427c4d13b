"""End-to-end on the real talent schema (all 30 tables as small fixtures):
the README's usage flow, extract -> vectors -> rank -> sinks."""

import datetime as dt
import decimal
import json

from talentmesh.config import CATEGORIES, MatchOptions
from talentmesh.operators import profiles as P
from models import hashed_bag_of_words
from talentmesh.operators.embed import ModelEmbedder
from talentmesh.operators.rank import global_rank, rank_members_for_job, score_jobs_for_member
from talentmesh.operators.sinks import nested_ranking, score_map, write_extract
from talentmesh.sources.tables import TableSource


def _tables(spark):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    tabs = {
        "Member": spark.createDataFrame(
            [(1, "Ada", "L", "a@x", True, ts, ts, 1, 1, 1, 10, "Software Engineer"),
             (2, "Bo", "K", "b@x", True, ts, ts, 2, 2, 2, 11, "Chef"),
             (3, "Cy", "M", "c@x", False, ts, ts, 1, 1, 1, 10, "Engineer")],
            "Id long, MemberFirstName string, MemberLastName string, MemberEmail string, IsActive boolean, "
            "CreatedDate timestamp, ModifiedDate timestamp, MemberEthnicityId int, MemberGenderId int, "
            "Age_Id int, CityId int, Headline string"),
        "Age": spark.createDataFrame([(1, "20-30"), (2, "30-40")], "Id int, AgeName string"),
        "City": spark.createDataFrame([(10, "Paris"), (11, "Rome")], "Id int, CityName string"),
        "Ethnicity": spark.createDataFrame([(1, "A"), (2, "B")], "Id int, EthnicityName string"),
        "EmploymentType": spark.createDataFrame([(1, "Full time")], "Id int, EmploymentTypeName string"),
        "Industry": spark.createDataFrame([(5, "Software")], "Id int, IndustryName string"),
        "MemberEducation": spark.createDataFrame([(1, "BSc", "CS", "Systems"), (3, "BSc", "CS", "Theory")],
                                                 "MemberId long, EducationDegree string, "
                                                 "EducationFieldStudy string, EducationDescription string"),
        "MemberExperience": spark.createDataFrame([(1, "Dev", "Acme", "Java services")],
                                                  "MemberId long, ExperienceJobTitle string, "
                                                  "ExperienceCompany string, ExperienceDescription string"),
        "Member_OtherSkills": spark.createDataFrame([(1, "Docker"), (3, "SQL")], "MemberId long, OtherSkillName string"),
        "JobPost": spark.createDataFrame(
            [(123, "J1", "Software Engineer", 1, 10, 5, ts, ts, decimal.Decimal("1.00"), decimal.Decimal("2.00"),
              "Paris", "desc", "BSc CS Systems", "Docker", "Java,SQL", "Dev at Acme - Java services", True, ts, ts)],
            "Id long, JobCode string, JobTitle string, EmploymentTypeId int, CityId int, IndustryId int, "
            "PostedDate timestamp, Deadline_for_Applications timestamp, Salary_Range_Start decimal(18,2), "
            "Salary_Range_End decimal(18,2), JobLocation string, Job_Description string, Qualifications string, "
            "PreferredSkills string, Required_Skills string, Key_Responsibilities string, IsActive boolean, "
            "CreatedDate timestamp, ModifiedDate timestamp"),
    }
    for i, (cat, bridge, dim, fk, name, desc, _n, _d) in enumerate(CATEGORIES):
        tabs[dim] = spark.createDataFrame([(1, f"{cat}-x", f"{cat} d1"), (2, f"{cat}-y", f"{cat} d2")],
                                          f"Id int, {name} string, {desc} string")
        tabs[bridge] = spark.createDataFrame([(1, 1 + i % 2), (3, 2)], f"MemberId long, {fk} int")
    tabs["TechnicalSkills"] = spark.createDataFrame(
        [(1, "Java", "Java dev"), (2, "SQL", "SQL dev")],
        "Id int, TechnicalSkillsName string, TechnicalSkillsDescription string")
    tabs["Member_TechnicalSkills"] = spark.createDataFrame([(1, 1), (1, 2), (3, 2)], "MemberId long, TechnicalSkillId int")
    return tabs


def test_usage_flow(spark, tmp_path):
    src = TableSource(spark, overrides=_tables(spark))
    t = src.table
    parts = [P.bridge_long_form(t(bridge), t(dim), cat, fk, name, desc)
             for cat, bridge, dim, fk, name, desc, _n, _d in CATEGORIES]
    parts += [P.education_long_form(t("MemberEducation")), P.experience_long_form(t("MemberExperience")),
              P.other_skills_long_form(t("Member_OtherSkills"))]
    long_form = parts[0]
    for p in parts[1:]:
        long_form = long_form.unionByName(p)
    members = P.member_profiles(t("Member"), long_form, age=t("Age"), city=t("City"), ethnicity=t("Ethnicity"))
    jobs = P.job_posts(t("JobPost"), t("EmploymentType"), t("City"), t("Industry"))

    counts = write_extract({"jobpost": P.job_by_id(jobs, 123), "member": members}, str(tmp_path / "extract"))
    assert counts == {"jobpost": 1, "member": 3}
    ada = {r.MemberId: r for r in members.collect()}[1]
    assert ada.TechnicalSkillNames == "Java; SQL" and ada.LeadershipNames == "Leadership-y"

    model = ModelEmbedder(hashed_bag_of_words(16), 16, "e2e")
    texts = (members.selectExpr("Education AS text").unionByName(members.selectExpr("Experience AS text"))
             .unionByName(jobs.selectExpr("Qualifications AS text"))
             .unionByName(jobs.selectExpr("Key_Responsibilities AS text")))
    embedder = model.refresh_table(texts, "text", str(tmp_path / "vectors"))

    ranked = global_rank(rank_members_for_job(members, jobs, 123, embedder, MatchOptions(threshold=None)))
    rows = ranked.orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3] and rows[0].MemberId == 1
    doc = nested_ranking(ranked, P.job_by_id(jobs, 123)).collect()
    assert [m["Member Id"] for m in doc[0]["Matched Members"]] == [r.MemberId for r in rows]
    thresholded = rank_members_for_job(members, jobs, 123, embedder).collect()
    assert all(r.Similarity >= 85 for r in thresholded)

    scores = score_jobs_for_member(members, jobs, 1, embedder)
    m = score_map(scores).collect()
    assert list(m[0].scores) == ["123"] and m[0].scores["123"] == rows[0].Similarity
    nested_ranking(ranked, P.job_by_id(jobs, 123)).write.json(str(tmp_path / "rankings"))
    first = json.loads(next((tmp_path / "rankings").glob("part-*.json")).read_text().splitlines()[0])
    assert first["Job Details"]["Job Title"] == "Software Engineer"
