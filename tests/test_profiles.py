"""S1-S4, J1-J4, G1-G5, P8 on small talent-schema fixtures (FIXTURES.md §D)."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from talentmesh.config import CATEGORIES
from talentmesh.operators import profiles as P


@pytest.fixture(scope="module")
def talent(spark):
    ts = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    member = spark.createDataFrame([
        (1, "Ada", "L", "ada@x", True, ts, ts, 1, 1, 1, 10, "Engineer"),
        (2, "Bo", "K", "bo@x", False, ts, None, None, None, None, None, None),  # no child rows
        (3, "Cy", "M", "cy@x", True, ts, ts, 2, 2, 2, 11, "Analyst"),
    ], "Id long, MemberFirstName string, MemberLastName string, MemberEmail string, IsActive boolean, "
       "CreatedDate timestamp, ModifiedDate timestamp, MemberEthnicityId int, MemberGenderId int, "
       "Age_Id int, CityId int, Headline string")
    city = spark.createDataFrame([(10, "Paris"), (11, "Lyon")], "Id int, CityName string")
    age = spark.createDataFrame([(1, "20-30"), (2, "30-40")], "Id int, AgeName string")
    eth = spark.createDataFrame([(1, "A"), (2, "B")], "Id int, EthnicityName string")
    tech = spark.createDataFrame([(1, "Java", "JVM"), (2, "SQL", "Queries"), (3, None, "nameless")],
                                 "Id int, TechnicalSkillsName string, TechnicalSkillsDescription string")
    bridge = spark.createDataFrame([(1, 2), (1, 1), (1, 3), (1, 99), (3, 3)],
                                   "MemberId long, TechnicalSkillId int")
    edu = spark.createDataFrame([(1, "BSc", "CS", "Good"), (1, "MSc", None, "Dropped"), (3, None, None, None)],
                                "MemberId long, EducationDegree string, EducationFieldStudy string, "
                                "EducationDescription string")
    exp = spark.createDataFrame([(1, "Dev", "Acme", "Built")], "MemberId long, ExperienceJobTitle string, "
                                "ExperienceCompany string, ExperienceDescription string")
    oth = spark.createDataFrame([(1, "Go"), (1, "Rust"), (3, "Go")], "MemberId long, OtherSkillName string")
    lf = (P.bridge_long_form(bridge, tech, "TechnicalSkills", "TechnicalSkillId",
                             "TechnicalSkillsName", "TechnicalSkillsDescription")
          .unionByName(P.education_long_form(edu)).unionByName(P.experience_long_form(exp))
          .unionByName(P.other_skills_long_form(oth)))
    job = spark.createDataFrame([
        (7, "J7", "Engineer", 1, 10, 5, ts, ts, decimal.Decimal("10.50"), decimal.Decimal("20.25"), "Paris",
         "desc", "quals", "SQL", "Java,SQL", "resp", True, ts, ts),
        (8, "J8", None, 9, None, None, None, None, None, None, None, None, None, None, None, None, None,
         None, None),
    ], "Id long, JobCode string, JobTitle string, EmploymentTypeId int, CityId int, IndustryId int, "
       "PostedDate timestamp, Deadline_for_Applications timestamp, Salary_Range_Start decimal(18,2), "
       "Salary_Range_End decimal(18,2), JobLocation string, Job_Description string, Qualifications string, "
       "PreferredSkills string, Required_Skills string, Key_Responsibilities string, IsActive boolean, "
       "CreatedDate timestamp, ModifiedDate timestamp")
    et = spark.createDataFrame([(1, "Full time")], "Id int, EmploymentTypeName string")
    ind = spark.createDataFrame([(5, "Software")], "Id int, IndustryName string")
    return dict(member=member, city=city, age=age, eth=eth, lf=lf, job=job, et=et, ind=ind)


def _members(t):
    return P.member_profiles(t["member"], t["lf"], age=t["age"], city=t["city"], ethnicity=t["eth"])


def test_member_row_shape_and_lists(talent):
    rows = {r.MemberId: r for r in _members(talent).collect()}
    assert len(rows) == 3
    cols = _members(talent).columns
    assert len(cols) == 38 and cols[0] == "MemberId" and cols[-3:] == ["Education", "Experience", "OtherSkills"]
    a = rows[1]
    # ordered by FK; null name skipped; missing dimension row (99) dropped by the inner join
    assert a.TechnicalSkillNames == "Java; SQL"
    assert a.TechnicalSkillDescriptions == "JVM; Queries; nameless"
    assert a.Education == "BSc - CS - Good"          # element with a null part dropped
    assert a.Experience == "Dev at Acme - Built"
    assert a.OtherSkills == "Go, Rust"
    assert a.CommunicationNames == "Unknown"
    assert (a.CityName, a.AgeName, a.EthnicityName) == ("Paris", "20-30", "A")
    assert a.CreatedDate == "2024-05-06 07:08:09"      # P4: seconds precision
    b = rows[2]                                       # no child rows at all
    assert all(getattr(b, c[-2]) == "Unknown" for c in CATEGORIES)
    assert (b.Education, b.Experience, b.OtherSkills) == ("Unknown",) * 3
    assert b.CityName is None and b.ModifiedDate is None   # CityName is not defaulted
    c = rows[3]
    assert c.TechnicalSkillNames == "Unknown"         # only a null name -> NULL -> Unknown
    assert c.TechnicalSkillDescriptions == "nameless"
    assert c.Education == "Unknown"                   # all parts null


def test_job_rows(talent):
    j = P.job_posts(talent["job"], talent["et"], talent["city"], talent["ind"])
    rows = {r.Id: r for r in j.collect()}
    assert len(j.columns) == 22
    a, b = rows[7], rows[8]
    assert (a.EmploymentTypeName, a.CityName, a.Industry, a.Role) == ("Full time", "Paris", "Software", "Engineer")
    assert a.Salary_Range_Start == 10.5 and isinstance(a.Salary_Range_End, float)
    assert a.Description == "desc" and a.PostedDate == "2024-05-06 07:08:09"
    assert (b.EmploymentTypeName, b.CityName, b.Industry) == ("Unknown", "Unknown", "Unknown")
    assert P.job_by_id(j, 7).count() == 1


def test_one_row_per_member_and_unique_dims(talent):
    m = _members(talent)
    assert m.groupBy("MemberId").count().where("count > 1").count() == 0
    for name in ("city", "age", "eth", "et", "ind"):
        d = talent[name]
        assert d.groupBy("Id").count().where("count > 1").count() == 0


def test_lists_equal_one_listagg_each(talent):
    lf = talent["lf"]
    tech = [c for c in CATEGORIES if c[0] == "TechnicalSkills"]
    one = P.aggregate_lists(lf, tech, children=()).where("TechnicalSkillNames is not null or TechnicalSkillDescriptions is not null").collect()
    sep = lf.where("cat = 'TechnicalSkills'").groupBy("MemberId").agg(
        F.expr("listagg(v1, '; ') WITHIN GROUP (ORDER BY k, v1, v2)"), F.expr("listagg(v2, '; ') WITHIN GROUP (ORDER BY k, v1, v2)")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, sep))


def test_hot_member_is_spread_over_its_lists(spark):
    """One member owns a third of the rows: no partition of the gathering
    stage holds all of them."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("MemberId"),
        F.get(F.array(*[F.lit(c[0]) for c in CATEGORIES]), (F.xxhash64("id") % 10 + 10).cast("int") % 10).alias("cat"),
        F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("v1"), F.lit(None).cast("string").alias("v2"))
    most = (rows.repartition(8, "MemberId", "cat").where("MemberId = 0").groupBy(F.spark_partition_id()).count()
            .agg(F.max("count")).first()[0])
    assert most < 6000
    out = P.aggregate_lists(rows).where("MemberId = 0").first()
    assert sum(len(out[c[-2]].split("; ")) for c in CATEGORIES) == 10_000


def test_member_filter_reaches_bridge_scan(spark, tmp_path):
    """The id filter is inferred through the join and aggregate down to
    the bridge parquet scan."""
    bridge = spark.createDataFrame([(i % 50, i % 7) for i in range(500)], "MemberId long, TechnicalSkillId int")
    bridge.write.parquet(str(tmp_path / "b"))
    member = spark.createDataFrame([(i, f"m{i}", "x", "e", True, None, None, None, None, None, None, None)
                                    for i in range(50)],
                                   "Id long, MemberFirstName string, MemberLastName string, MemberEmail string, "
                                   "IsActive boolean, CreatedDate timestamp, ModifiedDate timestamp, "
                                   "MemberEthnicityId int, MemberGenderId int, Age_Id int, CityId int, Headline string")
    dim = spark.createDataFrame([(i, f"s{i}", f"d{i}") for i in range(7)],
                                "Id int, TechnicalSkillsName string, TechnicalSkillsDescription string")
    b = spark.read.parquet(str(tmp_path / "b"))
    lf = P.bridge_long_form(b, dim, "TechnicalSkills", "TechnicalSkillId", "TechnicalSkillsName",
                            "TechnicalSkillsDescription")
    q = P.member_by_id(P.member_profiles(member, lf), 3)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(MemberId,3)" in plan
    r = q.collect()
    want = "; ".join(f"s{k}" for k in sorted(i % 7 for i in range(500) if i % 50 == 3))
    assert len(r) == 1 and r[0].TechnicalSkillNames == want


def test_a_repeated_dimension_id_is_refused_where_it_is_used(spark):
    jobs = spark.createDataFrame([(1, 5)], "Id long, CityId int")
    twice = spark.createDataFrame([(5, "Rome"), (5, "Roma"), (None, "x"), (None, "y")], "Id int, CityName string")
    with pytest.raises(Exception, match="CityName: id 5 occurs more than once"):
        P._lookup(jobs, twice, "CityId", "CityName", "c").collect()
    bridge = spark.createDataFrame([(1, 5)], "MemberId long, fk int")
    dim = spark.createDataFrame([(5, "a", "b"), (5, "a", "b")], "Id int, n string, d string")
    with pytest.raises(Exception, match="Leadership: id 5 occurs more than once"):
        P.bridge_long_form(bridge, dim, "Leadership", "fk", "n", "d").collect()


def test_checked_lookups_scan_a_dimension_once(spark, tmp_path):
    spark.createDataFrame([(i, f"c{i}") for i in range(9)], "Id int, CityName string").write.parquet(str(tmp_path / "city"))
    jobs = spark.createDataFrame([(1, 5), (2, None), (3, 77)], "Id long, CityId int")
    got = P._lookup(jobs, spark.read.parquet(str(tmp_path / "city")), "CityId", "CityName", "c")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 5, "c5"), (2, None, None), (3, 77, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
