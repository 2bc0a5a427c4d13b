"""Stand-in talent tables derived from the TPC-H-style test tables.

The test data holds no talent database, so every talent table is derived
from real tables (never from invented rows), and all of the work grows with
the data:

* Member            = customer (Headline = market segment, with the nation
                      behind it for every third; CityId = nation;
                      MemberEthnicityId = region of the nation; Age_Id over
                      the nations, some of them unknown; Industry = region
                      of every other one, else null)
* City = Age        = nation;  Ethnicity = Industry = EmploymentType = region
* skill bridges     = orders x lineitem x part, the category by the part's
                      size modulo 10, so all ten are filled
                      (name = part name, description = type)
* MemberEducation   = every line: brand - type (null for PROMO) - part name
* MemberExperience  = orders: priority at status - 'order <key>'
* Member_OtherSkills= brands of the A-flag lines of odd-sized parts
* JobPost           = part: complete and short by nature.  Required skills
                      are brand and name, preferred ones type and the words
                      of the name; JobTitle/Role = the segment of the
                      customer of the same number (null where there is none);
                      posted and deadline = first and last ship date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CATEGORIES
from ..operators.copartition import write_copartitioned
from ..operators.profiles import (
    EDUCATION,
    EXPERIENCE,
    OTHER_SKILLS,
    job_posts,
    member_profiles,
    scoring_profiles,
)
from ..session import written


class Tables:
    """Lazy parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


#: Line items of the members that are taken together, at least; and at least
#: twice the number of jobs, as every part brings the jobs to its lines.
PART_LINES = 2_000_000


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint"), F.lit(11)), F.lit(parts)).cast("int")


class MemberPart(Tables):
    """The tables with a part of the members: their customers, orders and the
    lines of these orders.  What does not hang on a member is whole."""

    def __init__(self, t: Tables, lines: DataFrame, at: int, parts: int):
        self.t, self.lines, self.at, self.parts = t, lines, at, parts

    def __call__(self, name: str) -> DataFrame:
        if name == "lineitem":
            return self.lines.where(F.col("_part") == self.at).drop("_part")
        key = {"customer": "c_custkey", "orders": "o_custkey"}.get(name)
        return self.t(name).where(_part(key, self.parts) == self.at) if key else self.t(name)


def parts_needed(t: Tables) -> int:
    return max(1, -(-t("lineitem").count() // max(PART_LINES, 2 * t("part").count())))


def member_parts(t: Tables, parts: int) -> list[Tables]:
    """``t`` cut by member: each member is in one part with all its orders and
    their lines, which are written once, by part.  The lines of an order that
    stands in several parts are in each of them."""
    if parts == 1:
        return [t]
    o = t("orders").select("o_orderkey", _part("o_custkey", parts).alias("_part")).distinct()
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    lines = written(li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey"), "part-lines", "zstd", by="_part")
    return [MemberPart(t, lines, at, parts) for at in range(parts)]


def shared_order_keys(t: Tables, parts: int) -> bool:
    """Whether requests of members of different parts have one key."""
    part = _part("o_custkey", parts)
    o = t("orders").where("o_custkey IS NOT NULL").groupBy("o_orderkey").agg((F.min(part) != F.max(part)).alias("apart"))
    return not o.where("apart").isEmpty()


def member_table(t: Tables) -> DataFrame:
    c = t("customer")
    n = t("nation").select("n_nationkey", "n_regionkey", "n_name")
    r = t("region")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("c_custkey").alias("Id"),
        F.col("c_name").alias("MemberFirstName"),
        F.col("c_mktsegment").alias("MemberLastName"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("MemberEmail"),
        (F.col("c_acctbal") >= 0).alias("IsActive"),
        F.lit(None).cast("timestamp").alias("CreatedDate"),
        F.lit(None).cast("timestamp").alias("ModifiedDate"),
        F.col("n_regionkey").alias("MemberEthnicityId"),
        F.lit(None).cast("int").alias("MemberGenderId"),
        (F.col("c_custkey") % 30).cast("int").alias("Age_Id"),
        F.col("c_nationkey").alias("CityId"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(" ", "c_mktsegment", "n_name")).otherwise(F.col("c_mktsegment")).alias("Headline"),
        F.when(F.col("c_custkey") % 2 == 1, F.col("r_name")).alias("Industry"),
    )


def city_table(t: Tables) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("Id"), F.col("n_name").alias("CityName"))


def age_table(t: Tables) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("Id"), F.concat(F.lit("age "), "n_name").alias("AgeName"))


def region_dim(t: Tables, name_col: str) -> DataFrame:
    return t("region").select(F.col("r_regionkey").alias("Id"), F.col("r_name").alias(name_col))


def bridge_lines(t: Tables) -> DataFrame:
    """orders x lineitem x part: one row per line item with its member."""
    o = t("orders").select("o_orderkey", "o_custkey")
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)


def member_long_form(t: Tables) -> DataFrame:
    """Skill-category, education and other-skill elements from ONE scan of
    the line items (``inline`` emits up to three elements per line), plus
    experience elements from orders."""
    b = bridge_lines(t)
    flag = F.col("l_returnflag")
    size = F.col("p_size")
    cat = F.get(F.array(*[F.lit(c[0]) for c in CATEGORIES]), (size % 10).cast("int"))
    edu = F.concat(F.col("p_brand"), F.lit(" - "), F.nullif(F.col("p_type"), F.lit("PROMO")),
                   F.lit(" - "), F.col("p_name"))

    def el(c, k, a, d):
        return F.struct(F.lit(c).alias("cat"), k.cast("bigint").alias("k"),
                        a.cast("string").alias("v1"), d.cast("string").alias("v2"))

    nul = F.lit(None)
    elements = F.array(
        el("", F.col("l_partkey"), F.col("p_name"), F.col("p_type")).withField("cat", cat),
        el(EDUCATION, nul, edu, nul),
        F.when((flag == "A") & (size % 2 == 1), el(OTHER_SKILLS, nul, F.col("p_brand"), nul)),
    )
    lines = b.select(F.col("o_custkey").cast("bigint").alias("MemberId"),
                     F.inline(F.filter(elements, lambda e: e.isNotNull())))
    o = t("orders")
    exp = o.select(
        F.col("o_custkey").cast("bigint").alias("MemberId"),
        F.lit(EXPERIENCE).alias("cat"),
        F.lit(None).cast("bigint").alias("k"),
        F.concat(F.col("o_orderpriority"), F.lit(" at "), F.col("o_orderstatus"), F.lit(" - "),
                 F.lit("order "), F.col("o_orderkey").cast("string")).alias("v1"),
        F.lit(None).cast("string").alias("v2"),
    )
    return lines.unionByName(exp)


def members(t: Tables, normalize: bool = True, spread: bool = False) -> DataFrame:
    return member_profiles(
        member_table(t), member_long_form(t), age=age_table(t), city=city_table(t),
        ethnicity=region_dim(t, "EthnicityName"), normalize=normalize, spread=spread,
    )


def copartitioned_members(t: Tables, buckets: int) -> DataFrame:
    """The same rows from bucketed tables written first."""
    member, elements = write_copartitioned(member_table(t), member_long_form(t), buckets)
    return member_profiles(member, elements, age=age_table(t), city=city_table(t), ethnicity=region_dim(t, "EthnicityName"))


def scoring_members(t: Tables, normalize: bool = True, only_ids=None) -> DataFrame:
    """Members with only the columns scoring reads (see
    :func:`..operators.profiles.scoring_profiles`)."""
    m = member_table(t)
    lf = member_long_form(t)
    if only_ids is not None:
        m = m.where(F.col("Id").isin(list(only_ids)))
        lf = lf.where(F.col("MemberId").isin(list(only_ids)))
    return scoring_profiles(m, lf, city=city_table(t), normalize=normalize)


def job_table(t: Tables, only_ids=None) -> DataFrame:
    """``only_ids`` restricts every scan to those parts (a single-job query
    then reads only that part's line items)."""
    li, p = t("lineitem"), t("part")
    if only_ids is not None:
        li = li.where(F.col("l_partkey").isin(list(only_ids)))
        p = p.where(F.col("p_partkey").isin(list(only_ids)))
    dates = li.groupBy("l_partkey").agg(F.min("l_shipdate").alias("PostedDate"),
                                        F.max("l_shipdate").alias("Deadline_for_Applications"))
    title = t("customer").select("c_custkey", F.col("c_mktsegment").alias("JobTitle"))
    n = t("nation").select("n_nationkey", "n_name")
    j = (p.join(dates, p.p_partkey == dates.l_partkey, "left")
         .join(title, p.p_partkey == title.c_custkey, "left")
         .join(n, p.p_partkey % 25 == n.n_nationkey, "left"))
    key = F.col("p_partkey")
    return j.select(
        key.alias("Id"),
        F.concat(F.lit("J-"), key.cast("string")).alias("JobCode"),
        "JobTitle",
        (F.col("p_size") % 6).cast("int").alias("EmploymentTypeId"),
        F.col("n_nationkey").alias("CityId"),
        (F.col("p_size") % 7).cast("int").alias("IndustryId"),
        "PostedDate", "Deadline_for_Applications",
        F.col("p_retailprice").cast("decimal(12,2)").alias("Salary_Range_Start"),
        (F.col("p_retailprice") + F.lit(1000.0)).cast("decimal(12,2)").alias("Salary_Range_End"),
        F.when(key % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" area"))).alias("JobLocation"),
        F.concat(F.lit("Part "), "p_name").alias("Job_Description"),
        F.concat_ws(" - ", "p_brand", "p_type", "p_name").alias("Qualifications"),
        F.concat_ws(",", "p_type", F.replace("p_name", F.lit(" "), F.lit(","))).alias("PreferredSkills"),
        F.concat_ws(",", "p_brand", "p_name").alias("Required_Skills"),
        F.concat(F.lit("deliver "), "p_name").alias("Key_Responsibilities"),
        (F.col("p_size") > 5).alias("IsActive"),
        F.lit(None).cast("timestamp").alias("CreatedDate"),
        F.lit(None).cast("timestamp").alias("ModifiedDate"),
    )


def jobs(t: Tables, normalize: bool = True, only_ids=None) -> DataFrame:
    return job_posts(job_table(t, only_ids), employment_type=region_dim(t, "EmploymentTypeName"), city=city_table(t),
                     industry=region_dim(t, "IndustryName"), normalize=normalize)


# Fields a request carries: what scoring reads plus the display fields.
PAYLOAD_MEMBER_FIELDS = ("MemberId", "MemberFirstName", "MemberLastName", "MemberEmail", "CityName",
                         "Headline", "Industry", "TechnicalSkillNames", "OtherSkills", "Education", "Experience")
PAYLOAD_JOB_FIELDS = ("Id", "JobCode", "JobTitle", "CityName", "JobLocation", "EmploymentTypeName",
                      "PostedDate", "Deadline_for_Applications", "IsActive", "Salary_Range_Start",
                      "Salary_Range_End", "Qualifications", "PreferredSkills", "Required_Skills",
                      "Key_Responsibilities", "Industry", "Role")


#: Requests of one member that are put together in one place.
REQUESTS_TOGETHER = 4096


def payload_json(t: Tables, members_df: DataFrame | None = None, jobs_df: DataFrame | None = None,
                 with_request_id: bool = True) -> DataFrame:
    """Request payloads built from the data: one request per order, with the
    jobs of its line items (in line order) and its customer as the only
    member.  Orders without line items give requests without a ``jobpost``
    key; of orders whose number ends in 11 the payload is cut short, in 12 it
    has no data, in 13 the job list, in 14 the member list is empty; in 15 there
    is no member list, in 16 it is a text, in 17 the salaries are texts.  Columns
    ``order_key`` (unique) and ``payload`` (JSON text).  A request's size is
    bounded by its line count."""
    m = (members_df if members_df is not None else scoring_members(t)).select(*PAYLOAD_MEMBER_FIELDS)
    j = (jobs_df if jobs_df is not None else jobs(t)).select(*PAYLOAD_JOB_FIELDS)
    key = m.schema["MemberId"].dataType
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = (t("orders").where(F.col("o_custkey").isNotNull()).select("o_orderkey", F.col("o_custkey").cast(key).alias("o_custkey"))
         .groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("_n")))
    # a member's requests are put together where the member is: the wide rows
    # of the jobs move once.  A member of many requests has several places.
    many = (o.groupBy("o_custkey").agg((F.floor(F.count("*") / REQUESTS_TOGETHER) + 1).cast("int").alias("_places")).where("_places > 1"))
    place = F.pmod(F.xxhash64("o_orderkey"), F.coalesce("_places", F.lit(1))).cast("int")
    o = o.join(many, "o_custkey", "left").select("o_custkey", place.alias("_place"), "o_orderkey", "_n")
    mem = (m.select(F.col("MemberId").alias("_mid"), F.struct(*[F.col(f"`{c}`") for c in m.columns]).alias("member"))
           .join(many.withColumnRenamed("o_custkey", "_mid"), "_mid", "left")
           .select("_mid", "member", F.explode(F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1)).alias("_at")))
    job = F.struct(*[F.col(f"`{c}`") for c in j.columns])
    lines = (o.join(li, o.o_orderkey == li.l_orderkey).join(j.select(F.col("Id").alias("_jid"), job.alias("job")), F.col("l_partkey") == F.col("_jid"))
             .select("o_custkey", "_place", "o_orderkey", "_n", F.struct("l_linenumber", "job").alias("_job")))
    # every order becomes a request; an order without line items has no
    # "jobpost" key at all (null fields are omitted from the JSON)
    rows = lines.unionByName(o.withColumn("_job", F.lit(None).cast(lines.schema["_job"].dataType))).repartition("o_custkey", "_place")
    per_order = rows.groupBy("o_custkey", "_place", "o_orderkey").agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list("_job")).alias("_jobs"))
    req = per_order.join(mem, (per_order.o_custkey == mem._mid) & (per_order._place == mem._at))
    # an order that stands twice in its table is asked twice
    req = req.select("o_orderkey", "member", F.when(F.size("_jobs") > 0, F.col("_jobs")).alias("_jobs"), F.explode(F.sequence(F.lit(1), F.col("_n"))))
    last = F.col("o_orderkey") % 100
    job_list = F.transform("_jobs", lambda s: s["job"])
    member_list = F.array("member")
    none_j, none_m = F.array().cast(T.ArrayType(j.schema)), F.array().cast(T.ArrayType(m.schema))
    data = F.struct(F.when(last == 13, none_j).otherwise(job_list).alias("jobpost"),
                    F.when(last == 14, none_m).when(last != 15, member_list).alias("member"))
    fields = [F.when(last != 12, data).alias("data")]
    if with_request_id:
        fields.insert(0, F.col("o_orderkey").cast("string").alias("request_id"))
    text = F.to_json(F.struct(*fields))
    no_list = F.to_json(F.struct(*fields[:-1], F.struct(job_list.alias("jobpost"), F.lit("nobody").alias("member")).alias("data")))
    text = F.when(last == 16, no_list).when(last == 17, F.regexp_replace(text, '"(Salary_Range_Start|Salary_Range_End)":[0-9.]+', '"$1":"on request"')).otherwise(text)
    return req.select(F.col("o_orderkey").alias("order_key"),
                      F.when(last == 11, F.substring(text, 1, 40)).otherwise(text).alias("payload"))

