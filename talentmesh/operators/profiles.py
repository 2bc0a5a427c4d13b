"""Wide member and job rows.

Member rows gather up to 13 delimited lists per member (ten skill
categories, education, experience, other skills).  Instead of 13 separate
``GROUP BY MemberId`` subqueries each joined back to the member table, all
list elements are brought into one long-form frame

    (MemberId, cat, k, v1, v2)

and aggregated in a single shuffle with per-category ``FILTER`` clauses.
Each list is ordered (by ``k`` then value) so that output, and the scores
computed from it, are deterministic; names and descriptions of a category
share the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..config import (
    CATEGORIES,
    EDUCATION_SEP,
    EXPERIENCE_AT,
    JOB_COLUMNS,
    LIST_DELIMITER,
    OTHER_SKILLS_DELIMITER,
    UNKNOWN,
)
from ..functions.normalize import normalize_row_values
from .ordered import in_runs


EDUCATION, EXPERIENCE, OTHER_SKILLS = "Education", "Experience", "OtherSkills"


def _long(member_id: Column, cat: str | Column, k: Column | None, v1: Column, v2: Column | None) -> list:
    return [
        member_id.cast("bigint").alias("MemberId"),
        (F.lit(cat) if isinstance(cat, str) else cat).alias("cat"),
        (k if k is not None else F.lit(None)).cast("bigint").alias("k"),
        v1.cast("string").alias("v1"),
        (v2 if v2 is not None else F.lit(None)).cast("string").alias("v2"),
    ]


def bridge_long_form(bridge: DataFrame, dim: DataFrame, category: str, fk: str,
                     name_col: str, desc_col: str) -> DataFrame:
    """Bridge inner-joined to its dimension, as long-form rows.

    Bridge rows whose dimension row is missing are dropped (inner join);
    dimension rows with a null name stay and are skipped by the aggregate."""
    d = _checked(dim, {name_col: "_name", desc_col: "_desc"}, category).withColumnRenamed("Id", "_did")
    j = bridge.join(d, bridge[fk] == d["_did"], "inner")
    return j.select(*_long(F.col("MemberId"), category, F.col(fk), F.col("_name"), F.col("_desc")))


def education_long_form(edu: DataFrame) -> DataFrame:
    """G3 element: degree + ' - ' + field + ' - ' + description (null if any part is)."""
    v = F.concat(F.col("EducationDegree"), F.lit(EDUCATION_SEP), F.col("EducationFieldStudy"),
                 F.lit(EDUCATION_SEP), F.col("EducationDescription"))
    return edu.select(*_long(F.col("MemberId"), EDUCATION, None, v, None))


def experience_long_form(exp: DataFrame) -> DataFrame:
    """G4 element: title + ' at ' + company + ' - ' + description."""
    v = F.concat(F.col("ExperienceJobTitle"), F.lit(EXPERIENCE_AT), F.col("ExperienceCompany"),
                 F.lit(EDUCATION_SEP), F.col("ExperienceDescription"))
    return exp.select(*_long(F.col("MemberId"), EXPERIENCE, None, v, None))


def other_skills_long_form(other: DataFrame) -> DataFrame:
    """G5 element."""
    return other.select(*_long(F.col("MemberId"), OTHER_SKILLS, None, F.col("OtherSkillName"), None))


CHILD_LISTS = (
    (EDUCATION, LIST_DELIMITER, "EducationInfo"),
    (EXPERIENCE, LIST_DELIMITER, "ExperienceInfo"),
    (OTHER_SKILLS, OTHER_SKILLS_DELIMITER, "OtherSkillNames"),
)


def aggregate_lists(long_form: DataFrame, categories=CATEGORIES, children=CHILD_LISTS, spread: bool = False) -> DataFrame:
    """One row per member with every list column.

    With ``spread``, for whole tables, elements are sorted as rows by range
    and joined where they lie (see :mod:`.ordered`), so that a member with any
    share of the rows is spread over the partitions they fill.  Without it, for
    few members (a filter on the member then reaches the scans), elements are gathered and sorted per (member, category) - so a member
    with many rows is spread over as many tasks as there are lists, and a
    buffer holds one list, not all - joined to their strings there, and only
    the strings meet per member.  Nulls are skipped; a member whose elements
    are all null gets NULL (the caller turns it into 'Unknown').  No
    DISTINCT: duplicates stay."""
    others = [cat for cat, delim, _ in children if delim != LIST_DELIMITER]
    wanted = [(cat, "v1", n) for cat, *_r, n, _ in categories] + [(cat, "v2", d) for cat, *_r, d in categories]
    wanted += [(cat, "v1", out) for cat, _, out in children]
    order = [c for cat in categories for c in cat[-2:]] + [c[2] for c in children]
    if spread:
        return _spread_lists(long_form, wanted, others).select("MemberId", *order)
    per = long_form.groupBy("MemberId", "cat").agg(F.array_sort(F.collect_list(F.struct("k", "v1", "v2"))).alias("_e"))

    def text(field):
        vals = F.filter(F.transform("_e", lambda e: e[field]), lambda v: v.isNotNull())
        text = F.when(F.col("cat").isin(others), F.array_join(vals, OTHER_SKILLS_DELIMITER)).otherwise(F.array_join(vals, LIST_DELIMITER))
        return F.when(F.size(vals) > 0, text)

    per = per.select("MemberId", "cat", text("v1").alias("v1"), text("v2").alias("v2"))
    # one string for each member and category, so a maximum picks it
    aggs = [F.max(F.when(F.col("cat") == cat, F.col(v))).alias(out) for cat, v, out in wanted]
    return per.groupBy("MemberId").agg(*aggs).select("MemberId", *order)


def _spread_lists(long_form: DataFrame, wanted: list, others: list[str]) -> DataFrame:
    """A member's runs of all lists meet in one aggregate; each output picks
    and joins its own."""
    delimiter = F.when(F.col("cat").isin(others), OTHER_SKILLS_DELIMITER).otherwise(LIST_DELIMITER)
    runs = in_runs(long_form, ["MemberId", "cat"], ["k", "v1", "v2"], ["v1", "v2"], delimiter)
    per = runs.groupBy("MemberId").agg(F.array_sort(F.collect_list(F.struct("run", "cat", "v1", "v2"))).alias("_e"))

    def text(cat, field):
        vals = F.transform(F.filter("_e", lambda e: (e["cat"] == cat) & e[field].isNotNull()), lambda e: e[field])
        return F.when(F.size(vals) > 0, F.array_join(vals, OTHER_SKILLS_DELIMITER if cat in others else LIST_DELIMITER))

    return per.select("MemberId", *[text(cat, v).alias(out) for cat, v, out in wanted])


def _checked(dim: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    """A dimension (Id and the renamed ``columns``), one row an id.  A
    repeated id would repeat its members: it is refused inside the same job,
    when the row is looked up, without a pass of its own."""
    again = F.raise_error(F.concat(F.lit(f"{what}: id "), F.col("Id").cast("string"), F.lit(" occurs more than once")))
    one = dim.groupBy("Id").agg(F.count("*").alias("_n"), *[F.first(c).alias(a) for c, a in columns.items()])
    checked = F.when(F.col("_n") > 1, again.cast(dim.schema["Id"].dataType)).otherwise(F.col("Id"))
    return one.where("Id IS NOT NULL").withColumn("Id", checked).drop("_n")


def _lookup(df: DataFrame, dim: DataFrame | None, fk: str, name_col: str, alias: str) -> DataFrame:
    """Left lookup of one name column by id (absent table -> nulls)."""
    if dim is None:
        return df.withColumn(alias, F.lit(None).cast("string"))
    d = _checked(dim, {name_col: alias}, name_col).withColumnRenamed("Id", f"_{alias}_id")
    return df.join(d, df[fk] == d[f"_{alias}_id"], "left").drop(f"_{alias}_id")


def member_profiles(member: DataFrame, long_form: DataFrame | None, age: DataFrame | None = None,
                    city: DataFrame | None = None, ethnicity: DataFrame | None = None,
                    categories=CATEGORIES, normalize: bool = True, extra: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """S3: one 38-column row per member (and ``extra`` columns of ``member``).
    ``spread``: see :func:`aggregate_lists`.

    ``long_form`` is the union of :func:`bridge_long_form`,
    :func:`education_long_form`, :func:`experience_long_form` and
    :func:`other_skills_long_form` outputs (any subset)."""
    m = member.select(
        F.col("Id").alias("MemberId"), "MemberFirstName", "MemberLastName", "MemberEmail",
        "IsActive", "CreatedDate", "ModifiedDate", "MemberEthnicityId", "MemberGenderId",
        "Age_Id", "CityId", "Headline", *extra,
    )
    m = _lookup(m, age, "Age_Id", "AgeName", "AgeName")
    m = _lookup(m, city, "CityId", "CityName", "CityName")
    m = _lookup(m, ethnicity, "MemberEthnicityId", "EthnicityName", "EthnicityName")
    list_cols = [c for cat in categories for c in cat[-2:]] + [
        "EducationInfo", "ExperienceInfo", "OtherSkillNames"]
    if long_form is not None:
        wanted = [c[0] for c in categories] + [c[0] for c in CHILD_LISTS]
        if len(categories) < len(CATEGORIES):   # drop elements no output needs
            long_form = long_form.where(F.col("cat").isin(wanted))
        m = m.join(aggregate_lists(long_form, categories, spread=spread), "MemberId", "left")
    else:
        for c in list_cols:
            m = m.withColumn(c, F.lit(None).cast("string"))
    out = m.select(
        "MemberId", "MemberFirstName", "MemberLastName", "MemberEmail", "IsActive",
        "CreatedDate", "ModifiedDate", "MemberEthnicityId", "MemberGenderId", "Age_Id",
        "AgeName", "CityId", "CityName", "EthnicityName", "Headline",
        *[F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for cat in categories for c in cat[-2:]],
        F.coalesce(F.col("EducationInfo"), F.lit(UNKNOWN)).alias("Education"),
        F.coalesce(F.col("ExperienceInfo"), F.lit(UNKNOWN)).alias("Experience"),
        F.coalesce(F.col("OtherSkillNames"), F.lit(UNKNOWN)).alias("OtherSkills"),
        *extra,
    )
    return normalize_row_values(out) if normalize else out


SCORING_CATEGORIES = tuple(c for c in CATEGORIES if c[0] == "TechnicalSkills")


def scoring_profiles(member: DataFrame, long_form: DataFrame | None, city: DataFrame | None = None,
                     normalize: bool = True) -> DataFrame:
    """Member rows restricted to what scoring and the ranking output read
    (skills, other skills, education, experience, headline, city, display
    fields): the other nine categories are never gathered."""
    extra = tuple(c for c in ("Industry",) if c in member.columns)
    prof = member_profiles(member, long_form, age=None, city=city, ethnicity=None,
                           categories=SCORING_CATEGORIES, normalize=normalize, extra=extra)
    return prof.select("MemberId", "MemberFirstName", "MemberLastName", "MemberEmail", "CityName",
                       "Headline", *extra, "TechnicalSkillNames", "OtherSkills", "Education", "Experience")


def job_posts(jobpost: DataFrame, employment_type: DataFrame | None = None,
              city: DataFrame | None = None, industry: DataFrame | None = None,
              normalize: bool = True) -> DataFrame:
    """One 22-column row per job (S1 is this plus ``where(Id == x)``;
    the filter is pushed to the scan)."""
    j = jobpost
    j = _lookup(j, employment_type, "EmploymentTypeId", "EmploymentTypeName", "_et")
    j = _lookup(j, city, "CityId", "CityName", "_city")
    j = _lookup(j, industry, "IndustryId", "IndustryName", "_ind")
    out = j.select(
        "Id", "JobCode", "JobTitle", "EmploymentTypeId",
        F.coalesce(F.col("_et"), F.lit(UNKNOWN)).alias("EmploymentTypeName"),
        "CityId",
        F.coalesce(F.col("_city"), F.lit(UNKNOWN)).alias("CityName"),
        "PostedDate", "Deadline_for_Applications", "Salary_Range_Start", "Salary_Range_End",
        "JobLocation", F.col("Job_Description").alias("Description"), "Qualifications",
        "PreferredSkills", "Required_Skills", "Key_Responsibilities",
        F.coalesce(F.col("_ind"), F.lit(UNKNOWN)).alias("Industry"),
        F.col("JobTitle").alias("Role"), "IsActive", "CreatedDate", "ModifiedDate",
    )
    assert tuple(out.columns) == JOB_COLUMNS
    return normalize_row_values(out) if normalize else out


def job_by_id(jobs: DataFrame, job_id) -> DataFrame:
    """S1/F1."""
    return jobs.where(F.col("Id") == F.lit(job_id))


def member_by_id(members: DataFrame, member_id) -> DataFrame:
    """The filter is inferred through the joins and aggregate down to
    every bridge scan."""
    return members.where(F.col("MemberId") == F.lit(member_id))



