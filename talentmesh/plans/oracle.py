"""DuckDB SQL twins of the stand-in plans, used as the correctness oracle.

The SQL is written independently of the Spark code path; only the fixed
values (category names, delimiters, weights, alphabet) are shared.
"""

from __future__ import annotations

from ..config import CATEGORIES, COMPONENTS, DEFAULT_WEIGHTS, MATCH_THRESHOLD
from ..functions.vectors import PROFILE_ALPHABET

# RE2 class equal to Python's str.split() whitespace set.
WS = ("[\\t\\n\\x{0b}\\x{0c}\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
      "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")


def _agg(value: str, delim: str, cat: str) -> str:
    return (f"string_agg({value}, '{delim}' ORDER BY k NULLS FIRST, v1 NULLS FIRST, v2 NULLS FIRST) "
            f"FILTER (WHERE cat = '{cat}')")


def member_ctes() -> str:
    aggs = []
    for cat, *_r, out_n, out_d in CATEGORIES:
        aggs.append(f"{_agg('v1', '; ', cat)} AS {out_n}")
        aggs.append(f"{_agg('v2', '; ', cat)} AS {out_d}")
    aggs += [f"{_agg('v1', '; ', 'Education')} AS EducationInfo",
             f"{_agg('v1', '; ', 'Experience')} AS ExperienceInfo",
             f"{_agg('v1', ', ', 'OtherSkills')} AS OtherSkillNames"]
    cat_cols = ",\n  ".join(
        f"coalesce(a.{c}, 'Unknown') AS {c}" for cat in CATEGORIES for c in cat[-2:])
    return f"""
mt AS (
  SELECT c.c_custkey AS Id, c.c_name AS MemberFirstName, c.c_mktsegment AS MemberLastName,
         lower(c.c_name) || '@example.org' AS MemberEmail, c.c_acctbal >= 0 AS IsActive,
         CAST(NULL AS VARCHAR) AS CreatedDate, CAST(NULL AS VARCHAR) AS ModifiedDate,
         n.n_regionkey AS MemberEthnicityId, CAST(NULL AS INTEGER) AS MemberGenderId,
         CAST(c.c_custkey % 30 AS INTEGER) AS Age_Id, c.c_nationkey AS CityId,
         CASE WHEN c.c_custkey % 3 = 0 THEN concat_ws(' ', c.c_mktsegment, n.n_name) ELSE c.c_mktsegment END AS Headline,
         CASE WHEN c.c_custkey % 2 = 1 THEN r.r_name END AS Industry
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
lines AS (
  SELECT o.o_custkey AS MemberId, l.l_partkey, l.l_returnflag AS flag, p.p_name, p.p_brand, p.p_type, p.p_size
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
lf AS (
  SELECT MemberId,
         CASE p_size % 10 {" ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(CATEGORIES))} END AS cat,
         CAST(l_partkey AS BIGINT) AS k, p_name AS v1, p_type AS v2
  FROM lines
  UNION ALL
  SELECT MemberId, 'Education', NULL, p_brand || ' - ' || nullif(p_type, 'PROMO') || ' - ' || p_name, NULL FROM lines
  UNION ALL
  SELECT MemberId, 'OtherSkills', NULL, p_brand, NULL FROM lines WHERE flag = 'A' AND p_size % 2 = 1
  UNION ALL
  SELECT o_custkey, 'Experience', NULL,
         o_orderpriority || ' at ' || o_orderstatus || ' - ' || 'order ' || CAST(o_orderkey AS VARCHAR), NULL
  FROM orders),
agg AS (
  SELECT MemberId,
  {(",\n  ").join(aggs)}
  FROM lf GROUP BY MemberId),
members AS (
  SELECT mt.Id AS MemberId, mt.MemberFirstName, mt.MemberLastName, mt.MemberEmail, mt.IsActive,
         mt.CreatedDate, mt.ModifiedDate, mt.MemberEthnicityId, mt.MemberGenderId, mt.Age_Id,
         'age ' || age.n_name AS AgeName, mt.CityId, city.n_name AS CityName,
         eth.r_name AS EthnicityName, mt.Headline,
  {cat_cols},
  coalesce(a.EducationInfo, 'Unknown') AS Education,
  coalesce(a.ExperienceInfo, 'Unknown') AS Experience,
  coalesce(a.OtherSkillNames, 'Unknown') AS OtherSkills
  FROM mt
  LEFT JOIN nation city ON mt.CityId = city.n_nationkey
  LEFT JOIN nation age ON mt.Age_Id = age.n_nationkey
  LEFT JOIN region eth ON mt.MemberEthnicityId = eth.r_regionkey
  LEFT JOIN agg a ON mt.Id = a.MemberId)"""


def job_ctes() -> str:
    return """
dates AS (
  SELECT l_partkey, min(l_shipdate) AS PostedDate, max(l_shipdate) AS Deadline_for_Applications
  FROM lineitem GROUP BY l_partkey),
jobs AS (
  SELECT p.p_partkey AS Id, 'J-' || CAST(p.p_partkey AS VARCHAR) AS JobCode, c.c_mktsegment AS JobTitle,
         CAST(p.p_size % 6 AS INTEGER) AS EmploymentTypeId, coalesce(et.r_name, 'Unknown') AS EmploymentTypeName,
         n.n_nationkey AS CityId, coalesce(n.n_name, 'Unknown') AS CityName,
         strftime(d.PostedDate, '%Y-%m-%d %H:%M:%S') AS PostedDate,
         strftime(d.Deadline_for_Applications, '%Y-%m-%d %H:%M:%S') AS Deadline_for_Applications,
         CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS Salary_Range_Start,
         CAST(CAST(p.p_retailprice + 1000.0 AS DECIMAL(12,2)) AS DOUBLE) AS Salary_Range_End,
         CASE WHEN p.p_partkey % 2 = 0 THEN n.n_name ELSE n.n_name || ' area' END AS JobLocation,
         'Part ' || p.p_name AS Description,
         concat_ws(' - ', p.p_brand, p.p_type, p.p_name) AS Qualifications,
         concat_ws(',', p.p_type, replace(p.p_name, ' ', ',')) AS PreferredSkills,
         concat_ws(',', p.p_brand, p.p_name) AS Required_Skills, 'deliver ' || p.p_name AS Key_Responsibilities,
         coalesce(ind.r_name, 'Unknown') AS Industry, c.c_mktsegment AS Role,
         p.p_size > 5 AS IsActive, CAST(NULL AS VARCHAR) AS CreatedDate, CAST(NULL AS VARCHAR) AS ModifiedDate
  FROM part p
  LEFT JOIN dates d ON p.p_partkey = d.l_partkey
  LEFT JOIN customer c ON p.p_partkey = c.c_custkey
  LEFT JOIN nation n ON p.p_partkey % 25 = n.n_nationkey
  LEFT JOIN region et ON p.p_size % 6 = et.r_regionkey
  LEFT JOIN region ind ON p.p_size % 7 = ind.r_regionkey)"""


# ---- scoring expressions ---------------------------------------------------

def tokens(lc: str) -> str:
    return f"list_filter(regexp_split_to_array({lc}, '{WS}'), lambda x: x <> '')"


def skill_points(m_lc: str, m_tok: str, job_raw: str, required: bool) -> str:
    hit, fuzzy = (3, 2) if required else (1, 1)
    frag = f"string_split(lower({job_raw}), ',')"
    per = (f"CASE WHEN contains({m_lc}, k) THEN {hit} "
           f"WHEN len(list_filter({m_tok}, lambda t: contains(k, t))) > 0 THEN {fuzzy} ELSE 0 END")
    return (f"CAST(CASE WHEN {job_raw} = '' THEN 0 ELSE "
            f"coalesce(list_sum(list_transform({frag}, lambda k: {per})), 0) END AS INTEGER)")


def graded(a: str, b: str, inner: str, outer: str, points) -> str:
    eq, within, none = points
    return f"CASE WHEN {a} = {b} THEN {eq} WHEN contains({outer}, {inner}) THEN {within} ELSE {none} END"


def char_profile(text: str) -> str:
    letters = ", ".join(f"'{c}'" for c in PROFILE_ALPHABET)
    t = f"lower(coalesce({text}, ''))"
    return f"list_transform([{letters}], lambda c: CAST(length({t}) - length(replace({t}, c, '')) AS DOUBLE))"


def cosine(a: str, b: str) -> str:
    den = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {den} END"


def total(cols: dict) -> str:
    terms = [f"CAST({cols[n]} AS DOUBLE) * CAST({DEFAULT_WEIGHTS[n]!r} AS DOUBLE)" for n in COMPONENTS]
    s = terms[0]
    for t in terms[1:]:
        s = f"({s} + {t})"
    return f"({s} * 100.0::DOUBLE)"


def display(x: str) -> str:
    return f"CAST(format('{{:.2f}}', least({x}, 100.0::DOUBLE)) AS DOUBLE)"


def pair_prep() -> str:
    """CTEs ``mp`` / ``jp``: prepared member and job inputs (null -> '')."""
    return f"""
mp AS (
  SELECT MemberId, MemberFirstName, MemberLastName, MemberEmail, CityName,
         lower(coalesce(TechnicalSkillNames, '')) AS ts_lc,
         lower(coalesce(OtherSkills, '')) AS os_lc,
         lower(coalesce(Industry, '')) AS ind_lc, lower(coalesce(Headline, '')) AS head_lc, lower(coalesce(CityName, '')) AS city_lc,
         {char_profile('Education')} AS edu_vec, {char_profile('Experience')} AS exp_vec
  FROM (SELECT members.*, mt.Industry FROM members JOIN mt ON members.MemberId = mt.Id)),
mp2 AS (SELECT *, {tokens('ts_lc')} AS ts_tok, {tokens('os_lc')} AS os_tok FROM mp),
jp AS (
  SELECT Id, JobTitle, coalesce(Required_Skills, '') AS req, coalesce(PreferredSkills, '') AS pref,
         coalesce(Required_Skills, '') || coalesce(PreferredSkills, '') AS fused,
         lower(coalesce(Industry, '')) AS ind_lc, lower(coalesce(Role, '')) AS role_lc,
         lower(coalesce(JobLocation, '')) AS loc_lc,
         {char_profile('Qualifications')} AS qual_vec, {char_profile('Key_Responsibilities')} AS resp_vec
  FROM jobs)"""


def component_exprs(m: str = "m", j: str = "j") -> dict:
    return {
        "required_skills": skill_points(f"{m}.ts_lc", f"{m}.ts_tok", f"{j}.req", True),
        "preferred_skills": skill_points(f"{m}.ts_lc", f"{m}.ts_tok", f"{j}.pref", False),
        "other_skills": skill_points(f"{m}.os_lc", f"{m}.os_tok", f"{j}.fused", False),
        "qualifications": cosine(f"{m}.edu_vec", f"{j}.qual_vec"),
        "responsibilities": cosine(f"{m}.exp_vec", f"{j}.resp_vec"),
        "industry": graded(f"{m}.ind_lc", f"{j}.ind_lc", f"{m}.ind_lc", f"{j}.ind_lc", (3, 2, 0)),
        "role": graded(f"{m}.head_lc", f"{j}.role_lc", f"{j}.role_lc", f"{m}.head_lc", (3, 2, 0)),
        "location": graded(f"{m}.city_lc", f"{j}.loc_lc", f"{m}.city_lc", f"{j}.loc_lc", (2, 1, 0)),
    }


def scored_pairs_cte(pairs_from: str, m: str = "m", j: str = "j") -> str:
    """CTE ``sc``: all components and Similarity over ``pairs_from`` (a FROM
    clause exposing aliases ``m`` and ``j``)."""
    comps = component_exprs(m, j)
    cols = ",\n         ".join(f"{e} AS {n}" for n, e in comps.items())
    return f"""
sc0 AS (
  SELECT {m}.MemberId, {j}.Id AS JobId, {m}.MemberFirstName, {m}.MemberLastName, {m}.MemberEmail,
         {m}.CityName AS City,
         {cols}
  FROM {pairs_from}),
sc AS (SELECT *, {display(total({n: n for n in COMPONENTS}))} AS Similarity FROM sc0)"""


THRESHOLD = MATCH_THRESHOLD
