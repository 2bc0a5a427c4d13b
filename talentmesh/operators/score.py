"""Pair scoring (M1-M9) with lossless score-bound pruning.

Member-side and job-side inputs are prepared once per member and once per
job (lower-casing, tokenising, fragment splitting, vectors); the per-pair
work is then pure column arithmetic.  Column naming convention:

* member side: ``m_<field>`` (see :data:`MEMBER_FIELDS`)
* job side:    ``j_<field>`` (see :data:`JOB_FIELDS`)

A pair frame may hold the job side as top-level ``j_*`` columns or as one
struct column ``j`` (e.g. a scalar subquery); :class:`Side` hides which.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCORE_CAP, MatchOptions
from ..functions import scoring as S
from ..functions.matching import industry_grade, location_grade, role_grade
from ..functions.once import computed_once
from ..functions.skills import blank_if_null, distinct_tokens, job_fragments, skill_points, skill_points_inside
from ..functions.vectors import cosine, norm
from .vocabulary import attach_inside
from .vocabulary import distinct_tokens as vocabulary_tokens


@dataclass(frozen=True)
class Side:
    """Accessor for one side's prepared fields: ``prefix_<name>`` columns."""

    prefix: str

    def __call__(self, name: str) -> Column:
        return F.col(f"{self.prefix}_{name}")


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def member_fields(df: DataFrame) -> dict[str, Column]:
    """Prepared member-side inputs from a member row (null -> '')."""
    ts = F.lower(blank_if_null(_opt(df, "TechnicalSkillNames")))
    os_ = F.lower(blank_if_null(_opt(df, "OtherSkills")))
    return {
        "ts_lc": ts,
        "os_lc": os_,
        "ind_lc": F.lower(blank_if_null(_opt(df, "Industry"))),
        "head_lc": F.lower(blank_if_null(_opt(df, "Headline"))),
        "city_lc": F.lower(blank_if_null(_opt(df, "CityName"))),
        "edu": blank_if_null(_opt(df, "Education")),
        "exp": blank_if_null(_opt(df, "Experience")),
    }


def prepare_members(df: DataFrame, prefix: str = "m") -> DataFrame:
    """Adds ``m_*`` inputs; tokens are derived from the lower-cased text once."""
    out = computed_once(df, {f"{prefix}_{n}": c for n, c in member_fields(df).items()})
    return computed_once(out, {
        f"{prefix}_ts_tok": distinct_tokens(F.col(f"{prefix}_ts_lc")),
        f"{prefix}_os_tok": distinct_tokens(F.col(f"{prefix}_os_lc")),
    })


def job_fields(df: DataFrame) -> dict[str, Column]:
    req = blank_if_null(_opt(df, "Required_Skills"))
    pref = blank_if_null(_opt(df, "PreferredSkills"))
    fused = F.concat(req, pref)  # M3: no separator between the two lists
    return {
        "req": req, "req_frag": job_fragments(req),
        "pref": pref, "pref_frag": job_fragments(pref),
        "fused": fused, "fused_frag": job_fragments(fused),
        "ind_lc": F.lower(blank_if_null(_opt(df, "Industry"))),
        "role_lc": F.lower(blank_if_null(_opt(df, "Role"))),
        "loc_lc": F.lower(blank_if_null(_opt(df, "JobLocation"))),
        "qual": blank_if_null(_opt(df, "Qualifications")),
        "resp": blank_if_null(_opt(df, "Key_Responsibilities")),
    }


def prepare_jobs(df: DataFrame, prefix: str = "j") -> DataFrame:
    return computed_once(df, {f"{prefix}_{n}": c for n, c in job_fields(df).items()})


def attach_member_vectors(df: DataFrame, embedder, prefix: str = "m") -> DataFrame:
    return _with_vectors(df, embedder, f"{prefix}_edu", f"{prefix}_exp")


def attach_job_vectors(df: DataFrame, embedder, prefix: str = "j") -> DataFrame:
    return _with_vectors(df, embedder, f"{prefix}_qual", f"{prefix}_resp")


def _with_vectors(df: DataFrame, embedder, *names: str) -> DataFrame:
    """Both texts in one pass where the provider can do that."""
    if hasattr(embedder, "attach_all"):
        df = embedder.attach_all(df, {f"{n}_vec": n for n in names})
    else:
        for n in names:
            df = embedder.attach(df, n, f"{n}_vec")
    return _with_norms(df, *names)


def _with_norms(df: DataFrame, *names: str) -> DataFrame:
    """Lengths of the vectors: once a member or job, not once a pair."""
    return df.withColumns({f"{n}_norm": norm(f"{n}_vec") for n in names})


FRAGMENT_LISTS = ("req_frag", "pref_frag", "fused_frag")


def attach_vocabulary(jobs: DataFrame, members: DataFrame, key: str = "Id", m: str = "m", j: str = "j") -> DataFrame:
    """Prepared ``jobs`` whose fragments carry the tokens of the prepared
    ``members`` that lie inside them: matched once for each distinct fragment
    and token, before any pairing."""
    return attach_inside(jobs, vocabulary_tokens(members, [f"{m}_ts_tok", f"{m}_os_tok"]), [f"{j}_{c}" for c in FRAGMENT_LISTS], key)


def cheap_components(m: Side, j: Side, vocabulary: bool = False) -> dict[str, Column]:
    """Everything except the two cosines (M1-M3, M6-M8)."""
    points, frag = (skill_points_inside, "{}_frag_in") if vocabulary else (skill_points, "{}_frag")
    return {
        "required_skills": points(m("ts_lc"), m("ts_tok"), j(frag.format("req")), j("req"), True),
        "preferred_skills": points(m("ts_lc"), m("ts_tok"), j(frag.format("pref")), j("pref"), False),
        "other_skills": points(m("os_lc"), m("os_tok"), j(frag.format("fused")), j("fused"), False),
        "industry": industry_grade(m("ind_lc"), j("ind_lc")),
        "role": role_grade(m("head_lc"), j("role_lc")),
        "location": location_grade(m("city_lc"), j("loc_lc")),
    }


def vector_components(m: Side, j: Side) -> dict[str, Column]:
    return {
        "qualifications": cosine(m("edu_vec"), j("qual_vec"), m("edu_norm"), j("qual_norm")),
        "responsibilities": cosine(m("exp_vec"), j("resp_vec"), m("exp_norm"), j("resp_norm")),
    }


def _c(name: str) -> str:
    """Internal component column name (avoids case-insensitive clashes such
    as ``required_skills`` vs a job's ``Required_Skills``)."""
    return f"_s_{name}"


CHEAP = ("required_skills", "preferred_skills", "other_skills", "industry", "role", "location")


def score_cheap(df: DataFrame, m: Side, j: Side, opts: MatchOptions) -> DataFrame:
    """Adds the cheap components and ``_cheap`` (their weighted part), and
    drops pairs that cannot reach the threshold whatever the cosines are."""
    comps = cheap_components(m, j, vocabulary=f"{j.prefix}_req_frag_in" in df.columns)
    df = computed_once(df, {_c(n): c for n, c in comps.items()})
    df = df.withColumn("_cheap", S.cheap_part({n: F.col(_c(n)) for n in CHEAP}, opts.weights))
    if opts.prune and opts.threshold is not None and S.pruning_enabled(opts.weights):
        df = df.where(~S.cannot_reach(F.col("_cheap"), opts.weights, opts.threshold))
    return df


def score_full(df: DataFrame, m: Side, j: Side, opts: MatchOptions, keep_components: bool = True) -> DataFrame:
    """Adds the cosine components and ``Similarity`` (capped, 2-dp).

    With pruning on, pairs whose score is certainly capped skip the cosine
    work (their cosine columns are NULL and Similarity is the cap)."""
    vec = vector_components(m, j)
    skip = (S.surely_capped(F.col("_cheap"), opts.weights)
            if opts.prune and S.pruning_enabled(opts.weights) else F.lit(False))
    df = df.withColumn("_skip", skip)
    df = computed_once(df, {_c(n): F.when(~F.col("_skip"), c) for n, c in vec.items()})
    comps = {n: F.col(_c(n)) for n in S.COMPONENTS}
    sim = F.when(F.col("_skip"), F.lit(SCORE_CAP)).otherwise(S.final_score(comps, opts.weights))
    df = df.withColumn("Similarity", sim)
    if opts.threshold is not None:
        df = df.where(F.col("Similarity") >= F.lit(float(opts.threshold)))
    df = df.drop("_skip", "_cheap")
    if not keep_components:
        return df.drop(*[_c(n) for n in S.COMPONENTS])
    for n in S.COMPONENTS:
        df = df.withColumnRenamed(_c(n), n)
    return df


# Raw texts are only needed to compute vectors; they are not carried further.
VECTOR_SOURCES = ("edu", "exp", "qual", "resp")


def packed_fields(df: DataFrame, prefix: str, key: str) -> list[Column]:
    """The ``prefix_*`` columns without raw texts, and the key as
    ``prefix__id``: flat, as nested fields behind a generator and a join are
    not pruned safely by the optimizer."""
    n = len(prefix) + 1
    return [F.col(c) for c in df.columns if c.startswith(prefix + "_") and c[n:] not in VECTOR_SOURCES] + [F.col(key).alias(f"{prefix}__id")]
