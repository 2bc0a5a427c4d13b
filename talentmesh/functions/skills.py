"""Skill-list matching as Column expressions.

Rule being reproduced, per job fragment ``k`` of ``job.split(',')``
(lower-cased, never trimmed, empties kept):

* ``k`` is a substring of the lower-cased member string -> ``hit`` points;
* else some whitespace token ``t`` of the member string lies inside ``k``
  -> ``fuzzy`` points;
* else 0.  An empty or null job string scores 0.

Everything is built from higher-order SQL functions so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import JOB_SKILL_SEPARATOR, OPTIONAL_POINTS, PY_WHITESPACE, REQUIRED_POINTS

# A Java regex character class equal to Python's str.split() whitespace set.
_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE) + "]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_if_null(c) -> Column:
    """Null policy for every scoring input: null -> ''."""
    return F.coalesce(_col(c), F.lit(""))


def whitespace_tokens(text) -> Column:
    """Python ``str.split()``: split on whitespace, drop empty pieces."""
    return F.filter(F.split(_col(text), _WS_CLASS), lambda t: t != F.lit(""))


def distinct_tokens(text) -> Column:
    """The tokens that occur, each once: all that matching asks for."""
    return F.array_distinct(whitespace_tokens(text))


def job_fragments(job_skills) -> Column:
    """X1+X2: lower-case then split on ',' with no trim; empties are kept."""
    return F.split(F.lower(_col(job_skills)), JOB_SKILL_SEPARATOR, -1)


def skill_points(member_lower, member_tokens, fragments, job_skills, required: bool) -> Column:
    """M0 on pre-computed member-side columns.

    ``member_lower``/``member_tokens`` are columns that were
    computed once per member (see :func:`.once.computed_once`).  ``fragments`` is :func:`job_fragments` of ``job_skills``.
    """
    hit, fuzzy = REQUIRED_POINTS if required else OPTIONAL_POINTS
    m = _col(member_lower)
    toks = _col(member_tokens)

    def per_fragment(acc, k):
        return acc + F.when(F.contains(m, k), F.lit(hit)).when(
            F.exists(toks, lambda t: F.contains(k, t)), F.lit(fuzzy)
        ).otherwise(F.lit(0))

    total = F.aggregate(_col(fragments), F.lit(0), per_fragment)
    js = _col(job_skills)
    return F.when(js.isNull() | (js == F.lit("")), F.lit(0)).otherwise(total)


def skill_points_inside(member_lower, member_tokens, fragments, job_skills, required: bool) -> Column:
    """M0 on fragments that carry the known tokens inside them, as (k, inside)
    (see :mod:`..operators.vocabulary`): a lookup takes the place of testing
    each token against each fragment."""
    hit, fuzzy = REQUIRED_POINTS if required else OPTIONAL_POINTS
    m, toks = _col(member_lower), _col(member_tokens)

    def per_fragment(acc, f):
        return acc + F.when(F.contains(m, f["k"]), F.lit(hit)).when(F.arrays_overlap(toks, f["inside"]), F.lit(fuzzy)).otherwise(F.lit(0))

    total = F.aggregate(_col(fragments), F.lit(0), per_fragment)
    return F.when(_col(job_skills) == F.lit(""), F.lit(0)).otherwise(total)


def match_skills(member_skills, job_skills, required: bool = False) -> Column:
    """M0 in one call, for ad-hoc use on any two string columns."""
    m = F.lower(blank_if_null(member_skills))
    js = blank_if_null(job_skills)
    return skill_points(m, whitespace_tokens(m), job_fragments(js), js, required)
