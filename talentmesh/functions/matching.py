"""Categorical matches M6-M8 (lower-cased equality, then containment)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import INDUSTRY_POINTS, LOCATION_POINTS, ROLE_POINTS
from .skills import _col, blank_if_null


def graded(a, b, inner, outer, points) -> Column:
    """``points[0]`` if a == b, ``points[1]`` if ``inner`` lies in ``outer``,
    else ``points[2]``; inputs are already lower-cased and null-free."""
    eq, within, none = points
    return (F.when(_col(a) == _col(b), F.lit(eq))
            .when(F.contains(_col(outer), _col(inner)), F.lit(within))
            .otherwise(F.lit(none)))


def _lc(c) -> Column:
    return F.lower(blank_if_null(c))


def industry_grade(member_lc, job_lc) -> Column:
    """M6 on lower-cased inputs: equal 3; member inside job 2; else 0."""
    return graded(member_lc, job_lc, member_lc, job_lc, INDUSTRY_POINTS)


def role_grade(headline_lc, role_lc) -> Column:
    """M7: equal 3; job role inside member headline 2; else 0."""
    return graded(headline_lc, role_lc, role_lc, headline_lc, ROLE_POINTS)


def location_grade(city_lc, location_lc) -> Column:
    """M8: equal 2; member city inside job location 1; else 0."""
    return graded(city_lc, location_lc, city_lc, location_lc, LOCATION_POINTS)


def industry_points(member_industry, job_industry) -> Column:
    return industry_grade(_lc(member_industry), _lc(job_industry))


def role_points(member_headline, job_role) -> Column:
    return role_grade(_lc(member_headline), _lc(job_role))


def location_points(member_city, job_location) -> Column:
    return location_grade(_lc(member_city), _lc(job_location))
