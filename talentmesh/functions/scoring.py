"""Score arithmetic: weighted total (M9), cap (X7), 2-dp rounding (X8),
lossless pruning bounds, and the optional linear rescale (D1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMPONENTS, SCORE_CAP, SCORE_DECIMALS
from .skills import _col

VECTOR_COMPONENTS = ("qualifications", "responsibilities")
# Largest absolute value a vector component can take (cosine in [-1, 1]).
_VECTOR_BOUND = 1.0
# Slack for rounding to 2 dp (half a unit) plus float noise.
_MARGIN = 0.01


def weighted_total(components: dict, weights: dict) -> Column:
    """M9 before capping: sum(score * weight) * 100, summed in the fixed
    component order so the double rounding matches a left-to-right sum."""
    total = None
    for name in COMPONENTS:
        term = _col(components[name]).cast("double") * F.lit(float(weights[name]))
        total = term if total is None else total + term
    return total * F.lit(100.0)


def cap(x) -> Column:
    """Upper cap only."""
    return F.least(_col(x), F.lit(SCORE_CAP))


def round_display(x, decimals: int = SCORE_DECIMALS) -> Column:
    """Round half-even on the exact binary value, as ``f"{x:.2f}"`` does,
    then read back as double.  ``format_number`` rounds the exact value;
    ``round``/``bround`` round the shortest decimal string and can differ."""
    s = F.regexp_replace(F.format_number(_col(x), decimals), ",", "")
    return s.cast("double")


def final_score(components: dict, weights: dict) -> Column:
    return round_display(cap(weighted_total(components, weights)))


def cheap_part(components: dict, weights: dict) -> Column:
    """The exactly-known part of the total (everything but the cosines)."""
    total = None
    for name in COMPONENTS:
        if name in VECTOR_COMPONENTS:
            continue
        term = _col(components[name]).cast("double") * F.lit(float(weights[name]))
        total = term if total is None else total + term
    return total * F.lit(100.0)


def pruning_enabled(weights: dict) -> bool:
    return all(float(w) >= 0 for w in weights.values())


def vector_swing(weights: dict) -> float:
    """Largest amount the cosine terms can add or remove."""
    return 100.0 * _VECTOR_BOUND * sum(abs(float(weights[n])) for n in VECTOR_COMPONENTS)


def cannot_reach(cheap, weights: dict, threshold: float) -> Column:
    """True when even perfect cosines keep the rounded score below threshold."""
    return _col(cheap) + F.lit(vector_swing(weights)) < F.lit(threshold - _MARGIN)


def surely_capped(cheap, weights: dict) -> Column:
    """True when even the worst cosines leave the score above the cap."""
    return _col(cheap) - F.lit(vector_swing(weights)) > F.lit(SCORE_CAP + _MARGIN)


def rescale(x, old_min=0.0, old_max=50.0, new_min=20.0, new_max=100.0, decimals=0) -> Column:
    """D1 (inactive in the reference): linear map old range -> new range,
    clamp, round.  A zero-width input range is a caller error."""
    if old_max == old_min:
        raise ValueError("input range has zero width (old_min == old_max)")
    scaled = (_col(x) - F.lit(old_min)) / F.lit(old_max - old_min) * F.lit(
        new_max - new_min
    ) + F.lit(new_min)
    clamped = F.greatest(F.least(scaled, F.lit(new_max)), F.lit(new_min))
    return F.bround(clamped, decimals)
