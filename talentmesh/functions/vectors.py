"""Vector functions: cosine similarity (V2) and a built-in character-profile
vector (a deterministic, model-free text vector used when no embedding
model or vector table is supplied)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .skills import _col

# The alphabet of the character-profile vector (one dimension per character,
# counted after lower-casing); a choice of this library.
PROFILE_ALPHABET = string.ascii_lowercase + string.digits


def dot(a, b) -> Column:
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """V2: dot(a,b) / (|a| |b|); 0 when either vector is zero or missing, or
    where a vector holds NaN.  Lengths at hand may be passed in.

    ``try_divide`` keeps a zero norm from failing the batch under ANSI mode.
    """
    denom = (norm(a) if norm_a is None else _col(norm_a)) * (norm(b) if norm_b is None else _col(norm_b))
    return F.nanvl(F.coalesce(F.try_divide(dot(a, b), denom), F.lit(0.0)), F.lit(0.0))


def char_profile(text) -> Column:
    """Counts of each :data:`PROFILE_ALPHABET` character in ``lower(text)``.

    Computed with ``replace`` + ``length`` inside ``transform`` so it runs in
    the JVM (one pass per alphabet character; the Arrow-batched counter in
    ``operators.embed`` does one pass per text and is the default).  It is a
    stand-in vector, not comparable to a language model.
    """
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    n = F.length(t)
    letters = F.array(*[F.lit(c) for c in PROFILE_ALPHABET])
    return F.transform(letters, lambda c: (n - F.length(F.replace(t, c, F.lit("")))).cast("double"))
