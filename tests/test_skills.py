"""M0-M3: goldens, edge cases and a property test against a plain-Python
statement of the skill rule."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentmesh.functions.skills import match_skills


def rule(member: str, job: str, required: bool) -> int:
    """Test oracle: the rule in plain Python (split on ',', no trim,
    substring hit, else any whitespace token of the member inside the fragment)."""
    score = 0
    if job:
        mem = member.lower()
        toks = mem.split()
        for frag in job.split(","):
            k = frag.lower()
            if k in mem:
                score += 3 if required else 1
            elif any(t in k for t in toks):
                score += 2 if required else 1
    return score


GOLDEN = [  # member, job, required, optional
    ("Java; SQL", "Java, SQL", 6, 2),
    ("SQL; Java", "Java, SQL", 3, 1),
    ("Unknown", "a,,b", 3, 1),
    ("Java", ",", 6, 2),
    ("Java", "JavaScript", 2, 1),
    ("C", "Machine Learning", 2, 1),
    ("Java; Go", "Java Script,Golang", 2, 1),
    ("", "Java", 0, 0),
    ("Java", "", 0, 0),
    ("Python", "SQLPython", 2, 1),
]


def _eval(spark, rows):
    df = spark.createDataFrame(rows, "m string, j string")
    out = df.select(match_skills("m", "j", True).alias("r"), match_skills("m", "j", False).alias("o"))
    return [(r.r, r.o) for r in out.collect()]


def test_goldens(spark):
    got = _eval(spark, [(m, j) for m, j, _, _ in GOLDEN])
    assert got == [(r, o) for _, _, r, o in GOLDEN]
    for m, j, r, o in GOLDEN:
        assert rule(m, j, True) == r and rule(m, j, False) == o


def test_nulls_score_zero(spark):
    # null member text -> "" (no token, no substring); null job text -> 0
    assert _eval(spark, [(None, "java"), ("java", None), (None, None), (None, ",")]) == [(0, 0), (0, 0), (0, 0), (6, 2)]


_alphabet = string.ascii_letters[:6] + " ;,\t" + "\xa0"
skill_text = st.text(alphabet=_alphabet, max_size=14)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(skill_text, skill_text), min_size=1, max_size=40))
def test_property_vs_rule(spark, pairs):
    got = _eval(spark, pairs)
    assert got == [(rule(m, j, True), rule(m, j, False)) for m, j in pairs]
