"""M6-M9, X7, X8, pruning bounds, D1."""

import random

from pyspark.sql import functions as F

from talentmesh.config import DEFAULT_WEIGHTS, COMPONENTS, MatchOptions
from talentmesh.functions import scoring as S
from talentmesh.functions.matching import industry_points, location_points, role_points


def py_total(vals):
    total = sum(v * DEFAULT_WEIGHTS[k] for k, v in zip(COMPONENTS, vals)) * 100
    return float(f"{round(min(total, 100), 2):.2f}")


M9_GOLDEN = [
    ((3, 0, 0, .8, .7, 2, 0, 1), 82.50),
    ((0, 0, 0, 1, 1, 3, 3, 2), 70.00),
    ((3, 0, 0, 1, 1, 2, 3, 2), 100.00),
    ((0, 0, 0, .8, .7, 2, 0, 1), 37.50),
    ((2, 1, 0, .85, .72, 2, 2, 0), 88.55),
]


def _scores(spark, rows):
    schema = ", ".join(f"{c} double" for c in COMPONENTS)
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in rows], schema)
    comps = {c: F.col(c) for c in COMPONENTS}
    return [r.s for r in df.select(S.final_score(comps, DEFAULT_WEIGHTS).alias("s")).collect()]


def test_m9_goldens(spark):
    assert _scores(spark, [g for g, _ in M9_GOLDEN]) == [v for _, v in M9_GOLDEN]


def test_rounding_matches_python_format(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(3000):
        rows.append((rnd.randint(0, 6), rnd.randint(0, 3), rnd.randint(0, 3), rnd.uniform(-1, 1),
                     rnd.uniform(-1, 1), rnd.choice([0, 2, 3]), rnd.choice([0, 2, 3]), rnd.choice([0, 1, 2])))
    # near-ties on the second decimal
    rows += [(0, 0, 0, x / 1000.0, 0, 0, 0, 0) for x in range(0, 1000, 7)]
    assert _scores(spark, rows) == [py_total(r) for r in rows]


def test_pruning_bounds_are_lossless():
    rnd = random.Random(3)
    w = DEFAULT_WEIGHTS
    swing = S.vector_swing(w)
    for _ in range(20000):
        req, pref, oth = rnd.randint(0, 9), rnd.randint(0, 4), rnd.randint(0, 4)
        ind, role, loc = rnd.choice([0, 2, 3]), rnd.choice([0, 2, 3]), rnd.choice([0, 1, 2])
        q, r = rnd.uniform(-1, 1), rnd.uniform(-1, 1)
        cheap = (req * .15 + pref * .15 + oth * .25 + ind * .05 + role * .05 + loc * .05) * 100
        final = py_total((req, pref, oth, q, r, ind, role, loc))
        if cheap + swing < 85 - 0.01:
            assert final < 85
        if cheap - swing > 100 + 0.01:
            assert final == 100.0


def test_categorical_points(spark):
    rows = [("", "Tech", "Engineer", "Senior Engineer", "Paris", "Paris"),
            ("tech", "TECH", "dev", "", "", "New Paris"),
            ("x", "tech", None, "dev", None, None)]
    df = spark.createDataFrame(rows, "mi string, ji string, h string, r string, c string, l string")
    out = df.select(industry_points("mi", "ji").alias("i"), role_points("h", "r").alias("r"),
                    location_points("c", "l").alias("l")).collect()
    # industry: '' in job -> 2; equal -> 3; neither -> 0
    # role: job role inside headline -> 2; '' role inside anything -> 2; null headline -> '' -> 0
    # location: equal 2; '' inside -> 1 ... both null -> equal -> 2
    assert [(r.i, r.r, r.l) for r in out] == [(2, 0, 2), (3, 2, 1), (0, 0, 2)]


def test_rescale_clamps(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (50.0,), (90.0,)], "x double")
    got = [r.y for r in df.select(S.rescale(F.col("x")).alias("y")).collect()]
    assert got == [20.0, 60.0, 100.0, 100.0]


def test_options_defaults():
    o = MatchOptions()
    assert o.threshold == 85.0 and o.prune and o.weights == DEFAULT_WEIGHTS
