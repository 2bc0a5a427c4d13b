"""Only what the asked components read travels with the pairs."""

from talentmesh.operators.rank import cheap_pairs


def test_components_ask_for_their_own_columns_only(spark):
    names = [f"m_{n}" for n in ("ind_lc", "head_lc", "city_lc")] + [f"j_{n}" for n in ("ind_lc", "role_lc", "loc_lc")]
    df = spark.createDataFrame([("it", "dev", "oslo", "it", "dev", "oslo area")], ", ".join(f"{n} string" for n in names))
    got = cheap_pairs(df, ("industry", "role", "location")).first()
    assert (got.industry, got.role, got.location) == (3, 3, 1)
