"""A compressed table is not broadcast for the size of its file."""

from pyspark.sql import functions as F

from talentmesh.session import written


def test_small_files_of_many_rows_are_not_broadcast_while_tables_are_written(spark, monkeypatch):
    table = written(spark.range(50_000).select(F.lit(7).alias("same"), (F.col("id") % 3).alias("k")).coalesce(1), "small", "zstd")
    seen = []
    from pyspark.sql import DataFrameWriter

    keep = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: seen.append(joined.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) or keep(self, *a, **k))
    joined = table.select("k")
    plain = int(str(joined.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    written(spark.range(1), "other")
    assert int(str(seen[0])) >= 9 * plain
