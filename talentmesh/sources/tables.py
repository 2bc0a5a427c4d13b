"""Table loading.

A :class:`TableSource` maps logical table names to DataFrames.  Parquet is
the default (one folder or file per table); JDBC reads are partitioned on a
numeric key so no single task pulls a whole table.  Connection settings are
always caller-supplied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


JDBC_FETCH_SIZE = 10_000


@dataclass
class TableSource:
    spark: SparkSession
    root: str | None = None                 # parquet root: {root}/{name}.parquet
    fmt: str = "parquet"
    jdbc_options: dict = field(default_factory=dict)   # url, user, driver, ...
    # per-table JDBC split: name -> (partitionColumn, lowerBound, upperBound, numPartitions)
    jdbc_partitions: dict = field(default_factory=dict)
    # tables small enough for one task to read
    jdbc_single: tuple = ()
    overrides: dict = field(default_factory=dict)      # name -> DataFrame

    def table(self, name: str) -> DataFrame:
        if name in self.overrides:
            return self.overrides[name]
        if self.fmt == "jdbc":
            return self._jdbc(name)
        return self.spark.read.format(self.fmt).load(f"{self.root}/{name}.{self.fmt}")

    def has(self, name: str) -> bool:
        if name in self.overrides:
            return True
        if self.fmt == "jdbc":
            return True
        return path_exists(self.spark, f"{self.root}/{name}.{self.fmt}")

    def _jdbc(self, name: str) -> DataFrame:
        if name not in self.jdbc_partitions and name not in self.jdbc_single:
            raise ValueError(f"no partitioning for table {name}: name its column and bounds in jdbc_partitions, "
                             "or list it in jdbc_single to have one task read it")
        r = self.spark.read.format("jdbc").option("fetchsize", str(JDBC_FETCH_SIZE)).options(**self.jdbc_options).option("dbtable", name)
        if name in self.jdbc_partitions:
            col, lo, hi, n = self.jdbc_partitions[name]
            r = (
                r.option("partitionColumn", col)
                .option("lowerBound", str(lo))
                .option("upperBound", str(hi))
                .option("numPartitions", str(n))
            )
        return r.load()


def path_exists(spark: SparkSession, path: str) -> bool:
    """False only where there is nothing at ``path``; other errors (no
    permission, no network) are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def bundle(**frames: DataFrame) -> dict[str, DataFrame]:
    """Named extract results kept lazy (no collect)."""
    return dict(frames)
