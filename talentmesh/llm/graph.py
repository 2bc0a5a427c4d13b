"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) -> (node, label): each node of a link with the least
    node that it reaches.  Every round lets each node point its larger
    neighbours, then its smaller ones, to the least of them; hot nodes are
    split by the skew join.  Loops and repeated links do no harm."""
    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = written(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                    .where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return written(e.select(F.col("u").alias("node"), F.col("v").alias("label"))
                   .union(e.select(F.col("v"), F.col("v"))).distinct(), "labels")
