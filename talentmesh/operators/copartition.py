"""Co-partitioned extract tables.

A talent database that is extracted again and again is written once as two
bucketed tables, members and long-form list elements, both cut and sorted by
member.  Equal members then lie in equal buckets: lists are aggregated and
joined to their members without a shuffle, and one member is read from one
bucket.  (A member's elements lie in one bucket, too: a table in which one
member owns a large share of the rows is better read with ``spread``, see
:func:`.profiles.aggregate_lists`.)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def write_copartitioned(member: DataFrame, long_form: DataFrame, buckets: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes both frames bucketed and sorted by member under ``path`` (a
    shared folder; by default one of its own in ``spark.checkpoint.dir``) and returns them
    read back.  Tables are registered under names of their own in the session's catalog."""
    spark = member.sparkSession
    run = uuid.uuid4().hex
    if path is None:
        path = f"{(spark.conf.get('spark.checkpoint.dir', None) or ensure_checkpoint_dir(spark)).rstrip('/')}/copartitioned-{run}"
    out = []
    for name, df, key in (("member", member, "Id"), ("elements", long_form, "MemberId")):
        table = f"talentmesh_{name}_{run}"
        # rows are dealt by the bucket's hash first, so each task writes whole buckets
        (df.withColumn(key, df[key].cast("bigint")).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
         .option("path", f"{path}/{name}").format("parquet").saveAsTable(table))
        out.append(spark.table(table))
    return out[0], out[1]
