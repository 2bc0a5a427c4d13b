"""Ordered concatenation of long lists (G1-G5 for groups of any size).

``string_agg(v ORDER BY k)`` needs a group's elements in one place.  Here they
are sorted as rows, by range: a group that holds a third of all elements lies
on as many partitions as its rows fill.  Each partition joins runs of at most
``chunk`` neighbours of one group to a string, before anything is shuffled
again; only the strings meet, in the order of partitions and runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements joined to one string before strings meet.
CHUNK = 1000


def _joined(elements: str, field: str, delimiter: Column) -> Column:
    """The elements' values but nulls, joined; null where there are none."""
    vals = F.filter(F.transform(elements, lambda e: e[field]), lambda v: v.isNotNull())
    return F.when(F.size(vals) > 0, F.call_function("array_join", vals, delimiter))


def in_runs(rows: DataFrame, groups: list[str], order: list[str], texts: list[str], delimiter: Column, chunk: int = CHUNK) -> DataFrame:
    """(groups, run, texts): the strings of runs of neighbours.  ``run`` grows
    with the order; nulls in ``texts`` are skipped, a run of nulls is null.
    Elements that are equal in all of ``groups`` and ``order`` are alike in
    ``texts``, or their order is open."""
    keys = [*groups, *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    # the partition's number is in the upper bits, so runs do not cross partitions
    run = F.expr(f"_at div {chunk}").alias("run")
    got = sorted_rows.groupBy(*groups, run).agg(F.array_sort(F.collect_list(F.struct("_at", *texts))).alias("_e"))
    return got.select(*groups, "run", *[_joined("_e", c, delimiter).alias(c) for c in texts])


def concat_runs(runs: DataFrame, groups: list[str], texts: list[str], delimiter: Column) -> DataFrame:
    """(groups, texts): the groups' whole strings."""
    got = runs.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("run", *texts))).alias("_e"))
    return got.select(*groups, *[_joined("_e", c, delimiter).alias(c) for c in texts])


def concat_in_order(rows: DataFrame, groups: list[str], order: list[str], texts: list[str], delimiter: Column, chunk: int = CHUNK) -> DataFrame:
    """One row a group: each of ``texts`` joined in ``order`` (nulls first,
    null texts skipped; null where a group has none)."""
    return concat_runs(in_runs(rows, groups, order, texts, delimiter, chunk), groups, texts, delimiter)
