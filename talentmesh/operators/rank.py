"""Pairing, thresholding and ranking.

The reference pairs ONE job with every member (rank members) or ONE member
with every job (score jobs).  Here the single side is one scalar subquery, so the big side is scanned once and never joined or
shuffled for pairing.  Ranks are computed with a distributed
range sort (no task ever holds one whole job's match list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchOptions
from ..functions.once import computed_once
from ..session import written
from .score import (
    CHEAP,
    Side,
    attach_job_vectors,
    attach_member_vectors,
    cheap_components,
    packed_fields,
    prepare_jobs,
    prepare_members,
    score_cheap,
    score_full,
)



def rank_order(key: str = "MemberId", score: str = "Similarity") -> tuple:
    """O1: score descending, then the key ascending (a total order)."""
    return (F.desc(score), F.asc(key))


def _with_single(df: DataFrame, one: DataFrame, prefix: str, key: str) -> DataFrame:
    """Every row of ``df`` with the first row of ``one`` (F4: pick first): its
    ``prefix_*`` columns (see :func:`..operators.score.packed_fields`) and its
    key as ``prefix__id``.  No row at all where ``one`` is empty.

    The single job (or member) of a request is a scalar subquery: it is run
    once when the query runs, nothing of it passes through Python, and the
    plan does not grow with its texts or vectors.  The large side is scanned
    once with no join and no shuffle."""
    row = one.select(F.struct(F.lit(True).alias("_found"), *packed_fields(one, prefix, key)).alias("_one")).limit(1).scalar()
    return df.select("*", F.inline(F.array(row))).where(F.col("_found")).drop("_found")


def rank_members_for_job(members: DataFrame, jobs: DataFrame, job_id, embedder,
                         opts: MatchOptions = MatchOptions()) -> DataFrame:
    """Score every member against job ``job_id``; keep Similarity >=
    threshold (inclusive, after rounding).  Output is flat:
    (JobId, MemberId, MemberFirstName, MemberLastName, MemberEmail, City, Similarity)."""
    job = attach_job_vectors(prepare_jobs(jobs.where(F.col("Id") == F.lit(job_id))), embedder)
    m = prepare_members(_with_single(members, job, "j", "Id"))
    ms, js = Side("m"), Side("j")
    m = score_cheap(m, ms, js, opts)
    m = attach_member_vectors(m, embedder)
    m = score_full(m, ms, js, opts, keep_components=False)
    out = m.select(
        F.col("j__id").alias("JobId"), "MemberId", "MemberFirstName", "MemberLastName",
        "MemberEmail", F.col("CityName").alias("City"), "Similarity",
    )
    return top_matches(out, opts.top_k) if opts.top_k else out


def score_jobs_for_member(members: DataFrame, jobs: DataFrame, member_id, embedder,
                          opts: MatchOptions = MatchOptions(threshold=None)) -> DataFrame:
    """Score every job for member ``member_id`` (no threshold by
    default).  Output is flat: (MemberId, JobId, score)."""
    mem = attach_member_vectors(prepare_members(members.where(F.col("MemberId") == F.lit(member_id))),
                                embedder)
    j = prepare_jobs(_with_single(jobs, mem, "m", "MemberId"))
    ms, js = Side("m"), Side("j")
    j = score_cheap(j, ms, js, opts)
    j = attach_job_vectors(j, embedder)
    j = score_full(j, ms, js, opts, keep_components=False)
    return j.select(F.col("m__id").alias("MemberId"), F.col("Id").alias("JobId"),
                    F.col("Similarity").alias("score"))


def score_pairs(pairs: DataFrame, embedder, opts: MatchOptions = MatchOptions(threshold=None, prune=False),
                keep_components: bool = True) -> DataFrame:
    """Scores a frame that already holds prepared ``m_*`` and ``j_*`` columns
    (pairs produced by an equi-join or carried by a request payload)."""
    ms, js = Side("m"), Side("j")
    df = score_cheap(pairs, ms, js, opts)
    if not all(f"m_{v}" in pairs.columns for v in ("edu_vec", "exp_vec")):
        df = attach_member_vectors(df, embedder)
    if not all(f"j_{v}" in pairs.columns for v in ("qual_vec", "resp_vec")):
        df = attach_job_vectors(df, embedder)
    return score_full(df, ms, js, opts, keep_components=keep_components)


def cheap_pairs(pairs: DataFrame, names: tuple[str, ...] = CHEAP) -> DataFrame:
    """The components ``names`` that need no vectors, of prepared pairs.  Only
    what these read travels with the pairs."""
    comps = cheap_components(Side("m"), Side("j"), vocabulary="j_req_frag_in" in pairs.columns)
    df = computed_once(pairs, {f"_s_{n}": comps[n] for n in names})
    for n in names:
        df = df.drop(n).withColumnRenamed(f"_s_{n}", n)
    return df


def global_rank(df: DataFrame, order_cols=None, partitions: int | None = None,
                rank_col: str = "rank") -> DataFrame:
    """Exact 1-based position in ``order_cols`` order, computed without a
    single-partition window:

    0. write the rows, as the range partitioning reads them twice (to
       sample its bounds and to sort);
    1. range-partition + sort within partitions (balanced by sampling);
    2. write each row with its partition and place, which fixes both for the
       next steps and cuts lineage (compressed, in ``spark.checkpoint.dir``);
    3. per-partition counts (one row per partition) -> prefix offsets,
       broadcast (size = number of partitions);
    4. rank = offset + position within the partition.

    The order must be total (unique), e.g. end with a key column."""
    order_cols = order_cols or rank_order()
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = written(df, "rank-rows", "zstd")
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = written(ordered.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")), "rank-order", "zstd")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(rank_col, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1).drop(
        "_pid", "_mid", "_first", "_off", "_n")


def group_rank(df: DataFrame, group_col: str, score: str = "Similarity", key: str = "MemberId",
               rank_col: str = "rank") -> DataFrame:
    """O2: rank within each group (e.g. per request or per job) without a
    per-group window: one global rank over (group, score desc, key), minus
    the group's first global rank.  The per-group minimum is a small
    aggregate joined back on the group key (AQE splits a skewed group)."""
    g = global_rank(df, (F.asc(group_col), F.desc(score), F.asc(key)), rank_col="_grank")
    first = g.groupBy(group_col).agg(F.min("_grank").alias("_gfirst"))
    return g.join(first, group_col).withColumn(rank_col, F.col("_grank") - F.col("_gfirst") + 1).drop(
        "_grank", "_gfirst")


def top_k_per_group(df: DataFrame, group_col: str, k: int, score: str = "Similarity",
                    key: str = "MemberId") -> DataFrame:
    """Top-k per group: ``row_number() <= k`` is planned with a partial
    ``WindowGroupLimit`` before the shuffle, so a hot group ships at most k
    rows per map task."""
    w = Window.partitionBy(group_col).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_matches(ranked: DataFrame, k: int) -> DataFrame:
    """Optional top-k of one job's ranking: a distributed take-ordered."""
    return ranked.orderBy(*rank_order()).limit(k)
