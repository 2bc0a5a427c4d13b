"""Training-corpus pipeline over ``documents``.

Stages, each working on all that its predecessor kept:

1. ``toxicity`` drops documents that score 0.5 or more;
2. ``near_duplicates`` keeps, of documents linked by five-word shingles at a
   Jaccard similarity of 0.8 or more, one row: the one with the least id, a row
   without an id only if none has one, any one of equal ids;
3. ``decontamination`` drops documents of whose words a twentieth or more lie
   in benchmark windows;
4. ``secrets`` masks found secrets in the texts (and renews ``n_chars``), by
   the same features as ``op4_secret_scans``, ``source`` as path included;
5. ``tokens`` encodes the texts by byte-level BPE and checks the way back; it
   returns its own columns only, so extra columns end here.

Every stage judges each row by itself or by its text's group, so ids may be
null or repeated; empty and null texts pass all stages.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.llm import bpe, decontaminate, jaccard, secrets, toxicity
from talentmesh.llm.common import keyed, read_table, small_batches, written
from talentmesh.llm.queries import TOXIC_CUT, tokenizer_path, toxic_lexicon
from talentmesh.session import ship_package


def _stage(fn):
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        small_batches(spark)
        return fn(spark, docs, sf_dir)

    return run


@_stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxic_lexicon(spark, docs, sf_dir), TOXIC_CUT)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    linked = jaccard.link_components(rows.select(key, "text"), key).select(key, "component_id")
    groups = written(linked.join(rows.select(key, "doc_id"), key), "groups")
    # least id, rows without an id last; the key decides between repeated ids
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)).alias("least"))
    gone = written(groups.join(first.select(f"least.{key}"), key, "left_anti").select(key), "near-duplicates")
    return rows.join(gone, key, "left_anti").select(*docs.columns)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


@_stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stats = secrets.corpus_stats(docs)
    masked = secrets.mask(docs, secrets.fit(spark, stats), stats, path_col="source")
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


@_stage
def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = bpe.encode(docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), bpe.read_ranks(tokenizer_path()),
                     with_offsets=False, with_decoded=True, keep=("lang", "source", "n_chars", "text_sha256"))
    return got.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.sha2("decoded", 256) == F.col("text_sha256")).alias("decodes"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]

#: SQL cannot express the lexicon, the forest or the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
