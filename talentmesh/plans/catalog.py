"""Registered queries: a Spark plan and (where SQL can express it) a DuckDB
twin for each, over the stand-in tables of :mod:`.standin`."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JOB_DETAIL_FIELDS, MATCHED_MEMBER_FIELDS
from ..functions.normalize import bytes_text, normalize_row_values
from ..functions.scoring import rescale
from ..functions.text import preprocess_text
from ..functions.vectors import cosine
from ..operators import profiles as P
from ..operators.batch_topk import top_members
from ..operators.embed import CharProfileEmbedder, ModelEmbedder
from ..operators.encode import TokenEncoder, seeded_token_vectors
from ..operators.rank import cheap_pairs, global_rank, group_rank, rank_members_for_job, score_jobs_for_member, score_pairs
from ..operators.score import FRAGMENT_LISTS, VECTOR_SOURCES, attach_job_vectors, attach_vocabulary, attach_member_vectors, prepare_jobs, prepare_members
from ..operators.sinks import match_list, nested_ranking, score_map, write_extract
from ..session import shared_folder, sparing, written, written_in_parts
from ..sources.documents import read_requests, score_documents, whole_requests
from ..sources.payload import RANK, SCORE, parse_payloads, payload_schema, rejected, split_valid
from . import oracle as O
from . import standin as S
from .flows import extract_for_job, rank_payload_documents, rank_payloads, ranked_documents, request_matches, score_payloads

JOB_ID = 7        # the job ranked by the single-job queries
MEMBER_ID = 42    # the member scored by the single-member queries
EMBEDDER = CharProfileEmbedder()


def _t(spark, sf_dir):
    return S.Tables(spark, sf_dir)


# ---------------------------------------------------------------- extracts

def q_job_extract_all(spark, d):
    return S.jobs(_t(spark, d))


def q_job_extract_by_id(spark, d):
    return P.job_by_id(S.jobs(_t(spark, d), only_ids=[JOB_ID]), JOB_ID)


def q_member_extract_all(spark, d):
    return S.members(_t(spark, d), spread=True)


BUCKETS = 16


def q_member_extract_copartitioned(spark, d):
    """S3 over tables written bucketed by member: no shuffle of members or
    list elements."""
    return S.copartitioned_members(_t(spark, d), BUCKETS)


def q_member_extract_by_id(spark, d):
    return P.member_by_id(S.members(_t(spark, d)), MEMBER_ID)


def _tech_cat():
    return [c for c in P.CATEGORIES if c[0] == "TechnicalSkills"]


def q_bridge_listagg(spark, d):
    """J3 + G1 + G2 with the generic bridge operator: bridge orders x lineitem,
    dimension part (name = p_name, description = p_type)."""
    t = _t(spark, d)
    o = t("orders").select("o_orderkey", "o_custkey")
    li = t("lineitem").select("l_orderkey", "l_partkey")
    bridge = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("MemberId"), F.col("l_partkey").alias("TechnicalSkillId"))
    dim = t("part").select(F.col("p_partkey").alias("Id"), F.col("p_name").alias("TechnicalSkillsName"),
                           F.col("p_type").alias("TechnicalSkillsDescription"))
    lf = P.bridge_long_form(bridge, dim, "TechnicalSkills", "TechnicalSkillId",
                            "TechnicalSkillsName", "TechnicalSkillsDescription")
    return P.aggregate_lists(lf, _tech_cat(), children=(), spread=True)


def _child(spark, d, which):
    t = _t(spark, d)
    if which == "Experience":
        o = t("orders")
        exp = o.select(F.col("o_custkey").alias("MemberId"),
                       F.col("o_orderpriority").alias("ExperienceJobTitle"),
                       F.col("o_orderstatus").alias("ExperienceCompany"),
                       F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("ExperienceDescription"))
        return P.aggregate_lists(P.experience_long_form(exp), (), children=[P.CHILD_LISTS[1]], spread=True)
    b = S.bridge_lines(t)
    if which == "Education":
        edu = b.select(F.col("o_custkey").alias("MemberId"), F.col("p_brand").alias("EducationDegree"),
                       F.nullif(F.col("p_type"), F.lit("PROMO")).alias("EducationFieldStudy"),
                       F.col("p_name").alias("EducationDescription"))
        return P.aggregate_lists(P.education_long_form(edu), (), children=[P.CHILD_LISTS[0]], spread=True)
    oth = b.select(F.col("o_custkey").alias("MemberId"), F.col("p_type").alias("OtherSkillName"))
    return P.aggregate_lists(P.other_skills_long_form(oth), (), children=[P.CHILD_LISTS[2]], spread=True)


def q_education_agg(spark, d):
    return _child(spark, d, "Education")


def q_experience_agg(spark, d):
    return _child(spark, d, "Experience")


def q_other_skills_agg(spark, d):
    return _child(spark, d, "OtherSkills")


def q_multi_category_profile(spark, d):
    return P.aggregate_lists(S.member_long_form(_t(spark, d)), spread=True)


def q_normalize_values(spark, d):
    o = _t(spark, d)("orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate",
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    return normalize_row_values(o)


def q_normalize_bytes(spark, d):
    doc = _t(spark, d)("documents")
    return doc.select("doc_id", bytes_text(F.col("text").cast("binary")).alias("text_utf8"))


# ---------------------------------------------------------------- pair components

def _pair_frames(t, parts: int, vectors: bool):
    """For each part of the members, what makes its pairs with the jobs that
    share an order line (linear in lineitem)."""
    cut = S.member_parts(t, parts)
    # inputs and vectors once per member / per job, before pairing; members
    # are read twice: for the vocabulary and for the pairs
    members = []
    for part in cut:
        m = prepare_members(S.scoring_members(part))
        m = attach_member_vectors(m, EMBEDDER) if vectors else m
        members.append(written(_sides_columns(m, "MemberId", "MemberId", "m"), "pair-members", "zstd"))
    j = prepare_jobs(S.jobs(t))
    j = attach_job_vectors(j, EMBEDDER) if vectors else j
    j = written(_sides_columns(j, "Id", "JobId", "j"), "pair-jobs", "zstd")
    j = attach_vocabulary(j, reduce(DataFrame.unionByName, members), "JobId").drop(*[f"j_{c}" for c in FRAGMENT_LISTS])
    j = written(j, "pair-jobs", "zstd")

    def pairs(part, m):
        li = part("lineitem").select("l_orderkey", "l_partkey")
        o = part("orders").select("o_orderkey", "o_custkey")
        ids = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("MemberId"), F.col("l_partkey").alias("JobId")).distinct()
        # the narrow side first: the wide member rows move once, by MemberId,
        # and never again by JobId
        return ids.join(j, "JobId").join(m, "MemberId")

    for part, m in zip(cut, members):
        yield partial(pairs, part, m)


def _sides_columns(df, key, name, prefix):
    raw = [f"{prefix}_{c}" for c in VECTOR_SOURCES]
    return df.select(F.col(key).alias(name), *[c for c in df.columns if c.startswith(f"{prefix}_") and c not in raw])


def _pairs(spark, d, vectors: bool = True) -> DataFrame:
    """All pairs at once."""
    return next(_pair_frames(_t(spark, d), 1, vectors))()


def _over_pairs(spark, d, make, vectors: bool = True) -> DataFrame:
    """``make(pairs)``; of many, for a part of the members at a time, as pairs
    are wide and are shuffled."""
    t = _t(spark, d)
    parts = S.parts_needed(t)
    return _made(spark, parts, _pair_frames(t, parts, vectors), make, "pairs")


def _made(spark, parts: int, frames, make, name: str) -> DataFrame:
    """``make`` of the only frame, or of each in turn (see
    :func:`..session.written_in_parts`)."""
    if parts == 1:
        return make(next(frames)())
    return written_in_parts(spark, (lambda f=f: make(f()) for f in frames), name)


def q_pair_scores(spark, d):
    return _over_pairs(spark, d, lambda pairs: score_pairs(pairs, EMBEDDER).select(
        "MemberId", "JobId", "required_skills", "preferred_skills", "other_skills",
        "qualifications", "responsibilities", "industry", "role", "location", "Similarity"))


def q_skill_points(spark, d):
    names = ("required_skills", "preferred_skills", "other_skills")
    return _over_pairs(spark, d, lambda pairs: cheap_pairs(pairs, names).select("MemberId", "JobId", *names), vectors=False)


def q_categorical_points(spark, d):
    names = ("industry", "role", "location")
    return _over_pairs(spark, d, lambda pairs: cheap_pairs(pairs, names).select("MemberId", "JobId", *names), vectors=False)


def q_cosine_pairs(spark, d):
    """V2 over the embeddings table: each vector against the next id."""
    e = _t(spark, d)("embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    j = a.join(b, b.b_id == a.a_id + 1)
    return j.select("a_id", "b_id", F.round(cosine("a", "b"), 6).alias("cosine"))


def q_rescale(spark, d):
    return _over_pairs(spark, d, lambda pairs: score_pairs(pairs, EMBEDDER).select("MemberId", "JobId", rescale(F.col("Similarity")).alias("rescaled")))


# ---------------------------------------------------------------- ranking

def q_rank_members_for_job(spark, d):
    t = _t(spark, d)
    return rank_members_for_job(S.scoring_members(t), S.jobs(t, only_ids=[JOB_ID]), JOB_ID, EMBEDDER)


def q_ranked_members(spark, d):
    return global_rank(q_rank_members_for_job(spark, d))


TOP_K = 10


def q_top_members_per_job(spark, d):
    """M10 and O2 for all jobs at once: the best members of each job."""
    t = _t(spark, d)
    return top_members(S.scoring_members(t), S.jobs(t), EMBEDDER, TOP_K)


def q_score_jobs_for_member(spark, d):
    t = _t(spark, d)
    return score_jobs_for_member(S.scoring_members(t, only_ids=[MEMBER_ID]), S.jobs(t), MEMBER_ID, EMBEDDER)


def q_match_list(spark, d):
    t = _t(spark, d)
    m, j = S.scoring_members(t, only_ids=[MEMBER_ID]), S.jobs(t)
    return match_list(score_jobs_for_member(m, j, MEMBER_ID, EMBEDDER), j, m)


def _nested_ranking(spark, d):
    t = _t(spark, d)
    j = S.jobs(t, only_ids=[JOB_ID])
    ranked = global_rank(rank_members_for_job(S.scoring_members(t), j, JOB_ID, EMBEDDER))
    return nested_ranking(ranked, P.job_by_id(j, JOB_ID), chunk_size=100)


def q_nested_ranking(spark, d):
    """K2: the documents of one job, summed up chunk by chunk (the whole of
    them: ``nested_ranking_flat``)."""
    m = F.col("`Matched Members`")
    return _nested_ranking(spark, d).select(
        "JobId", "chunk", F.col("`Job Details`.`Job Title`").alias("title"), F.size(m).cast("bigint").alias("n"),
        F.array_join(F.transform(m, lambda x: x["Member Id"].cast("string")), ",").alias("members"))


def _score_map(spark, d):
    return score_map(q_score_jobs_for_member(spark, d), chunk_size=50)


def q_score_map(spark, d):
    """K3: the score maps of one member, summed up map by map."""
    ids = F.array_sort(F.transform(F.map_keys("scores"), lambda k: k.cast("bigint")))
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x)
    return _score_map(spark, d).select("MemberId", "chunk", F.size("scores").cast("bigint").alias("n"), F.round(total, 4).alias("total"),
                                       F.array_join(ids.cast("array<string>"), ",").alias("jobs"))


def _flat_document(doc: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All 11 detail and 6 member fields, one row a match; a document without
    a match keeps its details (position null)."""
    rows = doc.select(*keys, "JobId", "chunk", "`Job Details`.*", F.posexplode_outer("`Matched Members`").alias("pos", "m"))
    member = [disp for disp, _ in MATCHED_MEMBER_FIELDS] + ["Similarity"]
    return rows.select(*keys, "JobId", "chunk", "pos", *[F.col(f"`{x}`").alias("d_" + x.replace(" ", "")) for x, _ in JOB_DETAIL_FIELDS],
                       *[F.col(f"m.`{x}`").alias("m_" + x.replace(" ", "")) for x in member])


def q_nested_ranking_flat(spark, d):
    """K2 checked against SQL: the nested document exploded back to rows
    (chunk, position inside the chunk, member, score, job title)."""
    doc = _nested_ranking(spark, d)
    return _flat_document(doc)


def q_score_map_flat(spark, d):
    """K3 checked against SQL: the chunked score maps exploded to rows."""
    m = _score_map(spark, d)
    return m.select("MemberId", "chunk", F.explode("scores").alias("JobKey", "score"))


# ---------------------------------------------------------------- payloads

def _request_frames(t, parts: int, with_request_id=True):
    """For each part of the members, what makes their requests' texts, and the
    schema of these."""
    j = S.jobs(t).select(*S.PAYLOAD_JOB_FIELDS)
    if parts > 1:   # read by every part
        j = written(j, "payload-jobs", "zstd")

    def texts(part):
        m = S.scoring_members(part).select(*S.PAYLOAD_MEMBER_FIELDS)
        return S.payload_json(part, m, j, with_request_id), payload_schema(j.schema, m.schema)

    for part in S.member_parts(t, parts):
        yield partial(texts, part)


def _parsed(frame) -> DataFrame:
    texts, schema = frame
    return parse_payloads(texts, "payload", schema, "order_key")


def _parsed_payloads(spark, d, with_request_id=True):
    """All requests at once."""
    return _parsed(next(_request_frames(_t(spark, d), 1, with_request_id))())


def _valid_payloads(spark, d, direction, with_request_id=True):
    return split_valid(_parsed_payloads(spark, d, with_request_id), direction)[0]


def _over_payloads(spark, d, make, with_request_id=True) -> DataFrame:
    """``make(parsed requests)``; of many, for a part of the members at a time,
    as each request brings its jobs' wide rows and its member's texts."""
    t = _t(spark, d)
    parts = S.parts_needed(t)
    return _made(spark, parts, _request_frames(t, parts, with_request_id), lambda frame: make(_parsed(frame)), "payloads")


def q_payload_quarantine(spark, d):
    """Requests rejected by the payload check in either direction, with
    the reason, and whether the raw text was kept."""
    return _over_payloads(spark, d, lambda p: rejected(p).select("direction", "request_key", "error", F.length("payload").alias("kept_text")))


def q_payload_rank(spark, d):
    return _over_payloads(spark, d, lambda p: rank_payloads(split_valid(p, RANK)[0], EMBEDDER))


def q_payload_ranked(spark, d):
    """O2 over O1: members in rank order within each request."""
    return group_rank(q_payload_rank(spark, d), "request_key")


def q_payload_nested_flat(spark, d):
    """E2 to the end, without ``request_id``s: details and matches of every
    request, also of those without a match."""
    keys, t = ("request_key", "request_id"), _t(spark, d)
    parts = S.parts_needed(t)
    if parts > 1 and S.shared_order_keys(t, parts):
        # requests of one key belong together, wherever their members are
        kept = _over_payloads(spark, d, lambda p: request_matches(split_valid(p, RANK)[0], EMBEDDER), False)
        return _flat_document(ranked_documents(kept, 100), keys)
    return _over_payloads(spark, d, lambda p: _flat_document(rank_payload_documents(split_valid(p, RANK)[0], EMBEDDER, chunk_size=100), keys), False)


def q_payload_score(spark, d):
    return _over_payloads(spark, d, lambda p: score_payloads(split_valid(p, SCORE)[0], EMBEDDER))


def q_payload_no_request_id(spark, d):
    """Payloads without the client's field stay apart."""
    return _over_payloads(spark, d, lambda p: score_payloads(split_valid(p, SCORE)[0], EMBEDDER), False)


def q_payload_score_ranked(spark, d):
    """Jobs ranked by score within each request."""
    return group_rank(q_payload_score(spark, d), "request_key", score="score", key="JobId")


def q_payload_score_map_flat(spark, d):
    """E3 to the end: a score map for each request."""
    def flat(p):
        scores = score_payloads(split_valid(p, SCORE)[0], EMBEDDER, positions=True)
        maps = score_map(scores, chunk_size=50, keys=("request_key", "MemberId"), pos_col="pos")
        return maps.select("request_key", "MemberId", "chunk", F.explode("scores").alias("JobKey", "score"))

    return _over_payloads(spark, d, flat)


# ---------------------------------------------------------------- large documents

DOCUMENT_PIECE = 2_000
#: Documents of a compressed file, which is read by one task.
DOCUMENTS_A_FILE = 10_000


def _pieces_of(frame):
    """Requests as files of JSON documents, read in pieces; those cut short are
    left to ``payload_quarantine``, as brackets must balance here."""
    texts, schema = frame
    spark = texts.sparkSession
    path = _shared_path(spark, "documents")
    with sparing(spark):
        texts.where(F.col("order_key") % 100 != 11).select("payload").write.option("maxRecordsPerFile", DOCUMENTS_A_FILE).text(path, compression="gzip")
    return read_requests(spark, path, schema, DOCUMENT_PIECE)


def _over_documents(spark, d, make) -> DataFrame:
    """``make(pieces)``; of many requests, for those of a part of the members
    at a time, which have files of their own."""
    t = _t(spark, d)
    parts = S.parts_needed(t)
    return _made(spark, parts, _request_frames(t, parts), lambda frame: make(_pieces_of(frame)), "documents")


def q_document_rank(spark, d):
    """E2 over documents read in pieces: the first job of each against its
    members, piece by piece."""
    return _over_documents(spark, d, lambda p: rank_payloads(whole_requests(p, RANK)[0], EMBEDDER).drop("request_key"))


def q_document_scores(spark, d):
    """E3 over documents read in pieces: the first member of each against its
    jobs; of a job listed twice the later entry counts."""
    return _over_documents(spark, d, lambda p: score_documents(whole_requests(p, SCORE)[0], lambda rows: score_payloads(rows, EMBEDDER, positions=True)).drop("request_key"))


def q_document_quarantine(spark, d):
    """S8 over documents read in pieces, both directions: a row a document."""
    def reasons(pieces):
        bad = [whole_requests(pieces, x)[1].select(F.lit(x).alias("direction"), "error") for x in (RANK, SCORE)]
        return bad[0].unionByName(bad[1]).groupBy("direction", "error").agg(F.count("*").alias("n"))

    return _over_documents(spark, d, reasons).groupBy("direction", "error").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- text / vectors

def letter_counts():
    """A model that SQL can recompute: text length and the counts of e, a, t."""
    def model(texts):
        return [[float(len(t)), float(t.count("e")), float(t.count("a")), float(t.count("t"))] for t in texts]

    return model


def q_embed_distinct_text(spark, d):
    """V1: one vector for each distinct text, by its key."""
    doc = _t(spark, d)("documents")
    v = ModelEmbedder(letter_counts, 4, "letter-counts").embed_distinct(doc, "text")
    return v.select("key", *[F.col("vector")[i].cast("double").alias(f"v{i}") for i in range(4)])


def q_embed_token_mean(spark, d):
    """V1: the distinct texts of the four scored columns and of the documents,
    in one pass: cut at 512 tokens, mean over the tokens."""
    t = _t(spark, d)
    m, j = S.scoring_members(t), S.jobs(t)
    coder = TokenEncoder(seeded_token_vectors(4), 4, "seeded-token-vectors")
    v = coder.encode_distinct([(m, "Education"), (m, "Experience"), (j, "Qualifications"), (j, "Key_Responsibilities"), (t("documents"), "text")])
    return v.select("key", "n_tokens", *[F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in range(4)])


def _shared_path(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_extract_round_trip(spark, d):
    """S6 + K1 + G8: the extract bundle is written, counted while it is
    written, and read back; one row for each table."""
    t = _t(spark, d)
    frames = extract_for_job(S.jobs(t, only_ids=[JOB_ID]), S.members(t, spread=True), JOB_ID)
    path = _shared_path(spark, "extract")
    counts = write_extract(frames, path)
    out = None
    for name, key in (("jobpost", "Id"), ("member", "MemberId")):
        back = spark.read.schema(frames[name].schema).json(f"{path}/{name}").agg(
            F.lit(name).alias("name"), F.lit(counts[name]).cast("bigint").alias("written"),
            F.count(F.lit(1)).alias("rows_read"), F.sum(key).alias("key_sum"))
        out = back if out is None else out.unionByName(back)
    return out


def q_preprocess_text(spark, d):
    doc = _t(spark, d)("documents")
    return doc.select("doc_id", preprocess_text(F.col("text")).alias("clean"))


QUERIES = {
    "job_extract_all": q_job_extract_all,
    "job_extract_by_id": q_job_extract_by_id,
    "member_extract_all": q_member_extract_all,
    "member_extract_copartitioned": q_member_extract_copartitioned,
    "member_extract_by_id": q_member_extract_by_id,
    "bridge_listagg": q_bridge_listagg,
    "education_agg": q_education_agg,
    "experience_agg": q_experience_agg,
    "other_skills_agg": q_other_skills_agg,
    "multi_category_profile": q_multi_category_profile,
    "normalize_values": q_normalize_values,
    "normalize_bytes": q_normalize_bytes,
    "skill_points": q_skill_points,
    "categorical_points": q_categorical_points,
    "pair_scores": q_pair_scores,
    "cosine_pairs": q_cosine_pairs,
    "rescale": q_rescale,
    "rank_members_for_job": q_rank_members_for_job,
    "ranked_members": q_ranked_members,
    "top_members_per_job": q_top_members_per_job,
    "score_jobs_for_member": q_score_jobs_for_member,
    "match_list": q_match_list,
    "nested_ranking": q_nested_ranking,
    "score_map": q_score_map,
    "nested_ranking_flat": q_nested_ranking_flat,
    "score_map_flat": q_score_map_flat,
    "payload_quarantine": q_payload_quarantine,
    "payload_rank": q_payload_rank,
    "payload_ranked": q_payload_ranked,
    "payload_nested_flat": q_payload_nested_flat,
    "payload_score": q_payload_score,
    "payload_no_request_id": q_payload_no_request_id,
    "payload_score_map_flat": q_payload_score_map_flat,
    "payload_score_ranked": q_payload_score_ranked,
    "document_rank": q_document_rank,
    "document_scores": q_document_scores,
    "document_quarantine": q_document_quarantine,
    "embed_distinct_text": q_embed_distinct_text,
    "embed_token_mean": q_embed_token_mean,
    "extract_round_trip": q_extract_round_trip,
    "preprocess_text": q_preprocess_text,
}


# ---------------------------------------------------------------- oracle SQL

def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _sql():
    mem, job, prep = O.member_ctes(), O.job_ctes(), O.pair_prep()
    pairs = """
pairs AS (SELECT DISTINCT o.o_custkey AS MemberId, l.l_partkey AS JobId
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
    pair_sc = O.scored_pairs_cte("pairs p JOIN mp2 m ON p.MemberId = m.MemberId JOIN jp j ON p.JobId = j.Id")
    comps = "required_skills, preferred_skills, other_skills, qualifications, responsibilities, industry, role, location"
    rank_sc = O.scored_pairs_cte(f"mp2 m JOIN jp j ON j.Id = {JOB_ID}")
    ranked = f"SELECT JobId, MemberId, MemberFirstName, MemberLastName, MemberEmail, City, Similarity FROM sc WHERE Similarity >= {O.THRESHOLD}"
    score_sc = O.scored_pairs_cte(f"mp2 m JOIN jp j ON m.MemberId = {MEMBER_ID}")
    usable = "o.o_orderkey % 100 NOT IN (11, 12, 15, 16)"
    first_job = f"""
fl AS (SELECT l_orderkey, l_partkey FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1),
rq AS (SELECT CAST(o.o_orderkey AS VARCHAR) AS request_key, o.o_orderkey AS k, o.o_custkey AS MemberId, fl.l_partkey AS JobId
       FROM fl JOIN orders o ON fl.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
       WHERE {usable} AND o.o_orderkey % 100 <> 13),
rp AS (SELECT * FROM rq WHERE k % 100 <> 14)"""
    pay_rank_sc = O.scored_pairs_cte(
        "(SELECT DISTINCT MemberId, JobId FROM rp) x JOIN mp2 m ON x.MemberId = m.MemberId JOIN jp j ON x.JobId = j.Id")
    all_jobs = f"""
sp2 AS (SELECT DISTINCT CAST(o.o_orderkey AS VARCHAR) AS request_key, o.o_custkey AS MemberId, l.l_partkey AS JobId
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE {usable} AND o.o_orderkey % 100 NOT IN (13, 14))"""
    pay_score_sc = O.scored_pairs_cte(
        "(SELECT DISTINCT MemberId, JobId FROM sp2) x JOIN mp2 m ON x.MemberId = m.MemberId JOIN jp j ON x.JobId = j.Id")
    pay_ranked = """(SELECT rp.request_key, rp.request_key AS request_id, sc.JobId, sc.MemberId, sc.MemberFirstName, sc.MemberLastName,
        sc.MemberEmail, sc.City, sc.Similarity
 FROM sc JOIN rp ON sc.MemberId = rp.MemberId AND sc.JobId = rp.JobId WHERE sc.Similarity >= 85.0)"""
    pay_scores = """(SELECT sp2.request_key, sc.MemberId, sc.JobId, sc.Similarity AS score
 FROM sc JOIN sp2 ON sc.MemberId = sp2.MemberId AND sc.JobId = sp2.JobId)"""
    rejected_rows = """
WITH o AS (SELECT o.o_orderkey AS k, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS has_lines
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
r AS (SELECT d.direction, k, CASE
        WHEN k % 100 = 11 THEN 'malformed' WHEN k % 100 = 12 THEN 'missing data'
        WHEN k % 100 = 13 THEN CASE WHEN d.direction = 'rank' THEN 'empty list' END
        WHEN NOT has_lines THEN 'missing jobpost'
        WHEN k % 100 = 15 THEN 'missing member' WHEN k % 100 = 16 THEN 'member is not a list'
        WHEN k % 100 = 14 AND d.direction = 'score' THEN 'empty list' END AS error
      FROM o, (VALUES ('rank'), ('score')) d(direction))"""
    details = ", ".join(f"jobs.{src} AS d_{disp.replace(' ', '')}" for disp, src in JOB_DETAIL_FIELDS)
    asked = details.replace("jobs.Salary_Range_", "CASE WHEN rq.k % 100 <> 17 THEN jobs.Salary_Range_").replace(" AS d_Salary", " END AS d_Salary")
    matched = ", ".join([f"rk.{'City' if src == 'CityName' else src} AS m_{disp.replace(' ', '')}" for disp, src in MATCHED_MEMBER_FIELDS]
                        + ["rk.Similarity AS m_Similarity"])
    ws = O.WS
    return {
        "job_extract_all": _with(job) + " SELECT * FROM jobs",
        "job_extract_by_id": _with(job) + f" SELECT * FROM jobs WHERE Id = {JOB_ID}",
        "member_extract_all": _with(mem) + " SELECT * FROM members",
        "member_extract_copartitioned": _with(mem) + " SELECT * FROM members",
        "member_extract_by_id": _with(mem) + f" SELECT * FROM members WHERE MemberId = {MEMBER_ID}",
        "bridge_listagg": """
SELECT o.o_custkey AS MemberId,
       string_agg(p.p_name, '; ' ORDER BY l.l_partkey, p.p_name, p.p_type) AS TechnicalSkillNames,
       string_agg(p.p_type, '; ' ORDER BY l.l_partkey, p.p_name, p.p_type) AS TechnicalSkillDescriptions
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY o.o_custkey""",
        "education_agg": """
SELECT MemberId, string_agg(v, '; ' ORDER BY v) AS EducationInfo FROM (
  SELECT o.o_custkey AS MemberId, p.p_brand || ' - ' || nullif(p.p_type, 'PROMO') || ' - ' || p.p_name AS v
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)
GROUP BY MemberId""",
        "experience_agg": """
SELECT o_custkey AS MemberId,
       string_agg(o_orderpriority || ' at ' || o_orderstatus || ' - ' || 'order ' || CAST(o_orderkey AS VARCHAR),
                  '; ' ORDER BY o_orderpriority || ' at ' || o_orderstatus || ' - ' || 'order ' || CAST(o_orderkey AS VARCHAR)) AS ExperienceInfo
FROM orders GROUP BY o_custkey""",
        "other_skills_agg": """
SELECT o.o_custkey AS MemberId, string_agg(p.p_type, ', ' ORDER BY p.p_type) AS OtherSkillNames
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY o.o_custkey""",
        "multi_category_profile": _with(mem) + " SELECT * FROM agg",
        "normalize_values": """
SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS o_totalprice FROM orders""",
        "normalize_bytes": "SELECT doc_id, text AS text_utf8 FROM documents",
        "skill_points": _with(mem, job, prep, pairs, pair_sc)
        + " SELECT MemberId, JobId, required_skills, preferred_skills, other_skills FROM sc",
        "categorical_points": _with(mem, job, prep, pairs, pair_sc)
        + " SELECT MemberId, JobId, industry, role, location FROM sc",
        "pair_scores": _with(mem, job, prep, pairs, pair_sc) + f" SELECT MemberId, JobId, {comps}, Similarity FROM sc",
        "cosine_pairs": """
SELECT a.vec_id AS a_id, b.vec_id AS b_id,
       round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
             / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
                * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "rescale": _with(mem, job, prep, pairs, pair_sc) + """
 SELECT MemberId, JobId,
        round_even(greatest(least((Similarity - 0.0) / 50.0 * 80.0 + 20.0, 100.0), 20.0), 0) AS rescaled FROM sc""",
        "rank_members_for_job": _with(mem, job, prep, rank_sc) + " " + ranked,
        "ranked_members": _with(mem, job, prep, rank_sc) + f"""
 SELECT *, row_number() OVER (ORDER BY Similarity DESC, MemberId) AS rank FROM ({ranked})""",
        "top_members_per_job": _with(mem, job, prep, O.scored_pairs_cte("mp2 m CROSS JOIN jp j")) + f"""
 SELECT JobId, CAST(rank AS INTEGER) AS rank, MemberId, MemberFirstName, MemberLastName, MemberEmail, City, Similarity
 FROM (SELECT *, row_number() OVER (PARTITION BY JobId ORDER BY Similarity DESC, MemberId) AS rank FROM ({ranked})) WHERE rank <= {TOP_K}""",
        "score_jobs_for_member": _with(mem, job, prep, score_sc)
        + " SELECT MemberId, JobId, Similarity AS score FROM sc",
        "match_list": _with(mem, job, prep, score_sc) + """
 SELECT row_number() OVER (ORDER BY sc.Similarity DESC, sc.JobId) AS position, sc.JobId AS job_id, jobs.JobTitle AS job_title,
        sc.Similarity AS match_percentage,
        concat_ws(' ', sc.MemberFirstName, sc.MemberLastName) AS candidate_name, sc.MemberId AS candidate_id
 FROM sc JOIN jobs ON sc.JobId = jobs.Id""",
        "payload_rank": _with(mem, job, prep, first_job, pay_rank_sc) + f" SELECT * FROM {pay_ranked}",
        "payload_ranked": _with(mem, job, prep, first_job, pay_rank_sc) + f"""
 SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY Similarity DESC, MemberId) AS rank FROM {pay_ranked}""",
        "payload_nested_flat": _with(mem, job, prep, first_job, pay_rank_sc) + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY Similarity DESC, MemberId) AS rank FROM {pay_ranked})
 SELECT rq.request_key, CAST(NULL AS VARCHAR) AS request_id, rq.JobId, coalesce(CAST((rk.rank - 1) // 100 AS BIGINT), 0) AS chunk,
        CAST((rk.rank - 1) % 100 AS INTEGER) AS pos, {asked}, {matched}
 FROM rq JOIN jobs ON rq.JobId = jobs.Id LEFT JOIN rk ON rq.request_key = rk.request_key""",
        "payload_score": _with(mem, job, prep, all_jobs, pay_score_sc) + f"""
 SELECT request_key, request_key AS request_id, MemberId, JobId, score FROM {pay_scores}""",
        "payload_no_request_id": _with(mem, job, prep, all_jobs, pay_score_sc) + f"""
 SELECT request_key, CAST(NULL AS VARCHAR) AS request_id, MemberId, JobId, score FROM {pay_scores}""",
        "document_rank": _with(mem, job, prep, first_job, pay_rank_sc) + f" SELECT * EXCLUDE (request_key) FROM {pay_ranked}",
        "document_scores": _with(mem, job, prep, all_jobs, pay_score_sc) + f"""
 SELECT request_key AS request_id, MemberId, JobId, score FROM {pay_scores}""",
        "payload_score_ranked": _with(mem, job, prep, all_jobs, pay_score_sc) + f"""
 SELECT request_key, request_key AS request_id, MemberId, JobId, score,
        row_number() OVER (PARTITION BY request_key ORDER BY score DESC, JobId) AS rank FROM {pay_scores}""",
        "payload_score_map_flat": _with(mem, job, prep, all_jobs, pay_score_sc) + f"""
 SELECT request_key, MemberId, CAST(floor(JobId / 50) AS BIGINT) AS chunk, CAST(JobId AS VARCHAR) AS JobKey, score FROM {pay_scores}""",
        "payload_quarantine": rejected_rows + """
SELECT direction, CAST(k AS VARCHAR) AS request_key, error, CASE WHEN error = 'malformed' THEN 40 END AS kept_text
FROM r WHERE error IS NOT NULL""",
        "document_quarantine": rejected_rows + """
SELECT direction, error, count(*) AS n FROM r WHERE error IS NOT NULL AND error <> 'malformed' GROUP BY ALL""",
        "nested_ranking_flat": _with(mem, job, prep, rank_sc) + f""",
rk AS (SELECT *, row_number() OVER (ORDER BY Similarity DESC, MemberId) AS rank FROM ({ranked}))
 SELECT jobs.Id AS JobId, coalesce(CAST((rk.rank - 1) // 100 AS BIGINT), 0) AS chunk, CAST((rk.rank - 1) % 100 AS INTEGER) AS pos,
        {details}, {matched}
 FROM jobs LEFT JOIN rk ON rk.JobId = jobs.Id WHERE jobs.Id = {JOB_ID}""",
        "score_map_flat": _with(mem, job, prep, score_sc) + """
 SELECT MemberId, CAST(floor(JobId / 50) AS BIGINT) AS chunk, CAST(JobId AS VARCHAR) AS JobKey,
        Similarity AS score FROM sc""",
        "nested_ranking": _with(mem, job, prep, rank_sc) + f""",
rk AS (SELECT *, row_number() OVER (ORDER BY Similarity DESC, MemberId) AS rank FROM ({ranked}))
 SELECT jobs.Id AS JobId, coalesce(CAST((rk.rank - 1) // 100 AS BIGINT), 0) AS chunk, any_value(jobs.JobTitle) AS title,
        count(rk.MemberId) AS n, coalesce(string_agg(CAST(rk.MemberId AS VARCHAR), ',' ORDER BY rk.rank), '') AS members
 FROM jobs LEFT JOIN rk ON rk.JobId = jobs.Id WHERE jobs.Id = {JOB_ID} GROUP BY 1, 2""",
        "score_map": _with(mem, job, prep, score_sc) + """
 SELECT MemberId, CAST(floor(JobId / 50) AS BIGINT) AS chunk, count(*) AS n, round(sum(Similarity), 4) AS total,
        string_agg(CAST(JobId AS VARCHAR), ',' ORDER BY JobId) AS jobs FROM sc GROUP BY 1, 2""",
        "embed_distinct_text": """
SELECT DISTINCT sha256(coalesce(text, '')) AS key, CAST(length(coalesce(text, '')) AS DOUBLE) AS v0,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS DOUBLE) AS v1,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')) AS DOUBLE) AS v2,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 't', '')) AS DOUBLE) AS v3 FROM documents""",
        "embed_token_mean": _with(mem, job) + f""",
tx AS (SELECT DISTINCT coalesce(t, '') AS t FROM (SELECT Education AS t FROM members UNION ALL SELECT Experience FROM members
       UNION ALL SELECT Qualifications FROM jobs UNION ALL SELECT Key_Responsibilities FROM jobs UNION ALL SELECT text FROM documents)),
tk AS (SELECT t, list_slice({O.tokens("lower(t)")}, 1, 512) AS w FROM tx)
 SELECT sha256(t) AS key, CAST(len(w) AS INTEGER) AS n_tokens, """ + ", ".join(
            f"round(coalesce(list_avg(list_transform(w, lambda x: CAST(CAST('0x' || substr(md5(x), {4 * i + 1}, 4) AS INTEGER) AS DOUBLE) / 65535.0)), 0.0), 6) AS v{i}"
            for i in range(4)) + " FROM tk",
        "extract_round_trip": f"""
SELECT 'jobpost' AS name, count(*) AS written, count(*) AS rows_read, sum(p_partkey) AS key_sum FROM part WHERE p_partkey = {JOB_ID}
UNION ALL SELECT 'member', count(*), count(*), sum(c_custkey) FROM customer""",
        "preprocess_text": f"""
SELECT doc_id, lower(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'),
                                                lambda x: x <> ''), ' ')) AS clean FROM documents""",
    }


ORACLE_SQL = _sql()
