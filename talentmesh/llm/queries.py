"""The registered queries over the operators of this subpackage."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_text, jaccard, manifest, quality, ranked, secrets, suffixes, topk, toxicity, urls
from .common import fit_sample, held_out, read_table, small_batches

TOXIC_CUT = 0.5
QUALITY_CUT = 0.3
TOXIC_FIT_ROWS = 12_000
QUALITY_FIT_ROWS = 4_000
PAGE_FIT_ROWS = 1_500
URL_RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
             urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def _scored(df: DataFrame, cut: float) -> DataFrame:
    return df.withColumn("held_out", held_out("doc_id")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def toxic_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.fit_lexicon(fit_sample(docs, labels, "toxic", TOXIC_FIT_ROWS))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxic_lexicon(spark, docs, sf_dir))
    return _scored(got, TOXIC_CUT).select("doc_id", "held_out", "score", "predicted", "n_hits")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = bpe.encode(docs, bpe.read_ranks(tokenizer_path()), with_offsets=False, with_decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    stats = secrets.corpus_stats(docs)
    got = secrets.scan(docs, secrets.fit(spark, stats), stats, path_col="source", confirmed_only=False)
    return got.select("doc_id", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(fit_sample(docs, read_table(spark, sf_dir, "labels"), "quality", QUALITY_FIT_ROWS))
    return _scored(quality.score(docs, model), QUALITY_CUT).select("doc_id", "held_out", "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=False)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    got = html_text.extract(pages, html_text.fit(pages, PAGE_FIT_ROWS))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                      decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


SEARCH_K = 10


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100, as a query, against all."""
    docs = read_table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return topk.search(docs, asked, SEARCH_K)


DOCUMENT_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = [F.try_add(c, F.lit(1)) if c == "n_chars" else F.col(c) for c in DOCUMENT_COLUMNS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    kept = manifest.build(docs, DOCUMENT_COLUMNS, carry={"tampered": F.when(chosen, F.unhex(manifest.leaf_hash(tampered)))})
    leaf = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    got = kept.proofs().select("doc_id", "leaf", "subroot", "root", manifest.path_digest().alias("proof_sha256"),
                               manifest.fold(leaf).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op11_sql() -> str:
    value = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
    plain = {c: f"CAST({c} AS VARCHAR)" for c in DOCUMENT_COLUMNS}
    row = " || ".join(value.format(plain[c]) for c in DOCUMENT_COLUMNS)
    more = " || ".join(value.format("CAST(n_chars + 1 AS VARCHAR)" if c == "n_chars" else plain[c]) for c in DOCUMENT_COLUMNS)
    return f"""
WITH RECURSIVE entry AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), d AS MATERIALIZED (
  SELECT documents.*, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 7 = 0 AS chosen FROM documents, entry
), leaf0 AS MATERIALIZED (
  SELECT doc_id, lang, sha256({row}) AS leaf, CASE WHEN chosen THEN sha256({more}) END AS tampered FROM d
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaf0
), tree AS (
  SELECT 0 AS level, g, pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT level + 1, g, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY level, g, pos // 2, n
), nodes AS MATERIALIZED (SELECT * FROM tree), subroots AS MATERIALIZED (SELECT g, node AS subroot FROM nodes WHERE n = 1
), roof AS (
  SELECT 0 AS level, g AS pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM roof WHERE n > 1 GROUP BY level, pos // 2, n
), top AS MATERIALIZED (SELECT * FROM roof), steps AS MATERIALIZED (
  SELECT k, t.level, xor(t.pos, 1) < t.pos AS is_left, s.node
  FROM leaves l JOIN nodes t ON t.g = l.g AND t.pos = l.pos >> t.level AND t.n > 1
  LEFT JOIN nodes s ON s.g = t.g AND s.level = t.level AND s.pos = xor(t.pos, 1)
  UNION ALL
  SELECT k, 1000 + t.level, xor(t.pos, 1) < t.pos, s.node
  FROM leaves l JOIN top t ON t.pos = l.g >> t.level AND t.n > 1
  LEFT JOIN top s ON s.level = t.level AND s.pos = xor(t.pos, 1)
), paths AS MATERIALIZED (
  SELECT k, sha256(coalesce(string_agg(node, '' ORDER BY level), '')) AS proof_sha256,
         list({{'l': is_left, 'd': coalesce(node, '')}} ORDER BY level) AS path FROM steps GROUP BY k
), fold AS (
  SELECT k, 0 AS i, coalesce(tampered, leaf) AS node FROM leaves
  UNION ALL
  SELECT fold.k, i + 1, sha256(CASE WHEN path[i + 1].l THEN path[i + 1].d || node ELSE node || path[i + 1].d END)
  FROM fold JOIN paths ON fold.k = paths.k WHERE i < len(path)
), ends AS MATERIALIZED (SELECT k, arg_max(node, i) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, r.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM leaves l JOIN subroots USING (g) JOIN (SELECT node FROM top WHERE n = 1) r ON true
LEFT JOIN paths USING (k) JOIN ends USING (k)
"""


OP11_SQL = _op11_sql()


RANKED_K = 50


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), RANKED_K)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents
), s AS (SELECT count(*) AS docs, sum(len(w)) AS words FROM d WHERE len(w) > 0
), post AS MATERIALIZED (
  SELECT k, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY k, doc_id, term
), wt AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM post, s GROUP BY term
), q AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark
), asked AS (SELECT i, item_id, unnest(w) AS term FROM q
), scored AS (
  SELECT i, any_value(item_id) AS item_id, k, any_value(doc_id) AS doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * docs) // words AS BIGINT))))) AS BIGINT) AS score
  FROM asked JOIN post USING (term) JOIN wt USING (term), s GROUP BY i, k
), ranks AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= {RANKED_K}
"""


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_CASE), (-1, 1, "assistant", CONTROL_CASE)], turns.schema)
    made = chat.format_conversations(turns.unionByName(more), chat.text_parts("text"))
    return chat.digests(chat.read_back(made))


def _op13_sql() -> str:
    t = chat.Template()
    escaped = "{0}"
    for first, rest in t.patterns():
        escaped = f"regexp_replace({escaped}, '\\{first}(\\\\*)({rest})', '{first}\\1\\\\\\2', 'g')"
    marks = len(t.turn) + len(t.body) + len(t.end)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CASE}'
), e AS (SELECT *, {marks} + length({escaped.format('role')}) + length({escaped.format('text')}) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP13_SQL = _op13_sql()


OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT k, array_to_string(list_slice(w, p, p + 4), ' ') AS x
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k
), c AS (SELECT a.k AS i, b.k AS j, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.k < b.k GROUP BY ALL
), l AS (SELECT i, j FROM c JOIN n ni ON ni.k = i JOIN n nj ON nj.k = j WHERE 100 * shared >= 80 * (ni.n + nj.n - shared)
), e AS MATERIALIZED (SELECT i AS a, j AS b FROM l UNION ALL SELECT j, i FROM l
), r AS (SELECT k, doc_id FROM d UNION SELECT e.b, r.doc_id FROM r JOIN e ON e.a = r.k
), m AS (SELECT k, min(doc_id) AS component_id FROM r GROUP BY k)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (k) JOIN m USING (k)
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents
), b AS MATERIALIZED (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM b)
), seen AS (
  SELECT k, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS x
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), found AS MATERIALIZED (SELECT k, seen.n, p, item_id FROM seen JOIN win USING (n, x)
), hit AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, n, p FROM found)) GROUP BY k
), items AS (
  SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""


OP7_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (SELECT k, doc_id, p, b[p:p + 49] AS x FROM (SELECT k, doc_id, b, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50)
), bad AS (SELECT k, p FROM win QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id
), runs AS (
  SELECT k, min(p) AS first, max(p) + 49 AS last FROM (
    SELECT k, p, sum(new) OVER (PARTITION BY k ORDER BY p) AS run FROM (
      SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM bad)) GROUP BY k, run
), cut AS MATERIALIZED (SELECT k, first, last, coalesce(lag(last) OVER (PARTITION BY k ORDER BY first), 0) AS before FROM runs
), kept AS (
  SELECT k, count(*) AS n_spans, sum(last - first + 1) AS n_removed, max(last) AS last,
         string_agg(CASE WHEN first > before + 1 THEN hex(b[before + 1:first - 1]) ELSE '' END, '' ORDER BY first) AS h FROM cut JOIN d USING (k) GROUP BY k
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(h || CASE WHEN last < n THEN hex(b[last + 1:n]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_filters": op3_url_filters,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_topk_search": op10_topk_search,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_chat_format": op13_chat_format,
}


def _bounded(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {name: _bounded(fn) for name, fn in QUERIES.items()}
ORACLE_SQL = {"op3_url_filters": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op9_decontamination": OP9_SQL,
              "op11_merkle_manifest": OP11_SQL, "op12_ranked_search": OP12_SQL,
              "op13_chat_format": OP13_SQL}
