"""URL filters: a cascade of Bloom filters, exact over the known keys.

Level 1 encodes the listed keys, level 2 those other keys of the corpus that
level 1 lets through, level 3 the listed keys that level 2 lets through, and
so on until a level lets no wrong key through.  As every key of the corpus
took part, a lookup is exact and needs no join: the number of levels a key
passes in a row decides.  Everything is DataFrame functions; the filters are
arrays of longs inside the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed

#: Longs in all levels together that may ride in a plan (1 MiB).
MAX_WORDS = 131_072
HASHES = 3


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
    empty for null or where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every host suffix at a label boundary, with every start of the path of
    a length that some rule has: the keys that could fit the url."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lens = F.filter(F.array(*map(F.lit, path_lengths)), lambda n: n <= F.length(path))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(suffixes, lambda h: F.transform(lens, lambda n: F.concat(h, F.substring(path, F.lit(1), n))))))


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits))


def _passes(key: Column, level: int, words: list[int]) -> Column:
    bits = 64 * len(words)
    table = F.lit(words).cast("array<bigint>")
    ok = F.lit(True)
    for i in range(HASHES):
        b = _bit(key, level, i, bits)
        word = F.get(table, F.shiftright(b, 6).cast("int"))
        ok = ok & (F.getbit(word, F.pmod(b, F.lit(64)).cast("int")) == 1)
    return ok


@dataclass
class Cascade:
    """``levels[i]`` holds the longs of level i + 1."""

    levels: list[list[int]]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            # a key that this level stops is not of the level's kind
            out = F.when(~_passes(key, i, self.levels[i - 1]), F.lit(i % 2 == 0)).otherwise(out)
        return out


def _words(keys: DataFrame, level: int, n_words: int) -> list[int]:
    """The longs of a Bloom filter of the column ``key``: bits are ORed in
    partial aggregates, so a hot key costs one bit and no more."""
    bits = 64 * n_words
    pos = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("b"))
    rows = (pos.groupBy(F.shiftright("b", 6).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits")).collect())
    out = [0] * n_words
    for r in rows:
        out[r["w"]] = r["bits"]
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_levels: int = 40) -> Cascade | None:
    """``universe`` and ``listed`` have a column ``key`` (repeats and nulls do
    no harm).  Null if the filters would outgrow ``MAX_WORDS``, which a plan
    can carry; the caller then joins."""
    listed = listed.where("key IS NOT NULL").distinct()
    n_listed = listed.count()
    if not n_listed:
        return Cascade([])
    others = universe.where("key IS NOT NULL").join(listed, "key", "left_anti")
    n_others = others.agg(F.approx_count_distinct("key")).first()[0]
    levels: list[list[int]] = []
    inside, outside = listed, others
    # level 1 lets through about as many strangers as there are listed keys
    rate = min(0.5, n_listed * math.sqrt(0.5) / max(1, n_others))
    n = n_listed
    while n:
        if len(levels) == max_levels:
            return None
        per_key = -HASHES / math.log(1 - rate ** (1 / HASHES))
        n_words = max(1, math.ceil(n * per_key / 64))
        if sum(map(len, levels)) + n_words > MAX_WORDS:
            return None
        level = len(levels) + 1
        levels.append(_words(inside, level, n_words))
        outside = outside.where(_passes(F.col("key"), level, levels[-1]))
        inside, outside, rate = outside, inside, 0.5
        n = inside.agg(F.approx_count_distinct("key")).first()[0]
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.  A rule fits its host and
    all subdomains where the path starts with the rule's; the longest wins, and
    of equally long ones the first by host and path.  Keys that the cascade
    does not hold are not listed: such a url gets ``default``.  Null urls and urls
    without ``://`` have an empty host and path and no rule; repeated rows are
    judged each for itself."""
    spark = pages.sparkSession
    rules = sorted({(r.host, r.path): r for r in rules}.values(), key=lambda r: (-len(r.key), r.host, r.path))
    lengths = sorted({len(r.path) for r in rules})
    d = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not rules:
        return d.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = d.select(F.explode(keys).alias("key"))
    listed = _key_frame(spark, [r.key for r in rules])
    cascade = build_cascade(universe, listed)
    if cascade is None:
        return _judge_by_join(d, keys, rules, id_col, default)
    hit = F.array_sort(F.filter(keys, cascade.contains), lambda a, b: F.length(b) - F.length(a))
    verdicts = F.create_map(*[F.lit(x) for r in reversed(rules) for x in (r.key, r.verdict)])
    d = d.withColumn("rule", F.get(hit, F.lit(0)))
    return d.select(id_col, "host", "path", "rule", F.coalesce(F.element_at(verdicts, F.col("rule")), F.lit(default)).alias("verdict"))


def _judge_by_join(d: DataFrame, keys: Column, rules: list[Rule], id_col: str, default: str) -> DataFrame:
    """The same for rule lists whose filters are too large for a plan: the
    candidate keys meet the rules as rows."""
    d, row = keyed(d.withColumn("_keys", keys))
    listed = d.sparkSession.range(1).select(F.explode(F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.verdict)])).alias("_key", "_verdict"))
    found = d.select(row, F.posexplode("_keys").alias("_at", "_key")).join(listed, "_key")
    best = found.groupBy(row).agg(F.max(F.struct(F.length("_key").alias("size"), (-F.col("_at")).alias("first"), "_key", "_verdict")).alias("_best"))
    return d.join(best, row, "left").select(id_col, "host", "path", F.col("_best._key").alias("rule"),
                                            F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))


def _key_frame(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.lit(keys)).alias("key"))
