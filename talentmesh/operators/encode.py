"""V1 as a batch job: a token encoder over the distinct texts of many columns.

A text is cut to its first ``max_tokens`` tokens, encoded in a batch of texts
of similar length, and its vector is the mean of the hidden states of its own
tokens: padding is masked out, so a batch gives what one text at a time gives.
All columns' distinct texts are encoded in one pass.  Texts that are common by
design ('' and 'Unknown') are not joined by key, or a third of all rows would
meet in one task: their vectors are looked up once.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN
from ..session import ensure_checkpoint_dir, small_batches
from .embed import text_key

MAX_TOKENS = 512
#: Tokens, padding included, that the encoder gets at a time.
BATCH_TOKENS = 16_384
_MODELS: dict = {}


def mean_pooled(ids: list[np.ndarray], encode: Callable, batch_tokens: int = BATCH_TOKENS) -> list[np.ndarray]:
    """The vector of each list of token ids, in the order given; a text
    without tokens has None.  ``encode(ids, mask)`` gets (n, length) arrays
    and returns (n, length, dim) hidden states."""
    out: list = [None] * len(ids)
    order = [i for i in sorted(range(len(ids)), key=lambda i: len(ids[i])) if len(ids[i])]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(ids[order[hi]]) <= batch_tokens:
            hi += 1
        some = order[lo:hi]
        length = len(ids[some[-1]])
        batch, mask = np.zeros((len(some), length), np.int64), np.zeros((len(some), length), bool)
        for r, i in enumerate(some):
            batch[r, :len(ids[i])] = ids[i]
            mask[r, :len(ids[i])] = True
        states = np.asarray(encode(batch, mask), np.float64)
        total = np.where(mask[:, :, None], states, 0.0).sum(1)
        for r, i in enumerate(some):
            out[i] = total[r] / len(ids[i])
        lo = hi
    return out


class TokenEncoder:
    """``factory()`` is called once a Python worker and returns (tokenize,
    encode): ``tokenize(text) -> list of ids`` and ``encode`` as for
    :func:`mean_pooled`.  ``common`` are texts that many rows hold.

    Null texts are empty; a text without tokens has a zero vector."""

    inline = False

    def __init__(self, factory: Callable, dim: int, name: str, max_tokens: int = MAX_TOKENS, common: tuple[str, ...] = ("", UNKNOWN)):
        self.factory, self.dim, self.name, self.max_tokens, self.common = factory, dim, name, max_tokens, common
        self.table: DataFrame | None = None

    def distinct_texts(self, columns: list[tuple[DataFrame, str]]) -> DataFrame:
        """(key, text) of the distinct texts of all columns."""
        frames: dict[int, tuple[DataFrame, list[str]]] = {}
        for df, c in columns:
            frames.setdefault(id(df), (df, []))[1].append(c)
        out = None
        for df, names in frames.values():
            # a frame is evaluated once, whatever the number of its columns
            one = df.select(F.explode(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in names])).alias("text"))
            out = one if out is None else out.unionByName(one)
        return out.select(text_key("text").alias("key"), "text").dropDuplicates(["key"])

    def encode_distinct(self, columns: list[tuple[DataFrame, str]]) -> DataFrame:
        """(key, n_tokens, vector): one pass over the texts of all columns.
        Texts are sorted by length within each task, so that batches hold
        little padding."""
        factory, dim, name, most = self.factory, self.dim, self.name, self.max_tokens

        def run(batches):
            if name not in _MODELS:  # one model load a worker
                _MODELS[name] = factory()
            tokenize, encode = _MODELS[name]
            for b in batches:
                ids = [np.asarray(tokenize(t)[:most], np.int64) for t in b.column(1).to_pylist()]
                vectors = [np.zeros(dim) if v is None else v for v in mean_pooled(ids, encode)]
                if any(v.shape != (dim,) for v in vectors):
                    raise ValueError(f"the encoder's states are not of {dim} dimensions")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int32()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))],
                                                 names=["key", "n_tokens", "vector"])

        small_batches(columns[0][0].sparkSession)
        texts = self.distinct_texts(columns)
        ordered = texts.withColumn("_size", F.length("text")).sortWithinPartitions("_size").select("key", "text")
        return ordered.mapInArrow(run, "key string, n_tokens int, vector array<double>")

    def prepare(self, *columns: tuple[DataFrame, str]) -> TokenEncoder:
        """Encodes the columns that ``attach`` will ask for, once."""
        spark = columns[0][0].sparkSession
        ensure_checkpoint_dir(spark)
        common = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in self.common])).alias("text"))
        self.table = self.encode_distinct([*columns, (common, "text")]).checkpoint()
        return self

    def attach(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """``df`` with the vectors of a prepared column.  Rows of common texts
        take theirs from one lookup and meet nothing in the join, where they
        are spread by a hash of the row."""
        if self.table is None:
            return TokenEncoder(self.factory, self.dim, self.name, self.max_tokens, self.common).prepare((df, text_col)).attach(df, text_col, out_col)
        text = F.coalesce(F.col(text_col), F.lit(""))
        is_common = text.isin(list(self.common))
        hashed = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
        key = F.when(is_common, F.concat(F.lit("common "), F.xxhash64(*hashed).cast("string"))).otherwise(text_key(text_col))
        joined = df.withColumn("_tk", key).join(self.table.select(F.col("key").alias("_vk"), F.col("vector").alias("_vv")), F.col("_tk") == F.col("_vk"), "left")
        vector = F.col("_vv")
        for t in self.common:
            one = self.table.where(F.col("key") == text_key(F.lit(t))).select("vector").limit(1).scalar()
            vector = F.when(text == t, one).otherwise(vector)
        return joined.withColumn(out_col, vector).drop("_tk", "_vk", "_vv")


def seeded_token_vectors(dim: int = 4):
    """A model that SQL can repeat: the hidden state of a token is read from
    the MD5 of the token, four hex digits a dimension, scaled to 0..1.  Tokens
    are the lower-cased runs of non-whitespace.  A token's id is the first 64
    bits of its MD5, which hold the state of four dimensions: no vocabulary
    grows with the texts."""
    if not 1 <= dim <= 4:
        raise ValueError("an id of 64 bits holds one to four dimensions")
    from functools import lru_cache
    from hashlib import md5

    def factory():
        @lru_cache(maxsize=1 << 16)
        def number(token):
            return int.from_bytes(md5(token.encode()).digest()[:8], "big", signed=True)

        def tokenize(text):
            return [number(t) for t in text.lower().split()]

        def encode(ids, mask):
            bits = ids.view(np.uint64)[..., None] >> np.array([48, 32, 16, 0][:dim], np.uint64)
            return (bits & np.uint64(0xFFFF)) / 65535.0

        return tokenize, encode

    return factory
