"""V1: text -> vector providers.

The scorer needs a vector for four texts per pair.  Scoring never calls a
model per pair: each provider attaches vectors to a frame by column, and the
model-backed provider embeds each *distinct* text once, in Arrow batches,
then joins the vectors back by a text hash.

* :class:`CharProfileEmbedder` - built in, JVM only, deterministic; a
  stand-in with no relation to a language model's geometry.
* :class:`VectorTableEmbedder` - precomputed vectors keyed by text hash
  (the output of an offline embedding job, or of :meth:`ModelEmbedder.embed_distinct`).
* :class:`ModelEmbedder` - caller-supplied model factory run in a pandas UDF.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import PROFILE_ALPHABET, char_profile
from ..session import small_batches
from ..sources.tables import path_exists


def text_key(text) -> Column:
    """Join key of a text: SHA-256 of its UTF-8 bytes (null -> '')."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(c, F.lit("")), 256)


_PROFILE_LUT = np.full(256, -1, dtype=np.int64)
for _i, _ch in enumerate(PROFILE_ALPHABET):
    _PROFILE_LUT[ord(_ch)] = _i


#: Bytes counted at a time: numpy's intermediates take some 30 times as much.
PROFILE_BYTES = 1 << 18


def char_profile_batch(texts: pd.Series) -> np.ndarray:
    """Vectorised :func:`..functions.vectors.char_profile` for one Arrow
    batch: one bincount over the UTF-8 bytes of the lower-cased texts (every
    alphabet character is ASCII, so counting bytes counts characters), taken
    in runs of ``PROFILE_BYTES``, across and within texts."""
    dim = len(PROFILE_ALPHABET)
    out = np.zeros((len(texts), dim), np.float64)
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0

    def count():
        lens = np.fromiter((len(b) for b in parts), np.int64, len(parts))
        idx = _PROFILE_LUT[np.frombuffer(b"".join(parts), np.uint8)]
        at = np.repeat(np.arange(len(parts)) * dim, lens) + idx
        counts = np.bincount(at[idx >= 0], minlength=len(parts) * dim)
        out[rows] += counts.reshape(len(parts), dim)

    for row, text in enumerate(texts.fillna("")):
        data = text.lower().encode("utf-8")
        # a row has one part in a run, so that its counts are added once
        for lo in range(0, len(data), PROFILE_BYTES):
            part = data[lo:lo + PROFILE_BYTES]
            if parts and held + len(part) > PROFILE_BYTES:
                count()
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(part)
            held += len(part)
    if parts:
        count()
    return out


def char_profile_vectors(texts: pa.Array) -> pa.Array:
    """The vectors of one Arrow batch.  A text that occurs again in it (a
    member of several requests) is counted once."""
    coded = pc.dictionary_encode(pc.fill_null(texts, ""))
    counts = char_profile_batch(coded.dictionary.to_pandas())
    flat = counts[coded.indices.to_numpy(zero_copy_only=False)].ravel()
    ends = np.arange(len(texts) + 1, dtype=np.int32) * len(PROFILE_ALPHABET)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _char_profile_udf(texts: pa.Array) -> pa.Array:
    return char_profile_vectors(texts)


# Marked non-deterministic only so the optimizer never copies the call into
# a pushed-down filter: each text is then counted once, after pruning.
char_profile_udf = _char_profile_udf.asNondeterministic()


class CharProfileEmbedder:
    """Character-count vectors.  ``engine="arrow"`` (default) counts with
    numpy over Arrow batches in one pass per text; ``engine="jvm"`` uses the
    pure column expression (one replace pass per alphabet character)."""

    inline = True

    def __init__(self, engine: str = "arrow"):
        self.engine = engine

    def vector(self, text) -> Column:
        c = F.col(text) if isinstance(text, str) else text
        return char_profile_udf(c) if self.engine == "arrow" else char_profile(c)

    def attach(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return self.attach_all(df, {out_col: text_col})

    def attach_all(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Several columns (out -> text) in one pass: rows go through one
        Python worker a task, not one a column, in batches of bounded size."""
        small_batches(df.sparkSession)
        return df.withColumns({out: self.vector(F.col(text)) for out, text in columns.items()})


class VectorTableEmbedder:
    """Vectors from a table ``(key string, vector array<float|double>)`` whose
    ``key`` is :func:`text_key` of the text.  Missing texts get NULL (cosine 0).
    The join is a plain equi-join; Spark broadcasts the table only when its
    measured size is under the broadcast threshold."""

    inline = False

    def __init__(self, table: DataFrame, key_col: str = "key", vector_col: str = "vector"):
        # a key stored twice counts once, or it would double the rows it joins
        self.table = table.groupBy(F.col(key_col).alias("_vk")).agg(F.first(vector_col).alias("_vv"))

    def attach(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        keyed = df.withColumn("_tk", text_key(text_col))
        return (keyed.join(self.table, keyed["_tk"] == self.table["_vk"], "left")
                .drop("_tk", "_vk").withColumnRenamed("_vv", out_col))


_MODEL_CACHE: dict = {}


def _embed_udf(factory: Callable, dim: int, cache_name: str):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        model = _MODEL_CACHE.get(cache_name)
        if model is None:  # one model load per Python worker
            model = _MODEL_CACHE[cache_name] = factory()
        vecs = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
        if vecs.ndim != 2 or vecs.shape[1] != dim:
            raise ValueError(f"model returned shape {vecs.shape}, expected (n, {dim})")
        return pd.Series(list(vecs))

    return embed.asNondeterministic()   # evaluate once; never duplicated into filters


class ModelEmbedder:
    """Batch embedding with a caller-supplied model.

    ``factory()`` is called once per Python worker and must return a callable
    ``list[str] -> array (n, dim)``.  Texts are de-duplicated by hash before
    the model runs, so each distinct text is embedded once per job."""

    inline = False

    def __init__(self, factory: Callable, dim: int, name: str = "model"):
        self.factory, self.dim, self.name = factory, dim, name
        self._udf = _embed_udf(factory, dim, name)

    def embed_distinct(self, df: DataFrame, text_col: str) -> DataFrame:
        """``(key, vector)`` for every distinct text of ``df[text_col]``."""
        texts = (df.select(text_key(text_col).alias("key"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                 .dropDuplicates(["key"]))
        return texts.select("key", self._udf(F.col("text")).alias("vector"))

    def attach(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return VectorTableEmbedder(self.embed_distinct(df, text_col)).attach(df, text_col, out_col)

    def refresh_table(self, df: DataFrame, text_col: str, table_path: str) -> VectorTableEmbedder:
        """Incremental vector table at ``table_path`` (parquet, shared
        storage): only texts whose key is not stored yet are embedded (left
        anti join on the key), then appended.  Returns a provider reading
        the table, so later scoring jobs never call the model again."""
        spark = df.sparkSession
        texts = df.select(text_key(text_col).alias("key"),
                          F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["key"])
        if path_exists(spark, table_path):  # any other error is raised
            texts = texts.join(spark.read.parquet(table_path).select("key"), "key", "left_anti")
        texts.select("key", self._udf(F.col("text")).alias("vector")).write.mode("append").parquet(table_path)
        return VectorTableEmbedder(spark.read.parquet(table_path))
