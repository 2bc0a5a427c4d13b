"""Document quality by attention-based multiple-instance learning.

Every text is cut into passages; each passage is encoded by figures of its
bytes and words.  A gated attention network, fitted to document labels alone,
weighs the passages, and the weighted mean passage gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, CHUNK_BYTES, SPACES, scan_words, text_chunks, written

PASSAGE_WORDS = 64
HASHED = 16


def _class(members) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(members)] = 1
    return t


_CLASSES = [
    _class(range(0x41, 0x5B)),                    # capitals
    _class(range(0x61, 0x7B)),                    # small letters
    _class(range(0x30, 0x3A)),                    # digits
    _class(map(ord, ".,;:?")),                    # sentence signs
    _class(map(ord, "!")),
    _class(map(ord, "#$%&*+/<=>@\\^_`{|}~-")),    # other signs
    _class(range(0x80, 0x100)),                   # bytes beyond ASCII
    _class([0x0A]),
]
N_FEATURES = len(_CLASSES) + 6 + HASHED


def passage_features(buf: np.ndarray, offs: np.ndarray):
    """(features, passages before each row): runs of ``PASSAGE_WORDS`` words
    of one text; a text without words is one passage of zeros."""
    s, e, h, before = scan_words(buf, offs, SPACES)
    n_words = np.diff(before)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate(([0], np.cumsum(n_pass)))
    row = np.repeat(np.arange(len(n_words)), n_pass)
    k = np.arange(first[-1]) - first[row]
    w0 = before[row] + k * PASSAGE_WORDS
    w1 = np.minimum(w0 + PASSAGE_WORDS, before[row + 1])
    n = (w1 - w0).astype(np.float64)
    full = n > 0
    x = np.zeros((len(row), N_FEATURES), np.float32)
    if len(s):
        b0 = s[np.minimum(w0, len(s) - 1)]
        b1 = np.where(full, e[np.maximum(w1 - 1, 0)], b0)
        size = np.maximum(1, b1 - b0).astype(np.float64)
        for j, t in enumerate(_CLASSES):
            c = np.concatenate(([0], np.cumsum(t[buf])))
            x[:, j] = (c[b1] - c[b0]) / size
        j = len(_CLASSES)
        length = np.concatenate(([0], np.cumsum(e - s)))
        x[:, j] = (length[w1] - length[w0]) / np.maximum(1, n) / 10
        # words met before in their passage, and words that follow themselves
        part = np.repeat(np.arange(len(row)), (w1 - w0))
        order = np.lexsort((h, part))
        same = np.zeros(len(h), np.int64)
        same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (part[order[1:]] == part[order[:-1]])
        c = np.concatenate(([0], np.cumsum(same)))
        x[:, j + 1] = (c[w1] - c[w0]) / np.maximum(1, n)
        twice = np.zeros(len(h), np.int64)
        twice[1:] = h[1:] == h[:-1]
        c = np.concatenate(([0], np.cumsum(twice)))
        x[:, j + 2] = (c[w1] - c[w0]) / np.maximum(1, n)
        sign = ALNUM_SEPARATORS[buf]
        ends = np.concatenate(([0], np.cumsum(sign[e - 1])))
        x[:, j + 3] = (ends[w1] - ends[w0]) / np.maximum(1, n)
        alone = np.concatenate(([0], np.cumsum(sign[s] & (e - s <= 2))))
        x[:, j + 4] = (alone[w1] - alone[w0]) / np.maximum(1, n)
        x[:, j + 5] = np.log1p(n_words[row]) / 10
        tail = buf[e - 1].astype(np.int64) % HASHED
        at = np.bincount(part * HASHED + tail, minlength=len(row) * HASHED).reshape(len(row), HASHED)
        x[:, j + 6:] = at / np.maximum(1, n)[:, None]
    return x, first


@dataclass
class MILModel:
    """Gated attention: a_k ~ exp(w . (tanh(V h_k) * sigm(U h_k))), with
    h_k = tanh(E x_k); score = sigm(c . sum a_k h_k + b)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _forward(self.p, (x - self.mean) / self.scale, first)["y"]


def _sigm(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(p, x, first):
    start = first[:-1]
    size = np.diff(first)
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigm(h @ p["U"])
    a = (t * g) @ p["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, start), size))
    a /= np.repeat(np.add.reduceat(a, start), size)
    z = np.add.reduceat(h * a[:, None], start, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "size": size, "y": _sigm(z @ p["c"] + p["b"])}


def _gradients(p, x, first, y):
    f = _forward(p, x, first)
    start, size, n = first[:-1], f["size"], len(y)
    dy = (f["y"] - y) / n
    d = {"c": f["z"].T @ dy, "b": np.array(dy.sum())}
    dz = np.repeat(dy[:, None] * p["c"], size, axis=0)
    da = (dz * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["a"] * da, start), size)
    ds = f["a"] * (da - mean)
    d["w"] = (f["t"] * f["g"]).T @ ds
    dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    d["V"], d["U"] = f["h"].T @ dt, f["h"].T @ dg
    dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
    dh *= 1 - f["h"] ** 2
    d["E"], d["e"] = x.T @ dh, dh.sum(0)
    return d


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 12, gate: int = 6, steps: int = 250,
          rate: float = 0.03, decay: float = 1e-3, seed: int = 5) -> MILModel:
    """Adam on the log loss of document labels; full batches, fixed seed."""
    r = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float64)
    p = {"E": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "e": np.zeros(hidden),
         "V": r.normal(0, hidden ** -0.5, (hidden, gate)), "U": r.normal(0, hidden ** -0.5, (hidden, gate)),
         "w": r.normal(0, gate ** -0.5, gate), "c": r.normal(0, hidden ** -0.5, hidden), "b": np.zeros(())}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, steps + 1):
        d = _gradients(p, x, first, y)
        for k in p:
            gk = d[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * gk
            v2[k] = 0.99 * v2[k] + 0.01 * gk * gk
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.99 ** t)) + 1e-8)
    return MILModel(mean, scale, p)


def _encode(batches):
    for b in batches:
        for lo, hi, buf, offs in text_chunks(b.column(0), CHUNK_BYTES):
            x, first = passage_features(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary()), pa.array(np.diff(first), pa.int64()),
                 b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)], names=["x", "n", "y", "doc_id"])


def fit(sample: DataFrame, max_passages: int = 120_000, **how) -> MILModel | None:
    """``sample`` (doc_id, text, y) is a bounded table of labelled texts.
    Passages are encoded in Spark and written; their numbers alone tell which
    texts, in order of id, keep within ``max_passages``, and only the figures
    of those reach the driver.  Null where a class lacks."""
    kind = sample.schema["doc_id"].dataType.simpleString()
    coded = written(sample.select("text", "y", "doc_id").mapInArrow(_encode, f"x binary, n long, y int, doc_id {kind}"), "quality-passages")
    taken, n = [], 0
    for r in coded.select("doc_id", "n").orderBy("doc_id").toLocalIterator():
        if n + r["n"] <= max_passages:
            n += r["n"]
            taken.append(r["doc_id"])
    xs, ys = [], []
    for r in coded.where(F.col("doc_id").isin(taken)).orderBy("doc_id").select("x", "y").collect():
        xs.append(np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES))
        ys.append(r["y"])
    y = np.array(ys, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    first = np.concatenate(([0], np.cumsum([len(x) for x in xs])))
    return train(np.concatenate(xs), first, y, **how)


def score(docs: DataFrame, model: MILModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row.  Null texts are empty; a text without words
    scores as one empty passage; without a model every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB
    kind = docs.schema[id_col].dataType

    def run(batches):
        m = shared.value
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column(1), CHUNK_BYTES):
                y = np.full(hi - lo, 0.5) if m is None else m.score(*passage_features(buf, offs))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(y.astype(np.float64))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double")
