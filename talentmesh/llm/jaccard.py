"""N-gram Jaccard join: a size-aware heavy-light set join.

Documents with equal shingle sets form a class; classes are joined.  All
shingles get one global order (rare before frequent, then by hash).  Two sets
with Jaccard similarity of 0.8 or more share c shingles among the first
n - ceil(0.8 n) + c of each.  Small (light) sets therefore enumerate the
two-element subsets of that prefix (c = 2) and meet on equal subsets; large
(heavy) sets put their prefix (c = 1) into inverted lists, which are scanned.
The size up to which a set is light is where enumerating its subsets costs
less than scanning its lists.  Sets just below the boundary do both, as they
can meet sets above it.

Scanning a list tests size, prefix position and a 512-bit parity signature
(|A xor B| is at least the number of differing bits), all of which only
exclude pairs that cannot link.  A pair is brought up in the list of its first
common shingle, as far as the sets' first shingles tell.  What is left is
verified exactly.  Large groups of near copies need no pair of each two:
neighbours by size are verified first, and in lists that hold more, later
only pairs of sets that are not yet connected, first near, then far ones.  No
list is cut off: long lists are cut into blocks, and pairs of blocks are
scanned by tasks of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, mix64, scan_words, shingle_hashes, text_chunks, written
from .graph import components

SHINGLE = 5
#: Offsets in a list at which sets are compared, round by round; from the
#: second round on only sets that are not yet connected.
SPANS = ((1, 5), (5, 65), (65, 1 << 62))
#: Sets of a list that one task scans at a time; longer lists are cut.
LIST_BLOCK = 4096
#: First prefix shingles by which a pair's first common list is told.
HEADS = 4
SIG_BITS = 512
#: Longs of the bitmap that tells tasks which sets are worth sending (4 MiB).
BITMAP_WORDS = 1 << 19
_U = np.uint64
_LINK_SCHEMA = "a long, b long"


def least_overlap(n):
    """Shingles that a set of n shares at least with any set it links to."""
    return (4 * n + 4) // 5


def set_class(x: np.ndarray) -> int:
    """64-bit name of a set of hashes (sorted, distinct)."""
    if not len(x):
        return 0
    y = mix64(np.add.reduce(x, keepdims=True) * _U(3) + np.bitwise_xor.reduce(mix64(x), keepdims=True) + _U(len(x)))
    return int(y.view(np.int64)[0])


def signature(x: np.ndarray) -> bytes:
    """Parity bits, at least one for each element; folded on halves they are
    the signature of half the length."""
    bits = SIG_BITS
    while bits < len(x):
        bits *= 2
    at = (x >> _U(20)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sig: bytes, size: int) -> np.ndarray:
    """A signature of ``size`` bytes from a longer one."""
    return np.bitwise_xor.reduce(np.frombuffer(sig, np.uint8).reshape(-1, size), axis=0)


def _sets(batch_column):
    """(rows, their sorted shingle hashes), chunk by chunk."""
    for lo, hi, buf, offs in text_chunks(batch_column):
        _, _, h, before = scan_words(buf, offs, SPACES)
        yield lo, hi, shingle_hashes(h, before, SHINGLE)


def _profile(batches):
    """Per document: size, class, signature; per task: prefix shingles by hash
    order that occurred three times or more (they may be frequent)."""
    tokens = []

    def counted():
        t, c = np.unique(np.concatenate(tokens), return_counts=True)
        tokens.clear()
        return t[c >= 3], c[c >= 3]

    sums: dict[int, int] = {}
    pending = 0
    for b in batches:
        for lo, hi, sets in _sets(b.column(1)):
            known = {}
            for x in sets:
                k = set_class(x)
                if k not in known:
                    known[k] = None
                    if len(x):
                        tokens.append(x[:len(x) - least_overlap(len(x)) + 1])
                        pending += len(tokens[-1])
            if pending > 1_000_000:
                for t, c in zip(*(v.tolist() for v in counted())):
                    sums[t] = sums.get(t, 0) + c
                pending = 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([set_class(x) for x in sets], pa.int64()), pa.array([signature(x) for x in sets], pa.binary()),
                 pa.nulls(hi - lo, pa.int64())], names=["doc_id", "n", "cls", "sig", "token"])
    if tokens:
        for t, c in zip(*(v.tolist() for v in counted())):
            sums[t] = sums.get(t, 0) + c
    if sums:
        k = len(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.array(list(sums.values()), pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
             pa.array(np.array(list(sums), _U).view(np.int64))], names=["doc_id", "n", "cls", "sig", "token"])


@dataclass
class Plan:
    """``frequent``: sorted shingles that come last in the global order;
    ``light``: the largest size whose sets enumerate subsets."""

    frequent: np.ndarray
    light: int


def prefix(x: np.ndarray, frequent: np.ndarray, c: int) -> np.ndarray:
    """The first shingles of a set in the global order, ``c`` more than could
    be missing from a partner."""
    if len(frequent):
        at = np.searchsorted(frequent, x)
        at[at == len(frequent)] = 0
        often = frequent[at] == x
        if often.any():
            x = np.concatenate((x[~often], x[often]))
    return x[:len(x) - least_overlap(len(x)) + c]


def choose_light(frequent_rows: int, total_rows: int) -> int:
    """Boundary by cost: a light set writes p (p + 1) / 2 subsets, a heavy
    one scans p lists of ``1 + partners`` on average."""
    partners = 1.0 + frequent_rows / max(1, total_rows)
    n = 2
    while True:
        p = n + 1 - least_overlap(n + 1) + 1
        if p * (p + 1) / 2 > p * (1 + partners):
            return n
        n += 1


def entries(x: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, position, shingles that a token stands for) of a set."""
    n = len(x)
    none = np.zeros(0, _U)
    tok, pos, kind = [none], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if 2 <= n <= plan.light:
        p = prefix(x, plan.frequent, 2)
        i, j = np.triu_indices(len(p), 1)
        tok.append(mix64(p[i] * _U(0x9E3779B97F4A7C15) + p[j] * _U(0xC2B2AE3D27D4EB4F) + _U(1)))
        pos.append(j)
        kind.append(np.full(len(i), 2))
    if n >= least_overlap(plan.light + 1):
        p = prefix(x, plan.frequent, 1)
        tok.append(p)
        pos.append(np.arange(len(p)))
        kind.append(np.ones(len(p), np.int64))
    return np.concatenate(tok), np.concatenate(pos), np.concatenate(kind)


def _runs(batches, keys: int):
    """Whole runs of equal leading columns of sorted batches, several in a
    table; a run that spans batches is put together."""
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        k = [t.column(i).to_numpy() for i in range(keys)]
        same = np.ones(t.num_rows, bool)
        for c in k:
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        carry = t.slice(cut).combine_chunks()
    if carry is not None and carry.num_rows:
        yield carry


def _shared(batches):
    """Keeps the (token, kind) lists of two sets or more, each set once.  Rows
    stream by; only the last one waits for its successor."""
    held, held_shared = None, False
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        tok, cls, kind = (t.column(c).to_numpy() for c in ("token", "cls", "kind"))
        same = (tok[1:] == tok[:-1]) & (kind[1:] == kind[:-1])
        first = np.concatenate(([True], ~(same & (cls[1:] == cls[:-1]))))
        keep = np.flatnonzero(first)
        if not len(keep):
            continue
        tok, kind = tok[keep], kind[keep]
        same = (tok[1:] == tok[:-1]) & (kind[1:] == kind[:-1])
        shared = np.concatenate(([held_shared], same)) | np.concatenate((same, [False]))
        held, held_shared = t.slice(int(keep[-1]), 1), bool(shared[-1])
        out = t.take(pa.array(keep[:-1][shared[:-1]]))
        yield from out.combine_chunks().to_batches(max_chunksize=20_000)
    if held is not None and held_shared:
        yield from held.combine_chunks().to_batches()


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def _elsewhere(heads: np.ndarray, i: np.ndarray, j: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Pairs that are met in an earlier list: what precedes a common head is
    among the heads, too, so the first common head is the first common
    shingle of all.  A missing head is 0."""
    first = np.zeros(len(i), heads.dtype)
    for k in range(heads.shape[1] - 1, -1, -1):
        h = heads[i, k]
        both = (h != 0) & (heads[j] == h[:, None]).any(1)
        first[both] = h[both]
    return (first != 0) & (first != token)


def _candidates(light: int, round_: int):
    """Scans cells (lists, or pairs of blocks of long lists), sorted by size.
    Pairs that may link and, from the second round on, bear different labels;
    and which lists hold sets further apart than this round looks."""
    lo, hi = SPANS[round_]

    def run(batches):
        for t in _runs(batches, 4):
            tok, kind, a, b, n, pos, cls, block = (t.column(c).to_numpy() for c in ("token", "kind", "a", "b", "n", "pos", "cls", "block"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SIG_BITS // 8)
            heads = np.zeros((len(tok), HEADS), np.int64)
            for k in range(HEADS):
                heads[:, k] = t.column(f"h{k}").to_numpy()
            label = None if round_ == 0 else t.column("label").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (kind[1:] != kind[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
            behind = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(tok)) - 1
            live = np.arange(len(tok))
            # pairs of different blocks were not looked at in the first round
            off = 1 if round_ == 1 and (a != b).any() else lo
            x, y, held = [], [], 0
            while off < hi and len(live):
                live = live[behind[live] >= off]
                live = live[4 * n[live + off].astype(np.int64) <= 5 * n[live].astype(np.int64)]
                i, j = live, live + off
                ok = np.where(a[i] == b[i], off >= lo, block[i] != block[j])
                if label is not None:
                    ok &= label[i] != label[j]
                i, j = i[ok], j[ok]
                ok = (kind[i] == 2) | (n[j] > light)
                need = -(-4 * (n[i] + n[j]) // 9)
                ok &= kind[i] + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= need
                i, j = i[ok], j[ok]
                ok = 9 * _POP[sig[j] ^ sig[i]].sum(1).astype(np.int64) <= n[i] + n[j]
                i, j = i[ok], j[ok]
                ok = (kind[i] == 2) | ~_elsewhere(heads, i, j, tok[i])
                x.append(cls[i[ok]])
                y.append(cls[j[ok]])
                held += len(x[-1])
                if held > 50_000:
                    yield _pair_batch(x, y)
                    x, y, held = [], [], 0
                off += 1
            if held:
                yield _pair_batch(x, y)
            live = live[behind[live] >= off] if off == hi else live[:0]
            live = live[4 * n[live + off].astype(np.int64) <= 5 * n[live].astype(np.int64)]
            if len(live):
                more = np.unique(np.stack((tok[live], kind[live]), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(more[:, 0]), pa.array(more[:, 1]), pa.array(np.ones(len(more), bool))], names=["a", "b", "more"])

    return run


def _pair_batch(a, b):
    a, b = np.concatenate(a), np.concatenate(b)
    ab = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(np.zeros(len(ab), bool))], names=["a", "b", "more"])


def _cells(lists: DataFrame, every: bool) -> DataFrame:
    """Rows of lists with the cell (a, b) that is scanned together.  A long
    list is cut into blocks by a hash of the set; ``every`` pairs each block
    with each other one, else a block meets itself only."""
    block = F.pmod(F.xxhash64("cls"), F.coalesce(F.col("blocks"), F.lit(1))).cast("int")
    rows = lists.withColumn("block", block)
    if not every:
        return rows.withColumn("a", F.col("block")).withColumn("b", F.col("block"))
    others = F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)).cast("int") - 1)
    return (rows.select("*", F.explode(others).alias("_o")).withColumn("a", F.least("block", "_o")).withColumn("b", F.greatest("block", "_o")).drop("_o"))


def _scan(cells: DataFrame, light: int, round_: int) -> DataFrame:
    columns = ["token", "kind", "a", "b", "n", "pos", "cls", "block", "sig", *(f"h{k}" for k in range(HEADS))]
    if round_:
        columns.append("label")
    cells = cells.repartition("token", "kind", "a", "b").sortWithinPartitions("token", "kind", "a", "b", "n", "cls").select(*columns)
    return written(cells.mapInArrow(_candidates(light, round_), "a long, b long, more boolean"), "jaccard-candidates")


def _shorten(batches):
    """Signatures of ``SIG_BITS`` for the rows of lists."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([folded(x, SIG_BITS // 8).tobytes() for x in b.column("sig").to_pylist()], pa.binary())],
                                         names=["cls", "sig"])


def _close(batches):
    """Pairs that full-length signatures do not exclude."""
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        keep = []
        for x, y, most in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), ((n + m) // 9).tolist()):
            size = min(len(x), len(y))
            keep.append(int(_POP[folded(x, size) ^ folded(y, size)].sum()) <= most)
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    c = classes.select("cls", "n", "sig")
    both = (pairs.join(c.withColumnsRenamed({"cls": "a", "n": "na", "sig": "sa"}), "a")
            .join(c.withColumnsRenamed({"cls": "b", "n": "nb", "sig": "sb"}), "b"))
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_close, "a long, b long")


def _bitmap(classes: DataFrame, bits: int) -> np.ndarray:
    rows = (classes.select(F.pmod("cls", F.lit(bits)).alias("x")).groupBy(F.shiftright("x", 6).cast("int").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(x % 64 as int)))").alias("v")).toPandas())
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out


def _member_sets(base: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, x) of the listed classes.  A bitmap of bounded size spares most
    other sets the shuffle; the join is exact whatever the bitmap lets through."""
    n = classes.count()
    bits = 64
    while bits < min(16 * n, 64 * BITMAP_WORDS):
        bits *= 2
    shared = base.sparkSession.sparkContext.broadcast(_bitmap(classes, bits))

    def run(batches):
        bitmap = shared.value
        sent = set()
        for b in batches:
            for _, _, sets in _sets(b.column(1)):
                ks, xs = [], []
                for x in sets:
                    k = set_class(x)
                    at = k % bits
                    if len(x) and k not in sent and (int(bitmap[at >> 6]) >> (at & 63)) & 1:
                        sent.add(k)
                        ks.append(k)
                        xs.append(x)
                if ks:
                    offs = np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.ListArray.from_arrays(
                        pa.array(offs), pa.array(np.concatenate(xs).view(np.int64)))], names=["cls", "x"])

    sets = base.mapInArrow(run, "cls long, x array<bigint>").join(classes, "cls", "left_semi")
    return sets.groupBy("cls").agg(F.first("x").alias("x"))


def _verified(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """Exact check: 100 |A and B| >= 80 |A or B|."""
    members = written(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "jaccard-members")
    s = written(_member_sets(base, members), "jaccard-sets")
    both = (pairs.join(s.withColumnsRenamed({"cls": "a", "x": "xa"}), "a").join(s.withColumnsRenamed({"cls": "b", "x": "xb"}), "b"))
    common = F.size(F.array_intersect("xa", "xb"))
    return both.where(100 * common >= 80 * (F.size("xa") + F.size("xb") - common)).select("a", "b")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id, n_shingles, component_id, n_copies).

    ``component_id`` is the least id that links reach, itself included;
    ``n_copies`` the rows with the same shingle set.  Words are runs of
    non-blanks, A-Z lower-cased.  Null, empty and wordless texts have no
    shingles and are linked with nothing.  Rows are expected to have distinct
    ids; repeated rows of one id each get a row, and rows with a null id one
    with a null component unless copies give it one."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prof = written(base.mapInArrow(_profile, "doc_id long, n long, cls long, sig binary, token long"), "jaccard-profile")
    per_doc = prof.where("sig IS NOT NULL").select("doc_id", "n", "cls", "sig")
    classes = written(per_doc.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"),
                                                              F.first("n").alias("n"), F.first("sig").alias("sig")), "jaccard-classes")
    stats = per_doc.agg(F.count("*"), F.sum(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1)).first()
    # at most (prefix rows / bound) tokens exceed the bound: a size that depends on the
    # mean document length only, not on their number
    bound = max(50, stats[0] // 2000)
    often = prof.where("sig IS NULL").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > bound).collect()
    plan = Plan(np.sort(np.array([r["token"] for r in often], np.int64).view(_U)),
                choose_light(sum(r["n"] for r in often), stats[1] or 0))
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def rows(batches):
        p = shared.value
        sent = set()
        for b in batches:
            for _, _, sets in _sets(b.column(1)):
                tok, pos, kind, who, size = [], [], [], [], []
                for x in sets:
                    k = set_class(x)
                    if k in sent or len(x) < 2:
                        continue
                    sent.add(k)
                    t, q, d = entries(x, p)
                    tok.append(t)
                    pos.append(q)
                    kind.append(d)
                    who.append(np.full(len(t), k))
                    size.append(np.full(len(t), len(x)))
                if tok:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(who)), pa.array(np.concatenate(size).astype(np.int32)),
                         pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(kind).astype(np.int32))],
                        names=["token", "cls", "n", "pos", "kind"])

    entry = "token long, cls long, n int, pos int, kind int"
    lists = base.mapInArrow(rows, entry).repartition("token").sortWithinPartitions("token", "kind", "n", "cls").mapInArrow(_shared, entry)
    lists = written(lists, "jaccard-lists")
    long_lists = (lists.groupBy("token", "kind").count().where(F.col("count") > LIST_BLOCK)
                  .select("token", "kind", F.ceil(F.col("count") / LIST_BLOCK).alias("blocks")))
    lists = lists.join(written(long_lists, "jaccard-long-lists"), ["token", "kind"], "left")
    heads = lists.where((F.col("kind") == 1) & (F.col("pos") < HEADS)).groupBy("cls").agg(
        *[F.max(F.when(F.col("pos") == k, F.col("token"))).alias(f"h{k}") for k in range(HEADS)])
    marked = written(classes.mapInArrow(_shorten, "cls long, sig binary").join(heads, "cls", "left").na.fill(0, [f"h{k}" for k in range(HEADS)]), "jaccard-marks")
    labels = None
    for k in range(len(SPANS)):
        rest = lists
        if k:
            named = lists.join(more, ["token", "kind"], "left_semi").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
            named = written(named.withColumn("label", F.coalesce("label", "cls")), "jaccard-labelled")
            mixed = named.groupBy("token", "kind").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
            rest = named.join(mixed.select("token", "kind"), ["token", "kind"], "left_semi")
        found = _scan(_cells(rest.join(marked, "cls"), k > 0), plan.light, k)
        more = found.where("more").select(F.col("a").alias("token"), F.col("b").cast("int").alias("kind"))
        if k == 0:
            more = more.union(lists.where("blocks IS NOT NULL").select("token", "kind"))
        more = written(more.distinct(), "jaccard-more")
        pairs = written(_sifted(found.where("not more").select("a", "b").distinct(), classes), "jaccard-pairs")
        links = written(_verified(pairs, base), "jaccard-links") if k == 0 or pairs.take(1) else pairs
        if labels is None:
            labels = components(links)
        elif links.take(1):
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
        if not more.take(1):
            break
    grouped = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "n_copies", "rep", F.coalesce("label", "cls").alias("label"))
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "label").select("cls", "n_copies", "component_id")
    return (per_doc.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
            .select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")))
