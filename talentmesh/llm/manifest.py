"""Merkle dataset manifest: hash trees over the rows of a table, kept as a
postorder append log.

Every group of rows (a language, say) is one binary tree; the groups' roots,
in order, are the leaves of one more tree, whose root names the whole table.
A node is the SHA-256 of its children's lowercase hex digests; the last node
of a level may have one child only.

An append log holds nodes in the order in which they are complete: a leaf,
then every subtree that ends with it.  This is postorder, and a node's place
follows from the sizes of the subtrees before it alone (``position``): after
``l`` leaves the log holds ``2 l - popcount(l)`` nodes.  So the tree is built
by many builders, each on an aligned run of 1,024 leaves; a builder's part of
the log is one segment, its last node is a leaf of the next tier's builders.
Proofs address siblings by place, in the segments on the way from the root
down.

Places of rows come from one range sort and the counts of its partitions; no
task holds more than a segment, whatever the size of a group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Levels of a segment: a builder takes 2 ** LEVELS leaves.
LEVELS = 10
DIGEST = 32
_PATH = "array<struct<left: boolean, digest: string>>"


def leaf_hash(values: list[Column]) -> Column:
    """Hex digest of a row: of each value ``-`` where null, else its number of
    UTF-8 bytes, a colon and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _parent(*children: str) -> str:
    return sha256("".join(children).encode()).hexdigest()


def tree_height(n: int) -> int:
    return max(0, n - 1).bit_length()


def _tail(n: int) -> int:
    """Height of the last complete subtree of n leaves."""
    return (n & -n).bit_length() - 1


def log_size(n: int, height: int) -> int:
    """Nodes of a tree of n leaves that is carried up to ``height``."""
    return 2 * n - n.bit_count() + height - _tail(n)


def position(h: int, i: int, n: int) -> int:
    """Place in the postorder log of node ``i`` of level ``h`` over n leaves.

    A subtree that is full is complete with its last leaf, before which
    ``2 l - popcount(l)`` nodes were; of one that is not, the last of its
    level, all levels from the first such one follow when the log is closed."""
    last = ((i + 1) << h) - 1
    if last < n:
        return 2 * last - last.bit_count() + h
    return 2 * n - n.bit_count() + h - _tail(n) - 1


def build_log(leaves: list[str], height: int) -> list[str]:
    """Nodes in the order in which they are complete."""
    log, waiting = [], []
    for j, node in enumerate(leaves):
        log.append(node)
        while j & 1:
            node = _parent(waiting.pop(), node)
            log.append(node)
            j >>= 1
        waiting.append(node)
    n = len(leaves)
    node = waiting.pop()
    for h in range(_tail(n), height):
        node = _parent(waiting.pop(), node) if (n - 1) >> h & 1 else _parent(node)
        log.append(node)
    return log


@lru_cache(maxsize=8)
def siblings(n: int, height: int) -> tuple:
    """For each leaf, level by level: (is the sibling on the left, its place
    in the log), the place None where a node is alone."""
    out = []
    for j in range(n):
        way = []
        for h in range(height):
            s = j >> h ^ 1
            way.append((bool(s < j >> h), position(h, s, n) if s <= (n - 1) >> h else None))
        out.append(tuple(way))
    return tuple(out)


def _segment_height(n: int, levels: int) -> int:
    return levels if n > 1 << levels else tree_height(n)


def _cut(log: bytes) -> list[str]:
    text = log.hex()
    return [text[k:k + 2 * DIGEST] for k in range(0, len(text), 2 * DIGEST)]


def _builder(levels: int):
    """Adds ``log``, the segment's nodes, to rows (tree, block, n, members)."""

    def run(batches):
        for b in batches:
            logs = []
            for n, members in zip(b.column("n").to_pylist(), b.column("members")):
                leaves = [x.hex() for x in members.values.field("digest").to_pylist()]
                logs.append(bytes.fromhex("".join(build_log(leaves, _segment_height(n, levels)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logs, pa.binary())], names=[*b.schema.names, "log"])

    return run


def placed_in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place of a row in its tree, and ``n``, the tree's
    rows.  ``order`` begins with ``tree``; a row key ends it, so that equal
    rows, too, are spread by the range sort."""
    rows = written(rows.withColumn("_key", F.monotonically_increasing_id()), "manifest-rows")
    rows = rows.repartitionByRange(*order, "_key").sortWithinPartitions(*order, "_key").drop("_key")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "manifest-order")
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    seen = rows.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    trees = Window.partitionBy("tree")
    before = F.sum("_n").over(trees.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(trees).alias("n"))
    return rows.join(seen, ["tree", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _tiers(placed: DataFrame, levels: int) -> list[DataFrame]:
    """The segments of all trees, tier by tier: (tree, block, n, members,
    log), n being the leaves that the tier's tree has."""
    size = 1 << levels
    out = []
    rows = placed
    while True:
        carried = [c for c in rows.columns if c not in ("tree", "n", "at")]
        block = rows.groupBy("tree", F.shiftright("at", levels).alias("block")).agg(
            F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *carried))).alias("members"))
        schema = T.StructType([*block.schema.fields, T.StructField("log", T.BinaryType())])
        out.append(written(block.mapInArrow(_builder(levels), schema), "manifest-log"))
        if not out[-1].where(F.col("n") > size).take(1):
            return out
        rows = out[-1].where(F.col("n") > size).select(
            "tree", F.col("block").alias("at"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), _root("log").alias("digest"))


def _root(log: str) -> Column:
    return F.substring(log, -DIGEST, DIGEST)


def _roots(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(tree, digest): the root of each tree closes its only segment of the
    last tier it has."""
    out = None
    for t in tiers:
        one = t.where(F.col("n") <= 1 << levels).select("tree", _root("log").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class Manifest:
    """``tiers``: segments of the groups' trees; ``top``: of the tree over
    their roots; ``carried``: columns kept beside each leaf."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    carried: list[Column]
    levels: int

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return _roots(self.top, self.levels).select(F.lower(F.hex("digest")).alias("root"))

    def nodes(self) -> DataFrame:
        """The log: (tree, position, level, at, digest) of every node of the
        groups' trees, ``position`` counted from 0 in each tree."""
        levels = self.levels

        def run(tier):
            def rows(batches):
                for b in batches:
                    for tree, block, n, leaves, log in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "n", "leaves", "log"))):
                        digests = _cut(log)
                        m = min(n - (block << levels), 1 << levels)
                        found = []
                        for h in range(1 if tier else 0, _segment_height(n, levels) + 1):
                            for i in range(((m - 1) >> h) + 1):
                                level, at = tier * levels + h, (block << levels - h) + i
                                found.append((position(level, at, leaves), level, at, digests[position(h, i, m)]))
                        found.sort()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tree] * len(found), pa.string()), *(pa.array([f[k] for f in found], t) for k, t in enumerate(
                                (pa.int64(), pa.int32(), pa.int64(), pa.string())))], names=["tree", "position", "level", "at", "digest"])

            return rows

        total = self.tiers[0].where("block = 0").select("tree", F.col("n").alias("leaves"))
        out = None
        for k, t in enumerate(self.tiers):
            one = t.join(total, "tree").select("tree", "block", "n", "leaves", "log").mapInArrow(
                run(k), "tree string, position long, level int, at long, digest string")
            out = one if out is None else out.unionByName(one)
        return out

    def proofs(self) -> DataFrame:
        """(carried columns, leaf, path, subroot, root): ``path`` holds a row's
        siblings from its leaf to the root, with no digest on levels where a
        node is alone."""
        root = _root("log")
        above = self.top[-1].select("tree", "block", F.array().cast(_PATH).alias("path"), root.alias("root"))
        above = above.withColumn("subroot", F.lit(b""))
        groups = _walk_down(self.top, above, self.levels).select(F.col("group").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
        groups = written(groups, "manifest-paths")
        rows = _walk_down(self.tiers, groups, self.levels)
        return rows.select(*self.carried, F.lower(F.hex("digest")).alias("leaf"), "path", F.lower(F.hex("subroot")).alias("subroot"),
                           F.lower(F.hex("root")).alias("root"))


def _climb(levels: int, names: list[str]):
    """Segments with the path above them -> their members, each with the path
    from it to the root."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                members = row.column("members").flatten()
                log = _cut(row.column("log")[0].as_py())
                n = row.column("n")[0].as_py()
                k = len(members)
                ways = siblings(k, _segment_height(n, levels))
                above = row.column("path").flatten()
                rest = [(x["left"], x["digest"]) for x in above.to_pylist()]
                left, digest, offs = [], [], [0]
                for way in ways:
                    left += [w[0] for w in way]
                    left += [x[0] for x in rest]
                    digest += [None if w[1] is None else log[w[1]] for w in way]
                    digest += [x[1] for x in rest]
                    offs.append(len(left))
                steps = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(digest, pa.string())], names=["left", "digest"])
                same = [pa.array([row.column(c)[0].as_py()] * k, row.column(c).type) for c in ("tree", "root", "subroot")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.ListArray.from_arrays(pa.array(offs, pa.int32()), steps), *(members.field(c) for c in names)],
                    names=["tree", "root", "subroot", "path", *names])

    return run


def _walk_down(tiers: list[DataFrame], groups: DataFrame, levels: int) -> DataFrame:
    """The members of the lowest tier with their paths.  ``groups`` holds the
    paths above each tree; from tier to tier each segment finds the path of
    its root in the segment above it."""
    rows = None
    for t in reversed(tiers):
        last = t.where(F.col("n") <= 1 << levels).join(groups.drop("block"), "tree")
        if rows is not None:
            up = rows.select("tree", F.col("at").alias("block"), "path", "root", "subroot")
            last = last.unionByName(t.where(F.col("n") > 1 << levels).join(up, ["tree", "block"]))
        member = t.schema["members"].dataType.elementType
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in member)
        rows = last.select("tree", "n", "members", "log", "path", "root", "subroot").mapInArrow(
            _climb(levels, member.names), f"tree string, root binary, subroot binary, path {_PATH}, {fields}")
    return rows


def build(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
          group_col: str = "lang", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs``, its log written to the shared folder.

    A leaf is the ``leaf_hash`` of ``columns``.  Groups are ordered by name,
    the one without a name first; the rows of a group by ``id_col``, rows
    without an id first, equal ids by their leaves.  Null and empty values
    differ; repeated rows are leaves of their own.  An empty table has no
    root and no proofs.  Other columns are ignored, whatever their names;
    ``carry`` names columns to keep beside each leaf."""
    carry = {"doc_id": F.col(id_col), **(carry or {})}
    leaf = F.unhex(leaf_hash([F.col(c) for c in columns]))
    group = F.col(group_col).cast("string")
    # '-' sorts before '=': the group without a name comes first
    tree = F.coalesce(F.concat(F.lit("="), group), F.lit("-"))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"),
                       *[c.alias(f"c_{name}") for name, c in carry.items()])
    tiers = _tiers(placed_in_order(rows, ["tree", "id", "digest"]).drop("id"), levels)
    tops = _roots(tiers, levels).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    top = _tiers(placed_in_order(tops, ["tree", "group"]), levels)
    return Manifest(tiers, top, [F.col(f"c_{name}").alias(name) for name in carry], levels)


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(
        F.when(s["digest"].isNull(), node).when(s["left"], F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"])), 256))


def path_digest(path: str = "path") -> Column:
    """Digest of a path's siblings in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)
