"""A manifest of a table as a tree of hashes, with a proof for every row.

Each row is a leaf. The leaves of a group, in the order of their ids, are cut
into runs of eight, each run becomes the hash of its nodes, and so on until one
node is left, the group's root; the roots of the groups form one more tree in
the same way.

Leaves are numbered within their group by ranges, so no group passes through
one task, and dealt to aligned blocks of ``8 ** BLOCK_LEVELS`` leaves. The
authentication paths of a block are made by traversal scheduling: while a leaf
is passed, each level shows its current run and a stack of half-built nodes
(treehash) takes in one leaf of the run after it, which is finished when it
becomes the current one. That is a run and a stack for each level, however many
leaves there are. Above the blocks, paths are shared by all leaves of a block:
they are made once, by grouped aggregation upwards and by explosion downwards,
and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.runtime import Scratch, running_total_by_order

#: Nodes in a run.
RUN = 8
#: Levels of the tree within one block; a block has at most ``RUN ** BLOCK_LEVELS`` leaves.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TREE = ["known", "name"]
_STEP = "array<struct<before:string,after:string>>"


def digest(parts: Iterable[str]) -> str:
    """Lowercase hex SHA-256 of the parts put together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Treehash:
    """Nodes of one level above the leaves that are fed to it, one by one; each level below keeps an open run at most."""

    def __init__(self, level: int):
        self.level = level
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def feed(self, node: str) -> None:
        for run in self.open[:-1]:
            run.append(node)
            if len(run) < RUN:
                return
            node = digest(run)
            run.clear()
        self.open[-1].append(node)

    def take(self) -> list[str]:
        """The nodes of the level, after runs that no leaf will fill are hashed as they are; the stack is empty then."""
        for low, high in zip(self.open, self.open[1:], strict=False):
            if low:
                high.append(digest(low))
                low.clear()
        nodes, self.open[-1] = self.open[-1], []
        return nodes


def block_root(leaves: Sequence[str], levels: int) -> str:
    """The node that stands for a block, ``levels`` above its leaves."""
    tree = Treehash(levels)
    for leaf in leaves:
        tree.feed(leaf)
    return tree.take()[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn within its block: for each level what stands before and after its node in the run."""
    widths = [RUN ** (h + 1) for h in range(levels)]
    later = [Treehash(h) for h in range(levels)]
    current = []
    for tree, width in zip(later, widths, strict=True):
        for leaf in leaves[:width]:
            tree.feed(leaf)
        current.append(tree.take())
    for i in range(len(leaves)):
        path, at = [], i
        for run in current:
            at, p = divmod(at, RUN)
            path.append(("".join(run[:p]), "".join(run[p + 1 :])))
        yield path
        for h, width in enumerate(widths):
            if i + width < len(leaves):
                later[h].feed(leaves[i + width])
            if (i + 1) % width == 0:
                current[h] = later[h].take()


def fold(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf leads to along a path."""
    for before, after in path:
        leaf = digest((before, leaf, after))
    return leaf


def _levels(count: int) -> int:
    """Levels of a block of a group of ``count`` leaves."""
    levels = 0
    while levels < BLOCK_LEVELS and RUN**levels < count:
        levels += 1
    return levels


def leaf_hash(text: Column) -> Column:
    """A row's leaf, with ``text`` in place of its text: every field as ``-`` if null, else as its bytes' number, ``:`` and value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[part(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves = batch.column(3)
        found = [block_root(leaves[i].as_py(), _levels(n)) for i, n in enumerate(batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], names=[*_TREE, "at", "node"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, upper, subroots, roots = (batch.column(i).to_pylist() for i in range(1, 5))
        for i, count in enumerate(counts):
            rows = batch.column(0)[i].values
            ids, leaves, tampered = (rows.field(k) for k in range(1, 4))
            leaves, above = leaves.to_pylist(), [(s["before"], s["after"]) for s in upper[i]]
            proofs, folded = [], []
            for path, leaf, other in zip(traverse(leaves, _levels(count)), leaves, tampered.to_pylist(), strict=True):
                path += above
                proofs.append(digest(x for step in path for x in step))
                folded.append(fold(other or leaf, path))
            n, root = len(leaves), roots[i]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(leaves), pa.array([subroots[i]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def _upwards(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The runs ``(known, name, at, n, run, node)`` of each level above ``nodes(known, name, at, n, node)``, and the rows of one node alone.

    ``n`` is the number of nodes that a tree has on the row's level.
    """
    most, levels, now = nodes.agg(F.max("n")).first()[0] or 0, [], nodes
    alone = nodes.where("n = 1").select(*_TREE, "node")
    while most > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])
        above = now.where("n > 1").groupBy(*_TREE, F.expr(f"at div {RUN}").alias("at")).agg(F.expr(f"(first(n) + {RUN - 1}) div {RUN}").alias("n"), run.alias("run"))
        now = scratch.keep(above.withColumn("node", F.sha2(F.array_join("run", ""), 256)), "runs")
        levels.append(now)
        alone = alone.union(now.where("n = 1").select(*_TREE, "node"))
        most = -(-most // RUN)
    return levels, alone


def _downwards(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, scratch: Scratch) -> DataFrame:
    """``known, name, at, path`` and the other columns of ``tops(known, name, path, ...)`` for each of ``nodes``.

    ``path`` leads from the node to the top of its tree and on along the path of ``tops``.
    """
    more = [c for c in tops.columns if c not in _TREE]
    above: DataFrame | None = None

    def placed(rows: DataFrame, *columns: str) -> DataFrame:
        alone = rows.where("n = 1").join(tops, _TREE).select(*_TREE, "at", *columns, *more)
        return alone if above is None else alone.union(rows.where("n > 1").join(above, [*_TREE, "at"]).select(*alone.columns))

    for runs in reversed(levels):
        children = placed(runs, "run").select("*", F.posexplode("run").alias("p", "__node"))
        side = lambda start, length: F.array_join(F.slice("run", start, length), "")
        step = F.struct(side(F.lit(1), F.col("p")).alias("before"), side(F.col("p") + 2, F.lit(RUN)).alias("after"))
        path = F.concat(F.array(step), "path").alias("path")
        above = scratch.keep(children.select(*_TREE, (F.col("at") * RUN + F.col("p")).alias("at"), path, *[c for c in more if c != "path"]), "paths")
    return placed(nodes)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    Groups are the values of ``lang``, null being one of its own and the first.
    Null ids come before all others; rows that share an id are ordered by their
    leaf, and rows that are alike in all five fields are leaves one beside the
    other. ``proof_sha256`` is over all siblings from the leaf up, from left to
    right; a tree of one leaf has none. ``folded_root`` starts from the leaf of
    the tampered row where 3 divides the checksum of the id (a null id is never
    tampered with), else from the leaf itself. Other columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    lowered = leaf_hash(F.translate("text", UPPER, LOWER))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    leaves = docs.select(
        F.col("lang").isNotNull().alias("known"), F.coalesce("lang", F.lit("")).alias("name"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(F.col("text")).alias("leaf"), F.when(hit, lowered).alias("tampered"), F.monotonically_increasing_id().alias("salt"),
    )
    # Written before they are cut into ranges, as Spark looks at all rows once to find the ranges.
    leaves = scratch.keep(leaves, "leaves")
    cut = scratch.keep(leaves.repartitionByRange(*_TREE, "doc_id", "leaf", "salt").withColumn("range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(*_TREE, "range").agg(F.count("*").alias("rows"))
    trees = Window.partitionBy(*_TREE)
    before = trees.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*_TREE, "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(trees).alias("count"))
    place = F.row_number().over(Window.partitionBy(*_TREE, "range").orderBy("doc_id", "leaf", "salt"))
    numbered = cut.withColumn("place", place).join(offsets, [*_TREE, "range"]).withColumn("place", F.col("offset") + F.col("place") - 1)

    block = RUN**BLOCK_LEVELS
    row = F.struct("place", "doc_id", "leaf", "tampered")
    blocks = scratch.keep(
        numbered.groupBy(*_TREE, F.expr(f"place div {block}").alias("at"), "count").agg(F.array_sort(F.collect_list(row)).alias("rows")), "blocks"
    )
    roots = blocks.select(*_TREE, "at", F.col("rows.leaf").alias("leaves"), "count").mapInArrow(_roots, "known boolean, name string, at long, node string")
    sizes = blocks.where("at = 0").select(*_TREE, F.expr(f"(count + {block - 1}) div {block}").alias("n"))
    nodes = scratch.keep(roots.join(sizes, _TREE), "nodes")
    levels, subroots = _upwards(nodes, scratch)

    # The tree of the groups' roots is made in the same way, as one group.
    ordered = scratch.keep(running_total_by_order(subroots, _TREE, "at").withColumnRenamed("node", "subroot"), "groups")
    one = ordered.select(F.lit(True).alias("known"), F.lit("").alias("name"), "at", F.lit(ordered.count()).cast("long").alias("n"), F.col("subroot").alias("node"))
    over, root = _upwards(one, scratch)
    top = root.select(*_TREE, F.array().cast(_STEP).alias("path"), F.col("node").alias("root"))
    tops = ordered.join(_downwards(one, over, top, scratch).drop(*_TREE), "at").select(*_TREE, "path", "subroot", "root")

    paths = _downwards(nodes, levels, scratch.keep(tops, "tops"), scratch)
    parts = blocks.join(paths, [*_TREE, "at"]).select("rows", "count", "path", "subroot", "root")
    return parts.mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
