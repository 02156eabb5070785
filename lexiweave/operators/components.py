"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.runtime import Scratch

#: Edges that a task joins up at a time.
JOINED_EDGES = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to its smallest neighbour or itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every ``u`` has one ``v``, which is no ``u`` itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(
    edges: DataFrame, src: str = "src", tgt: str = "tgt", max_rounds: int = 60, condense: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row ``(node, component)`` per node of an edge; component is its smallest node.

    Nodes may be of any type that has an order; strings are ordered by code
    point. Self loops give a component of their own; edges with a null end are
    ignored; repeated and reversed edges count once. An empty edge table gives
    an empty result. The number of rounds grows with the logarithm of the
    component size, not with its diameter, and every round is written to the
    shared scratch folder, so a lost executor costs one round at most.

    ``condense`` may replace the edges ``(u, v)`` before each round by fewer
    ones with the same nodes and components, for example those of a forest of
    the edges that a task holds.
    """
    scratch = Scratch(edges.sparkSession, "components")
    fewer = condense or (lambda e: e)
    clean = edges.select(F.col(src).alias("u"), F.col(tgt).alias("v")).where("u is not null and v is not null")
    base = scratch.keep(fewer(clean), "edges")
    now, current = base.where("u <> v"), None
    for _ in range(max_rounds):
        if _settled(now):
            break
        step = scratch.keep(_small_star(_large_star(fewer(now).where("u <> v"))), "star")
        scratch.drop(current)
        now = current = step
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).union(base.where("u = v"))
    return found.groupBy("node").agg(F.min("component").alias("component"))


def _stars(names: tuple[str, str], limit: int):
    """Of every ``limit`` edges of a task: each node, once, with the smallest node that these edges join it to."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array(table.column(0).chunks + table.column(1).chunks).combine_chunks().dictionary_encode()
        nodes, codes = ends.dictionary, ends.indices.to_numpy()
        order = pc.sort_indices(nodes).to_numpy()  # strings: by their UTF-8 bytes, as Spark
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        u, v = rank[codes[: table.num_rows]], rank[codes[table.num_rows :]]
        least = np.arange(len(order))
        while len(u):
            np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
            while not np.array_equal(least, up := least[least]):
                least = up
            u, v = least[u], least[v]
            u, v = u[u != v], v[u != v]
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(order)), nodes.take(pa.array(order[least]))], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)

    return run


def joined_components(edges: DataFrame, src: str = "src", tgt: str = "tgt", joined: int = JOINED_EDGES) -> DataFrame:
    """``connected_components`` of strings or whole numbers, for many edges to a node.

    Each task joins up the edges it holds, ``joined`` at a time, and passes on
    one row a node. A node then takes its smallest label, and its labels are
    linked: the rounds run on labels alone, few of which are left where most
    nodes hang together. The smallest node of a component is always a label.
    """
    scratch = Scratch(edges.sparkSession, "joined")
    clean = edges.select(F.col(src).alias("u"), F.col(tgt).alias("v")).where("u is not null and v is not null")
    stars = clean.mapInArrow(_stars(("u", "v"), joined), clean.schema)
    labels = scratch.keep(stars.groupBy("u").agg(F.min("v").alias("least"), F.collect_set("v").alias("labels")), "labels")
    links = labels.where("size(labels) > 1").select("least", F.explode("labels").alias("label")).where("least <> label").distinct()
    found = connected_components(links, "least", "label").withColumnRenamed("node", "least")
    return labels.join(found, "least", "left").select(F.col("u").alias("node"), F.coalesce("component", "least").alias("component"))
