"""Word networks: counting, merging, filtering, components, strongest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.operators.components import joined_components
from lexiweave.operators.lexicon import direct_subgraph, subgraph
from lexiweave.runtime import Scratch


def directed_edges(trials: DataFrame) -> DataFrame:
    """``src, tgt, wt`` counts of cue and response; no blank ends, no loops."""
    said = trials.select(F.coalesce("cue", F.lit("")).alias("src"), F.explode(F.array("R1", "R2", "R3")).alias("tgt"))
    return said.where("src <> '' and tgt <> '' and src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("wt"))


def response_edges(trials: DataFrame) -> DataFrame:
    """As ``directed_edges``, from ``cue, responses``; loops stay."""
    said = trials.select(F.col("cue").alias("src"), F.explode("responses").alias("tgt"))
    return said.where("src <> '' and tgt <> ''").groupBy("src", "tgt").agg(F.count("*").alias("wt"))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge per pair, src before tgt, with the larger weight of both directions."""
    return edges.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.max("wt").alias("wt")).select(
        F.col("a").alias("src"), F.col("b").alias("tgt"), "wt"
    )


def undirected_edges(trials: DataFrame) -> DataFrame:
    """``undirected(directed_edges(trials))``, with both directions of a pair counted together."""
    said = trials.select(F.coalesce("cue", F.lit("")).alias("cue"), F.explode(F.array("R1", "R2", "R3")).alias("said")).where("cue <> '' and said <> '' and cue <> said")
    both = said.groupBy(F.least("cue", "said").alias("src"), F.greatest("cue", "said").alias("tgt")).agg(F.count_if(F.col("cue") < F.col("said")).alias("up"), F.count("*").alias("n"))
    return both.select("src", "tgt", F.greatest(F.col("up"), F.col("n") - F.col("up")).alias("wt"))


def not_idiosyncratic(edges: DataFrame) -> DataFrame:
    return edges.where("wt > 1")


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: components named by their smallest node."""
    return joined_components(edges)


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with the most nodes; of equal ones that with the smallest node. The edges are made once."""
    edges = Scratch(edges.sparkSession, "graph").keep(edges, "edges")
    found = components(edges)
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    nodes = found.join(F.broadcast(best), "component", "left_semi").select("node")
    return edges.join(nodes, edges["src"] == nodes["node"], "left_semi")


def filtered_graph(trials: DataFrame, lexicon: DataFrame | None = None, direct: bool = False) -> DataFrame:
    """Trials to the largest component: count, merge, lexicon, weight over 1, component, in this order.

    With ``direct`` a node is in the lexicon if any of its noun forms is.
    """
    edges = undirected_edges(trials)
    if lexicon is not None:
        edges = (direct_subgraph if direct else subgraph)(edges, lexicon)
    return largest_component(not_idiosyncratic(edges))


def strongest(edges: DataFrame, word: str, k: int) -> DataFrame:
    """The ``k`` heaviest neighbours of a word, with their share of its weight."""
    near = edges.where((F.col("src") == word) | (F.col("tgt") == word)).select(
        F.when(F.col("src") == word, F.col("tgt")).otherwise(F.col("src")).alias("word"), "wt"
    )
    total = near.agg(F.sum("wt").alias("__total"))
    return near.crossJoin(F.broadcast(total)).select("word", "wt", (F.col("wt") / F.col("__total")).alias("share")).orderBy(F.desc("wt"), "word").limit(k)


def vocabulary(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("word")).union(edges.select("tgt")).distinct()


def graph_size(edges: DataFrame) -> DataFrame:
    """One row ``nodes, edges``."""
    return vocabulary(edges).agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
