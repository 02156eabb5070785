"""Dictionaries and the lexicon: lookups with a default, compound derivation, noun lemmas.

Dictionaries are tables ``(wrong, correct)`` or ``(squashed, expanded)``. A
lookup leaves it to Catalyst whether the dictionary is broadcast (it does so by
the measured size), so a large one is joined by a shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.text import lemma_candidates, strip
from lexiweave.runtime import Scratch


def replace_cells(df: DataFrame, columns: list[str], pairs: DataFrame) -> DataFrame:
    """Each cell of ``columns`` that is a key of ``pairs`` (first column) becomes its value (second); ``pairs`` is made once, not for each column."""
    key, value = pairs.columns
    pairs = Scratch(df.sparkSession, "pairs").keep(pairs.where(F.col(key) != F.col(value)), "pairs")
    for c in columns:
        lookup = pairs.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
        df = df.join(lookup, df[c] == lookup["__k"], "left").withColumn(c, F.coalesce("__v", c)).drop("__k", "__v")
    return df


def distinct_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``cell`` of all the columns, each value once; null is blank."""
    return df.select(F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in columns])).alias("cell")).distinct()


def map_cells(df: DataFrame, columns: list[str], pairs: DataFrame) -> DataFrame:
    """Cells by ``pairs(cell, out)``, which is joined once for each column; others stay, null is blank."""
    return replace_cells(df.withColumns({c: F.coalesce(c, F.lit("")) for c in columns}), columns, pairs.select("cell", "out"))


def spelling_dictionary(lines: DataFrame) -> DataFrame:
    """``(wrong, correct)`` of lines ``(line_no, value)`` with a tab between; the last line of a word wins."""
    parts = F.split("value", "\t", 2)
    both = lines.where(F.col("value").contains("\t")).select(
        "line_no", F.lower(strip(F.get(parts, F.lit(0)))).alias("wrong"), F.lower(strip(F.get(parts, F.lit(1)))).alias("correct")
    )
    return both.where("wrong <> '' and correct <> ''").groupBy("wrong").agg(F.max_by("correct", "line_no").alias("correct"))


def compound_dictionary(lexicon: DataFrame) -> DataFrame:
    """``(squashed, expanded)`` from a lexicon ``word`` with ``_`` for space.

    A compound without its underscores stands for it with spaces, one without
    its hyphens for itself; neither if the squashed form is a word already. If
    both fit, the hyphenated one wins; of several, the last in code-point order.
    """
    words = lexicon.select("word").distinct()
    spaced = words.select(F.replace("word", F.lit("_"), F.lit("")).alias("squashed"), F.replace("word", F.lit("_"), F.lit(" ")).alias("expanded"), F.lit(0).alias("rank"))
    joined = words.select(F.replace("word", F.lit("-"), F.lit("")).alias("squashed"), F.col("word").alias("expanded"), F.lit(1).alias("rank"))
    fresh = spaced.union(joined).join(words.withColumnRenamed("word", "squashed"), "squashed", "left_anti")
    return fresh.groupBy("squashed").agg(F.max(F.struct("rank", "expanded"))["expanded"].alias("expanded"))


def lemmatise(df: DataFrame, columns: list[str], lexicon: DataFrame, exceptions: DataFrame | None = None, substring_hands: bool = False) -> DataFrame:
    """Noun lemma of each cell: the shortest candidate in the lexicon, else the cell itself; null is blank.

    ``exceptions(word, lemma)`` go first. ``men`` becomes ``man`` and ``hands``
    becomes ``hand``; with ``substring_hands`` also inside other words.
    """
    return map_cells(df, columns, lemma_pairs(distinct_cells(df, columns).withColumn("out", F.col("cell")), lexicon, exceptions, substring_hands))


def lemma_pairs(pairs: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None, substring_hands: bool = False) -> DataFrame:
    """``cell, out`` with the lemma of ``out`` in its place (see ``lemmatise``)."""
    words = lexicon.select(F.col("word").alias("__lemma")).distinct()
    tries = pairs.select("cell", F.explode(lemma_candidates(F.col("out"))).alias("__lemma")).join(words, "__lemma", "left_semi")
    found = tries.groupBy("cell").agg(F.min(F.struct(F.length("__lemma").alias("n"), "__lemma"))["__lemma"].alias("__lemma"))
    joined = pairs.join(found, "cell", "left")
    lemma = F.coalesce("__lemma", "out")
    if exceptions is not None:
        known = exceptions.select(F.col("word").alias("__word"), F.col("lemma").alias("__known"))
        joined = joined.join(known, joined["out"] == known["__word"], "left")
        lemma = F.coalesce("__known", lemma)
    return joined.select("cell", _hands(lemma, substring_hands).alias("out"))


def _hands(word: Column, substring: bool) -> Column:
    whole = F.replace(word, F.lit("hands"), F.lit("hand")) if substring else F.when(word == "hands", F.lit("hand")).otherwise(word)
    return F.when(word == "men", F.lit("man")).otherwise(whole)


def subgraph(edges: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Edges with both ends in the lexicon, spaces read as underscores."""
    words = lexicon.select(F.col("word").alias("__w")).distinct()
    out = edges
    for end in ("src", "tgt"):
        out = out.join(words, F.replace(out[end], F.lit(" "), F.lit("_")) == words["__w"], "left_semi")
    return out


def direct_subgraph(edges: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Edges with both ends in the lexicon by any of their noun forms, spaces read as underscores: ``dogs`` by ``dog``.

    Every node is looked up once, however many edges it has.
    """
    words = lexicon.select(F.col("word").alias("form")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct()
    forms = nodes.select("node", F.explode(lemma_candidates(F.replace("node", F.lit(" "), F.lit("_")))).alias("form"))
    kept = Scratch(edges.sparkSession, "nodes").keep(forms.join(words, "form", "left_semi").select("node").distinct(), "nodes")
    out = edges
    for end in ("src", "tgt"):
        out = out.join(kept, out[end] == kept["node"], "left_semi")
    return out


def within_norms(words: DataFrame, length: tuple[int, int] = (4, 9), zipf: tuple[float, float] = (2.5, 5.0)) -> DataFrame:
    """Rows of ``word, zipf`` whose word has letters and hyphens only, and whose length and frequency lie within the bounds."""
    return words.where(F.length("word").between(*length) & F.col("zipf").between(*zipf) & F.col("word").rlike("^[a-zA-Z-]+$"))
