"""Comparing edge lists and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct rows on each side, those on one side only, and IDENTICAL or DIFF; nulls are alike, as in ``EXCEPT``."""
    both = left.withColumns({"__l": F.lit(1), "__r": F.lit(0)}).unionByName(right.select(*left.columns).withColumns({"__l": F.lit(0), "__r": F.lit(1)}))
    rows = both.groupBy(*left.columns).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return rows.agg(
        F.count_if(F.col("__l") == 1).alias("n_left"), F.count_if(F.col("__r") == 1).alias("n_right"),
        F.count_if(F.col("__r") == 0).alias("only_left"), F.count_if(F.col("__l") == 0).alias("only_right"),
    ).withColumn("verdict", F.when((F.col("only_left") == 0) & (F.col("only_right") == 0), "IDENTICAL").otherwise("DIFF"))


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """``word, __l, __r``: each word once, with 1 for the sides that have it. Rows are counted down to words before they are shuffled."""
    rows = left.select("word", F.lit(1).alias("__l"), F.lit(0).alias("__r")).union(right.select("word", F.lit(0), F.lit(1)))
    return rows.groupBy("word").agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words of both sides, each once; null is a word like any other."""
    return _sides(left, right).where("__l = 1 and __r = 1").select("word")


def unique(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words of the left side that the right one lacks, each once."""
    return _sides(left, right).where("__r = 0").select("word")
