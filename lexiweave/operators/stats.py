"""Distances, correlations and outliers of weighted edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.text import cosine_distance
from lexiweave.operators.network import vocabulary
from lexiweave.runtime import Scratch, running_total_by_order


def edge_distances(edges: DataFrame, vectors: DataFrame, oov: str = "skip", dim: int | None = None) -> DataFrame:
    """``src, tgt, wt, distance`` (null: no vector) for edges over ``vectors(word, vec)``.

    A word that is missing is looked up with underscores for spaces. Words
    still missing have no vector (``skip``) or the zero vector of ``dim``
    numbers (``zero``), whose distance is 1.
    """
    words = vocabulary(edges).where("word is not null")
    exact = words.join(vectors.select("word", "vec"), "word")
    under = vectors.select(F.col("word").alias("__under"), "vec")
    missed = words.join(vectors.select("word"), "word", "left_anti")
    found = exact.unionByName(missed.join(under, F.replace("word", F.lit(" "), F.lit("_")) == under["__under"]).select("word", "vec"))
    out = edges
    for end in ("src", "tgt"):
        own = found.select(F.col("word").alias(f"__{end}"), F.col("vec").alias(f"__v_{end}"))
        out = out.join(own, out[end] == own[f"__{end}"], "left")
    both = [F.col(f"__v_{end}") for end in ("src", "tgt")]
    if oov == "zero":
        both = [F.coalesce(v, F.array_repeat(F.lit(0.0).cast("float"), dim)) for v in both]
    return out.select("src", "tgt", "wt", F.when(both[0].isNotNull() & both[1].isNotNull(), cosine_distance(*both)).alias("distance"))


def nearest(word: str, vectors: DataFrame) -> DataFrame:
    """``word, distance`` from one word to all; the one vector is a single row."""
    one = vectors.where(F.col("word") == word).limit(1).select(F.col("vec").alias("__v"))
    return vectors.crossJoin(F.broadcast(one)).select("word", cosine_distance(F.col("vec"), F.col("__v")).alias("distance"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            total *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return total


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs: the incomplete beta of the t statistic."""
    if n < 2 or math.isnan(r):
        return math.nan
    if n == 2:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x, a, b = 1 - r * r, df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def average_rank(column: str, out: str, df: DataFrame) -> DataFrame:
    """Rank from 1 by value, ties sharing their mean rank.

    Ranks are running totals of the counts of distinct values, cut into ranges
    of the value, so neither rows nor values pass through one task.
    """
    per = df.groupBy(column).agg(F.count("*").alias("__n"))
    before = running_total_by_order(per, [column], "__before", F.col("__n"))
    ranks = before.select(F.col(column).alias("__v"), (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, df[column] == ranks["__v"]).drop("__v")


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``value``: the exact quantile with linear interpolation; null for no rows. Nulls are left out."""
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    placed = running_total_by_order(per, [column], "__before", F.col("__n"))
    total = placed.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total")).select(((F.col("__total") - 1) * F.lit(q)).alias("__at"))
    holds = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__n")), F.col(column).cast("double")))
    low, high = F.floor("__at"), F.ceil("__at")
    ends = placed.crossJoin(F.broadcast(total)).agg(holds(low).alias("low"), holds(high).alias("high"), F.max(F.col("__at") - low).alias("part"))
    return ends.select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))


def _corr(x: str, y: str):
    """Pearson's r from centred sums; NaN for fewer than two rows or a constant column."""
    fixed = (F.count("*") < 2) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(fixed, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / F.when(spread == 0, None).otherwise(spread))


def correlations(distances: DataFrame) -> DataFrame:
    """``n, pearson_r, spearman_r`` of weight and distance; NaN for fewer than two rows or a constant column."""
    rows = distances.where("distance is not null").select(F.col("wt").cast("double").alias("wt"), F.col("distance").alias("distance"))
    rows = Scratch(rows.sparkSession, "distances").keep(rows, "rows")
    ranked = average_rank("distance", "rank_d", average_rank("wt", "rank_w", rows))
    return ranked.agg(F.count("*").alias("n"), _corr("wt", "distance").alias("pearson_r"), _corr("rank_w", "rank_d").alias("spearman_r"))


def missing_words(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """``word`` of the edges' words that have no vector, nor one with underscores for spaces."""
    words = vocabulary(edges).where("word is not null").withColumn("__under", F.replace("word", F.lit(" "), F.lit("_")))
    known = vectors.select(F.col("word").alias("__known"))
    for name in ("word", "__under"):
        words = words.join(known, words[name] == known["__known"], "left_anti")
    return words.select("word")


def correlation_table(edges: DataFrame, vectors: DataFrame, oov: str = "skip", dim: int | None = None) -> DataFrame:
    """``metric, value``: both correlations with p-values, missing words and edges."""
    distances = Scratch(edges.sparkSession, "distances").keep(edge_distances(edges, vectors, oov, dim), "all")
    missing = missing_words(edges, vectors).count()
    row = correlations(distances).first()
    misses = distances.where("distance is null").count()
    values = [("pearson_r", row["pearson_r"]), ("pearson_p", correlation_p(row["pearson_r"], row["n"])), ("spearman_r", row["spearman_r"]),
              ("spearman_p", correlation_p(row["spearman_r"], row["n"])), ("missing_words", float(missing)), ("missing_edges", float(misses))]
    return distances.sparkSession.createDataFrame(values, "metric string, value double")


def outliers(distances: DataFrame, weight_q: float = 0.9, distance_q: float = 0.9) -> DataFrame:
    """Edges whose weight and distance both reach their quantile (linear interpolation)."""
    rows = Scratch(distances.sparkSession, "distances").keep(distances.where("distance is not null"), "rows")
    cut = quantile(rows, "wt", weight_q).withColumnRenamed("value", "__w").crossJoin(quantile(rows, "distance", distance_q).withColumnRenamed("value", "__d"))
    return rows.join(F.broadcast(cut), (rows["wt"] >= cut["__w"]) & (rows["distance"] >= cut["__d"])).drop("__w", "__d")
