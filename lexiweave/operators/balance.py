"""Sampling, capping, padding and ordering, all decided by a hash and so repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.runtime import running_total, running_total_by_order


def draw_key(seed: int, *parts: str | Column) -> Column:
    """A pseudorandom text by seed and row; equal in every run and engine."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def cap_per_cue(rows: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` rows of each cue in the given order."""
    w = Window.partitionBy("cue").orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def cap_and_renumber(rows: DataFrame, n: int, position: str) -> DataFrame:
    """Cues with ``n`` rows or more, their first ``n`` by position, trials renumbered from 0."""
    enough = rows.groupBy("cue").agg(F.count("*").alias("__n")).where(F.col("__n") >= n).select("cue")
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("cue").orderBy(position))).where(F.col("__rn") <= n)
    return ranked.join(enough, "cue", "left_semi").withColumn("trial", (F.col("__rn") - 1).cast("int")).drop("__rn")


def balance(rows: DataFrame, cues: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """Exactly ``n`` rows ``cue, R1, R2, R3`` for each cue of ``cues``; other cues go.

    A cue with more rows keeps those with the smallest draw keys, one with
    fewer is filled up with blank rows, an absent one is all blank. Each cue
    has ``n`` places, and the drawn rows are joined to theirs.
    """
    w = Window.partitionBy("cue").orderBy(draw_key(seed, "cue", *key), *key)
    drawn = rows.select("cue", "R1", "R2", "R3", F.row_number().over(w).alias("__rn")).where(F.col("__rn") <= n)
    places = cues.select("cue").distinct().select("cue", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("__rn"))
    return places.join(drawn, ["cue", "__rn"], "left").select("cue", *[F.coalesce(r, F.lit("")).alias(r) for r in ("R1", "R2", "R3")])


def align(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows ``cue, trial, responses`` per cue present; fillers take the next trial numbers and no responses.

    The rows are read and shuffled once: the last drawn row of a cue brings its fillers.
    """
    w = Window.partitionBy("cue").orderBy(draw_key(seed, "cue", "trial"), "trial")
    drawn = rows.select("cue", "trial", "responses", F.row_number().over(w).alias("__rn")).where(F.col("__rn") <= n)
    have = drawn.withColumn("__n", F.count("*").over(Window.partitionBy("cue")).cast("int"))
    own = F.array(F.struct("trial", "responses"))
    empty = F.array().cast(rows.schema["responses"].dataType)
    fill = F.transform(F.sequence(F.col("__n"), F.lit(n - 1)), lambda t: F.struct(t.cast(rows.schema["trial"].dataType).alias("trial"), empty.alias("responses")))
    last = (F.col("__rn") == F.col("__n")) & (F.col("__n") < n)
    return have.select("cue", F.explode(F.when(last, F.concat(own, fill)).otherwise(own)).alias("__row")).select("cue", "__row.trial", "__row.responses")


def sample_cues(cues: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows of ``(pos, cue)`` by draw key; all of them if there are no more."""
    return cues.orderBy(draw_key(seed, "cue", "pos"), "pos").limit(k)


def master_order(cues: DataFrame, seed: int) -> DataFrame:
    """``(position, cue)``: a seeded shuffle of ``(pos, cue)``, numbered from 0.

    The draw keys are evenly spread hex digits, so their first four cut the order into buckets.
    """
    keyed = cues.select("pos", "cue", draw_key(seed, "cue", "pos").alias("__draw"))
    placed = running_total(keyed, group=[], buckets={"draw": F.substring("__draw", 1, 4)}, order=["__draw", "pos"], out="position")
    return placed.select("position", "cue")


def cue_window(ordered: DataFrame, start: int, count: int) -> DataFrame:
    """Rows with position in ``[start, start + count)``; a negative start is 0, no count is none."""
    start = max(0, start)
    return ordered.where((F.col("position") >= start) & (F.col("position") < start + max(0, count)))


def first_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The row with the smallest position of each key; null and empty keys go."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.where((F.col(key).isNotNull()) & (F.col(key) != "")).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def chunks(rows: DataFrame, size: int, order: str) -> DataFrame:
    """``(chunk, n, first_id, last_id)``: the ordered ids cut into chunks of ``size`` (1, if not positive)."""
    size = max(1, size)
    placed = running_total_by_order(rows.select(order), [order], "__at")
    return placed.groupBy(F.expr(f"__at div {size}").alias("chunk")).agg(F.count("*").alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id"))


def open_slots(chunked: DataFrame, open_now: int, most: int) -> DataFrame:
    """The chunks that may be submitted now: as many of the first ones as there are slots free."""
    return chunked.where(F.col("chunk") < max(0, most - open_now))


def balance_class(rows: DataFrame, cues: DataFrame, n: int) -> DataFrame:
    """``cue, n, class`` of every cue of ``cues``: over, exact or under ``n`` rows, or missing."""
    have = rows.groupBy("cue").agg(F.count("*").alias("n"))
    placed = cues.select("cue").distinct().join(have, "cue", "left").select("cue", F.coalesce("n", F.lit(0)).alias("n"))
    return placed.withColumn("class", F.when(F.col("n") > n, "over").when(F.col("n") == n, "exact").when(F.col("n") > 0, "under").otherwise("missing"))
