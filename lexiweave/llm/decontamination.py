"""Benchmark decontamination with DataFrame functions only.

The hashes of all benchmark windows are a broadcast hash set; the windows of a
text are tested against it as they are cut, and only hits leave the task, with
their words. Each hit is then verified word by word against the benchmark. A
benchmark of more than ``SET_ROWS`` windows is several sets, one after another,
so what is broadcast at a time is bounded, whatever the benchmark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.runtime import Scratch

#: Characters that separate words: all of ASCII but digits and lower-case letters.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Window hashes in one broadcast set, 8 bytes each and about three times that in the hash table.
SET_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Words of a text with only A-Z lower-cased; none for a null text."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def windows_of(items: DataFrame, size: int, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, len, window, hash)`` of every window: ``size`` words, or all words of a shorter item."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    sized = w.select("item_id", "w", F.least(F.size("w"), F.lit(size)).alias("len"))
    out = sized.select("item_id", "len", F.explode_outer(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("ws"))
    return out.select("item_id", "len", F.array_join("ws", " ").alias("window"), F.xxhash64("ws").alias("hash")).distinct()


def _places(size: int) -> Column:
    """Starts, from 1, of the runs of ``size`` words in ``w``."""
    return F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))


def _run(i: Column, size: int | Column) -> Column:
    return F.slice(F.col("w"), i, size)


def _hits(base: DataFrame, known: DataFrame, lengths: list[int], rows: bool) -> DataFrame:
    """``doc_id, tk, n_words, at, len, window`` of the runs of ``w`` whose hash is in the broadcast table ``known(hash)``.

    With ``rows`` also one row with ``at`` 0 for each input row. The runs are
    cut as (place, length, hash); the words of a run are put together only
    behind the join, in the same code-generated stage, so for hits alone.
    """
    def runs(size: int) -> Column:
        return F.transform(_places(size), lambda i: F.struct(i.alias("at"), F.lit(size).alias("len"), F.xxhash64(_run(i, size)).alias("hash")))

    row = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("hash")))
    cut = base.select("doc_id", "tk", "w", F.concat(*([row] if rows else []), *map(runs, lengths)).alias("runs"))
    # Outer, as Spark would else test the size of the runs below, with the words cut anew for each run.
    each = cut.select("doc_id", "tk", "w", F.inline_outer("runs")).where("at is not null")
    mark = F.broadcast(known.select(F.col("hash").alias("known")))
    tested = each.join(mark, each["hash"] == mark["known"], "left").where("at = 0 or known is not null")
    return tested.select("doc_id", "tk", F.size("w").cast("long").alias("n_words"), "at", "len", F.when(F.col("at") > 0, F.array_join(_run(F.col("at"), F.col("len")), " ")).alias("window"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", set_rows: int = SET_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, ``spans`` and ``tk``.

    ``spans`` lists the hit word ranges (first and last word, from 1), merged
    where they touch or overlap; ``tk`` is a hash of the text. Null, empty and
    word-less texts have no words and no hits; items without words have no
    window; repeated items and null item ids count by their id as text (null:
    not counted). Rows that repeat an id and a text have the same result.
    Either table may be empty; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tk"), words(text).alias("w"))
    windows = scratch.keep(windows_of(benchmark, size), "windows")
    known = windows.select("len", "hash").distinct()
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect())
    hashes = scratch.keep(known.select("hash").distinct(), "hashes")
    sets = max(1, -(-hashes.count() // set_rows))
    tested = [_hits(base, hashes.where(F.pmod("hash", F.lit(sets)) == k), lengths, k == 0) for k in range(sets) if lengths or k == 0]
    own = scratch.keep(reduce(DataFrame.unionByName, tested), "rows")
    runs = own.where("at > 0").select(F.struct("doc_id", "tk").alias("row"), "at", "len", "window")
    found = runs.join(windows.select("len", "window", "item_id"), ["len", "window"]).select("row", "at", "len", "item_id")
    # One row per place first: however many items share a passage, a place counts once.
    spot = found.select("row", "at", (F.col("at") + F.col("len") - 1).alias("to")).distinct()
    w = Window.partitionBy("row").orderBy("at", "to")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = spot.withColumn("new", (F.coalesce(reach, F.lit(-1)) + 1 < F.col("at")).cast("int"))
    spans = starts.withColumn("span", F.sum("new").over(w)).groupBy("row", "span").agg(F.min("at").alias("from"), F.max("to").alias("to"))
    per_row = spans.groupBy("row").agg(
        F.sum(F.col("to") - F.col("from") + 1).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans")
    )
    items = found.select("row", "item_id").distinct().groupBy("row").agg(
        F.count("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items")
    )
    marks = per_row.join(items, "row").select(
        F.col("row.doc_id").alias("__id"), F.col("row.tk").alias("__tk"), "n_hit", "n_items", "items", "spans"
    ).distinct()
    own = own.where("at = 0").select("doc_id", "tk", "n_words")
    return own.join(marks, own["doc_id"].eqNullSafe(marks["__id"]) & (own["tk"] == marks["__tk"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"), "tk",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit; columns as they came."""
    bad = scan(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__tk"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with the hit words taken out of ``text``; texts without a hit stay as they are.

    A text with hits is returned as its remaining lower-cased words, separated by single spaces.
    """
    hit = scan(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk"), F.col("spans").alias("__spans")).distinct()
    kept = F.expr("array_join(filter(__w, (x, i) -> not exists(__spans, s -> i + 1 between s.`from` and s.`to`)), ' ')")
    joined = docs.join(hit, docs["doc_id"].eqNullSafe(hit["__id"]) & (F.xxhash64(docs["text"]) == hit["__tk"]), "left")
    return joined.withColumn("__w", words(F.col("text"))).withColumn("text", F.when(F.col("__spans").isNotNull(), kept).otherwise(F.col("text"))).select(*docs.columns)
