"""Mixing sources to target weights: packed blocks, drawn shards, index permutations.

The words of each source, document after document, are packed into blocks of
``block`` words. Every source has a quota of words, and so of block slots, the
last one perhaps in part. All slots are dealt to output shards without
replacement, by a keyed permutation of their numbers: the counts of the sources
in a shard are a multivariate hypergeometric draw (a multinomial without
replacement), so shards vary and totals are exact. Every slot is drawn where it
is made, by the same rule at every size. A source's n-th slot takes the block
that a pseudorandom permutation of its block numbers gives for n; when all
blocks are used, the next round has another permutation. Blocks are joined to
slots by number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.runtime import Scratch, hash_buckets, running_total

@dataclass(frozen=True)
class Params:
    """``weights`` go to the sources in code-point order, null last, over and over; ``most`` bounds the repeats.

    ``shard_slots`` is the number of slots of an output shard; the last one may have fewer.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block: int = 64
    shard_slots: int = 4096
    seed: int = 20


#: Characters between words: the six ASCII white-space characters.
SPACES = "[\\x20\\x09-\\x0D]+"


def count_words(text: Column) -> Column:
    """Number of runs of characters that are not white space."""
    parts = F.split(text, SPACES)
    ends = (F.get(parts, F.lit(0)) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(parts) - ends).cast("long")


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.crc32(text.cast("binary")))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``tk, doc_id, source, no_source, size`` of every row; a null or empty text has size 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        text_key(text).alias("tk"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("no_source"), count_words(text).alias("size"),
    )


def targets(sized: DataFrame, p: Params = Params()) -> DataFrame:
    """``source, no_source, source_size, weight, target, s``: one row per source, numbered from 0 by ``s``.

    Targets share all words by weight; none is above ``most`` times its
    source's size, and the excess goes to the others by weight. Sources fill up
    in the order of size by weight, so the ones that are full are a prefix.
    """
    by = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("no_source", "source")
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    w = by.withColumn("s", F.row_number().over(order) - 1).withColumn("weight", F.get(weights, F.pmod("s", F.lit(len(p.weights)))))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "no_source", "source")
    everything = Window.partitionBy(F.lit(0))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = w.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        (F.sum("source_size").over(everything) - p.most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("rest"),
        F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights"),
    )
    level = left.withColumn("level", F.col("rest") / F.col("weights")).withColumn("full", F.col("level") * F.col("weight") > p.most * F.col("source_size"))
    # The level that holds is that of the first source that does not fill up.
    ranked = level.withColumn("at", F.row_number().over(ratio))
    first = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(everything)
    return ranked.withColumn("first", first).select(
        "source", "no_source", "source_size", "weight", "s",
        F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), (p.most * F.col("source_size")).cast("double"))
        .otherwise(F.col("first.level") * F.col("weight")).alias("target"),
    )


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 for each row: a Feistel network on the covering square, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
            left, right = x >> h, x & m
            for r in range(4):
                f = (right + k + np.uint64(r * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(31)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Deal:
    """How slots are dealt: for each source its blocks of full length, whether a shorter one ends it, and its quota of words."""

    full: np.ndarray
    size: np.ndarray
    quota: np.ndarray
    params: Params

    @property
    def per_turn(self) -> np.ndarray:
        return -(-self.size // self.params.block)

    @property
    def ends(self) -> np.ndarray:
        """Number of the first slot after each source's."""
        turns, rest = np.divmod(self.quota, np.maximum(self.size, 1))
        return np.cumsum(turns * self.per_turn + -(-rest // self.params.block))

    def slots(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source, block and number of words of the slots ``t``, counted over all shards."""
        ends, p = self.ends, self.params
        x = permute(t, np.full(len(t), ends[-1]), np.full(len(t), p.seed, np.uint64))
        s = np.searchsorted(ends, x, "right")
        nth = x - np.concatenate([[0], ends[:-1]])[s]
        turn, at = np.divmod(nth, self.per_turn[s])
        with np.errstate(over="ignore"):
            key = (s.astype(np.uint64) * np.uint64(1_000_003) + turn.astype(np.uint64) + np.uint64(p.seed)) * np.uint64(0xD6E8FEB86659FD93)
        inner = at < self.full[s]
        block = at.copy()
        block[inner] = permute(at[inner], self.full[s][inner], key[inner])
        left = self.quota[s] - turn * self.size[s] - at * p.block
        return s, block, np.minimum(left, p.block)


def deal(sizes: list[int], goals: list[float], p: Params) -> Deal:
    size = np.array(sizes, np.int64)
    quota = np.minimum(np.floor(np.array(goals, float) + 0.5).astype(np.int64), p.most * size)
    return Deal(size // p.block, size, quota, p)


def mix(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Spans of the mix and the documents.

    Returns ``spans(row, shard, slot, from_word, to_word)``, one row for each
    piece of a document in a taken slot (words counted from 0, the end left
    out; a source's pieces add up to its target, rounded), and ``rows(row, doc_id, source, no_source, size, source_size,
    target)``, one per input row. ``row`` numbers the rows in an order that
    depends on their ids and texts alone, so a rerun gives the same mix. Rows
    that repeat an id are rows of their own; a null source is a source, the
    last one. No word is taken more than ``most`` times. An empty table gives
    no spans.
    """
    spark, p = docs.sparkSession, params
    scratch = Scratch(spark, "mixing")
    narrow = scratch.keep(sizes(docs, id_col, text_col, source_col), "sizes")
    goal = scratch.keep(targets(narrow, p), "targets")
    n = narrow.count()
    ordered = running_total(narrow, group=[], buckets={"h": F.pmod(F.xxhash64("doc_id", "tk"), F.lit(hash_buckets(n)))}, order=["doc_id", "tk"], out="row")
    placed = running_total(
        ordered, group=["no_source", "source"], buckets={"h": F.pmod(F.xxhash64("doc_id", "tk"), F.lit(hash_buckets(n)))},
        order=["doc_id", "tk", "row"], out="start", value=F.col("size"),
    )
    rows = scratch.keep(
        placed.join(goal, ["no_source", "source"]).select("row", "doc_id", "tk", "source", "no_source", "s", "size", "start", "source_size", "target"), "rows",
    )
    each = goal.orderBy("s").select("source_size", "target").collect()  # one row a source
    dealt = deal([r["source_size"] for r in each], [r["target"] for r in each], p)
    total = int(dealt.ends[-1]) if each else 0

    @F.pandas_udf("s int, block long, keep long")
    def drawn(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("s", "block", "keep"), dealt.slots(t.to_numpy()), strict=True)))

    slots = spark.range(total).select(F.expr(f"id div {p.shard_slots}").alias("shard"), F.expr(f"id % {p.shard_slots}").alias("slot"), drawn("id").alias("x")).select("shard", "slot", "x.*")
    b = F.lit(p.block).cast("long")
    pieces = rows.where("size > 0").select(
        "row", "s", "start", "size", F.explode(F.sequence(F.expr(f"start div {p.block}"), F.expr(f"(start + size - 1) div {p.block}"))).alias("block")
    )
    # Slots grow with the input, though the plan takes them for as few as the numbers they are made of.
    met = pieces.join(slots.hint("merge"), ["s", "block"])
    spans = met.select(
        "row", "shard", "slot", (F.greatest("start", F.col("block") * b) - F.col("start")).alias("from_word"),
        (F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("keep")) - F.col("start")).alias("to_word"),
    ).where("from_word < to_word")
    return spans, rows


def taken(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, n_shards, first_shard`` of every row.

    ``taken`` is how many of its words the mix takes, repeats counted;
    ``n_shards`` and ``first_shard`` tell into which output shards they were
    drawn (0 and null, if none are taken).
    """
    spans, rows = mix(docs, params)
    got = spans.groupBy("row").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.size(F.collect_set("shard")).alias("n_shards"), F.min("shard").alias("first_shard")
    )
    return rows.join(got, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"), "first_shard"
    )


def mixed_documents(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document whose words are taken up to c times comes as up to c rows: the
    k-th holds, in order, its words that are taken k times or more, and the
    text as it is if that is all of them. Documents of which nothing is taken
    do not appear. ``n_chars``, if there, is that of the new text.
    """
    spans, rows = mix(docs, params)
    # A block's piece is taken ``most`` times at most, once perhaps in part; the longest go to the first copies.
    ends = spans.groupBy("row", "from_word").agg(F.sort_array(F.collect_list("to_word"), asc=False).alias("ends"))
    copies = ends.select("row", "from_word", F.posexplode("ends").alias("__copy", "to_word"))
    parts = copies.groupBy("row", "__copy").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("__spans"))
    # Rows that repeat an id and a text are told apart by number, on both sides; the order of ``docs``' is by their other columns.
    again = Window.partitionBy("doc_id", "tk").orderBy("row")
    plan = parts.join(rows.select("row", "doc_id", "tk", "size", F.row_number().over(again).alias("nth")), "row").select(
        F.col("doc_id").alias("__id"), F.col("tk").alias("__tk"), F.col("nth").alias("__nth"), "__copy", "__spans", F.col("size").alias("__size")
    )
    own = docs.withColumn("__tk0", text_key(F.coalesce(F.col("text"), F.lit(""))))
    own = own.withColumn("__nth0", F.row_number().over(Window.partitionBy("doc_id", "__tk0").orderBy(F.xxhash64(*docs.columns))))
    joined = own.join(plan, own["doc_id"].eqNullSafe(plan["__id"]) & (own["__tk0"] == plan["__tk"]) & (own["__nth0"] == plan["__nth"]))
    body = F.expr("aggregate(__spans, 0L, (n, x) -> n + x.to_word - x.from_word)")
    words = F.filter(F.split(F.col("text"), SPACES), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("__spans", lambda x: F.slice(F.col("__words"), (x["from_word"] + 1).cast("int"), (x["to_word"] - x["from_word"]).cast("int")))), " ")
    out = joined.withColumn("__all", body == F.col("__size")).withColumn("__words", F.when(~F.col("__all"), words)).withColumn(
        "text", F.when(F.col("__all"), F.col("text")).otherwise(cut)
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
