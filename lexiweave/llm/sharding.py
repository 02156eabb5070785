"""Balanced label propagation: linked documents start and move together, under quotas."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.runtime import Scratch, hash_buckets, running_total


def quotas(rows: int, n_shards: int) -> list[int]:
    """Rows for each shard, at most one apart."""
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


#: Links of more than this part of all nodes are heavy; there are at most so many of them.
HEAVY = 4096


def _by_link(rows: DataFrame, table: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` joined to ``table`` on ``link``; what the ``heavy`` links have in the table, a few rows each, goes to their rows by broadcast."""
    some = F.broadcast(heavy)
    many = rows.join(some, "link", "left_semi").join(F.broadcast(table.join(some, "link", "left_semi")), "link")
    return many.unionByName(rows.join(some, "link", "left_anti").join(table, "link"))


def _pairs(spark, values: list[int], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(int, values))), f"shard int, {name} long")


def _filled(sizes: list[int]):
    """The shard of a ``place`` when shards of these sizes are filled one after another."""
    shard = F.lit(len(sizes) - 1)
    for s in reversed(range(len(sizes))):
        shard = F.when(F.col("place") < sum(sizes[: s + 1]), F.lit(s)).otherwise(shard)
    return shard.cast("int")


def _start(live: DataFrame, n_shards: int, scratch: Scratch) -> DataFrame:
    """``node, shard`` of linked nodes, dealt evenly, the members of a node's smallest link one after another."""
    by = live.groupBy("node").agg(F.min(F.struct("members", "link")).alias("by")).select("node", "by.link", "by.members")
    by = scratch.keep(by, "by")
    linked = by.count()
    large = F.col("members") > 1024
    placed = running_total(
        by, group=[],
        buckets={
            "link": F.pmod(F.xxhash64("link"), F.lit(hash_buckets(linked))),
            "large": F.when(large, F.xxhash64("link")).otherwise(F.lit(0).cast("long")),
            "part": F.when(large, F.pmod("node", (F.col("members") / 1024).cast("long"))).otherwise(F.lit(0).cast("long")),
        },
        order=["link", "node"], out="place",
    )
    return placed.select("node", _filled(quotas(linked, n_shards)).alias("shard"))


def propagate(nodes: DataFrame, links: DataFrame, n_shards: int, rounds: int | None = None) -> DataFrame:
    """Place nodes 0..n-1 into shards whose row counts are at most one apart.

    ``nodes(node)`` holds the numbers 0..n-1 once each; ``links(node, link)``
    joins nodes that name the same link. Linked nodes are dealt evenly over the
    shards in the order of their links, so where each node has one link, at most
    ``n_shards - 1`` links that fit a shard start cut, room or none. In each
    round every link counts its members in each
    shard, every node sums these votes over its links and asks for the shard
    with the most votes that has room; a target takes requests, link by link,
    up to its quota. Nodes without a link fill what is left. Rounds end when
    nothing moves, or when the number of moves has had no new low for more
    than ``n_shards`` rounds (nodes of several links may go to and fro), or
    after ``rounds`` if given. Returns ``(node, shard, linked)``.

    A link may hold any share of the nodes: its votes are one row per shard,
    those of heavy links are broadcast to the members instead of the members
    being brought together, and the members that ask for a full shard ask for another one next time.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "sharding")
    n = nodes.count()
    quota = quotas(n, n_shards)
    sizes = links.groupBy("link").agg(F.count("*").alias("members")).where("members > 1")
    sizes = scratch.keep(sizes, "sizes")
    heavy = scratch.keep(sizes.where(F.col("members") > n / HEAVY).select("link"), "heavy")
    live = scratch.keep(_by_link(links, sizes, heavy).select("node", "link", "members").distinct(), "links")
    state = scratch.keep(_start(live, n_shards, scratch), "start")
    n_buckets = hash_buckets(state.count())
    fewest, since = n + 1, 0
    for turn in count() if rounds is None else range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [quota[s] - load.get(s, 0) for s in range(n_shards)]
        if not load:
            break
        votes = (
            live.join(state, "node").groupBy("link", "shard").agg(F.count("*").alias("votes"))
            .select("link", F.col("shard").alias("target"), (F.col("votes") + F.pmod(F.xxhash64("link", "shard"), F.lit(1 << 20)) / F.lit(float(1 << 21))).alias("votes"))
        )
        asked = (
            _by_link(live, votes, heavy).groupBy("node", "target")
            .agg(F.sum("votes").alias("votes"), F.min(F.struct("members", "link")).alias("by"))
            .join(F.broadcast(_pairs(spark, room, "room").withColumnRenamed("shard", "target")), "target")
            .join(state, "node").where("room > 0 or target = shard")
            .groupBy("node").agg(
                F.max(F.struct("votes", "target", "room", "by")).alias("best"), F.first("shard").alias("shard")
            )
            .where("best.target <> shard")
            .select("node", F.col("best.target").alias("target"), F.col("best.room").alias("room"), F.col("best.by.link").alias("link"), F.col("best.by.members").alias("members"))
        )
        ranked = running_total(
            asked, group=["target"],
            buckets={
                "link": F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(n_buckets)),
                "part": F.pmod("node", F.greatest(F.lit(1).cast("long"), (F.col("members") / 1024).cast("long"))),
            },
            order=["link", "node"], out="place",
        )
        moved = ranked.where("place < room").select("node", F.col("target").alias("moved_to"))
        step = scratch.keep(
            state.join(moved, "node", "left").select(
                "node", F.coalesce("moved_to", "shard").alias("shard"), F.col("moved_to").isNotNull().alias("moved")
            ), "round",
        )
        moves = step.where("moved").count()
        scratch.drop(state)
        state = step.select("node", "shard")
        state._lexiweave_path = step._lexiweave_path
        fewest, since = (moves, 0) if moves < fewest else (fewest, since + 1)
        if not moves or since > n_shards:
            break
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = [quota[s] - load.get(s, 0) for s in range(n_shards)]
    loose = running_total(
        nodes.join(state, "node", "left_anti"), group=[],
        buckets={"node": F.pmod(F.xxhash64("node"), F.lit(hash_buckets(n)))}, order=["node"], out="place",
    )
    return state.select("node", "shard", F.lit(True).alias("linked")).unionByName(
        loose.select("node", _filled(free).alias("shard"), F.lit(False).alias("linked"))
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard documents so that equal texts meet and row counts are at most one apart.

    Returns one row per input row: ``doc_id, size, text_crc32, law, shard,
    slot, grown_shard`` and ``linked``. ``size`` is the UTF-8 length plus 1, so
    1 for a null or empty text; both have the CRC of no bytes and count as
    equal texts. ``slot`` numbers a shard's rows from 0 without gaps. Repeated
    rows, null ids and ties are separate rows; an empty table gives an empty
    result; other columns of the input are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.crc32(text.cast("binary")), F.octet_length(text)).alias("link"),
    )
    rows = scratch.keep(rows, "rows")
    buckets = hash_buckets(rows.count())
    numbered = scratch.keep(
        running_total(rows, group=[], buckets={"id": F.pmod(F.xxhash64("doc_id", "link"), F.lit(buckets))}, order=["doc_id", "link"], out="node"),
        "numbered",
    )
    scratch.drop(rows)
    placed = propagate(numbered.select("node"), numbered.select("node", "link"), n_shards, rounds)
    return running_total(
        numbered.join(placed, "node"), group=["shard"],
        buckets={"id": F.pmod(F.xxhash64("node"), F.lit(max(16, buckets // n_shards)))}, order=["node"], out="slot",
    ).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "linked",
    )


def cut_groups(placed: DataFrame, key: str = "text_crc32") -> DataFrame:
    """How many shards each group of equal keys touches, for groups of two rows or more."""
    return placed.groupBy(key).agg(F.count("*").alias("members"), F.countDistinct("shard").alias("shards")).where("members > 1")


__all__ = ["cut_groups", "propagate", "quotas", "shard_documents"]
