import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexiweave.llm.sharding import cut_groups, shard_documents


def test_counts_slots_and_groups(docs, corpus):
    out = shard_documents(docs.withColumn("shard", F.lit("x")).withColumn("node", F.lit(1)), 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus
    )
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(by) == [0, 1, 2, 3]
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_links_meet_in_one_shard(docs):
    placed = shard_documents(docs, 4)
    groups = cut_groups(placed).collect()
    # Every group fits a shard here, so propagation must bring nearly all of them together.
    assert sum(g.shards > 1 for g in groups) <= 1 and len(groups) >= 4


def test_a_group_larger_than_a_shard_is_split_and_kept(spark):
    rows = [(i, "same" if i < 60 else f"t{i}") for i in range(90)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(out) == 90 and sorted(Counter(r.shard for r in out).values()) == [22, 22, 23, 23]
    assert len({r.shard for r in out if r.doc_id < 60}) == 3


def test_groups_meet_where_no_place_is_free(spark):
    """Every row is linked: all pairs, a few huge groups, and large groups beside pairs."""
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = shard_documents(table([f"t{i // 2}" for i in range(400)]), 4)
    assert sorted(Counter(r.shard for r in pairs.collect()).values()) == [100] * 4
    assert sum(g.shards > 1 for g in cut_groups(pairs).collect()) <= 3
    huge = shard_documents(table([f"t{i % 4}" for i in range(96)]), 16)
    assert [g.shards for g in cut_groups(huge).collect()] == [4] * 4
    mixed = shard_documents(table([f"t{i % 3}" if i < 6000 else f"u{i // 2}" for i in range(6400)]), 4)
    groups = cut_groups(mixed).collect()
    assert sum(g.shards > 1 for g in groups if g.members == 2) <= 3 and len(groups) == 203
    assert all(g.shards <= 3 for g in groups) and sorted(Counter(r.shard for r in mixed.collect()).values()) == [1600] * 4


def test_empty_and_repeatable(no_docs, docs):
    assert shard_documents(no_docs, 4).count() == 0
    assert sorted(shard_documents(docs, 4).select("doc_id", "shard", "slot").collect()) == sorted(
        shard_documents(docs.repartition(3), 4).select("doc_id", "shard", "slot").collect()
    )
