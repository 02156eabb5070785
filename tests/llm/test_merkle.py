"""Merkle manifests against a plain tree of whole lists."""

import hashlib
import random
import zlib

import pytest

from lexiweave.llm import merkle
from tests.llm.conftest import DOCS

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """All levels of a tree, from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i // 8 * 8
        out.append((nodes[start:i], nodes[i + 1 : start + 8]))
        i //= 8
    return out


def plain(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low(r[1]))))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: tree([x[2] for x in sorted(groups[n])]) for n in names}
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for g, n in enumerate(names):
        for i, (known, doc_id, own, other) in enumerate(sorted(groups[n])):
            steps = path(trees[n], i) + path(top, g)
            tampered = known and zlib.crc32(str(doc_id).encode()) % 3 == 0
            node = other if tampered else own
            for before, after in steps:
                node = H(*before, node, *after)
            out.append((doc_id if known else None, own, trees[n][-1][0], top[-1][0], H(*[x for b, a in steps for x in (*b, *a)]), node, node == top[-1][0]))
    return out


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512])
def test_traversal_of_one_block(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]
    for i, steps in enumerate(merkle.traverse(leaves, len(levels) - 1)):
        assert steps == [("".join(b), "".join(a)) for b, a in path(levels, i)]
        assert merkle.fold(leaves[i], steps) == levels[-1][0]


def test_the_stack_stays_small():
    trees = merkle.Treehash(3)
    for i in range(511):
        trees.feed(H(str(i)))
        assert sum(map(len, trees.open)) <= 8 * 4


def test_odd_rows(spark, corpus):
    """Nulls in all columns, repeated rows, empty texts, one language per group of few rows."""
    check(spark, [*corpus, (None, None, None, None, None), (None, "A", None, None, None), (None, "A", None, None, None), (10**12, "Ä" * 70000 + "B", "fr", "x", 1), (-(2**63), "Q", "zz", None, None)])


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(None, None, None, None, None)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_more_than_one_level_above_the_blocks(spark):
    rng = random.Random(3)
    rows = [(i, f"Text {rng.random()}", "en" if i % 50 else f"l{i % 450}", "s", i) for i in range(5200)]
    rng.shuffle(rows)
    check(spark, rows)


def test_one_id_in_every_row_and_other_columns(spark):
    rows = [(7, f"t{i % 5}", None, None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as name", "1 as at", "2 as n", "3 as rows", "'y' as leaf", "true as known", "0 as count", "0 as salt")
    assert sorted(map(repr, map(tuple, merkle.manifest(docs).collect()))) == sorted(map(repr, plain(rows)))
