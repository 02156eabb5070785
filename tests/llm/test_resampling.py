"""Resampling against plain counts of all n-grams."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiweave.llm import resampling
from lexiweave.llm.resampling import Params
from tests.llm.conftest import DOCS

ITEMS = "item_id long, text string"


def grams(text, max_n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(rows, items, p):
    bucket = lambda g: zlib.crc32(g.encode()) % p.buckets
    own = [(r[0], *grams(r[1], p.max_n)) for r in rows]
    s = Counter(bucket(g) for _, _, gs in own for g in gs)
    t = Counter(bucket(g) for _, text in items for g in grams(text, p.max_n)[1])
    n, total_s, total_t = p.buckets, sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + n) / ((s[b] + 1) * (total_t + n))))
    out = []
    for doc_id, w, gs in own:
        weight = sum(gain(bucket(g)) for g in gs)
        out.append([doc_id, len(gs), weight, weight + resampling.luck(doc_id, p.seed), None, len(w)])
    fit = sorted((r for r in out if r[5] >= p.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: p.percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def got(spark, rows, items, p):
    out = resampling.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), p)
    return sorted(map(repr, map(tuple, out.select("doc_id", "n_features", "weight", "score", "rank").collect())))


@pytest.mark.parametrize("p", [Params(), Params(max_n=3, buckets=97, percent=35, least_words=2), Params(max_n=2, buckets=70_000, seed="x")])
def test_against_plain_counts(spark, corpus, p, monkeypatch):
    rows = [*corpus, (None, "no id but words " * 9, None, None, 1), (None, None, None, None, None), (10**9, "long Text ÄÖ 1a " * 60_000, "en", "a", 1)]
    items = [(1, corpus[1][1]), (2, None), (None, "x y"), (2, "x y")]
    assert got(spark, rows, items, p) == plain(rows, items, p)


def test_empty_tables(spark, corpus):
    assert got(spark, [], [], Params()) == []
    assert got(spark, corpus[:9], [], Params(percent=50)) == plain(corpus[:9], [], Params(percent=50))
    assert resampling.score(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], ITEMS)).count() == 0


def test_other_columns_and_drawn_rows(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS).selectExpr("*", "1 as rank", "2 as score", "'t' as tk", "3 as bucket", "4 as weight", "5 as n_words")
    items = spark.createDataFrame([(1, corpus[1][1])], ITEMS).selectExpr("*", "9 as doc_id")
    p = Params(percent=30)
    drawn = resampling.resample(docs, items, p)
    assert drawn.columns == docs.columns
    ranks = resampling.score(docs, items, p).where("rank is not null")
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in ranks.collect()} and ranks.count() == sum(len(grams(r[1], 1)[0]) >= 20 for r in corpus) * 30 // 100


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_runs_of_the_suffix_array(texts, max_n):
    flat, counts = resampling.block_buckets([[w.encode() for w in t] for t in texts], max_n, 1009)
    want = [Counter(zlib.crc32(" ".join(t[i : i + n]).encode()) % 1009 for n in range(1, max_n + 1) for i in range(len(t) - n + 1)) for t in texts]
    ends = np.cumsum([0, *counts])
    assert [Counter(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)] == want
