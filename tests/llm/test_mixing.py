from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.llm.mixing import Params, deal, mixed_documents, permute, sizes, taken, targets


def plain_targets(size, weights=(1, 2, 3), most=3):
    """Share by weight, cut at the bound, share the excess again, until nothing is cut."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(most * size[s] for s in full)
        open_ = [s for s in names if s not in full]
        got = {s: most * size[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if got[s] > most * size[s]}
        if not over:
            return got
        full |= over


@pytest.mark.parametrize("size", [{"a": 1000, "b": 10, "c": 5, None: 300}, {"x": 7}, {"a": 0, "b": 9, "c": 1, "d": 2, "é": 500}])
def test_targets(spark, size):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(size.items())]
    df = sizes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {None if r.no_source else r.source: r.target for r in targets(df).collect()}
    want = plain_targets(size)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutation_and_draws():
    for n in (1, 2, 3, 10, 257, 4096):
        out = permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out) == list(range(n))


def test_slots_use_blocks_evenly_and_totals_are_exact():
    p = Params(block=4, shard_slots=10)
    sizes, goals = [30, 0, 400, 7, 3], [90.0, 0.0, 133.4, 16.6, 1.0]
    d = deal(sizes, goals, p)
    s, block, keep = d.slots(np.arange(d.ends[-1]))
    words = defaultdict(Counter)
    for i, j, k in zip(s, block, keep, strict=True):
        words[i].update(range(j * 4, min(j * 4 + k, sizes[i])))
    assert [sum(words[i].values()) for i in range(5)] == [90, 0, 133, 17, 1]
    for i in (0, 2, 3):  # a word is used again only when all are used
        n = [words[i][x] for x in range(sizes[i])]
        assert max(n) - min(n) <= 1 and max(n) <= 3
    shards = [Counter(s[at : at + 10]) for at in range(0, len(s), 10)]
    assert len({tuple(sorted(x.items())) for x in shards}) > 3  # shards vary


def test_taken_is_what_the_slots_hold(spark):
    """Against a plain version: pack, deal and count word by word."""
    p = Params(block=4, shard_slots=5)
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), "ab"[i % 2] if i % 5 else None) for i in range(40)]
    got = {r.doc_id: (r.taken, r.n_shards) for r in taken(spark.createDataFrame(rows, "doc_id long, text string, source string"), p).collect()}
    from lexiweave.llm.mixing import mix
    spans, numbered = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), p)
    order = [(r.doc_id, r.source if not r.no_source else None, r.size) for r in numbered.orderBy("s", "start", "row").collect()]
    size = Counter()
    for _, s, n in order:
        size[s] += n
    goal = plain_targets(size)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    owner = {s: [i for i, t, n in order if t == s for _ in range(n)] for s in names}
    d = deal([size[s] for s in names], [goal[s] for s in names], p)
    want, shards = Counter(), defaultdict(set)
    for t, (s, block, keep) in enumerate(zip(*d.slots(np.arange(d.ends[-1])), strict=True)):
        for i in owner[names[s]][block * 4 : block * 4 + keep]:
            want[i] += 1
            shards[i].add(t // 5)
    assert got == {i: (want[i], len(shards[i])) for i, *_ in rows}


def test_taken_near_target_and_bounded(docs, corpus, spark):
    p = Params(block=4, shard_slots=64)
    out = taken(docs.withColumn("row", F.lit(1)), p).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len((t or "").split())) for i, t, *_ in corpus)
    by, goal = defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source_size] += r.taken
        goal[r.source_size] = r.target
    for s in by:
        assert abs(by[s] - goal[s]) <= 0.5
    again = taken(docs.repartition(5), p).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixed_documents_hold_the_words_taken(docs, corpus, no_docs):
    p = Params(block=4, shard_slots=64)
    out = mixed_documents(docs.withColumn("size", F.lit(1)), p)
    assert out.columns == [*docs.columns, "size"]
    words = defaultdict(int)
    rows = out.collect()
    for r in rows:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    want = defaultdict(int)
    for r in taken(docs, p).collect():
        want[r.doc_id] += r.taken
    assert dict(words) == {k: v for k, v in want.items() if v}
    texts = {(r[0], " ".join((r[1] or "").split())) for r in corpus}
    for r in rows:  # each copy is a subsequence of its text
        assert any(i == r.doc_id and is_subsequence(r.text.split(), t.split()) for i, t in texts)
    assert mixed_documents(no_docs, p).count() == 0 and taken(no_docs, p).count() == 0


def is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)
