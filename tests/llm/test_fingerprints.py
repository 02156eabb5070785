import hashlib
import random
from collections import Counter

import numpy as np

from lexiweave.llm.fingerprints import Params, _mix, anchors, code_points, edited, fingerprint_documents, likeness, parse, render, syncmers


def test_followers_and_edits(docs, corpus, spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    got = Counter(map(tuple, fingerprint_documents(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered = sorted(corpus, key=lambda r: (r[0], r[1] or ""))
    want = Counter()
    for x, y in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, follower = x[1] or "", y[1] or ""
        q = len(text) // 4
        new = text[: len(text) - q] + follower[:q]
        assert new == edited(text, follower)
        mine, theirs, other = (anchors(code_points(t)) for t in (text, new, follower))
        want[x[0], len(text), hashlib.sha256(new.encode()).hexdigest(), render(mine), render(theirs), likeness(mine, theirs), likeness(mine, other)] += 1
    assert got == want


def test_one_row_and_none(spark, no_docs):
    assert fingerprint_documents(no_docs).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(7, hashlib.sha256(b"abca").hexdigest())]


def test_syncmers_match_their_definition():
    rng, p = random.Random(1), Params()
    text = "".join(rng.choices("abcde ", k=400))
    points = code_points(text)
    with np.errstate(over="ignore"):
        inner = []
        for i in range(len(points) - p.s + 1):
            h = np.zeros(1, np.uint32)
            for x in points[i : i + p.s]:
                h = h * np.uint32(0x9E3779B1) + x
            inner.append(int(_mix(h)[0]))
    w = p.k - p.s + 1
    want = [i for i in range(len(text) - p.k + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])]
    h, at = syncmers(points, p)
    assert at.tolist() == want
    named = {}
    for x, i in zip(h.tolist(), at.tolist(), strict=True):
        assert named.setdefault(text[i : i + p.k], x) == x


def test_likeness_orders_copies_edits_and_strangers():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    a, b = (" ".join(rng.choices(words, k=300)) for _ in range(2))
    f = lambda t: parse(render(anchors(code_points(t))))
    assert likeness(f(a), f(a)) == 1 and likeness(f(""), f("")) == 1 and likeness(f(""), f(a)) == 0
    assert likeness(f(a), f(edited(a, b))) > 0.4 > 0.2 > likeness(f(a), f(b))


def test_null_ids_come_before_the_least_id(spark):
    rows = [(-(2**63), "aaaa bbbb"), (None, "cccc dddd"), (2**63 - 1, "eeee ffff"), (None, None)]
    got = fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(None, sha("")), (None, sha("cccc ddaa")), (-(2**63), sha("aaaa bbee")), (2**63 - 1, sha("eeee ff"))]
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
