import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lexiweave.llm.decontamination import drop_contaminated, remove_spans, scan

ITEMS = [(1, "Ab cd, EF gh ij kl mn op qr st uv wx"), (2, "short Äitem é"), (3, None), (4, "!!"), (30, "cd ef gh ij kl mn op qr st uv"), (30, "short äitem é"), (5, "x1")]


def split(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc_id, text, items):
    w, hit, got = split(text), set(), set()
    for item, t in items:
        b = split(t)
        n = min(10, len(b))
        for j in range(len(b) - n + 1 if b else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    hit |= set(range(i, i + n))
                    got.add(str(item))
    return (doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))


DOCS = [
    (1, "zz ab CD ef-gh ij kl mn op qr st uv wx yy"), (2, None), (3, ""), (4, "cd ef gh ij kl mn op qr st uv"), (5, "a short äitem é b short Äitem é"),
    (6, "clean words only"), (6, "x1 and more"), (7, "ab cd ef gh ij kl mn op qr"), (7, "ab cd ef gh ij kl mn op qr"), (None, "x1"),
    (8, "x1 x1 q x1"), (9, "ab cd ef gh ij kl mn op qr st ab cd ef gh ij kl mn op qr st"),
]


@pytest.mark.parametrize("set_rows", [2_000_000, 3])
def test_against_brute_force(spark, set_rows):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"row": F.lit(1), "w": F.lit(2), "tk": F.lit(3), "hits": F.lit(4)})
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("len", F.lit(1))
    got = [tuple(r)[:6] for r in scan(docs, bench, set_rows=set_rows).drop("spans", "tk").collect()]
    key = lambda r: (str(r[0]), r)
    assert sorted(got, key=key) == sorted((brute(i, t, ITEMS) for i, t in DOCS), key=key)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7, 7]


def test_spans_are_removed_and_clean_texts_stay(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {(r.doc_id, r.text) for r in remove_spans(docs, bench).collect()}
    assert (1, "zz yy") in out and (5, "a b") in out and (6, "clean words only") in out and (8, "q") in out and (2, None) in out


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert scan(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert [r.n_hit for r in scan(spark.createDataFrame(DOCS[:1], "doc_id long, text string"), items).collect()] == [0]


def test_many_windows_and_long_texts(spark):
    word = lambda i: f"w{i * 7919 % 100_003}"
    item = " ".join(map(word, range(60_000)))
    texts = [(1, " ".join(map(word, range(100, 20_100)))), (2, " ".join(map(word, range(70_000, 90_000)))), (3, item)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = scan(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in out} == {1: (20_000, 20_000, 1), 2: (20_000, 0, 0), 3: (60_000, 60_000, 1)}
