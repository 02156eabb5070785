import zlib

from pyspark.sql import functions as F

from lexiweave.llm.language_id import Params, fit, grams, identify, keep_known


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.97


def test_counts_against_brute_force(docs, corpus):
    p = Params(buckets=1 << 10)
    model = fit(docs, p)
    count = {}
    for _, t, lang, *_ in corpus:
        if t is not None and lang is not None:
            for g in grams(t, p).tolist():
                count[(lang, g)] = count.get((lang, g), 0) + 1
    assert model.languages == ["de", "en"]
    import numpy as np

    want = np.full((1 << 10, 2), p.smooth)
    for (lang, g), n in count.items():
        want[g, model.languages.index(lang)] += n
    (part,) = model.parts()
    assert np.allclose(part.weights, np.log(want / want.sum(0)), atol=1e-5)


def test_defined_results(docs, corpus, no_docs, spark):
    out = identify(docs).collect()
    assert len(out) == len(corpus)
    texts = {r[0]: r[1] for r in corpus}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert identify(no_docs).count() == 0
    kept = keep_known(docs.withColumn("score", F.lit(1)))
    assert kept.columns == [*docs.columns, "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(none).collect()] == [("und", 0.0)]


def test_letters_stay_when_no_language_is_known(spark):
    rows = [(1, "abc", None), (2, "12 .", None), (3, None, None), (4, "d", None)]
    kept = keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_parts_of_the_languages_give_what_one_gives(spark):
    """A further language leaves the others' weights alone, and parts in turn find what plain sums over all languages find."""
    import math
    import random

    rng = random.Random(4)
    text = lambda letters: "".join(rng.choices(letters + " ", k=80))
    rows = [(i, text("abcdefghijklmnopqrst"[j % 16 : j % 16 + 4]), f"l{j:02d}") for i, j in enumerate([*range(20)] * 4)] + [(900, None, None), (901, "12", "l01")]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string")
    small, large = Params(buckets=1 << 10, model=1 << 12), Params(buckets=1 << 10)
    own = lambda r, p: {n: x.weights[:, i].tolist() for x in fit(make(r), p).parts() for i, n in enumerate(x.languages)}
    few, more = own(rows, small), own([*rows, (999, "zzz yyy", "l05b")], small)
    assert len(few) == 20 and all(more[n] == w for n, w in few.items()) and few == own(rows, large)
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identify(make(rows), p).collect()} for p in (large, small))
    assert one == many and one[900] == one[901] == ("und", 0.0)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    weights, n = own(learned, large), {}
    for _, t, lang in learned:
        n[lang] = n.get(lang, 0) + (t is not None)
    total = sum(x for k, x in n.items() if k)
    for i, t, _ in rows[:80]:
        logs = {k: math.log(n[k] / total) + sum(weights[k][g] for g in grams(t, large).tolist()) for k in weights}
        best = max(logs.values())
        assert abs(logs[many[i][0]] - best) < 1e-3 and abs(many[i][1] - 1 / sum(math.exp(x - best) for x in logs.values())) < 1e-3
