import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiweave.llm.lm_scoring import Params, score


def words(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()


def brute(texts, order, alpha=0.4):
    """``n_words, log_score`` of each text, by n-grams of the others."""
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own = [[grams(words(t), k) for k in range(1, order + 1)] for t in texts]
    every = [sum((o[k] for o in own), Counter()) for k in range(order)]
    out = []
    for t, mine in zip(texts, own, strict=True):
        w, log = words(t), 0.0
        rest = lambda g: every[len(g) - 1][g] - mine[len(g) - 1][g]  # noqa: E731, B023
        for i in range(len(w)):
            factor = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    log += math.log(factor * max(rest(g), 1) / max(sum(every[0].values()) - len(w), 1))
                elif rest(g) > 0:
                    log += math.log(factor * rest(g) / rest(g[:-1]))
                    break
                factor *= alpha
        out.append((len(w), log))
    return out


@pytest.mark.parametrize("order, block, bucket", [(1, 4000, 1 << 20), (2, 1 << 20, 100), (3, 3000, 700), (3, 8 << 20, 1 << 20), (4, 1, 50)])
def test_against_brute_force(spark, docs, corpus, order, block, bucket):
    want = brute([r[1] for r in corpus], order)
    out = score(docs.withColumns({"block": F.lit(1), "k": F.lit(2), "bucket": F.lit(3)}), Params(order=order, block_bytes=block, bucket=bucket)).collect()
    key = lambda x: (x[0], x[1], round(x[2], 6))
    got = sorted(key((r.doc_id, r.n_words, r.log_score)) for r in out)
    exp = sorted(key((r[0], *x)) for r, x in zip(corpus, want, strict=True))
    assert [x[:2] for x in got] == [x[:2] for x in exp]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, exp, strict=True)) < 1e-5
    assert all((r.per_word is None) == (r.n_words == 0) for r in out)


def test_null_ids_repeated_rows_and_no_rows(spark, no_docs):
    rows = [(None, "a b c"), (None, "a b c"), (None, None), (1, ""), (1, "a b d"), (1, "A b d")]
    out = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([r[1] for r in rows], 3)
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in out) == sorted((str(i), n, round(x, 6)) for (i, _), (n, x) in zip(rows, want, strict=True))
    assert score(no_docs).count() == 0


def test_time_is_linear_in_the_length_of_a_text(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n_words for r in score(df).collect()}
    assert got == {1: 200_000, 2: len(text[: len(text) // 2].split())} and time.time() - began < 90
