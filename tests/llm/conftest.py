import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with copies, near copies, a shared passage and odd texts."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, rows = prose(60), []
    base = prose(80)
    for i in range(140):
        kind = i % 7
        if kind == 0:
            text = prose(rng.randint(1, 150))
        elif kind == 1:
            text = base
        elif kind == 2:
            w = base.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind == 3:
            text = passage + " " + prose(rng.choice([3, 8, 14, 40, 100]))
        elif kind == 4:
            text = prose(rng.randint(1, 6))
        elif kind == 5:
            text = [None, "", "  \n", "ÄÖ Straße", "x", "A b\n\n  C d"][i // 7 % 6]
        else:
            w = base.split()[: rng.randint(55, 80)]
            text = " ".join(w).upper()
        rows.append((i * 3, text, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], len(text or "")))
    rows.append(rows[5])
    rows.append(rows[8])
    return rows


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
