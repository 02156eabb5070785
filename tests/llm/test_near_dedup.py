import random

import pytest

from lexiweave.llm.near_dedup import EXACT, Params, keep_one, near_duplicates, shingle_set


def brute(rows, words=5, percent=75):
    """Components by comparing all pairs of full word-shingle sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in rows:
        w = [x.decode() for x in (t or "").translate(lower).encode().split()]
        sets.append((i, {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets)


@pytest.mark.parametrize("params", [Params(), Params(list_limit=2, block=8), Params(sketch=32, list_limit=3, block=8)])
def test_against_all_pairs(docs, corpus, params):
    assert sorted(map(tuple, near_duplicates(docs, params).collect())) == brute(corpus)


def test_long_lists_lose_no_link(spark):
    """Families around one base and texts that mostly share one passage, with every list a long one."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage, rows = rng.choices(words, k=60), []
    for i in range(90):
        rows.append((i, " ".join(passage + rng.choices(words, k=rng.randint(3, 30)))))
    for f in range(3):
        base = rng.choices(words, k=120)
        for i in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(120)] = rng.choice(words)
            rows.append((1000 * (f + 1) + i, " ".join(w)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Params(list_limit=3, block=16))
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_empty_tables_and_columns(no_docs, docs):
    assert near_duplicates(no_docs).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {r[2] for r in brute([tuple(r) for r in docs.collect()])}
    assert {r.doc_id for r in kept.collect()} == want


def test_rows_without_id_stay_once_a_group(spark):
    same = "one two three four five six seven"
    rows = [(None, "alone with words of its own here", "a"), (None, same, "b"), (None, same, "c"), (None, "", "d"), (None, None, "e"),
            (7, "seven eight nine ten eleven twelve", "f"), (None, "seven eight nine ten eleven twelve", "g"), (9, "x y", "h")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    got = sorted(r.source for r in kept.collect())
    assert len([s for s in got if s in "bc"]) == 1 and [s for s in got if s not in "bc"] == list("adefh")
    nameless = keep_one(spark.createDataFrame(rows[:5], "doc_id long, text string, source string"))
    assert nameless.count() == 4


def test_shingles_of_short_texts():
    assert len(shingle_set("a b c")) == 1 and len(shingle_set("")) == 0 and len(shingle_set(None)) == 0
    assert len(shingle_set("a b c d e f")) == 2
    assert (shingle_set("A\x0bB") == shingle_set("a b")).all() and len(shingle_set("a b")) == 1


def test_null_ids_are_kept_or_stand_behind_an_id(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "x y"), (None, "x y"), (None, None), (7, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(None, 2, 4, False), (4, 2, 4, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True)]))


def test_null_ids_beside_both_ends_of_the_long_range(spark):
    least, most, same = -(2**63), 2**63 - 1, "one two three four five six seven"
    rows = [(least, "a b", "low"), (most, same, "high"), (None, same, "copy"), (None, "x y z", "alone"), (0, "x y", "zero"), (None, "x y z", "again")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = [r.source for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "source"] and sorted(set(got) - {"alone", "again"}) == ["high", "low", "zero"] and len(got) == 4


def test_exact_sketches(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = near_duplicates(docs, EXACT)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute(rows)))


def test_a_very_long_text_and_a_hub_with_many_partners(spark, monkeypatch):
    from lexiweave.llm import near_dedup

    monkeypatch.setattr(near_dedup, "HUB_PAIRS", 3)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=300)
    rows = [(i, " ".join([*base[:-1], words[i]])) for i in range(30)] + [(100, " ".join(rng.choices(words, k=300_000)))]
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_classes_that_met_in_any_earlier_list_are_not_sent_again():
    """Rows of one side have partners unmet only if these are of another component and share none of the lists before."""
    import numpy as np

    from lexiweave.llm.near_dedup import _unmet

    met = [np.array(x, np.int64) for x in ([1, 2], [1], [2], [], [2, 3], [1, 4])]
    component = np.array([10, 11, 12, 13, 14, 10])
    assert _unmet(component, met, 4).tolist() == [False, True, True, True, True, True]
    assert _unmet(component[:2], met[:2], 2).tolist() == [False, False]  # a block that meets itself
    assert _unmet(component[1:3], met[1:3], 2).tolist() == [True, True]
    rng = np.random.default_rng(5)
    component, met = rng.integers(0, 6, 90), [rng.choice(9000, rng.integers(0, 40), replace=False) % 4999 for _ in range(90)]
    pairs = [(i, j) for i in range(30) for j in range(30, 90) if component[i] != component[j] and not set(met[i]) & set(met[j])]
    assert set(np.flatnonzero(_unmet(component, met, 30))) == {i for pair in pairs for i in pair}
