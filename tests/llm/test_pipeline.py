"""The five stages on a small corpus, each against a plain version of it."""

from collections import Counter

import pytest

import corpus_pipeline
from lexiweave.llm.language_id import has_letter
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_mixing import plain_targets

P = pytest.importorskip("public_tokenizers")


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(docs):
    """Smallest id of each near-duplicate group, by all pairs."""
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {find(x) for x in ids}


def test_stages_against_plain_versions(spark, corpus, tmp_path):
    rows = list({r[0]: r for r in corpus}.values())
    passage = " ".join(rows[3][1].split()[:20])  # of the passage that many documents share
    items = [(1, passage), (2, "never said words")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns

    def stage(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    text = {r[0]: r[1] for r in rows}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    docs = stage("language_id", docs)
    lettered = {i for i, t in text.items() if has_letter(t)}
    assert docs.columns == columns and ids(docs) == lettered
    docs = stage("near_dedup", docs)
    kept = groups([(i, text[i]) for i in lettered])
    assert docs.columns == columns and ids(docs) == kept
    docs = stage("decontamination", docs)
    clean = {i for i in kept if not hits(i, text[i], items)[-1]}
    assert docs.columns == columns and ids(docs) == clean and clean < kept
    docs = stage("source_mix", docs)
    size, got = Counter(), Counter()
    for r in rows:
        if r[0] in clean:
            size[r[3]] += len(r[1].split())
    mixed = docs.collect()
    for r in mixed:
        got[r.source] += len(r.text.split())
    assert docs.columns == columns and all(abs(got[s] - x) <= 0.5 for s, x in plain_targets(size).items())
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(encode.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    out = stage("token_store", docs).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == want
    assert [r.start for r in out] == [sum(r.n_tokens for r in out[:i]) for i in range(len(out))]


def test_null_and_empty_documents(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (None, "a b c", "en", None, 5), (2, "!!", "en", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("some", rows), ("none", [])):
        path = tmp_path / name
        spark.createDataFrame(own, schema).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(path)).collect()
        assert [(r.doc_id, r.start) for r in got] == ([(None, 0)] if own else [])
