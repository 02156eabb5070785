import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiweave.llm.elias_fano import EliasFano
from lexiweave.llm.token_store import WordEncoder, document_ids, read_ids, read_store, write_store

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900))
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(gaps).astype(np.int64)
    ef = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert ef.all().tolist() == values.tolist()
    for i in range(0, len(values), max(1, len(values) // 7)):
        assert ef.select(i) == values[i]
        assert ef.select_range(i, min(i + 300, len(values))).tolist() == values[i : i + 300].tolist()


def test_elias_fano_space():
    values = np.arange(100_000) * 1000
    assert len(EliasFano.encode(values).to_bytes()) * 8 / 100_000 < 13


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def whole(texts):
    return [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x85  ab1.'é漢s!")))
def test_words_encode_like_whole_texts(text):
    enc = test_words_encode_like_whole_texts.__dict__.setdefault("enc", WordEncoder(P.path("byte_bpe_50k.json"), cached=5))
    texts = [text, text[::-1], None, text + " " + text]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.batch(texts)] == whole([t or "" for t in texts])


def test_added_tokens_keep_their_id():
    enc = WordEncoder(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>", "\n <|endoftext|>\n\n<|endoftext|> x", "a <|endoftext| > b", "a b"]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.batch(texts)] == whole(texts)
    assert tokenizer().token_to_id("<|endoftext|>") in whole(texts[:1])[0]


def test_store_round_trip(spark, docs, corpus, no_docs, tmp_path):
    path = P.path("byte_bpe_50k.json")
    write_store(docs, str(tmp_path / "s"), path, shard_ids=500)
    got = sorted(map(tuple, read_store(spark, str(tmp_path / "s")).collect()), key=lambda r: r[1])
    ordered = sorted(corpus, key=lambda r: (r[0], r[1] or ""))
    ids = [x + [2] for x in whole([r[1] or "" for r in ordered])]
    start, want = 0, []
    for r, x in zip(ordered, ids, strict=True):
        want.append((r[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert got == want
    back = read_ids(spark, str(tmp_path / "s")).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == Counter((r[0], tuple(x)) for r, x in zip(ordered, ids, strict=True))
    write_store(no_docs, str(tmp_path / "e"), path)
    assert read_store(spark, str(tmp_path / "e")).count() == 0


def test_single_documents_and_long_texts(spark, tmp_path):
    path, store = P.path("byte_bpe_50k.json"), str(tmp_path / "s")
    texts = {1: "a b " * 30_000, 2: None, 3: "x" * 20_000, 4: "end", 5: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "part", "seq", "ends")})
    write_store(df, store, path, shard_ids=1000)
    got = {r.doc_id: r.ids for r in document_ids(spark, store, df.where("doc_id in (1, 3, 4, 9)")).collect()}
    assert got == {i: whole([texts[i]])[0] + [2] for i in (1, 3, 4)}
    assert {r.doc_id: r.ids for r in read_ids(spark, store).collect()} == {i: x + [2] for i, x in zip(texts, whole([t or "" for t in texts.values()]), strict=True)}


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.chars = inner, 0

    def encode_batch_fast(self, texts, **how):
        self.chars += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **how)


def test_words_of_letters_are_not_cut_again():
    enc = WordEncoder(P.path("byte_bpe_50k.json"))
    texts = [" ".join(f"Wört{chr(97 + i % 26)}{chr(97 + i // 26)}{'.' * (i % 3)}" for i in range(600)) + f"\nñandú {k}" for k in range(3)]
    enc.tokenizer = Counted(enc.tokenizer)
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.batch(texts)] == whole(texts)
    assert enc.tokenizer.chars < 100


def test_common_words_outlast_the_rare_ones():
    enc = WordEncoder(P.path("byte_bpe_50k.json"), cached=30)
    rounds = [[" ".join(["x", *(f"{w}'s" for w in ("le", "la", "the")), *(f"{k}-{i}" for i in range(20))])] for k in range(9)]
    for texts in rounds:
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.batch(texts)] == whole(texts)
    assert len(enc.known) <= 60 and {"le's", "la's", "the's"} <= set(enc.known.to_pylist())


def test_odd_spaces_letters_and_marks():
    draw = np.random.default_rng(3)
    parts = [" ", " ", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "the", "é", "ß", "ǅ", "ɐ", "漢", "😀", "1", "²", "'s", ".", "...", "-", "_", "\r\n", "Ġ", "Ċ", "ʰ", "́", "\x00", "]", "<|endoftext|>"]
    enc = WordEncoder(P.path("byte_bpe_50k.json"), cached=40)
    for _ in range(20):
        texts = ["".join(draw.choice(parts, draw.integers(0, 25))) for _ in range(40)] + [None, ""]
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.batch(texts)] == whole([t or "" for t in texts])
