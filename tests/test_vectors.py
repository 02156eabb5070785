"""Binary word vectors against the bytes that were written."""

import gzip
import random

import numpy as np
import pytest

from lexiweave.sources import vectors


@pytest.fixture()
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "16"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def content(n, dim, newline, seed=1):
    rng = random.Random(seed)
    words = [f"{rng.choice(['wörd', 'x', 'long-er', '東京'])}{i}" for i in range(n)]
    floats = np.random.default_rng(seed).normal(size=(n, dim)).astype("<f4")
    # Bytes that look like spaces, line feeds, returns and letters.
    odd = np.frombuffer(b"\n\n\n\n a b\r\n \n    abcd", "<f4")
    for i in range(0, n, 3):
        floats[i, : min(dim, 5)] = odd[: min(dim, 5)]
    data = f"{n} {dim}\n".encode() + b"".join(w.encode() + b" " + v.tobytes() + (b"\n" if newline else b"") for w, v in zip(words, floats, strict=True))
    return data, {w: v.tobytes() for w, v in zip(words, floats, strict=True)}


def read(spark, path):
    return {r.word: np.array(r.vec, "<f4").tobytes() for r in vectors.read_binary_vectors(spark, str(path)).collect()}


@pytest.mark.parametrize("newline", [True, False])
@pytest.mark.parametrize("n, dim", [(700, 12), (60, 300), (5, 3), (1, 1), (0, 4)])
def test_ranges_that_cut_words_and_numbers(spark, tmp_path, small_ranges, newline, n, dim):
    data, want = content(n, dim, newline)
    (tmp_path / "v.bin").write_bytes(data)
    df = vectors.read_binary_vectors(spark, str(tmp_path / "v.bin"))
    assert read(spark, tmp_path / "v.bin") == want and (n < 700 or df.rdd.getNumPartitions() > 8)


def test_pieces_and_compressed_files(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 500)
    data, want = content(300, 10, False)
    (tmp_path / "v.bin").write_bytes(data)
    (tmp_path / "v.bin.gz").write_bytes(gzip.compress(data))
    assert read(spark, tmp_path / "v.bin") == want and read(spark, tmp_path / "v.bin.gz") == want


def test_the_text_form_has_the_same_rows(spark, tmp_path):
    from lexiweave.sources import files

    data, want = content(50, 6, False, 4)
    want = {w: v for w, v in want.items() if np.isfinite(np.frombuffer(v, "<f4")).all()}
    text = "50 6\n" + "".join(f"{w} {' '.join(repr(float(x)) for x in np.frombuffer(v, '<f4'))}\n" for w, v in want.items())
    (tmp_path / "v.txt").write_text(text)
    (tmp_path / "v.bin").write_bytes(data)
    as_text = {r.word: np.array(r.vec, "<f4").tobytes() for r in files.read_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert as_text == {w: v for w, v in read(spark, tmp_path / "v.bin").items() if w in want} == want


def test_a_cut_off_file_is_an_error(spark, tmp_path):
    data, _ = content(40, 8, False)
    (tmp_path / "v.bin").write_bytes(data[:-5])
    with pytest.raises(Exception, match="cut off"):
        vectors.read_binary_vectors(spark, str(tmp_path / "v.bin")).collect()


def test_written_files_come_back(spark, tmp_path, small_ranges):
    rows = [(f"w{i}", np.random.default_rng(i).normal(size=20).astype("f4").tolist()) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 20), ("none", None)], "word string, vec array<float>")
    vectors.write_binary_vectors(df, str(tmp_path / "out"), 3)
    assert read(spark, tmp_path / "out") == {w: np.array(v, "<f4").tobytes() for w, v in rows} and len(list((tmp_path / "out").glob("file=*/part-*"))) == 3
