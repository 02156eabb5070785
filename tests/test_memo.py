"""Memoised tables: found again, made anew after a change or damage."""

import json

import pytest

from lexiweave.functions import payloads
from lexiweave.sources.memo import Memo, fingerprint
from pyspark.sql import functions as F


def test_fingerprints(spark):
    df = lambda rows, schema="a int, b string": spark.createDataFrame(rows, schema)
    base = fingerprint(df([(1, "x"), (2, None), (1, "x")]))
    assert base == fingerprint(df([(2, None), (1, "x"), (1, "x")]).select("b", "a"))
    others = [df([(1, "x"), (2, None)]), df([(1, "x"), (2, ""), (1, "x")]), df([(1, "x"), (None, "2"), (1, "x")]), df([(1, "x"), (2, None), (1, "x")], "a long, b string"), df([])]
    assert len({base, *map(fingerprint, others)}) == 6


@pytest.mark.parametrize("damage", ["note", "cut", "gone", "other"])
def test_damage_makes_the_table_anew(spark, tmp_path, damage):
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    make = lambda: words.withColumn("n", F.length("word"))
    job = lambda **k: (m := Memo(spark, str(tmp_path)), sorted(map(tuple, m.table("t", {"words": words}, make, **k).collect())))
    first, second = job(), job()
    assert (first[0].made, second[0].made) == (1, 0) and first[1] == second[1] == [("a", 1), ("b", 1)]
    assert job(params={"x": 1})[0].made == 1 and job(version=2)[0].made == 1
    (note,) = [p for p in (tmp_path / "t").glob("*.json") if job()[0].made == 0 and json.loads(p.read_text())["path"] == first[0].table("t", {"words": words}, make).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]]
    files = list((tmp_path / "t/tables" / json.loads(note.read_text())["path"].rsplit("/", 1)[1]).glob("part-*"))
    if damage == "note":
        note.write_text(note.read_text()[:20])
        (note.parent / f".{note.name}.crc").unlink(missing_ok=True)
    elif damage == "other":
        spark.createDataFrame([("a", 1), ("c", 1)], "word string, n int").write.mode("overwrite").parquet(str(files[0].parent))
    for f in files:
        if damage == "cut":
            f.write_bytes(f.read_bytes()[:-20])
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        elif damage == "gone":
            f.unlink()
    again = job()
    assert again[0].made == 1 and again[1] == first[1] and job()[0].made == 0


def test_payloads(spark):
    row = spark.createDataFrame([("id1", 'a "b"\nc')], "i string, c string")
    s = payloads.Settings("m", 5, 0.0, "S")
    a, b = row.select(payloads.batch_line_a(F.col("i"), F.col("c"), s), payloads.batch_line_b(F.col("i"), F.col("c"), s)).first()
    user = 'Input: a "b"\nc\nOutput:'
    assert json.loads(a) == {"custom_id": "id1", "params": {"model": "m", "max_tokens": 5, "temperature": 0.0, "system": [{"type": "text", "text": "S"}], "messages": [{"role": "user", "content": [{"type": "text", "text": user}]}]}}
    assert json.loads(b) == {"custom_id": "id1", "method": "POST", "url": "/v1/chat/completions", "body": {"model": "m", "max_completion_tokens": 5, "temperature": 0.0, "messages": [{"role": "system", "content": "S"}, {"role": "user", "content": user}]}}
