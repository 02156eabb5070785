"""File sources and sinks, written and read back on literal rows."""

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import text as T
from lexiweave.operators import lexicon
from lexiweave.sources import envelopes, files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lines_of(path):
    """The lines of a folder's files, in the order of the files."""
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_cues_are_stripped_and_blank_ones_go(spark, tmp_path):
    (tmp_path / "cues.csv").write_text('cue,n\n sea ,1\n"a ""b"", c",2\n"  ",3\n\nsea,4\nnull,5\n')
    assert rows(files.read_cues(spark, str(tmp_path / "cues.csv"))) == [('a "b", c',), ("null",), ("sea",), ("sea",)]


def test_trials_with_blanks_quotes_and_line_feeds(spark, tmp_path):
    (tmp_path / "t.csv").write_text('cue,R1,R2,R3\nsea,water,,null\n"x\ny","a ""b""",NaN,c\n')
    want = [("sea", "water", "", "null"), ("x\ny", 'a "b"', "NaN", "c")]
    back = files.read_trials(spark, str(tmp_path / "t.csv"))
    assert rows(back) == want
    files.write_trials(back.union(back), str(tmp_path / "out"))
    files.write_csv(back, str(tmp_path / "out"), "append")
    assert rows(files.read_trials(spark, str(tmp_path / "out"))) == sorted(want * 3, key=repr)
    files.write_trials(back, str(tmp_path / "out"))
    assert rows(files.read_trials(spark, str(tmp_path / "out"))) == want


def test_trials_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", "y", "z"), ("a", "z", "", ""), ("a", "b", "2", ""), ("a", "b", "1", "")], files.TRIALS)
    files.write_trials(df, str(tmp_path / "o"))
    assert [x for x in lines_of(tmp_path / "o") if not x.startswith("cue,")] == ['a,b,1,""', 'a,b,2,""', 'a,z,"",""', "b,x,y,z"]


def test_json_lines_are_appended(spark, tmp_path):
    one = spark.createDataFrame([("a", 1), (None, 2)], "id string, n int")
    for _ in range(2):
        files.write_jsonl(one, str(tmp_path / "l"))
    files.write_jsonl(one.limit(0), str(tmp_path / "l"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "l"), "id string, n int")) == sorted([("a", 1), (None, 2)] * 2, key=repr)


def test_strengths_keep_quotes(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('cue\tresponse\tR123\n"sea\two"rd\t3\nb\tc\t\n')
    assert rows(files.read_strengths(spark, str(tmp_path / "s.tsv"), "cue string, response string, R123 int")) == [('"sea', 'wo"rd', 3), ("b", "c", None)]


def test_spelling_lines(spark):
    lines = spark.createDataFrame([(0, " Colour \tColor"), (1, "no tab"), (2, "\tx"), (3, "x\t "), (4, "colour\tCOLOR2\tmore"), (5, "grey\tgray")], "line_no long, value string")
    assert rows(lexicon.spelling_dictionary(lines)) == [("colour", "color2\tmore"), ("grey", "gray")]


def test_edges_metrics_and_outliers(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", None)], files.EDGES)
    files.write_edges(edges, str(tmp_path / "e"))
    assert rows(files.read_csv(spark, str(tmp_path / "e"), files.EDGES)) == [("a", "b", 2)]
    metrics = spark.createDataFrame([("z", 1.5), ("a", float("nan")), ("m", 0.0)], "metric string, value double")
    files.write_metrics(metrics, str(tmp_path / "m"))
    assert lines_of(tmp_path / "m") == ["metric,value", "z,1.5", "a,NaN", "m,0.0"]
    out = spark.createDataFrame([("b", "a", 3, 0.5, "x"), ("a", "c", 1, 0.25, "y")], "src string, tgt string, wt long, distance double, more string")
    files.write_outliers(out, str(tmp_path / "o"))
    assert [x for x in lines_of(tmp_path / "o") if not x.startswith("src")] == ["a,c,1,0.25", "b,a,3,0.5"]


def test_output_and_error_files_of_a_batch(spark, tmp_path):
    good = '{"custom_id":"a","response":{"status_code":200,"body":{"choices":[{"message":{"content":" hi "}}],"usage":{"prompt_tokens":3,"completion_tokens":1}}},"error":null}'
    bad = ['{"custom_id":"b","response":{"status_code":429,"body":{"error":{"message":"slow down"}}},"error":null}', '{"custom_id":"c","response":null,"error":{"message":"gone"}}',
           '{"custom_id":"d","response":{"status_code":500,"body":{}},"error":null}', '{"custom_id":"e","response":{"status_code":200,"body":{}},"error":"text"}']
    (tmp_path / "out").write_text(good + "\n")
    (tmp_path / "err").write_text("\n".join(bad) + "\n{broken\n")
    both = envelopes.joined_files(*(spark.read.text(str(tmp_path / f)).withColumnRenamed("value", "payload") for f in ("out", "err")))
    assert rows(envelopes.from_b(both)) == [("a", True, "hi", 3, 1), ("b", False, "slow down", None, None), ("c", False, "gone", None, None), ("d", False, "HTTP 500", None, None), ("e", False, "text", None, None)]


@pytest.mark.parametrize("attempt, want", [(0, 1.0), (3, 8.0), (6, 60.0), (50, 60.0)])
def test_backoff_doubles_up_to_a_bound(spark, attempt, want):
    assert spark.range(1).select(T.backoff_seconds(F.lit(attempt)).alias("s")).first().s == want
