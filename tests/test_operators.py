"""Literal rows for the expressions and operators of the association engine."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.functions import text as T
from lexiweave.operators import balance, compare, lexicon, network, stats
from lexiweave.operators import ledger as ledger_ops
from lexiweave.operators.components import connected_components, joined_components
from lexiweave.plans import cleaning, views
from lexiweave.runtime import Scratch
from lexiweave.sources import envelopes, files
from lexiweave.streaming.ledger import ROWS, run_ledger, start_ledger


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("water, beach, sun", ["water", "beach", "sun"]), ('"water",\n \'sun\' , , sea, sand', ["water", "sun", "sea"]), ("", []), ("one, two", ["one", "two"]), (None, [])])
def test_parse(spark, text, want):
    assert one(spark, T.parse_associations(F.col("t").cast("string")), t=text) == want


@pytest.mark.parametrize("cues, said, want", [(["sea"], "the sea", "sea"), (["sea"], "to the sea", "the sea"), (["sea"], "a the sea", "sea"), (["the end"], "the end", "the end")])
def test_articles(spark, cues, said, want):
    rows = spark.createDataFrame([("c", said, "", "")], "cue string, R1 string, R2 string, R3 string")
    known = spark.createDataFrame([(c,) for c in cues], "cue string")
    assert cleaning.strip_articles(rows, known).first().R1 == want


@pytest.mark.parametrize("cells, want", [(("a", "b", "b"), ("b", "", "")), (("", "x", "y"), ("x", "y", "")), (("", "", "y"), ("y", "", "")), (("x", "", "y"), ("x", "y", ""))])
def test_compact(spark, cells, want):
    rows = spark.createDataFrame([("a", *cells)], "cue string, R1 string, R2 string, R3 string")
    assert tuple(cleaning.compact_responses(rows).first())[1:] == want


def test_probes(spark):
    assert one(spark, T.probe_answers_a(F.col("t")), t="<think>x</think> 1. Sea, the sun") == ["sea", "sun", "NaN"]
    assert one(spark, T.probe_answers_b(F.col("t")), t="Sea water, a very long phrase, sun") == ["sea water", "sun", "NaN"]


def test_booleans_and_status(spark):
    assert [one(spark, T.lenient_bool(F.col("t")), t=t) for t in ("True", " YES ", "1", "0", "")] == [True, True, True, False, False]
    assert [one(spark, envelopes.batch_status(F.col("t")), t=t) for t in ("completed", "failed", "in_progress")] == ["ended", "ended", "in_progress"]


def test_balance_to_three(spark):
    rows = [(c, i, "r", "", "") for c, n in (("x", 5), ("y", 2)) for i in range(n)]
    out = balance.balance(spark.createDataFrame(rows, "cue string, trial int, R1 string, R2 string, R3 string"), spark.createDataFrame([("x",), ("y",), ("z",)], "cue string"), 3, 1, ["trial"])
    assert sorted((r.cue, r.R1) for r in out.collect()) == [("x", "r")] * 3 + [("y", "")] + [("y", "r")] * 2 + [("z", "")] * 3


def test_edges(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "a", 5), ("b", "c", 1)], "src string, tgt string, wt long")
    assert sorted(map(tuple, network.undirected(e).collect())) == [("a", "b", 5), ("b", "c", 1)]
    assert network.not_idiosyncratic(network.undirected(e)).count() == 1


def test_components_of_a_chain_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, tgt long")).collect()))
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}


# Published correlations of 68 pairs and their probabilities.
@pytest.mark.parametrize("r, n, p", [(-0.04337925463914871, 68, 0.7254023442020483), (-0.08213856825177354, 68, 0.5054744222249548), (1.0, 9, 0.0), (1.0, 2, 1.0)])
def test_p_values(r, n, p):
    assert abs(stats.correlation_p(r, n) - p) < 1e-12


def test_few_rows_have_no_correlation(spark):
    row = stats.correlations(spark.createDataFrame([("a", "b", 1, 0.5)], "src string, tgt string, wt long, distance double")).first()
    assert math.isnan(row.pearson_r) and math.isnan(row.spearman_r)


def test_correlation_table_counts_missing_words(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c d", 2), ("a", "gone", 3), ("lost", "gone", 4)], "src string, tgt string, wt long")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c_d", [1.0, 1.0])], "word string, vec array<float>")
    values = dict(map(tuple, stats.correlation_table(edges, vectors).collect()))
    assert (values["missing_words"], values["missing_edges"]) == (2.0, 2.0)


def test_windows(spark):
    o = balance.master_order(spark.createDataFrame([(i, f"c{i}") for i in range(5)], "pos int, cue string"), 1)
    assert balance.cue_window(o, -3, 2).count() == 2 and balance.cue_window(o, 0, 0).count() == 0


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    lines = ['{"id": "a", "n": 1}', "", "   ", "{bad", "[1, 2]", '"text"', '{"id": "b"}', '{"id": "c", "n": "x"}', '  {"id": "d", "n": 4}  ']
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    got = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int")
    assert got.columns == ["id", "n"] and sorted(map(tuple, got.collect()), key=str) == [("a", 1), ("b", None), ("d", 4)]


def test_payload_of_several_lines(spark):
    one = '{"custom_id": "%s", "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": " hi "}]}}}'
    pretty = '{\n "custom_id": "p",\n "result": {"type": "errored", "error": {"message": "no"}}\n}'
    rows = [("\n".join(one % x for x in "abc") + "\n\n{bad",), (pretty,), ("",), (None,), ("[" + one % "d" + "]",), ('{"custom_id": "e"}',)]
    got = {r.custom_id: (r.ok, r.text) for r in envelopes.from_a(spark.createDataFrame(rows, "payload string")).collect()}
    assert got == dict.fromkeys("abcd", (True, "hi")) | {"p": (False, "no"), "e": (False, "unknown_batch_result")}


def test_manifests_and_runs(spark, tmp_path):
    row = lambda n: spark.createDataFrame([(n, "running", "")], "run string, state string, updated_at string")
    path = str(tmp_path / "runs/r1/m.json")
    assert files.create_or_load(row("a"), path).first().run == "a"
    kept = files.create_or_load(row("b"), path)
    assert kept.first().run == "a"
    fresh = files.rewrite(kept, path).first()
    assert (fresh.run, fresh.state) == ("a", "running") and len(fresh.updated_at) == 32 and fresh.updated_at.endswith("+00:00")
    for i, name in enumerate(("one", "two")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "manifest.json").write_text("{}")
        os.utime(tmp_path / "runs" / name / "manifest.json", (1000 + i, 1000 + i))
    assert [r.run.rsplit("/", 1)[1] for r in files.discover_runs(spark, str(tmp_path / "runs")).collect()] == ["two", "one"]


def test_ledger_stream_pauses_and_resumes(spark, tmp_path):
    source, ledger, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    write = lambda ids: spark.createDataFrame([(i, "c", 0, "", "", True, u) for i, u in ids], ROWS).write.mode("append").json(source)
    write([("a", "2"), ("a", "1"), ("b", "1"), (None, "1"), ("", "1")])
    assert run_ledger(spark, source, ledger, state) == 2
    write([("b", "3"), ("c", "3")])
    query = start_ledger(spark, source, ledger, state, poll="1 second")
    query.processAllAvailable()
    query.stop()
    assert run_ledger(spark, source, ledger, state) == 0
    got = spark.read.schema(ROWS).parquet(ledger).select("custom_id", "updated_at").collect()
    assert sorted(map(tuple, got)) == [("a", "1"), ("b", "1"), ("c", "3")]


def test_identical_edge_lists(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "src string, tgt string, wt long")
    assert compare.edge_diff(e, e).first().verdict == "IDENTICAL"


@pytest.mark.parametrize("values", [[1.0, 2.0, 5.0, 9.0], [3.0], [2.0, 2.0, 2.0, 7.0, 7.0], []])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 1.0])
def test_quantile(spark, values, q):
    got = stats.quantile(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x", q).first().value
    assert got is None if not values else abs(got - float(np.quantile(values, q))) < 1e-12


def test_guards(spark):
    rows = [("running", 1.0), ("running", 3.0), ("paused", 9.0), ("failed", 0.0), ("timed_out", 9.0)]
    df = spark.createDataFrame(rows, "state string, cost_usd double")
    assert [r.action for r in ledger_ops.guard(df, 3.0).collect()] == ["run", "pause", "wait", "stop", "stop"]
    assert [r.action for r in ledger_ops.guard(df, None).collect()] == ["run", "run", "wait", "stop", "stop"]


def test_components_of_words_and_numbers(spark):
    words = [("b", "a"), ("c", "b"), ("z", "é"), ("k", "k"), (None, "q"), ("a", "c")]
    got = connected_components(spark.createDataFrame(words, "src string, tgt string")).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "a"), ("c", "a"), ("k", "k"), ("z", "z"), ("é", "z")]
    chain = connected_components(spark.range(300).selectExpr("id as src", "id + 1 as tgt")).collect()
    assert len(chain) == 301 and {r.component for r in chain} == {0}


def test_nulls_are_alike_in_edge_lists(spark):
    schema = "src string, tgt string, wt long"
    a, b = (spark.createDataFrame(rows, schema) for rows in ([("a", None, 1), (None, None, None), ("a", None, 1)], [(None, None, None), ("a", None, 1)]))
    assert tuple(compare.edge_diff(a, b).first()) == (2, 2, 0, 0, "IDENTICAL")
    c = spark.createDataFrame([("a", None, 2), (None, None, None)], schema)
    assert tuple(compare.edge_diff(a, c).first()) == (2, 2, 1, 1, "DIFF")


def test_direct_lookup_keeps_forms_of_a_word(spark):
    edges = spark.createDataFrame([("dogs", "big cats", 3), ("dogs", "zzz", 4), ("men", "dog", 5)], "src string, tgt string, wt long")
    words = spark.createDataFrame([("dog",), ("big_cat",), ("man",)], "word string")
    assert sorted(map(tuple, lexicon.direct_subgraph(edges, words).collect())) == [("dogs", "big cats", 3), ("men", "dog", 5)]
    assert lexicon.subgraph(edges, words).count() == 0


def test_words_of_two_sides_are_compared_without_a_join_of_rows(spark):
    from lexiweave.operators import compare

    left, right = (spark.createDataFrame([(w,) for w in words], "word string") for words in (["a", "a", None, "b", "c"], ["b", "b", "d", None]))
    both, own = compare.overlap(left, right), compare.unique(left, right)
    assert sorted(map(repr, (r.word for r in both.collect()))) == ["'b'", "None"] and sorted(r.word for r in own.collect()) == ["a", "c"]
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (both, own))


def test_articles_go_without_a_shuffle_of_rows(spark):
    from lexiweave.plans.cleaning import strip_articles
    from lexiweave.runtime import setting

    cells = [("the cat", "a the dog", "to go"), ("a an the to be", "the the x", None), ("the", "a ", "an a b"), ("the dog", "a the cat", "theatre")]
    rows = spark.createDataFrame([("c", *r) for r in cells], "cue string, R1 string, R2 string, R3 string")
    cues = spark.createDataFrame([("the dog",), ("to go",), ("c",), (None,)], "cue string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = strip_articles(rows, cues)
        got = {tuple(r)[1:] for r in out.collect()}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert got == {("cat", "the dog", "to go"), ("be", "the x", ""), ("the", "", "a b"), ("the dog", "cat", "theatre")}


def test_largest_component_makes_its_edges_once(spark):
    from lexiweave.operators.network import largest_component

    edges = spark.range(6).selectExpr("concat('w', id div 2 * 2) as src", "concat('w', id div 2 * 2 + 1 + id % 2) as tgt", "id as wt")
    kept = largest_component(edges)
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == [("w0", "w1", 0), ("w0", "w2", 1), ("w2", "w3", 2), ("w2", "w4", 3), ("w4", "w5", 4), ("w4", "w6", 5)]


def test_pairs_are_counted_in_one_shuffle(spark):
    rows = [("b", "a", "a", "c"), ("a", "b", "a", ""), (None, "a", "b", None), ("c", "b", None, "c"), ("", "a", "b", "c"), ("a", "b", "b", "c")]
    trials = spark.createDataFrame(rows, "cue string, R1 string, R2 string, R3 string")
    found = network.undirected_edges(trials)
    want = network.undirected(network.directed_edges(trials))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) == [("a", "b", 3), ("a", "c", 1), ("b", "c", 1)]
    assert found.dtypes == want.dtypes
    assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_alignment_shuffles_rows_once(spark):
    rows = [(c, t, [f"{c}{t}"]) for c, m in (("a", 5), ("b", 2), (None, 1), ("c", 3)) for t in range(10, 10 + m)]
    found = balance.align(spark.createDataFrame(rows, "cue string, trial long, responses array<string>"), 3, 42)
    got = {c: sorted((r.trial, tuple(r.responses)) for r in found.collect() if r.cue == c) for c in ("a", "b", None, "c")}
    assert got["b"] == [(2, ()), (10, ("b10",)), (11, ("b11",))] and got[None] == [(1, ()), (2, ()), (10, ("None10",))]
    assert got["c"] == [(t, (f"c{t}",)) for t in (10, 11, 12)] and len(got["a"]) == 3 and all(r for _, r in got["a"])
    assert dict(found.dtypes)["trial"] == "bigint"
    assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_trials_are_dealt_in_pieces_by_the_size_of_texts(spark, tmp_path, monkeypatch):
    texts = [None, "", " .. ", "Eins zwei, drei-vier f\u00fcnf!", "a b c d", "x" * 1000, "\n a \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(views, "PIECE", 20)
    found = views.trials(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 40
    assert sorted(tuple(r) for r in found.collect()) == [
        (3 << 32, "eins", "zwei", "drei", "vier"), ((3 << 32) + 1, "f\u00fcnf", "", "", ""), (4 << 32, "a", "b", "c", "d"), (5 << 32, "x" * 1000, "", "", ""), (6 << 32, "a", "", "", ""),
    ]


def test_unique_cues_read_the_trials_once(spark):
    read = spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    trials = spark.createDataFrame([("Sea_dogs",), ("sea dogs",), ("hands",), ("",)], "cue string").mapInArrow(tally, "cue string")
    words = spark.createDataFrame([("sea dog",)], "word string")
    none = spark.createDataFrame([], "k string, v string")
    assert sorted(r.cue for r in cleaning.unique_cues(trials, none, none, words).collect()) == ["hand", "sea dog"]
    assert read.value == 4


@pytest.mark.parametrize("joined", [3, 1 << 20])
def test_joined_components_are_those_of_the_rounds(spark, joined):
    draw = random.Random(5)
    words = ["\uffff", "\U0001f600", "é", "", *(f"w{i}" for i in range(60))]
    rows = [(draw.choice(words), draw.choice(words)) for _ in range(45)] + [(None, "w1"), ("w2", None), ("lone", "lone"), ("\U0001f601", "\ufffe")]
    for edges in (spark.createDataFrame(rows, "src string, tgt string").repartition(3), spark.range(300).selectExpr("id as src", "id + 1 as tgt"), spark.createDataFrame([], "src string, tgt string")):
        got, want = (Counter(map(tuple, found.collect())) for found in (joined_components(edges, joined=joined), connected_components(edges)))
        assert got == want


def test_components_write_rows_by_nodes_not_by_edges(spark, monkeypatch):
    written, keep = [], Scratch.keep

    def counted(self, df, name):
        kept = keep(self, df, name)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    edges = spark.range(4000).selectExpr("concat('w', id % 63) as src", "concat('w', id * 7 % 64) as tgt").repartition(4)
    assert network.components(edges).count() == 64 and max(written) == 64
