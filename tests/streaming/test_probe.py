"""Probe runs that are killed, flushes by count, and progress rows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import text as T
from lexiweave.streaming import ledger, probe, progress


def answering(log, dies_at=None):
    """A scorer that notes each loading and each prompt; the ``dies_at``-th call fails."""
    def load():
        with open(f"{log}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def score(prompts):
            if dies_at and any(dies_at in p for p in prompts):
                raise RuntimeError("killed")
            with open(f"{log}/asked", "a") as f:
                f.write("".join(p.split("\n")[0] + "\n" for p in prompts))
            return [f"<think>x</think> sea, {p.split()[1]}" for p in prompts]

        return score
    return load


def test_a_killed_probe_goes_on_where_it_stood(spark, tmp_path):
    names = [f"q{'bcdefghijklmnopqrstu'[i % 20]}{'xy'[i // 20]}" for i in range(40)]
    cues, out = spark.createDataFrame([(n,) for n in [*names, names[1]]], "cue string"), str(tmp_path / "out")
    with pytest.raises(Exception, match="killed"):
        probe.run_probe(cues, 5, out, "m-dies", answering(str(tmp_path), f"{names[17]}\n"), T.probe_answers_a, batch=7, flush=16, wave=20)
    first = probe.read_answers(spark, out).count()
    assert first < 200
    got = probe.run_probe(cues, 5, out, "m-lives", answering(str(tmp_path)), T.probe_answers_a, batch=7, flush=16, wave=20)
    assert sorted(map(tuple, got.collect())) == sorted((n, t, "sea", n, "NaN") for n in names for t in range(1, 6))
    assert max(r.n for r in got.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) <= 16
    asked = len((tmp_path / "asked").read_text().splitlines())
    assert probe.run_probe(cues, 5, out, "m-lives", answering(str(tmp_path)), T.probe_answers_a).count() == 200
    assert len((tmp_path / "asked").read_text().splitlines()) == asked
    loads = (tmp_path / "loads").read_text().splitlines()
    assert len(loads) <= 2 * len(set(loads))


def test_groups_of_64_and_the_rest(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    sizes, sent = {}, []
    for step, n in enumerate((50, 100, 0, 7)):
        lines = [(lane, f"{step}-{lane}-{i}", False) for lane in (0, 1) for i in range(n + lane)]
        sent += [x[1] for x in lines]
        spark.createDataFrame(lines, probe.LINES).write.mode("append").json(source)
        probe.start_flushes(spark, source, out, state).awaitTermination()
    probe.end_lanes(spark, source, 3)
    probe.start_flushes(spark, source, out, state).awaitTermination()
    probe.end_lanes(spark, source, 3)
    probe.start_flushes(spark, source, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    for r in sorted(rows, key=lambda r: (r.lane, r.flush)):
        sizes.setdefault(r.lane, []).append(len(r.lines))
    assert sizes == {0: [64, 64, 29], 1: [64, 64, 33]} and sorted(x for r in rows for x in r.lines) == sorted(sent)


def test_progress_rows_of_every_batch(spark, tmp_path):
    source, path, state, folder = (str(tmp_path / x) for x in ("in", "ledger", "state", "progress"))
    listener = progress.ProgressRows(spark, folder)
    assert progress.read_progress(spark, folder).count() == 0
    spark.streams.addListener(listener)
    try:
        for ids in ("abc", "cd"):
            spark.createDataFrame([(i, "c", 0, "", "", True, "1") for i in ids], ledger.ROWS).coalesce(1).write.mode("append").json(source)
            ledger.run_ledger(spark, source, path, state)
        for _ in range(100):
            if progress.read_progress(spark, folder).count() == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    totals = spark.createDataFrame([(10, 2, 1, 1)], "total long, completed long, failed long, skipped long")
    got = progress.live_progress(progress.read_progress(spark, folder), totals, 1.0, 1.0).orderBy("batch").collect()
    assert [(r.rows_in, r.added, r.remaining, r.percent_complete) for r in got] == [(3, 3, 3, 66.6667), (2, 1, 2, 77.7778)]
    assert all(r.seconds > 0 and r.rate == round(r.added / r.seconds, 3) for r in got)
    priced = progress.read_progress(spark, folder).withColumn("metrics", F.expr("map('added', 1D, 'input_tokens', 2e6D, 'output_tokens', 1e6D)"))
    assert [(r.cost_usd, r.spent_usd) for r in progress.live_progress(priced, totals, 0.25, 2.0).orderBy("batch").collect()] == [(2.5, 2.5), (2.5, 5.0)]
