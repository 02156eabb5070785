"""Probing a model: what is missing is queued, scored, cleaned and appended.

The queue is what the output lacks, so a run that was killed goes on where it
stood. It is cut into waves by hash; a wave is one append, in files of ``flush``
rows, and what it wrote counts as done for the next one. Scoring goes on in
tasks, with one model for each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexiweave.functions.text import RESPONSES, prompt
from lexiweave.operators.ledger import request_index
from lexiweave.runtime import Scratch
from lexiweave.sources import commits
from lexiweave.streaming.ledger import stateful_settings

ANSWERS = "cue string, trial_id int, R1 string, R2 string, R3 string"
#: Takes prompts, gives as many replies.
Scorer = Callable[[list[str]], list[str]]
_MODELS: dict[str, Scorer] = {}


def _loaded(model: str, load: Callable[[], Scorer]) -> Scorer:
    """The worker's model; a function of this module, as what tasks are sent brings copies of its variables."""
    if model not in _MODELS:
        _MODELS[model] = load()
    return _MODELS[model]


def _scored(model: str, load: Callable[[], Scorer], batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _loaded(model, load)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                replies = score(part["prompt"].tolist())
                if len(replies) != len(part):
                    raise ValueError(f"{len(replies)} replies to {len(part)} prompts")
                yield part[["cue", "trial_id"]].assign(reply=replies)
    return run


def missing(cues: DataFrame, repetitions: int, done: DataFrame) -> DataFrame:
    """``cue, trial_id`` from 1 to ``repetitions`` of distinct cues that are not done."""
    tasks = request_index(cues.select("cue").distinct(), repetitions, first=1).select("cue", F.col("trial").alias("trial_id"))
    return tasks.join(done.select("cue", "trial_id"), ["cue", "trial_id"], "left_anti")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(path) if commits.exists(spark, path) else spark.createDataFrame([], ANSWERS)


def run_probe(
    cues: DataFrame, repetitions: int, path: str, model: str, load: Callable[[], Scorer], clean: Callable[[Column], Column], batch: int = 64, flush: int = 64, wave: int = 1_000_000
) -> DataFrame:
    """Append ``cue, trial_id, R1, R2, R3`` of every missing task to the Parquet folder ``path``; what is there then.

    ``load`` makes a scorer, once in each Python worker for a ``model`` name;
    it gets ``batch`` prompts at a time. ``clean`` turns a reply into three
    answers. A wave has about ``wave`` tasks. One run at a time may write.
    """
    spark = cues.sparkSession
    queue = Scratch(spark, "probe").keep(missing(cues, repetitions, read_answers(spark, path)), "queue")
    waves = max(1, -(-queue.count() // wave))
    for w in range(waves):
        tasks = queue.where(F.pmod(F.xxhash64("cue", "trial_id"), F.lit(waves)) == w).withColumn("prompt", prompt(F.col("cue"))).repartition("cue", "trial_id")
        replies = tasks.mapInPandas(_scored(model, load, batch), "cue string, trial_id int, reply string").withColumn("said", clean(F.col("reply")))
        answers = replies.select("cue", "trial_id", *[F.coalesce(F.get("said", F.lit(i)), F.lit("NaN")).alias(r) for i, r in enumerate(RESPONSES)])
        answers.write.mode("append").option("maxRecordsPerFile", flush).parquet(path)
    return read_answers(spark, path)


class FlushByCount(StatefulProcessor):
    """Gathers the rows of a lane and passes them on ``size`` at a time; a row whose ``last`` is true passes on the rest."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "line string")
        self.at = handle.getValueState("at", "flush long, rows int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        flush, n = self.at.get() if self.at.exists() else (0, 0)
        held, ended = [r[0] for r in self.held.get()] if n else [], False
        for row in rows:
            ended = ended or bool(row.last)
            if row.line is not None:
                held.append(row.line)
            if len(held) == self.size:
                yield Row(lane=key[0], flush=flush, lines=held)
                flush, held = flush + 1, []
        if ended and held:
            yield Row(lane=key[0], flush=flush, lines=held)
            flush, held = flush + 1, []
        if held:
            self.held.put([(x,) for x in held])
        else:
            self.held.clear()
        self.at.update((flush, len(held)))

    def close(self) -> None:
        pass


LINES = "lane int, line string, last boolean"


def start_flushes(spark: SparkSession, source: str, path: str, checkpoint: str, size: int = 64) -> StreamingQuery:
    """Pass on the JSON lines ``lane, line, last`` of ``source`` in groups of ``size`` of a lane: ``lane, flush, lines`` in Parquet."""
    rows = spark.readStream.schema(LINES).json(source).where("lane is not null")
    groups = rows.groupBy("lane").transformWithState(FlushByCount(size), "lane int, flush long, lines array<string>", "Append", "None")
    with stateful_settings(spark):
        return groups.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def end_lanes(spark: SparkSession, source: str, lanes: int) -> None:
    """Tell the lanes 0 to ``lanes`` - 1 that nothing more will come: the next run passes on what they hold."""
    spark.range(lanes).select(F.col("id").cast("int").alias("lane"), F.lit(True).alias("last")).write.mode("append").json(source)
