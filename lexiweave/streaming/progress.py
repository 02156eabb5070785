"""Live progress: what every micro-batch did, as rows that a reader can follow.

A listener puts one small file for each finished micro-batch into a folder,
named by query and batch, in one step; a batch that is reported twice has one
row. Readers join the rows to the run's totals.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lexiweave.functions.text import cost_usd
from lexiweave.sources import commits

ROWS = "query string, batch long, at string, rows_in long, seconds double, metrics map<string,double>"


class ProgressRows(StreamingQueryListener):
    """Add the progress of the session's queries to a folder: ``spark.streams.addListener(ProgressRows(spark, path))``.

    ``metrics`` holds the numbers of every ``observe`` of the query by their names. Batches without rows are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:
            return
        metrics = {k: float(v) for row in p.observedMetrics.values() for k, v in row.asDict().items() if isinstance(v, (int, float))}
        line = {"query": str(p.id), "batch": p.batchId, "at": p.timestamp, "rows_in": p.numInputRows, "seconds": p.batchDuration / 1000, "metrics": metrics}
        commits.put_text(self.spark, json.dumps(line) + "\n", f"{self.path}/{p.id}-{p.batchId:09d}.json")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows so far, none if no batch has ended yet."""
    return spark.read.schema(ROWS).json(path) if commits.exists(spark, path) else spark.createDataFrame([], ROWS)


def live_progress(rows: DataFrame, totals: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """A row for each batch of a query: what it added and cost, its rate, and how far the run had come by then.

    ``totals`` is the run's row of counts (see ``run_progress``) from when the
    stream began: ``total``, ``completed``, ``failed``, ``skipped``.
    """
    number = lambda name: F.coalesce(F.col("metrics")[name], F.lit(0.0))
    so_far = Window.partitionBy("query").orderBy("batch")
    named = rows.withColumns({"added": number("added").cast("long"), "cost_usd": F.round(cost_usd(number("input_tokens"), number("output_tokens"), price_in, price_out), 6)})
    run = named.withColumns({
        "rate": F.when(F.col("seconds") > 0, F.round(F.col("added") / F.col("seconds"), 3)), "done": F.sum("added").over(so_far), "spent_usd": F.round(F.sum("cost_usd").over(so_far), 6),
    })
    before = totals.select((F.col("total") - F.col("skipped")).alias("goal"), (F.col("completed") + F.col("failed")).alias("before"))
    done = F.col("before") + F.col("done")
    return run.crossJoin(F.broadcast(before)).select(
        "query", "batch", "at", "rows_in", "added", "seconds", "rate", "cost_usd", "spent_usd", (F.col("goal") - done).alias("remaining"),
        F.when(F.col("goal") > 0, F.round(F.lit(100.0) * done / F.col("goal"), 4)).otherwise(F.lit(0.0)).alias("percent_complete"),
    )
