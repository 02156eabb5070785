"""The ledger as a stream: every request id is added once, however often it arrives.

Of a micro-batch's rows the earliest of each id is found by a shuffle; which
ids were taken is keyed state of the stream (RocksDB, Spark's own
``dropDuplicates``), so the work of a micro-batch follows its own rows, not the
size of the ledger, and Python takes rows in Arrow batches only. State, source
offsets and the files of the sink go by the same batch number: a batch that is
replayed after a failure finds the state from before it and its files are
committed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiweave.runtime import setting
from lexiweave.sources import commits

# The fields of a ledger row.
ROWS = "custom_id string, cue string, trial int, raw_text string, parsed string, ok boolean, updated_at string"
#: Name of the numbers that each micro-batch reports.
METRICS = "ledger"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_settings(spark: SparkSession) -> ExitStack:
    """Session settings under which a query with keyed state is started; a started query keeps its own copy."""
    stack = ExitStack()
    stack.enter_context(setting(spark, "spark.sql.streaming.stateStore.providerClass", _ROCKSDB))
    stack.enter_context(setting(spark, "spark.sql.streaming.numRecentProgressUpdates", "100000"))
    return stack


#: So many rows of a partition are held before all but the earliest of each id go.
HELD_ROWS = 100_000
#: What makes a row the earliest of its id: ids of earlier runs, then Spark's order of structs, nulls first.
_ORDER = [("custom_id", "ascending"), ("known", "descending"), *[(c, "ascending") for c in ("updated_at", "cue", "trial", "raw_text", "parsed", "ok")]]


def _first_of_ids(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    large = pa.schema([f.with_type(pa.large_string()) if pa.types.is_string(f.type) else f for f in rows.schema])
    rows = rows.cast(large)
    rows = rows.take(pc.sort_indices(rows, sort_keys=_ORDER, null_placement="at_start"))
    ids, first = rows.column("custom_id").combine_chunks(), np.ones(rows.num_rows, bool)
    first[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(first)).to_batches(max_chunksize=10_000)


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest row of each id of a partition."""
    held, n, most, schema = [], 0, HELD_ROWS, None
    for batch in batches:
        schema = schema or batch.schema
        held.append(batch)
        n += batch.num_rows
        if n > most:
            held = [b.cast(schema) for b in _first_of_ids(held)]
            n = sum(b.num_rows for b in held)
            most = max(HELD_ROWS, 2 * n)
    if n:
        for batch in _first_of_ids(held):
            yield batch.cast(schema)


def start_ledger(
    spark: SparkSession, source: str, ledger_path: str, checkpoint: str, files_per_trigger: int = 100, poll: str | None = None, known: DataFrame | None = None
) -> StreamingQuery:
    """Take in the JSON-lines files of ``source``: those there are, or new ones every ``poll`` (such as ``5 seconds``).

    ``ledger_path`` belongs to the stream. Ids of ``known``, the ledger of
    earlier runs, count as taken; it is read once, when the checkpoint is new,
    and its ids are a source of their own, all in the first batch.
    Rows without an id are left out. To pause, ``stop`` the query; a new one
    with the same checkpoint resumes where it stood. Each batch reports how
    many rows it added.
    """
    before = f"{checkpoint}/known"
    if not commits.exists(spark, f"{checkpoint}/offsets"):
        ids = known.select("custom_id").where("custom_id <> ''").distinct() if known is not None else spark.range(0).select(F.lit("").alias("custom_id"))
        ids.write.mode("overwrite").json(before)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_trigger).json(source).where("custom_id <> ''").withColumn("known", F.lit(False))
    taken = spark.readStream.schema("custom_id string").json(before).withColumn("known", F.lit(True))
    rows = stream.unionByName(taken, allowMissingColumns=True).repartition("custom_id").mapInArrow(_earliest, f"{ROWS}, known boolean")
    fresh = rows.dropDuplicates(["custom_id"]).where("not known").drop("known")
    fresh = fresh.observe(METRICS, F.count("*").alias("added"))
    writer = fresh.writeStream.format("parquet").option("path", ledger_path).option("checkpointLocation", checkpoint)
    with stateful_settings(spark):
        return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def run_ledger(spark: SparkSession, source: str, ledger_path: str, checkpoint: str, files_per_trigger: int = 100, known: DataFrame | None = None) -> int:
    """Take in all files of ``source`` that were not taken in before; returns how many rows that added."""
    query = start_ledger(spark, source, ledger_path, checkpoint, files_per_trigger, known=known)
    query.awaitTermination()
    return added_rows(query)


def added_rows(query: StreamingQuery) -> int:
    """Rows that a ledger query added since its start."""
    return sum(p.observedMetrics[METRICS]["added"] for p in query.recentProgress if METRICS in p.observedMetrics)


def read_ledger(spark: SparkSession, ledger_path: str, known: DataFrame | None = None) -> DataFrame:
    """The rows of a ledger, behind those of earlier runs."""
    own = spark.read.schema(ROWS).parquet(ledger_path)
    return own if known is None else known.select(*own.columns).unionByName(own)


def ledger_index(ledger: DataFrame) -> DataFrame:
    """``cue, completed`` of the ledger; always derived, never stored."""
    return ledger.groupBy("cue").agg(F.countDistinct("custom_id").alias("completed"))
