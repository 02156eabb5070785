"""Requests, results and the ledger of collected trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.text import cost_usd, request_id
from lexiweave.operators.balance import cap_and_renumber, cap_per_cue, first_wins
from lexiweave.runtime import running_total_by_order

#: So many states, one row each, are broadcast.
STATES = 10_000


def request_index(cues: DataFrame, repetitions: int, first: int = 0) -> DataFrame:
    """``custom_id, cue, trial`` for every cue and trial."""
    return cues.select("cue", F.explode(F.sequence(F.lit(first), F.lit(first + repetitions - 1))).alias("trial")).select(
        request_id(F.col("cue"), F.col("trial")).alias("custom_id"), "cue", "trial"
    )


def pending(index: DataFrame, *done: DataFrame) -> DataFrame:
    """Requests whose id is in none of the id tables."""
    ids = done[0].select("custom_id")
    for d in done[1:]:
        ids = ids.union(d.select("custom_id"))
    return index.join(ids, "custom_id", "left_anti")


def match_results(results: DataFrame, index: DataFrame) -> DataFrame:
    """Results with their cue and trial; ``known`` is false where the index has no such id."""
    own = index.select(F.col("custom_id").alias("__id"), F.col("cue").alias("cue"), F.col("trial").alias("trial"))
    return results.join(own, results["custom_id"] == own["__id"], "left").withColumn("known", F.col("__id").isNotNull()).drop("__id")


def complete_cues(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the cues that have ``n`` rows or more."""
    enough = rows.groupBy("cue").agg(F.count("*").alias("__n")).where(F.col("__n") >= n)
    return rows.join(enough, "cue", "left_semi")


def completed_by_cue(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cue").agg(F.count("*").alias("completed"), F.countDistinct("custom_id").alias("distinct_ids"))


def usage_cost(usage: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """``input_tokens, output_tokens, cost_usd`` over all rows; absent numbers count as 0."""
    total = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return usage.agg(*total).withColumn("cost_usd", F.round(cost_usd(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out), 6))


def run_progress(index: DataFrame, states: DataFrame) -> DataFrame:
    """One row of counts: total, completed, errored, failed, skipped, remaining, percent.

    ``states(custom_id, state)`` with state completed, errored, failed or
    skipped. Errored requests are completed ones as well; skipped ones (done in
    an earlier run) are not remaining.
    """
    named = index.join(states, "custom_id", "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("state").isin("completed", "errored")).alias("completed"), F.count_if(F.col("state") == "errored").alias("errored"),
        F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "skipped").alias("skipped"),
    )
    done = F.col("completed") + F.col("failed")
    goal = F.col("total") - F.col("skipped")
    return named.withColumns({
        "remaining": goal - done, "percent_complete": F.when(goal > 0, F.round(F.lit(100.0) * done / goal, 4)).otherwise(F.lit(0.0)),
    })


def campaign_snapshot(master: DataFrame, ledger: DataFrame, repetitions: int) -> DataFrame:
    """One row: cues, completed rows, cues touched, cues full, and where the full prefix of ``(position, cue)`` ends."""
    have = ledger.groupBy("cue").agg(F.count("*").alias("n"))
    placed = master.join(have, "cue", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return placed.agg(
        F.count("*").alias("total_cues"), F.coalesce(F.sum("n"), F.lit(0)).alias("completed"), F.count_if(F.col("n") > 0).alias("touched"),
        F.count_if(F.col("n") >= repetitions).alias("full"), F.coalesce(F.min(F.when(F.col("n") < repetitions, F.col("position"))), F.count("*")).alias("next_start"),
    )


def merge_late(existing: DataFrame, late: DataFrame) -> DataFrame:
    """Existing rows and those late ones whose id and whose (cue, trial) are both new."""
    fresh = late.join(existing.select("custom_id"), "custom_id", "left_anti").join(existing.select("cue", "trial"), ["cue", "trial"], "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def requeue(submitted: DataFrame, lost_batch: DataFrame, done: DataFrame) -> DataFrame:
    """Submitted ids without those of a lost batch that are not done."""
    lost = lost_batch.select("custom_id").join(done.select("custom_id"), "custom_id", "left_anti")
    return submitted.join(lost, "custom_id", "left_anti")


def usage_of(usage: DataFrame, completed: DataFrame) -> DataFrame:
    """Usage rows of completed ids."""
    return usage.join(completed.select("custom_id"), "custom_id", "left_semi")


def open_cues(master: DataFrame, ledger: DataFrame, repetitions: int) -> DataFrame:
    """``position, cue, completed`` of the cues with fewer rows than ``repetitions``."""
    have = ledger.groupBy("cue").agg(F.count("*").alias("completed"))
    return master.join(have, "cue", "left").select("position", "cue", F.coalesce("completed", F.lit(0)).alias("completed")).where(F.col("completed") < repetitions)


def skipped_count(index: DataFrame, campaign: DataFrame) -> DataFrame:
    """One row ``skipped``: requests that an earlier run completed."""
    return index.join(campaign.select("custom_id"), "custom_id", "left_semi").agg(F.count("*").alias("skipped"))


def is_terminal(state: Column) -> Column:
    # States that no run leaves.
    return state.isin("completed", "timed_out", "failed")


def guard(progress: DataFrame, limit_usd: float | None) -> DataFrame:
    """``action`` for each row of ``state, cost_usd``: ``stop`` if the state is final, ``wait`` if paused, ``pause`` at the cost limit, else ``run``."""
    over = F.lit(False) if limit_usd is None else F.col("cost_usd") >= limit_usd
    return progress.withColumn(
        "action", F.when(is_terminal(F.col("state")), "stop").when(F.col("state") == "paused", "wait").when((F.col("state") == "running") & over, "pause").otherwise("run")
    )


def status_line(progress: DataFrame) -> DataFrame:
    """``line``: a progress row as one line of text."""
    cell = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return progress.select(F.concat_ws(" ", *[cell(c) for c in progress.columns]).alias("line"))


def sync_campaign(rows: DataFrame, ledger: DataFrame, repetitions: int) -> DataFrame:
    """Ledger rows after a run's ``custom_id, cue, trial, ...`` were taken in: at most ``repetitions`` a cue by trial, ids once, the ledger's first."""
    capped = cap_per_cue(rows.where("cue <> ''"), repetitions, ["trial", "custom_id"])
    fresh = first_wins(capped.withColumn("__at", F.struct("trial", "cue")), "custom_id", "__at").join(ledger.select("custom_id"), "custom_id", "left_anti")
    return ledger.unionByName(fresh.select(*ledger.columns))


def reconcile(existing: DataFrame, late: DataFrame, repetitions: int, position: str = "position") -> DataFrame:
    """Existing and new late rows, of cues with ``repetitions`` rows or more, their first ones by ``position``, renumbered.

    Late rows come behind the existing ones of their cue; ids follow from the new numbers.
    """
    placed = merge_late(existing.withColumn("__late", F.lit(0)), late.withColumn("__late", F.lit(1))).withColumn("__at", F.struct("__late", position))
    kept = cap_and_renumber(placed, repetitions, "__at")
    return kept.withColumn("custom_id", request_id(F.col("cue"), F.col("trial"))).drop("__late", "__at")


def reconciled_artefacts(
    index: DataFrame, existing: DataFrame, late: DataFrame, usage: DataFrame, late_usage: DataFrame, still_open: DataFrame, repetitions: int, prices: tuple[float, float], position: str = "position"
) -> dict[str, DataFrame]:
    """What a run consists of after late results were taken in, to be committed as one: rows, index, usage, checkpoint and progress.

    ``rows`` are those of ``reconcile``; ``index`` numbers their ids. Usage of
    late results counts if their id is among these; all earlier usage stays, but
    costs are those of completed ids. Submitted are completed ids and those of
    batches that are ``still_open``.
    """
    rows = reconcile(existing, late, repetitions, position)
    done = rows.select("custom_id").distinct()
    columns = ["custom_id", "input_tokens", "output_tokens"]
    spent = usage.select(columns).unionByName(usage_of(late_usage, done).select(columns))
    states = done.withColumn("state", F.lit("completed"))
    checkpoint = states.unionByName(done.union(still_open.select("custom_id")).distinct().withColumn("state", F.lit("submitted")))
    counts = run_progress(index, states).select("total", "completed", "remaining", "percent_complete")
    progress = counts.crossJoin(F.broadcast(usage_cost(usage_of(spent, done), *prices)))
    return {"rows": rows, "index": sorted_ids(states).select("position", "custom_id"), "usage": spent, "checkpoint": checkpoint, "progress": progress}


def sorted_ids(states: DataFrame) -> DataFrame:
    """``state, position, custom_id`` of ``custom_id, state``: each state's distinct ids, numbered from 0 in order."""
    ids = states.select("state", "custom_id").where("state is not null and custom_id is not null").distinct()
    placed = running_total_by_order(ids, ["state", "custom_id"], "at")
    first = placed.groupBy("state").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first) if first.count() <= STATES else first, "state").select("state", (F.col("at") - F.col("first")).alias("position"), "custom_id")
