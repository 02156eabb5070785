"""Streams with keyed state against plain replays."""

import random
import time
from datetime import datetime, timedelta

import pyarrow as pa

from lexiweave.streaming import admission, ledger
from lexiweave.streaming.admission import EVENTS, Limits
from lexiweave.streaming.ledger import ROWS

START = datetime(2024, 1, 1)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def replay(events, limits):
    """The log of one run's events, by lists."""
    pending, open_, done, left, batches, over, paused, log = [], {}, set(), set(), 0, False, False, []
    for run, seq, at, kind, id_, batch in events:
        steps = []
        if not over and at >= events[0][2] + limits.timeout:
            over = True
            steps.append(("timed_out", None, []))
        inside = {i: b for b, ids in open_.items() for i in ids}
        if kind == "request" and id_ not in done | left and id_ not in pending and id_ not in inside:
            pending.append(id_)
        elif kind == "result" and id_ not in done:
            known = id_ in pending or id_ in inside or id_ in left
            done.add(id_)
            left.discard(id_)
            pending = [p for p in pending if p != id_]
            steps.append(("completed" if known else "failed", inside.get(id_), [id_]))
            if id_ in inside:
                open_[inside[id_]].remove(id_)
                if not open_[inside[id_]]:
                    del open_[inside[id_]]
                    steps.append(("closed", inside[id_], []))
        elif kind in ("lost", "ended") and batch in open_:
            ids = open_.pop(batch)
            if kind == "lost":
                pending += ids
            else:
                left |= set(ids)
            steps.append(("requeued" if kind == "lost" else "closed", batch, ids))
        elif kind in ("pause", "resume"):
            paused = kind == "pause"
        elif kind == "poll" and not over and not paused:
            while pending and (limits.slots is None or len(open_) < limits.slots):
                open_[batches], pending = pending[: limits.limit], pending[limits.limit :]
                steps.append(("submitted", batches, list(open_[batches])))
                batches += 1
        assert limits.slots is None or len(open_) <= limits.slots
        log += [(run, seq, i, *s) for i, s in enumerate(steps)]
    return log


def story(seed, n):
    rng = random.Random(seed)
    kinds = ["request"] * 6 + ["result"] * 6 + ["poll"] * 4 + ["lost", "ended", "pause", "resume", "resume"]
    out = []
    for i in range(n):
        kind = rng.choice(kinds)
        out.append((f"run{seed}", i, START + timedelta(minutes=i), kind, f"q{rng.randint(0, 60)}" if kind in ("request", "result") else None, rng.randint(0, 12) if kind in ("lost", "ended") else None))
    return out


def entries(df):
    return sorted(((r.run, r.seq, r.step, r.action, r.batch, r.ids) for r in df.collect()), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))


def test_the_log_equals_a_replay_however_the_events_are_cut(spark, tmp_path):
    for slots in (2, None):
        limits = Limits(slots, 3, timedelta(minutes=150))
        runs = [story(seed, 190) for seed in (1, 2, 3)]
        want = sorted(entry for events in runs for entry in replay(events, limits))
        assert {w[3] for w in want} == {"timed_out", "completed", "failed", "closed", "requeued", "submitted"}
        for cuts in ([190], [3, 60, 61, 190]):
            source, log, state = (str(tmp_path / f"{slots}-{len(cuts)}-{x}") for x in ("in", "log", "state"))
            for a, b in zip([0, *cuts], cuts, strict=False):
                rows = [e for events in runs for e in events[a:b]]
                random.Random(b).shuffle(rows)
                write(spark, rows, EVENTS, source)
                found = admission.run_admission(spark, source, log, state, limits)
            assert entries(found) == want


def test_a_silent_run_times_out(spark, tmp_path):
    source, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    write(spark, [("r", 0, START, "request", "a", None), ("r", 1, START, "poll", None, None)], EVENTS, source)
    query = admission.start_admission(spark, source, log, state, Limits(1, 5, timedelta(seconds=1)), poll="500 milliseconds")
    for _ in range(120):
        time.sleep(0.5)
        found = entries(spark.read.schema(admission.LOG).parquet(log)) if query.lastProgress else []
        if len(found) == 2:
            break
    query.stop()
    assert found == [("r", 1, 0, "submitted", 0, ["a"]), ("r", None, 0, "timed_out", None, [])]
    write(spark, [("r", 2, START, "request", "b", None), ("r", 3, START, "lost", None, 0), ("r", 4, START, "poll", None, None)], EVENTS, source)
    assert entries(admission.run_admission(spark, source, log, state, Limits(1, 5, timedelta(seconds=1))))[1:] == [("r", 3, 0, "requeued", 0, ["a"]), ("r", None, 0, "timed_out", None, [])]


def test_ids_of_earlier_runs_are_not_added_again(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    row = lambda i, at="1": (i, "c", 0, "", "", True, at)
    known = spark.createDataFrame([row("old"), row("old"), row(None)], ROWS)
    write(spark, [row("old"), row("new", "3"), row("new", "2"), row("", "1")], ROWS, source)
    assert ledger.run_ledger(spark, source, path, state, known=known) == 1
    write(spark, [row("old", "0"), row("new", "0"), row("later")], ROWS, source)
    assert ledger.run_ledger(spark, source, path, state, known=known) == 1
    assert sorted((r.custom_id, r.updated_at) for r in ledger.read_ledger(spark, path, known.where("custom_id = 'old'").limit(1)).collect()) == [("later", "1"), ("new", "2"), ("old", "1")]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    """The commit of the last batch is lost, as in a crash right after the sink wrote."""
    source, path, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    row = lambda i: (i, "c", 0, "", "", True, "1")
    for ids in ("ab", "bc"):
        write(spark, [row(i) for i in ids], ROWS, source)
        ledger.run_ledger(spark, source, path, state)
    last = max((tmp_path / "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    write(spark, [row("d")], ROWS, source)
    ledger.run_ledger(spark, source, path, state)
    assert sorted(r.custom_id for r in ledger.read_ledger(spark, path).collect()) == ["a", "b", "c", "d"]


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    """Rows that a batch reads, from source and files, do not grow with the ledger."""
    source, path, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    row = lambda i: (f"id{i}", "c", 0, "", "", True, "1")
    write(spark, [row(i) for i in range(3000)], ROWS, source)
    ledger.run_ledger(spark, source, path, state)
    write(spark, [row(i) for i in range(2995, 3005)], ROWS, source)
    query = ledger.start_ledger(spark, source, path, state)
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == 10 and ledger.added_rows(query) == 5


def test_a_batch_is_cut_down_to_first_rows_before_the_state(spark, tmp_path, monkeypatch):
    """Ids are state of Spark's own; nulls and ids of earlier runs come first, however the rows are cut."""
    source, path, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    write(spark, [(f"id{i % 7}", None if i == 11 else "c", i, "", "", i % 2 == 0, "1") for i in range(40)], ROWS, source)
    query = ledger.start_ledger(spark, source, path, state, known=spark.createDataFrame([("id2", "c", 0, "", "", True, "9")], ROWS))
    query.awaitTermination()
    assert [o.operatorName for p in query.recentProgress for o in p.stateOperators][:1] == ["dedupe"]
    assert sorted((r.custom_id, r.trial) for r in ledger.read_ledger(spark, path).collect()) == [("id0", 0), ("id1", 1), ("id3", 3), ("id4", 11), ("id5", 5), ("id6", 6)]
    monkeypatch.setattr(ledger, "HELD_ROWS", 3)
    names = [x.split()[0] for x in ROWS.split(",")]
    rows = [dict(zip(names, (f"id{i % 5}", "c", i, None, "", True, str(9 - i % 3)), strict=True)) | {"known": i == 8} for i in range(30)]
    schema = pa.schema([("custom_id", pa.string()), ("cue", pa.string()), ("trial", pa.int32()), ("raw_text", pa.string()), ("parsed", pa.string()), ("ok", pa.bool_()), ("updated_at", pa.string()), ("known", pa.bool_())])
    found = pa.Table.from_batches(ledger._earliest(pa.RecordBatch.from_pylist(rows[i : i + 4], schema) for i in range(0, 30, 4)), schema).to_pylist()
    want = {k: min((r for r in rows if r["custom_id"] == k), key=lambda r: (not r["known"], r["updated_at"], r["trial"])) for k in {r["custom_id"] for r in rows}}
    assert {r["custom_id"]: r for r in found} == want and len(found) == 5
