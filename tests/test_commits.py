"""Replacing files and groups of tables: what a reader finds when a writer dies at any point."""

import pytest
from pyspark.sql import DataFrameWriter

from lexiweave.operators import ledger
from lexiweave.sources import commits, files
from lexiweave.sources.commits import Conflict, Versions


class Died(Exception):
    pass


def hidden(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc"))


def test_a_file_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "a" / "m.json")
    commits.put_text(spark, "old", path)
    commits.put_text(spark, "new ä", path)
    assert commits.read_text(spark, path) == "new ä" and hidden(tmp_path / "a") == []
    with pytest.raises(Conflict):
        commits.put_text(spark, "third", path, replace=False)
    assert commits.read_text(spark, path) == "new ä" and hidden(tmp_path / "a") == []


def test_a_failing_rewrite_leaves_the_old_row(spark, tmp_path):
    path = str(tmp_path / "m.json")
    row = files.create_or_load(spark.createDataFrame([("r", "running", "")], "run string, state string, updated_at string"), path)
    bad = row.selectExpr("run", "raise_error('no') as state", "updated_at")
    with pytest.raises(Exception, match="no"):
        files.rewrite(bad, path)
    assert row.first().state == "running" and hidden(tmp_path) == []
    assert files.rewrite(row.selectExpr("run", "'done' as state", "updated_at"), path).first().state == "done"
    assert files.create_or_load(row.selectExpr("'x' as run", "state", "updated_at"), path).first().run == "r"


def test_missing_and_odd_files_give_the_default(spark, tmp_path):
    default = spark.createDataFrame([(0,)], "n int")
    for name, text, want in (("none", None, 0), ("bad", "{n", 0), ("list", "[1]", 0), ("empty", "", 0), ("good", '{\n "n": 5\n}', 5)):
        if text is not None:
            (tmp_path / name).write_text(text)
        assert files.read_or_default(spark, str(tmp_path / name), "n int", default).first().n == want


@pytest.fixture()
def run_tables(spark):
    rows = lambda *r: spark.createDataFrame(r, "custom_id string, cue string, trial int, position int")
    usage = lambda *r: spark.createDataFrame(r, "custom_id string, input_tokens int, output_tokens int")
    index = ledger.request_index(spark.createDataFrame([("a",), ("b",)], "cue string"), 2)
    ids = {(r.cue, r.trial): r.custom_id for r in index.collect()}
    return ledger.reconciled_artefacts(
        index, rows((ids["a", 0], "a", 0, 1)), rows((ids["a", 1], "a", 1, 1), (ids["b", 0], "b", 0, 1)), usage((ids["a", 0], 10, 1)),
        usage((ids["a", 1], 100, 2), (ids["b", 0], 1000, 3)), rows((ids["b", 1], "b", 1, 1)), 2, (1e6, 0.0),
    ), ids


def test_artefacts_of_a_reconciled_run(run_tables):
    made, ids = run_tables
    got = {name: sorted(map(tuple, df.collect())) for name, df in made.items()}
    done = sorted([ids["a", 0], ids["a", 1]])
    assert sorted((r.cue, r.trial) for r in made["rows"].collect()) == [("a", 0), ("a", 1)]
    assert got["index"] == list(enumerate(done)) and got["usage"] == sorted([(ids["a", 0], 10, 1), (ids["a", 1], 100, 2)])
    assert got["checkpoint"] == sorted([(i, "completed") for i in done] + [(i, "submitted") for i in [*done, ids["b", 1]]])
    assert got["progress"] == [(4, 2, 2, 50.0, 110, 3, 110.0)]


def test_a_crash_between_any_two_writes_leaves_the_old_version(spark, tmp_path, monkeypatch, run_tables):
    made, _ = run_tables
    versions = Versions(spark, str(tmp_path / "run"))
    assert versions.current() == 0
    old = {name: spark.createDataFrame([(i,)], "old int") for i, name in enumerate(made)}
    assert versions.commit(old) == 1
    parquet, put = DataFrameWriter.parquet, commits.put_text
    for survived in range(len(made) + 1):
        left = [survived]

        def dying(self, *a, left=left, **k):
            left[0] -= 1
            if left[0] < 0:
                raise Died
            return parquet(self, *a, **k)

        def no_entry(*a, **k):
            raise Died

        monkeypatch.setattr(DataFrameWriter, "parquet", dying)
        monkeypatch.setattr(commits, "put_text", no_entry)
        with pytest.raises(Died):
            versions.commit(made)
        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        monkeypatch.setattr(commits, "put_text", put)
        assert versions.current() == 1
        assert [versions.read(name).first().old for name in made] == list(range(len(made)))
    assert versions.commit(made) == 2 and versions.read("progress").first().completed == 2 and versions.read("usage", 1).columns == ["old"]
    with pytest.raises(Conflict):
        versions.commit(old, base=1)
    versions.clear()
    assert versions.read("usage").count() == 2 and len(list((tmp_path / "run/tables").iterdir())) == 1 and len(versions._numbers()) == 1
