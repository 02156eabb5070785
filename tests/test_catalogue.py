"""Every registered query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from lexiweave.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that have no rows on the smallest tables are held against the next ones.
LARGER = {"outliers": "/root/testdata/sf0.01", "complete_cues": "/root/testdata/sf0.01"}


@pytest.fixture(scope="session")
def duck():
    found = {}
    for sf in (SF, *LARGER.values()):
        found[sf] = duckdb.connect()
        for t in TABLES:
            found[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return found


def canon(rows):
    f = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v
    return sorted([tuple(f(v) for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    sf = LARGER.get(name, SF)
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = duck[sf].execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall()
    assert canon(got.select(*[f"`{c}`" for c in cols]).collect()) == canon(want)
    assert want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_correlation_table_agrees_with_counts(spark):
    values = dict(map(tuple, QUERIES["correlation_table"](spark, SF).collect()))
    counts = QUERIES["oov_counts"](spark, SF).first()
    assert values["missing_words"] == counts.missing_words > 0 and values["missing_edges"] == counts.missing_edges


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["src", "tgt", "wt"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
