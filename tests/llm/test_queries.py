"""The numbered queries against their SQL and their names."""

import duckdb
import pytest

from lexiweave.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def canon(rows):
    return sorted([tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert canon(got.select(*cols).collect()) == canon(c.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall())


def test_one_query_for_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
