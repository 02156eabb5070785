"""Operators on rows with nulls, repeats, a very long text and columns whose names they use themselves."""

import pytest

import corpus_pipeline
from lexiweave.llm import fingerprints, language_id, mixing, near_dedup, sharding
from tests.llm.conftest import DOCS

CLASHING = (
    "1 as shard", "2 as slot", "'x' as rep", "3 as component_id", "4 as n_shingles", "'y' as sig", "5 as bucket", "true as ahead", "false as named", "6 as size", "7 as taken", "8 as held_out",
    "'z' as lang_pred", "9.5 as score", "10 as kept", "11 as block", "12 as place", "13 as target", "14 as source_size", "'w' as law", "15 as copies", "16 as node", "17 as part", "18 as v",
)
OPERATORS = {
    "op1": lambda d: sharding.shard_documents(d, n_shards=16),
    "op2": near_dedup.near_duplicates,
    "op4": fingerprints.fingerprint_documents,
    "op5": language_id.identify,
    "op8": mixing.taken,
}


@pytest.fixture(scope="module")
def odd(spark, corpus):
    rows = [*corpus[:60], (None, corpus[1][1], "en", None, 3), (None, None, None, None, None), (None, "a b", "de", "a", 3), (None, "a b", "de", "a", 3), (-(2**63), "c d e", "en", "b", 5)]
    return [*rows, (2**63 - 1, "very long Text " * 70_000, "en", "a", 1_050_000)]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_change_nothing(spark, odd, name):
    docs = spark.createDataFrame(odd, DOCS)
    plain, clashing = (sorted(map(repr, map(tuple, OPERATORS[name](d).collect()))) for d in (docs, docs.selectExpr("*", *CLASHING)))
    assert plain == clashing
    ids = sorted(repr(r[0]) for r in odd)
    assert sorted(repr(r.doc_id) for r in OPERATORS[name](docs).select("doc_id").collect()) == ids


@pytest.mark.parametrize("name, stage", [s for s in corpus_pipeline.STAGES if s[0] in ("language_id", "near_dedup", "decontamination")])
def test_filtering_stages_keep_columns_and_rows(spark, odd, tmp_path, name, stage):
    spark.createDataFrame([(1, "nothing of this kind is in any text of the corpus here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(odd, DOCS).selectExpr("*", *CLASHING)
    kept = stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got, want = sorted(map(repr, map(tuple, kept.collect()))), sorted(map(repr, map(tuple, docs.collect())))
    assert set(got) <= set(want) and len(got) >= (len(want) if name == "decontamination" else 20)
