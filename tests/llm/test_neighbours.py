"""Multiprobe search against exact inner products of all pairs."""

import math

import numpy as np
import pytest

from lexiweave.llm import neighbours
from lexiweave.llm.neighbours import Params

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, step, k):
    """``query: [(id, score), ...]`` of all neighbours in their order."""
    sizes = [len(v) for _, v in rows if v is not None and len(v)]
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dim = max(set(sizes), key=lambda n: (sum(len(v) == n for _, v in good), -n)) if sizes else 0
    good = sorted((i, v) for i, v in good if len(v) == dim)
    if not good:
        return {}
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(np.float64)
    out = {}
    for i, v in good:
        if i % step == 0:
            s = x @ np.array(v, np.float32).astype(np.float64)
            order = [j for j in np.lexsort((ids, -s.round(9))) if ids[j] != i]
            out[i] = [(int(ids[j]), float(s[j])) for j in order[:k]]
    return out


def search(spark, rows, step=20, p=Params()):
    df = neighbours.nearest(spark.createDataFrame([(*r, 1) for r in rows], VECTORS), f"vec_id % {step} = 0", p)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(found[r["query_id"]]) == r["rank"]
    return found


def recall(found, want):
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def spheres(n, dim, seed, unit=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(12, dim))[rng.integers(0, 12, n)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.lognormal(size=(n, 1))).astype(np.float32)


@pytest.mark.parametrize("unit", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_recall_and_scores(spark, unit, small, monkeypatch):
    """Also with groups so small that buckets are split and queries shared out."""
    if small:
        monkeypatch.setattr(neighbours, "GROUP_BYTES", 30 * 8 * 16)
        monkeypatch.setattr(neighbours, "GROUP_QUERIES", 7)
    rows = [(i * 2, v.tolist()) for i, v in enumerate(spheres(1500, 16, 4, unit))]
    want, found = plain(rows, 20, 20), search(spark, rows)
    assert found.keys() == want.keys() and all(len(f) == 20 for f in found.values()) and recall(found, want) >= 0.9
    exact = {q: dict(w) for q, w in plain(rows, 20, 10**6).items()}
    for q, f in found.items():
        assert all(abs(s - exact[q][i]) < 1e-9 for i, s in f) and [s for _, s in f] == sorted((s for _, s in f), reverse=True)


def test_copies_ties_and_rows_that_take_no_part(spark):
    base = [v.tolist() for v in spheres(40, 4, 9)]
    rows = [(i, base[i % 7]) for i in range(300)] + [(1000 + i, v) for i, v in enumerate(base)] + [(20, base[20 % 7])] * 3
    rows += [(2000, None), (2001, []), (2020, [0.0] * 4), (2040, [1.0, None, 0.0, 0.0]), (2060, [1.0, float("nan"), 0.0, 0.0]), (2080, [float("inf"), 0.0, 0.0, 1.0]), (None, base[0]), (2100, [1.0, 2.0])]
    found, want = search(spark, rows, p=Params(recall=1.0)), plain(rows, 20, 20)
    assert found.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in w]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(20, [1.0, 0.0])], [(20, [1.0, 0.0]), (3, [0.5, 0.5]), (40, [0.0, -1.0])], [(20, None)]])
def test_few_rows(spark, rows):
    want = {q: w for q, w in plain(rows, 20, 20).items() if w}
    assert {q: [i for i, _ in f] for q, f in search(spark, rows).items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_other_columns_and_extreme_ids(spark):
    rows = [(i, v.tolist(), 1) for i, v in zip([-(2**63), 2**63 - 8, *range(100)], spheres(102, 8, 2), strict=True)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as v", "2 as id", "3 as rep", "'x' as key", "4 as score")
    got = neighbours.nearest(df, "vec_id % 20 = 0", Params(k=3, recall=1.0)).collect()
    want = plain([r[:2] for r in rows], 20, 3)
    assert {(r.query_id, r.rank): r.vec_id for r in got} == {(q, n + 1): i for q, w in want.items() for n, (i, _) in enumerate(w)}


def test_the_likeliest_buckets_come_first():
    rng = np.random.default_rng(0)
    model = neighbours._new_model(5, 4, 1.0, 1.0, Params())
    projected = model.queries(rng.normal(size=(6, 5)))
    keys = model.sequence(projected, 0, 625)
    assert all(len(set(row.tolist())) == 625 for row in keys)
    assert (model.sequence(projected, 0, 40) == keys[:, :40]).all() and (keys[:, 0] == model.keys(projected)[0]).mean() > 0.5
