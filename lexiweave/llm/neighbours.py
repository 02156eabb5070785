"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

1. Rows with the same vector are one class, of which no more than the ``k + 1``
   smallest ids can be of use; query vectors that are alike are searched once.
2. A vector ``x`` is hashed as ``(x / m, sqrt(1 - |x / m|^2))``, ``m`` being the
   largest norm, and a query as ``(q / |q|, 0)``: nearest on these points means
   largest inner product. A table has ``depth`` Gaussian projections, each cut
   into cells of ``width`` deviations with a random offset; a bucket is a cell
   of all of them.
3. A query visits its own bucket and perturbed ones, up to two cells away in
   every projection, in the order of the estimated chance that a neighbour lies
   there; the chance comes from how neighbours' projections lie about those of
   a sample of queries. How many buckets are visited, and the depth, also come
   from that sample: so many that it finds the wanted share of its true
   neighbours.
4. Tables are dealt to groups of whole buckets of about ``GROUP_BYTES``; a
   larger bucket is split, and so are the queries of a group that many visit. A
   task holds the vectors of a group, passes the queries along them bucket by
   bucket, with exact inner products, and keeps the best of each query only.
   The bests of all groups and tables are merged.

The sample is ``SAMPLE_QUERIES`` query vectors, compared with all rows, and
``SAMPLE_ROWS`` rows for the spread; every row is indexed. The smallest hashes
decide who is in the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.runtime import Scratch

SAMPLE_QUERIES = 100
SAMPLE_ROWS = 2000
#: Vectors of a group, in double precision.
GROUP_BYTES = 4 << 20
#: Queries that one task passes along a group, at most.
GROUP_QUERIES = 50_000
#: Cells to either side of a query's own that a probe may differ by in one projection.
REACH = 2
_CHUNK = 256


@dataclass(frozen=True)
class Params:
    """``k`` neighbours of each query; ``recall`` is the share of true neighbours that the sample has to find."""

    k: int = 20
    tables: int = 2
    width: float = 4.0
    recall: float = 0.95
    most_probes: int = 512
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """The tables: ``planes[t]`` projects, ``offsets[t]`` shifts and ``factors[t]`` mixes the cells of table ``t``."""

    planes: np.ndarray
    offsets: np.ndarray
    factors: np.ndarray
    width: float
    norm: float
    slope: float = 1.0
    spread: float = 1.0
    probes: int = 1

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Projections ``(table, row, depth)`` of candidates."""
        x = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1) @ self.planes

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Projections of queries."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ self.planes

    def keys(self, projected: np.ndarray) -> np.ndarray:
        """Bucket ``(table, row)`` of projections."""
        cells = np.floor((projected + self.offsets[:, None, :]) / self.width).astype(np.int64)
        return (cells * self.factors[:, None, :]).sum(axis=2)

    def sequence(self, projected: np.ndarray, table: int, most: int) -> np.ndarray:
        """The buckets ``(row, probe)`` that queries visit in a table, the likeliest first.

        Chances of the projections multiply, so the best ``most`` combinations
        begin with the best ``most`` of the projections before.
        """
        at = projected[table]
        cells = np.floor((at + self.offsets[table]) / self.width)
        edges = (cells[:, :, None] + np.arange(-REACH, REACH + 2)) * self.width - self.offsets[table][None, :, None]
        below = _normal((edges - self.slope * at[:, :, None]) / self.spread)
        chance = np.log(np.maximum(np.diff(below, axis=2), 1e-300))
        base = (cells.astype(np.int64) * self.factors[table]).sum(axis=1)
        steps = np.arange(-REACH, REACH + 1)[None, :] * self.factors[table][:, None]
        score, key = chance[:, 0, :], base[:, None] + steps[0]
        for j in range(1, at.shape[1]):
            score = (score[:, :, None] + chance[:, j, None, :]).reshape(len(at), -1)
            key = (key[:, :, None] + steps[j]).reshape(len(at), -1)
            if score.shape[1] > most:
                best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                score, key = np.take_along_axis(score, best, 1), np.take_along_axis(key, best, 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(key, order, 1)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun, 26.2.17)."""
    # Coefficients of the approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-np.minimum(x * x / 2, 700.0)) / math.sqrt(2 * math.pi) * t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    return np.where(x >= 0, 1 - tail, tail)


def _new_model(dim: int, depth: int, width: float, norm: float, p: Params) -> Model:
    rng = np.random.default_rng([p.seed, depth])
    planes = rng.normal(size=(p.tables, dim + 1, depth))
    return Model(planes, rng.uniform(0, width, (p.tables, depth)), rng.integers(1, 1 << 62, (p.tables, depth)) | 1, width, norm)


def fit(sample: np.ndarray, queries: np.ndarray, neighbours: list[np.ndarray], rows: int, norm: float, p: Params) -> Model:
    """A model by which the sampled queries reach ``p.recall`` of their true neighbours.

    ``depth`` begins where a bucket would hold a few rows, and is lowered while
    ``p.most_probes`` buckets of each table are too few.
    """
    dim, owner = sample.shape[1], np.repeat(np.arange(len(neighbours)), [len(n) for n in neighbours])
    depth = max(2, math.ceil(math.log2(max(rows, 2))) - 3)
    while True:
        spread = float(_new_model(dim, depth, 1.0, norm, p).rows(sample).std()) or 1.0
        model = _new_model(dim, depth, p.width * spread, norm, p)
        if not len(owner):
            return model
        own, other = model.queries(queries), model.rows(np.concatenate(neighbours))
        near = own[:, owner, :]
        slope = float((near * other).sum() / max((near * near).sum(), 1e-300))
        model = Model(model.planes, model.offsets, model.factors, model.width, norm, slope, max(float((other - slope * near).std()), 1e-9 * model.width))
        least = np.full(len(owner), p.most_probes + 1)
        keys = model.keys(other)
        for t in range(p.tables):
            hit = model.sequence(own, t, p.most_probes)[owner] == keys[t][:, None]
            least = np.minimum(least, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, p.most_probes + 1))
        need = int(np.sort(least)[min(len(least) - 1, math.ceil(p.recall * len(least)) - 1)])
        if need <= p.most_probes or depth == 1:
            return Model(model.planes, model.offsets, model.factors, model.width, norm, model.slope, model.spread, min(need, p.most_probes))
        depth = max(1, depth - 2)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best_of(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each owner, of equal scores the smaller id."""
    order = np.lexsort((ids, -scores, owner))
    o = owner[order]
    starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.empty(0, int)
    place = np.arange(len(o)) - np.repeat(starts, np.diff([*starts, len(o)]))
    return order[place < k]


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the values that are among the ``k`` best of their row, with all that equal the last of them."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones_like(scores, bool))
    return np.nonzero(scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k])


def _true_neighbours(queries: np.ndarray, k: int):
    """The ``k`` best of a task's rows for each of the sampled queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ids, x = batch.column(0).slice(at, 4096).to_numpy(), _matrix(batch.column(1).slice(at, 4096))
                scores = queries @ x.T
                q, j = _top(scores, k)
                found = [np.concatenate(z) for z in zip(held, (q, ids[j], scores[q, j]), strict=True)]
                best = best_of(*found, k)
                held = tuple(z[best] for z in found)
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in held], names=["q", "rep", "score"])
    return run


def _scan(k: int):
    """Pass the queries of a group, which come behind its candidates, along these, bucket by bucket."""
    def search(ids: np.ndarray, keys: np.ndarray, x: np.ndarray, qids: np.ndarray, probes: pa.Array, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(qids), _CHUNK):
            part = probes.slice(at, _CHUNK)
            owner = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
            wanted = part.flatten().to_numpy()
            by = np.argsort(wanted, kind="stable")
            owner, wanted = owner[by], wanted[by]
            cuts = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1], [True]])) if len(wanted) else []
            found: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(cuts, cuts[1:], strict=False):
                low, high = np.searchsorted(keys, wanted[a], "left"), np.searchsorted(keys, wanted[a], "right")
                if low == high:
                    continue
                asking = owner[a:b]
                scores = q[at + asking] @ x[low:high].T
                i, j = _top(scores, k)
                for held, new in zip(found, (asking[i], ids[low:high][j], scores[i, j]), strict=True):
                    held.append(new)
            if found[0]:
                o, i, s = map(np.concatenate, found)
                best = best_of(o, i, s, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[at:][o[best]]), pa.array(i[best]), pa.array(s[best])], names=["q", "rep", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            tags = np.stack([batch.column(i).to_numpy() for i in range(5)])  # table, gkey, part, share, asks
            cuts = np.flatnonzero(np.concatenate([[True], (tags[:, 1:] != tags[:, :-1]).any(axis=0), [True]]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(a, b - a)
                ids, x = own.column(5).to_numpy(), _matrix(own.column(8))
                if tuple(tags[:4, a]) != group:
                    group, held, ready = tuple(tags[:4, a]), [], None
                if not tags[4, a]:
                    held.append((ids, own.column(6).to_numpy(), x))
                elif held:
                    if ready is None:
                        c, keys, v = map(np.concatenate, zip(*held, strict=True))
                        by = np.argsort(keys, kind="stable")
                        ready = c[by], keys[by], v[by]
                    yield from search(*ready, ids, own.column(7), x)
    return run


def nearest(vectors: DataFrame, is_query: str, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of the rows for which ``is_query`` holds, nearest first.

    Candidates are all rows but those with the query's own id; equal scores go
    by the smaller id. Vectors that are null, zero, or hold null or non-finite
    components, rows with a null id, and vectors whose length is not the most
    common one take no part. Rows that repeat an id and a vector count once.
    With fewer candidates than ``k`` all that are found come back. A table
    without queries gives an empty result; other columns are ignored.
    """
    p, spark, scratch = params, vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.expr(is_query).alias("asks")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & whole
    )
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, keep = sizes["dim"], p.k + 1
    rows = scratch.keep(rows.where(F.size("v") == dim), "rows")

    # Classes of equal vectors: the window keeps a few rows of each vector before anything is shuffled.
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = rows.select("v", "id", place.alias("at")).where(F.col("at") <= keep).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = scratch.keep(few.select(F.get("ids", F.lit(0)).alias("rep"), "v", "ids"), "classes")
    asked = scratch.keep(rows.where("asks").select("id", "v").distinct(), "asked")
    queries = scratch.keep(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")

    # The model, from bounded samples.
    total, norm = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    pick = lambda df, by, n: np.array([r["v"] for r in df.orderBy(F.xxhash64(by), by).limit(n).select("v").collect()], np.float64).reshape(-1, dim)
    sample, asking = pick(classes, "rep", SAMPLE_ROWS), pick(queries, "q", SAMPLE_QUERIES)
    if not len(asking):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    true = classes.select("rep", "v").mapInArrow(_true_neighbours(asking, keep), "q long, rep long, score double")
    true = scratch.keep(true.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= keep), "true")
    near: list[list] = [[] for _ in asking]
    for r in true.join(classes, "rep").select("q", "v").collect():
        if r["v"] != asking[r["q"]].tolist():
            near[r["q"]].append(r["v"])
    model = fit(sample, asking, [np.array(n, np.float64).reshape(-1, dim) for n in near], total, norm, p)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = model.keys(model.rows(_matrix(batch.column(1)))) if batch.num_rows else np.empty((p.tables, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(keys.T.ravel()), p.tables).cast(pa.list_(pa.int64()))], names=["rep", "v", "keys"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                own = batch.slice(at, _CHUNK)
                projected = model.queries(_matrix(own.column(1)))
                for t in range(p.tables):
                    keys = model.sequence(projected, t, model.probes)
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array([t] * len(keys), pa.int32()), pa.array(list(keys), pa.list_(pa.int64()))], names=["q", "table", "keys"])

    # Groups of whole buckets; a bucket larger than a group has parts.
    per_group = max(1, GROUP_BYTES // (8 * dim))
    groups = max(1, -(-total // per_group))
    index = classes.select("rep", "v").mapInArrow(indexed, "rep long, v array<double>, keys array<long>")
    index = scratch.keep(index.select("rep", "v", F.posexplode("keys").alias("table", "key")), "index")
    buckets = scratch.keep(index.groupBy("table", "key").agg(F.ceil(F.count("*") / per_group).cast("int").alias("parts")), "buckets")
    large = buckets.where("parts > 1")
    place = lambda part: (F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(groups))).alias("gkey"), F.when(F.col("parts") > 1, part).otherwise(F.lit(-1)).cast("int").alias("part"))
    placed = index.join(large, ["table", "key"], "left").select("table", *place(F.pmod(F.xxhash64("rep"), F.col("parts"))), "rep", "key", "v")
    visits = queries.select("q", "v").mapInArrow(probed, "q long, table int, keys array<long>").select("q", "table", F.explode("keys").alias("key")).join(buckets, ["table", "key"])
    visits = visits.select("q", "table", "key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select("q", "table", *place(F.col("p")), "key")
    visits = scratch.keep(visits.groupBy("table", "gkey", "part", "q").agg(F.collect_set("key").alias("keys")), "visits")
    shares = visits.groupBy("table", "gkey", "part").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("shares"))

    group = ["table", "gkey", "part"]
    none = F.array().cast("array<long>")
    offered = placed.join(shares, group).select(*group, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("asks"), F.col("rep").alias("id"), "key", none.alias("keys"), "v")
    asks = visits.join(shares, group).join(queries, "q").select(*group, F.pmod(F.xxhash64("q"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("asks"), F.col("q").alias("id"), F.lit(0).cast("long").alias("key"), "keys", "v")
    dealt = offered.union(asks).repartition(*group, "share").sortWithinPartitions(*group, "share", "asks")
    found = dealt.mapInArrow(_scan(keep), "q long, rep long, score double").groupBy("q", "rep").agg(F.max("score").alias("score"))
    found = scratch.keep(found.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= keep).drop("at"), "found")

    # Classes back to ids, query vectors back to queries; a query's own id goes.
    ids = found.join(classes.where("size(ids) > 1").select("rep", "ids"), "rep", "left").select("q", "score", F.explode(F.coalesce("ids", F.array("rep"))).alias("id"))
    listed = ids.groupBy("q").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("least"), "id", "score"))).alias("best"))
    listed = listed.join(queries, "q").select("v", "best")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, p.k)
    out = asked.withColumnRenamed("id", "query_id").join(listed, "v").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
