"""Document quality by hierarchical empirical Bayes over host and path.

A sparse logistic model of words and shape gives each document's own evidence.
Its mean over a host is shrunk towards the global mean, and its mean over a
path towards the host's; how strongly is estimated from how much hosts, and
paths within hosts, really differ. A document's quality adds to its own
log-odds how far the rest of its path lies from the global mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.batches import bounded
from lexiweave.runtime import Scratch


@dataclass(frozen=True)
class Params:
    """The model is fitted on the ``sample`` labelled documents with the smallest hashed ids (all, if fewer).

    Fitting ends after ``rounds``, or when no weight moves by ``settled``.
    """

    sample: int = 10000
    buckets: int = 1 << 17
    least_docs: int = 4
    l1: float = 2e-4
    rounds: int = 800
    settled: float = 1e-4
    threshold: float = 0.5


SHAPES = 8


class _Buckets(dict):
    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = SHAPES + xxhash.xxh3_64_intdigest(word) % self.size
        return h


_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CAPITALS, _DIGITS = list(range(65, 91)), list(range(48, 58))
_EDGE = b".,;:!?\"'()[]{}|#$%&*+-=<>/\\`~^_@"


def features(text: str | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a document: its shape first, then its distinct words, trimmed of punctuation, each 1.

    The shape is a constant, the shares of marks, capitals and digits, the mean
    length of words, the share of distinct ones, of repeated lines, and length.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.split()
    n = max(1, len(tokens))
    size = max(1, len(raw))
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda kinds: float(bytes_[kinds].sum()) / size
    kinds = {w.strip(_EDGE) for w in raw.lower().split()}
    kinds.discard(b"")
    lines = raw.split(b"\n")
    shape = np.array([
        1.0, share(_MARKS) * 4, share(_CAPITALS) * 4, share(_DIGITS) * 4, min(2.0, size / n / 8), len(kinds) / n,
        1 - len(set(lines)) / len(lines), min(1.0, np.log1p(n) / 8),
    ])
    words = np.unique(np.fromiter(map(buckets.__getitem__, kinds), np.int64, len(kinds)))
    return np.concatenate([np.arange(SHAPES), words]), np.concatenate([shape, np.ones(len(words))])


def fit_sparse(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, p: Params) -> np.ndarray:
    """L1-penalised logistic regression by accelerated proximal gradient; shape columns are not penalised."""
    w = np.zeros(width)
    if len(rows) == 0 or y.min() == y.max():
        if len(rows):
            rate = (y.sum() + 0.5) / (len(y) + 1)
            w[0] = np.log(rate / (1 - rate))
        return w
    cols, vals = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    common = np.bincount(cols, minlength=width) >= p.least_docs
    common[:SHAPES] = True
    keep = common[cols]
    cols, vals, at, n = cols[keep], vals[keep], at[keep], len(rows)
    penalty = np.full(width, p.l1)
    penalty[:SHAPES] = 0
    x = np.ones(width)
    for _ in range(12):  # largest curvature, by power iteration
        x = np.bincount(cols, vals * np.bincount(at, vals * x[cols], n)[at], width) / n
        norm = np.linalg.norm(x)
        x /= norm
    step = 4 / norm
    v, t = w.copy(), 1.0
    for _ in range(p.rounds):
        z = np.bincount(at, vals * v[cols], n)
        g = np.bincount(cols, vals * (1 / (1 + np.exp(-z)) - y)[at], width) / n
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, moved, w = new + (before - 1) / t * (new - w), np.abs(new - w).max(), new
        if moved < p.settled:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> np.ndarray:
    """Two columns of weights, for quality 1 and toxic 1, from a bounded sample of labelled documents."""
    p = params
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(p.buckets)
        for b in batches:
            got = [features(t, buckets) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([x for x, _ in got], pa.list_(pa.int64())), pa.array([x[:SHAPES] for _, x in got], pa.list_(pa.float64()))],
                names=["doc_id", "quality", "toxic", "cols", "shape"],
            )

    rows = sample.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        run, "doc_id long, quality int, toxic int, cols array<long>, shape array<double>"
    ).toArrow().sort_by("doc_id")
    data = []
    for c, s in zip(rows["cols"], rows["shape"], strict=True):
        c = np.asarray(c.values)
        data.append((c, np.concatenate([np.asarray(s.values), np.ones(len(c) - SHAPES)])))
    out = []
    for name in ("quality", "toxic"):
        y = rows[name].to_pylist()
        known = [i for i, v in enumerate(y) if v is not None]
        out.append(fit_sparse([data[i] for i in known], np.array([y[i] for i in known], float), SHAPES + p.buckets, p))
    return np.array(out).T.astype(np.float32)


def evidence(docs: DataFrame, weights: np.ndarray, keep: list[str], params: Params = Params()) -> DataFrame:
    """``keep`` columns with ``p_doc`` and ``p_toxic``, the model's probabilities for the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    fields = list(docs.select(*keep).schema)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", p_doc double, p_toxic double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(params.buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                z = []
                for t in part.column(part.num_columns - 1).to_pylist():
                    c, v = features(t, buckets)
                    z.append(v @ shared.value[c])
                z = 1 / (1 + np.exp(-np.clip(np.array(z, float).reshape(-1, 2), -12, 12)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(fields))), pa.array(z[:, 0]), pa.array(z[:, 1])], names=[*(f.name for f in fields), "p_doc", "p_toxic"]
                )

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _strength(groups: DataFrame, prior, default: float = 50.0) -> float:
    """Prior sample size by moments: how many documents the prior mean is worth against a group's own."""
    row = groups.where("n > 1").agg(
        F.count("*").alias("k"), F.avg(F.pow(F.col("s") / F.col("n") - prior, 2)).alias("spread"), F.avg((F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)) / F.col("n")).alias("noise"),
        F.avg(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("within"),
    ).first()
    if not row["k"] or row["within"] is None:
        return default
    between = max(row["spread"] - row["noise"], 1e-9)
    return float(min(max(row["within"] / between, 1.0), 1e6))


def _logit(x):
    return F.log(x / (1 - x))


def with_site(docs: DataFrame, url: str = "url") -> DataFrame:
    """``docs`` with ``host`` and ``path`` of a URL column: the site's name in lower case, and the first part of the path on it.

    A URL that is null or has no host has neither; one without a path has an empty one.
    """
    parsed = lambda part: F.try_parse_url(F.col(url), F.lit(part))
    host = F.lower(parsed("HOST"))
    first = F.regexp_extract(F.coalesce(parsed("PATH"), F.lit("")), "^/([^/]*)", 1)
    return docs.withColumns({"host": host, "path": F.when(host.isNotNull(), first)})


def score(docs: DataFrame, labels: DataFrame, params: Params = Params(), host: str = "source", path: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, p_doc, p_host, p_path, quality, p_toxic, kept``.

    ``host`` names the site column and ``path`` the part of the site, such as
    those of ``with_site``; without URLs any two nested groupings will do. Null
    hosts and paths are groups of their own; a text that is null or empty has
    only its shape as evidence. A document's own evidence is left out of its
    path's mean, so a path of one document is its host's posterior. ``kept``
    says that quality reaches the threshold and that toxicity does not.
    Labels may be empty or of one kind (then the model is their rate), and an
    empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(bounded(docs).sparkSession, "quality")
    weights = fit(docs, labels, params)
    named = docs.select("doc_id", "text", F.struct(F.col(host).isNull(), F.coalesce(F.col(host).cast("string"), F.lit(""))).cast("struct<no:boolean,name:string>").alias("host"),
                        F.struct(F.col(path).isNull(), F.coalesce(F.col(path).cast("string"), F.lit(""))).cast("struct<no:boolean,name:string>").alias("path"))
    own = scratch.keep(evidence(named, weights, ["doc_id", "host", "path"], params), "evidence")
    total = own.agg(F.avg("p_doc")).first()[0]
    mean = 0.5 if total is None else min(max(total, 1e-4), 1 - 1e-4)
    sums = [F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("ss")]
    hosts = own.groupBy("host").agg(*sums)
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("p_host"))
    paths = scratch.keep(own.groupBy("host", "path").agg(*sums).join(hosts, "host"), "paths")
    k_path = _strength(paths, F.col("p_host"))
    rest = F.when(F.col("n") > 1, (F.col("s") - F.col("p_doc") + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path)).otherwise(F.col("p_host"))
    out = own.join(paths.select("host", "path", "n", "s", "p_host"), ["host", "path"]).withColumn("p_path", rest)
    odds = _logit(F.col("p_doc")) + _logit(F.least(F.greatest("p_path", F.lit(1e-4)), F.lit(1 - 1e-4))) - float(np.log(mean / (1 - mean)))
    quality = 1 / (1 + F.exp(-odds))
    return out.withColumn("quality", quality).select(
        "doc_id", "p_doc", "p_host", "p_path", "quality", "p_toxic", ((F.col("quality") >= params.threshold) & (F.col("p_toxic") < params.threshold)).alias("kept")
    )
