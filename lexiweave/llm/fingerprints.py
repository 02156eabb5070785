"""Document fingerprints from closed syncmers of characters.

A k-mer is a closed syncmer if the smallest of its inner s-mers is its first
or its last one. That depends on the k-mer alone, so an edit elsewhere in the
text never changes which k-mers are chosen. A fingerprint keeps the ``size``
chosen k-mers with the smallest hashes, each with its position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.batches import bounded


@dataclass(frozen=True)
class Params:
    """k-mers of 12 code points, s-mers of 4, 64 anchors in a fingerprint."""

    k: int = 12
    s: int = 4
    size: int = 64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def syncmers(points: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (48 bits) and positions of the closed syncmers; a text shorter than k is one anchor, an empty one none."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        if n < p.k:
            h = np.uint32(n)
            for x in points:
                h = _mix(np.atleast_1d(h * np.uint32(31) + x))[0]
            return np.array([int(h)], np.int64), np.zeros(1, np.int64)
        inner = np.zeros(n - p.s + 1, np.uint32)
        for i in range(p.s):
            inner = inner * np.uint32(0x9E3779B1) + points[i : n - p.s + 1 + i]
        inner = _mix(inner)
        width = p.k - p.s + 1
        low, have = inner, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        last = len(inner) - width + 1
        at = np.flatnonzero((inner[:last] == low) | (inner[width - 1 :] == low))
        h = np.zeros(len(at), np.uint64)
        for i in [*range(0, p.k - p.s, p.s), p.k - p.s]:
            h = (h ^ inner[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(16)).astype(np.int64), at


def anchors(points: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` smallest distinct hashes and where each first stands."""
    h, at = syncmers(points, p)
    if len(h) > 8 * p.size:  # repeats of a k-mer are few: a cut well above the size-th value spares the sort
        cut = np.partition(h, 4 * p.size)[4 * p.size]
        low = h <= cut
        u, first = np.unique(h[low], return_index=True)
        if len(u) >= p.size:
            return u[: p.size], at[low][first[: p.size]]
    u, first = np.unique(h, return_index=True)
    return u[: p.size], at[first[: p.size]]


def render(a: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: 12 hex digits of hash and the position, for each anchor."""
    return ".".join(f"{h:012x}{at:x}" for h, at in zip(*a, strict=True))


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = fingerprint.split(".") if fingerprint else []
    return np.array([int(x[:12], 16) for x in parts], np.int64), np.array([int(x[12:], 16) for x in parts], np.int64)


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], size: int = 64) -> float:
    """0 to 1: the share of the smallest anchors of both that are common and in step.

    Common anchors are in step if their shift is within an eighth of the
    covered length of the median shift, so scattered chance matches do not add
    up. Two empty fingerprints are alike (1), an empty and another one are not.
    """
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    union = np.union1d(x[0], y[0])[:size]
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    seen = both <= union[-1]
    if not seen.any():
        return 0.0
    shift = (y[1][j] - x[1][i])[seen]
    reach = max(8, int(max(x[1].max(), y[1].max())) // 8)
    return float((np.abs(shift - np.median(shift)) <= reach).sum() / len(union))


def edited(text: str, follower: str) -> str:
    """The text with its last quarter replaced by as many first characters of the next one."""
    q = len(text) // 4
    return text[: len(text) - q] + follower[:q]


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _scan(p: Params):
    """Rows come by bucket, in order, each bucket closed by its look-ahead row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, anchors
        for batch in batches:
            texts = batch.column(1)
            ids, buckets, ahead, named = (batch.column(c).to_pylist() for c in (0, 2, 3, 4))
            rows = []
            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                mine = anchors(code_points(text), p)
                if held is not None and held[0] == buckets[row]:
                    rows.append(_row(held, text, mine, p))
                held = None if ahead[row] else (buckets[row], ids[row] if named[row] else None, text, mine)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_OUT)

    return run


def _row(held, follower: str, theirs, p: Params):
    _, doc_id, text, mine = held
    new = edited(text, follower)
    changed = mine if new == text else anchors(code_points(new), p)
    return (
        doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), render(mine), render(changed),
        likeness(mine, changed, p.size), likeness(mine, theirs, p.size),
    )


def fingerprint_documents(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", per_partition: int = 4) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them.

    A document's follower is the next in ascending id (rows that repeat an id
    are ordered by text, null ids come first), the first one for the last. The
    documents are cut by id into buckets of about equal row counts; the first
    rows of a bucket also go to the one before, as its look-ahead. So the texts
    are shuffled once, and a task holds one batch at a time. A null text is an
    empty one. A table of one row is its own follower; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = bounded(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).isNotNull().alias("named"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = per_partition * parts
    at = [i / n for i in range(n)]
    stats = rows.agg(F.percentile_approx("doc_id", at, 10 * n), F.min("doc_id")).first()
    bounds = sorted({*(stats[0] or []), *([stats[1]] if stats[1] is not None else [])})
    edges = np.array(bounds or [0], np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right") - 1).astype("int32")

    bucket, first = F.col("bucket"), F.col("doc_id").isin(bounds) if len(bounds) else F.lit(False)
    dealt = rows.withColumn("bucket", bucket_of("doc_id")).withColumn(
        "copies", F.when(first, F.array(
            F.struct(bucket.alias("bucket"), F.lit(False).alias("ahead")),
            F.struct(F.pmod(bucket - 1, F.lit(len(edges))).alias("bucket"), F.lit(True).alias("ahead")),
        )).otherwise(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("ahead"))))
    ).select("doc_id", "text", "named", F.explode("copies").alias("c")).select("doc_id", "text", "named", "c.bucket", "c.ahead")
    # An id that fits the look-ahead may repeat; the scan stops at the first such row.
    placed = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "named", "text")
    return placed.select("doc_id", "text", "bucket", "ahead", "named").mapInArrow(
        _scan(params), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
