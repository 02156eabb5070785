"""Drawing the documents of a corpus that look like a target, by importance over hashed n-grams.

Within a partition, texts are taken in blocks of bounded size. A block's words
become ids in one array, and its suffixes are sorted by their first ``max_n``
words. In that suffix array the occurrences of an n-gram stand side by side: a
run of suffixes whose longest common prefixes reach ``n``. So each n-gram of a
block is hashed once, for its run, and its bucket is scattered back to all its
places. The buckets of a document are written once, a few bytes for each
feature; counts over the corpus and the scores are both made from them.

Counts are ``buckets`` numbers for each of the two sides, whatever the corpus;
only those, and the gains made from them, pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.runtime import Scratch, running_total_by_order

#: Characters of text in a block, unless one text alone has more.
BLOCK_CHARS = 4 << 20
#: A-Z lower-cased, all other ASCII but digits and letters a space, bytes of other characters as they are.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Params:
    """Features are runs of 1 to ``max_n`` words; ``percent`` of the documents of at least ``least_words`` words are drawn."""

    max_n: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of their next ``depth`` values (or more), by doubling; what is beyond the end counts as least."""
    rank, width = ids, 1
    while width < depth:
        later = np.zeros_like(rank)
        later[:-width] = rank[width:] + 1
        _, rank = np.unique(rank * (int(later.max(initial=0)) + 1) + later, return_inverse=True)
        width *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix shares with the one before it, ``depth`` at most; ``left`` words remain in a document from each place."""
    out = np.zeros(len(order), np.int64)
    a, b = order[1:], order[:-1]
    same = np.ones(max(len(order) - 1, 0), bool)
    for j in range(depth):
        inside = same & (left[a] > j) & (left[b] > j)
        same = inside.copy()
        same[inside] = ids[a[inside] + j] == ids[b[inside] + j]
        out[1:] += same
    return out


def block_buckets(texts: list[list[bytes]], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of a block of texts, document after document, and how many each has."""
    lengths = np.array([len(t) for t in texts], np.int64)
    # A 0 behind each text sorts before all words, so that no other suffix stands between equal runs.
    named: dict[bytes, int] = {}
    ids = np.fromiter((i for t in texts for i in (*[named.setdefault(w, len(named) + 1) for w in t], 0)), np.int64, lengths.sum() + len(texts))
    known = [b"", *named]
    left = np.repeat(np.cumsum(lengths + 1), lengths + 1) - 1 - np.arange(len(ids))
    order = suffix_array(ids, max_n)
    prefixes = common_prefixes(ids, left, order, max_n)
    found = np.full((len(ids), max_n), -1, np.int64)
    for n in range(1, max_n + 1):
        fits = left[order] >= n
        places, heads = order[fits], prefixes[fits] < n
        if len(places) == 0:
            break
        grams = ids[places[heads][:, None] + np.arange(n)] if n > 1 else ids[places[heads]][:, None]
        hashes = np.fromiter((zlib.crc32(b" ".join([known[i] for i in g])) % buckets for g in grams.tolist()), np.int64, len(grams))
        found[places, n - 1] = hashes[np.cumsum(heads) - 1]
    counts = np.minimum(np.maximum(lengths[:, None] - np.arange(max_n), 0), lengths[:, None]).sum(axis=1)
    flat = found.ravel()
    return flat[flat >= 0], counts


def _width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _featured(p: Params):
    kind = _width(p.buckets)

    def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
        start, chars, held = 0, 0, []
        for i in range(len(texts)):
            text = texts[i].as_py()
            if held and chars + len(text or "") > BLOCK_CHARS:
                yield start, held
                start, chars, held = i, 0, []
            held.append(text)
            chars += len(text or "")
        if held:
            yield start, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(2)):
                cut = [words(t) for t in texts]
                flat, counts = block_buckets(cut, p.max_n, p.buckets)
                data, at = flat.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(counts)]) * kind.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(cut)), batch.column(1).slice(start, len(cut)), pa.array([len(t) for t in cut], pa.int64()),
                        pa.array(counts, pa.int64()), pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                    ],
                    names=["doc_id", "tk", "n_words", "n_features", "grams"],
                )
    return run


def features(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tk, n_words, n_features, grams``: ``tk`` is a hash of the text, ``grams`` the buckets of its features, packed."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(_featured(p), f"doc_id {kind}, tk long, n_words long, n_features long, grams binary")


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of packed buckets, and where each row's begin and end."""
    rows = column.to_pylist()
    ends = np.cumsum([0, *(len(r) // kind.itemsize for r in rows)])
    return np.frombuffer(b"".join(rows), kind), ends


def bucket_counts(grams: DataFrame, p: Params) -> np.ndarray:
    """How many features each bucket has; a task sums up its own before anything is shuffled."""
    kind = _width(p.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), kind)[0], minlength=p.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(p.buckets, np.int64)
    for row in grams.select("grams").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket speaks for the target, in thousandths of a natural logarithm, rounded down."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def score(docs: DataFrame, target: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words, tk`` for every row of ``docs``.

    ``rank`` numbers the drawn rows from 1, the highest score first, of equal
    scores the smaller id (null ids last, then by ``tk``); it is null for the
    others. Every row counts, also one that repeats another. Null, empty and
    word-less texts have no features, weight 0 and are never drawn. A null id
    takes part in the draw as an empty text. Either table may be empty; other
    columns are ignored.
    """
    p, scratch, kind = params, Scratch(docs.sparkSession, "resample"), _width(params.buckets)
    own = scratch.keep(features(docs, p, id_col, text_col), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), p)
    gain = gains(bucket_counts(own, p), bucket_counts(wanted, p))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _flat(batch.column(4), kind)
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=["doc_id", "tk", "n_words", "n_features", "weight"])

    weighed = own.mapInArrow(weigh, f"doc_id {dict(own.dtypes)['doc_id']}, tk long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(name, 256), F.lit(8)), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + luck), "scored")
    fit = scored.where(F.col("n_words") >= p.least_words)
    drawn = fit.count() * p.percent // 100
    placed = running_total_by_order(
        fit.withColumns({"__least": -F.col("score"), "__unnamed": F.col("doc_id").isNull()}), ["__least", "__unnamed", "doc_id", "tk"], "__at"
    )
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words", "tk"]
    ranked = placed.withColumn("rank", F.when(F.col("__at") < drawn, F.col("__at") + 1)).select(columns)
    return ranked.union(scored.where(F.col("n_words") < p.least_words).withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(docs: DataFrame, target: DataFrame, params: Params = Params()) -> DataFrame:
    """The drawn rows of ``docs``, columns as they came; rows that repeat a drawn id and text come with it."""
    drawn = score(docs, target, params).where("rank is not null").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["__id"]) & (F.xxhash64(docs["text"]) == drawn["__tk"]), "left_semi")


def luck(doc_id: object, seed: str = "2024") -> int:
    """The part of a score that chance gives to an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
