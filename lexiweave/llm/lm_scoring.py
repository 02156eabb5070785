"""Stupid-backoff scores by n-gram count tables that are partitioned by hash and joined to the n-grams of documents.

All documents are counted, and each is scored by the counts of all others: its
own occurrences are taken off every count that it is scored with. So no text
vouches for itself, and no part of the corpus is kept out of the counts.

1. Documents are dealt by hash to blocks of a bounded size. A block counts its
   n-grams of an order and sends each distinct one, with its count, to the
   bucket of its hash.
2. A bucket adds the counts of all blocks up: its part of the count table. It
   joins this table to the n-grams of each block and returns their counts.
3. A block joins the counts of all orders to the places of its documents, takes
   off what each document has itself, and sums the scores by document.

The join is made on sorted hashes within tasks; Spark deals blocks and buckets
and brings them together. A block sends an n-gram once, however often it occurs
there, and looks only at buckets that it has n-grams for, so the work is in
proportion to the n-grams. A bucket holds about ``bucket`` of them; one that is
in every block comes once from each, which adds 16 bytes for 8 MB of text.
A longer text than ``block_bytes`` is a block by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.batches import bounded
from lexiweave.llm.mixing import count_words
from lexiweave.llm.near_dedup import WordHashes
from lexiweave.runtime import Scratch

#: Odd factors of the n-gram hashes: for what an n-gram begins with and for its last word.
BEGIN, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Params:
    """``alpha`` is the factor of a step back; blocks have about ``block_bytes`` of text, buckets ``bucket`` n-grams."""

    order: int = 3
    alpha: float = 0.4
    block_bytes: int = 8 << 20
    bucket: int = 1 << 20


class _Grams:
    """N-grams of some texts: hashes of every order by the place of the first word, documents by place."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, order: int):
        known, parts, sizes = WordHashes(), [], []
        for at in range(0, len(texts), 64):
            tokens = [x for t in texts.slice(at, 64).to_pylist() for x in ([t.encode("utf-8", "surrogatepass").lower().split()] if t else [[]])]
            sizes += map(len, tokens)
            words = [w for t in tokens for w in t]
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        g = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        words, self.hashes, self.whole = g, [g], [np.ones(len(g), bool)]
        with np.errstate(over="ignore"):
            for k in range(2, order + 1):
                n = max(0, len(words) - k + 1)
                g = (g[:n] * BEGIN ^ g[:n] >> np.uint64(31)) + words[k - 1 :][:n] * LAST
                self.hashes.append(g)
                self.whole.append(self.doc[:n] == self.doc[k - 1 :][:n])

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of order k, how often each occurs, which one stands at each place (-1: none), how often its document has it."""
        at = np.flatnonzero(self.whole[k - 1])
        by = at[np.argsort(self.hashes[k - 1][at], kind="stable")]
        h, d = self.hashes[k - 1][by], self.doc[by]
        new = np.ones(len(by), bool)
        new[1:] = h[1:] != h[:-1]
        mine = new.copy()
        mine[1:] |= d[1:] != d[:-1]
        starts, runs = np.flatnonzero(new), np.flatnonzero(mine)
        which, own = np.full(len(self.doc), -1, np.int64), np.zeros(len(self.doc), np.int64)
        which[by] = np.cumsum(new) - 1
        n = np.diff(np.append(runs, len(by)))
        own[by] = np.repeat(n, n)
        return h[starts], np.diff(np.append(starts, len(by))), which, own


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the shuffle's compression finds those that hardly change."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


_SENT = "block long, k int, bucket long, hashes binary, counts binary"


def _send(orders: list[int], order: int, buckets: int):
    """Distinct n-grams of a block, cut where the hashes of the next bucket begin."""

    def run(block: pa.Table) -> pa.Table:
        grams, rows = _Grams(block["text"], order), []
        for k in orders:
            h, n, *_ = grams.distinct(k)
            # Sorted hashes have sorted buckets; only those that occur are looked at.
            bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(h) else np.zeros(1, int)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                rows.append((block["block"][0].as_py(), k, int(bucket[x]), _planes(h[x:y]), _planes(n[x:y])))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "k", "bucket", "hashes", "counts"])

    return run


def _answer(sent: pa.Table) -> pa.Table:
    """The counts of a bucket's n-grams over all blocks, for each block in the order it sent them."""
    hashes = [_values(x.as_py()) for x in sent["hashes"]]
    counts = [_values(x.as_py()).astype(np.int64) for x in sent["counts"]]
    table, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), len(table)).astype(np.int64)[which]
    parts = np.split(total, np.cumsum([len(x) for x in hashes])[:-1])
    return pa.table([sent["block"], sent["k"], sent["bucket"], pa.array([_planes(x) for x in parts], pa.binary())], names=["block", "k", "bucket", "counts"])


def _score(p: Params, n_words: int, fields: list[str]):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _Grams(block["text"], p.order)
        found = sorted(zip(answers["k"].to_pylist(), answers["bucket"].to_pylist(), range(len(answers)), strict=True))
        places = len(grams.doc)
        others = []  # by order: how often other documents have the n-gram that begins at a place
        for k in range(1, p.order + 1):
            _, _, which, own = grams.distinct(k)
            total = np.concatenate([np.empty(0, np.int64), *(_values(answers["counts"][i].as_py()).astype(np.int64) for j, _, i in found if j == k)])
            others.append(np.where(which >= 0, total[which] if len(total) else 0, 0) - own)
        inside = np.arange(places) - np.repeat(np.cumsum(grams.sizes) - grams.sizes, grams.sizes)
        logs = np.log(np.maximum(others[0], 1)) - np.log(np.maximum(n_words - np.repeat(grams.sizes, grams.sizes), 1)) + np.minimum(inside, p.order - 1) * np.log(p.alpha)
        for k in range(2, p.order + 1):
            start = np.maximum(np.arange(places) - k + 1, 0)
            seen = (inside >= k - 1) & (others[k - 1][start] > 0)
            back = np.maximum(np.minimum(inside, p.order - 1) - (k - 1), 0)
            logs[seen] = np.log(others[k - 1][start[seen]] / others[k - 2][start[seen]]) + back[seen] * np.log(p.alpha)
        score = np.bincount(grams.doc, logs, len(grams.sizes)).astype(float)
        per = np.where(grams.sizes > 0, score / np.maximum(grams.sizes, 1), 0)
        return pa.table([block["doc_id"], pa.array(grams.sizes), pa.array(score), pa.array(per, mask=grams.sizes == 0)], names=fields)

    return run


def score(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_score, per_word`` for every row, by the counts over all other rows.

    Words are separated by the six ASCII white-space characters; only A-Z is
    lower-cased. A word scores the count of the n-gram that ends with it, of
    ``order`` words or what there is of them, over the count of that n-gram
    without it. If no other row has the n-gram, it steps back: ``alpha`` times
    the score with one word of context less. Without context it is the count of
    the word (1, if no other row has it) over the number of words of other rows.

    Null and empty texts and those without words have score 0 and no mean. Rows
    that repeat an id are scored each for itself, equal rows by each other too.
    Null ids are fine; an empty table gives an empty result; other columns are
    ignored. Time and memory are linear in the length of a text, which one task
    holds whole.
    """
    p, scratch = params, Scratch(docs.sparkSession, "backoff")
    own = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bytes_, n_words = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(count_words(F.coalesce("text", F.lit("")))), F.lit(0))).first()
    blocks, buckets = max(1, -(-bytes_ // p.block_bytes)), max(1, -(-n_words // p.bucket))
    placed = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    answers = []
    # The highest order by itself: what the n-grams of the lower ones need of the disk is less.
    for orders in ([*range(1, p.order)], [p.order]):
        if orders:
            sent = placed.groupBy("block").applyInArrow(_send(orders, p.order, buckets), _SENT)
            answers.append(scratch.keep(sent.groupBy("k", "bucket").applyInArrow(_answer, "block long, k int, bucket long, counts binary"), "answers"))
    known = answers[0] if len(answers) == 1 else answers[0].union(answers[1])
    kind = own.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "n_words", "log_score", "per_word"]
    return placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _score(p, n_words, fields), f"doc_id {kind}, n_words long, log_score double, per_word double"
    )
