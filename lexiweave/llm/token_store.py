"""Token ids of documents as binary shards with Elias-Fano document boundaries.

A store is a folder with two tables. ``shards`` has one row per shard: the ids
of its documents one after another (``ids``, little-endian, ``id_bytes`` each),
the documents' ids (``doc_ids``) and, in ``ends``, the Elias-Fano coded ends of
the documents within the shard. ``index`` has one row per shard: the number of
ids before it. Shards follow each other in ascending document id.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm.batches import bounded
from lexiweave.llm.elias_fano import EliasFano
from lexiweave.runtime import running_total

SHARDS = (
    "part int, seq int, n_docs long, n_ids long, id_bytes int, doc_ids array<long>, ends binary, ids binary"
)
#: A shard is closed at so many ids; one longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: So many encoded words, of 16 ids on average at most, and those of one batch, a Python worker keeps.
CACHED_WORDS = 300_000
#: Texts whose words are encoded together.
BATCH_TEXTS = 1024

_SPACE = re.compile(r"\s")
#: What ``\s`` stands for in Python; Arrow's expressions know the ASCII ones only.
_TWO_SPACES = "[" + "".join(f"\\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace()) + "]{2}"
#: Marks that never join a letter or digit before them; an apostrophe may.
_MARKS = ".,;:!?#$%&*|()+-"
_LETTER_END = "[" + "".join(f"\\x{{{i:x}}}" for i in range(0x250) if chr(i).isalnum()) + "]$"
_LETTERS = "".join(chr(i) for i in range(0x250) if chr(i).isalpha())
_LETTERS_ONLY = f"^\n?[{_LETTERS}]+$"
_BEFORE_MARKS = f"^(?s:.*)[^{re.escape(_MARKS)}]"
_BEFORE_WORD = re.compile(r"(?= \S)")


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Ids of texts by a byte-level BPE file, as bytes; words already seen are not encoded again.

    A byte-level BPE cuts a text before every space that a non-space character
    follows, whatever comes before, and merges nothing across such a cut. So
    the ids of a text are those of its words, each with the space before it.
    It cuts around a lone line end and between a letter and a mark as well.
    New words of a batch are encoded as one text, a line each. A text that holds
    an added token, such as ``<|endoftext|>``, is encoded whole. Words of Latin
    letters are one piece each, so the library is told to cut at line ends only.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Split

        self.tokenizer = Tokenizer.from_file(path)
        cuts = self.tokenizer.pre_tokenizer
        self.letters = None
        if isinstance(cuts, ByteLevel) and cuts.use_regex and not cuts.add_prefix_space and self.tokenizer.normalizer is None:
            as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
            self.byte_names = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _LETTERS + " \n"}
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = Split(self.byte_names[10], "isolated")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cached = cached
        #: Words seen, without marks at their end; of each, where its ids with a space before it lie in ``flat``, and in how many batches it was met.
        self.known = pa.array([], pa.string())
        self.starts = self.sizes = self.met = np.zeros(0, np.int64)
        self.flat = np.zeros(0, f"<u{self.width}")
        self.tails: dict[str, np.ndarray] = {}
        self.line = self._ids("\n")

    def _ids(self, text: str, letters: bool = False) -> np.ndarray:
        tokenizer, text = (self.letters, text.translate(self.byte_names)) if letters else (self.tokenizer, text)
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def _forget(self) -> None:
        """Keep the words met in several batches since the last time."""
        kept = self.met > 1
        self.known = self.known.filter(pa.array(kept))
        self.flat = _runs(self.flat, self.starts[kept], self.sizes[kept])
        self.sizes = self.sizes[kept]
        self.starts, self.met = np.cumsum(self.sizes) - self.sizes, np.zeros(len(self.sizes), np.int64)
        self.tails.clear()

    def _learn(self, words: pa.Array) -> None:
        """Add these words, many at a time; those that begin with a line end stand after it, not after a space."""
        after = pc.starts_with(words, "\n")
        only = pc.and_(pc.match_substring_regex(words, _LETTERS_ONLY), self.letters is not None and len(self.line) == 1)
        learned: list[str] = []
        flat, sizes = [self.flat], [self.sizes]

        def add(part: list[str], ids: np.ndarray, own: np.ndarray) -> None:
            learned.extend(part)
            flat.append(ids)
            sizes.append(own)

        for space, letters in ((" ", True), (" ", False), ("", True), ("", False)):
            group = words.filter(pc.and_(pc.equal(after, not space), pc.equal(only, letters))).to_numpy(zero_copy_only=False).tolist()
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                rests = part if space else [w[1:] for w in part]
                if not letters and (len(self.line) != 1 or "" in rests or _SPACE.search("".join(rests))):  # a word that lines cannot part is encoded by itself
                    odd = [len(self.line) != 1 or not r or bool(_SPACE.search(r)) for r in rests]
                    for w in (w for w, x in zip(part, odd, strict=True) if x):
                        ids = self._ids(space + w)
                        add([w], ids, np.array([len(ids)]))
                    part, rests = ([y for y, x in zip(z, odd, strict=True) if not x] for z in (part, rests))
                if not part:
                    continue
                ids = self._ids(space + f"\n{space}".join(rests) + "\n", letters)
                ends = np.flatnonzero(ids == self.line[0])
                if len(ends) != len(part):
                    raise ValueError("this tokenizer joins words to line ends")
                own = np.diff(ends, prepend=-1)  # with a line end, after a word or before it
                if space:
                    add(part, np.delete(ids, ends), own - 1)
                else:
                    add(part, np.concatenate([self.line, ids[:-1]]), own)
        self.known = pa.concat_arrays([self.known, pa.array(learned, self.known.type)])
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.met = np.concatenate([self.met, np.zeros(len(learned), np.int64)])

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one after another, and how many each has."""
        if max(len(self.known), len(self.tails), len(self.flat) // 16) > self.cached:
            self._forget()
        bare = pc.utf8_rtrim(words, _MARKS)
        parted = pc.and_(pc.not_equal(bare, words), pc.match_substring_regex(bare, _LETTER_END))
        stems = pc.if_else(parted, bare, words)
        at = pc.index_in(stems, self.known)
        before = len(self.known)
        if at.null_count:
            new = pc.unique(stems.filter(at.is_null()))
            self._learn(new)
            at = pc.coalesce(at, pc.add(pc.index_in(stems, self.known.slice(before)), before))
        at = at.to_numpy()
        hit = np.zeros(len(self.known), bool)
        hit[at] = True
        self.met += hit

        ends = pc.replace_substring_regex(words.filter(parted), _BEFORE_MARKS, "").dictionary_encode()
        for tail in ends.dictionary.to_pylist():
            if tail not in self.tails:
                self.tails[tail] = self._ids(tail)
        place = {tail: i for i, tail in enumerate(self.tails, 1)}
        own = np.array([0, *map(len, self.tails.values())], np.int64)
        tails = np.zeros(len(words), np.int64)
        tails[parted.to_numpy(zero_copy_only=False)] = np.array([place[tail] for tail in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
        flat = np.concatenate([self.flat, *self.tails.values()])
        starts = np.stack([self.starts[at], (len(self.flat) + np.cumsum(own) - own)[tails]], 1)
        sizes = np.stack([self.sizes[at], own[tails]], 1)
        return _runs(flat, starts.ravel(), sizes.ravel()), sizes.sum(1)

    def batch(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null("")
        n = len(texts)
        loose = pc.match_substring_regex(texts, _TWO_SPACES)
        whole = pa.array(np.zeros(n, bool))
        for t in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, t))
        plain = pc.if_else(pc.or_(loose, whole), "", texts)
        # A lone line end is a piece of its own. What stands before the first cut, and texts with an added token, go to the library together.
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        offsets, words = cut.offsets.to_numpy(), cut.values
        firsts = words.take(pa.array(offsets[:-1])).to_pylist()
        counts, later = np.diff(offsets) - 1, {}
        rest = np.ones(len(words), bool)
        rest[offsets[:-1] - cut.offsets[0].as_py()] = False
        more: list[str] = []
        for i in np.flatnonzero(pc.or_(loose, whole)).tolist():
            text = texts[i].as_py()
            if whole[i].as_py():
                firsts[i] = text
                continue
            firsts[i], *own = _BEFORE_WORD.split(text)
            later[i] = n + len(later)
            more += [w[1:] for w in own]  # none begins with a line end: a non-space character follows the space
            counts = np.append(counts, len(own))
        words = pa.concat_arrays([words.filter(pa.array(rest)), pa.array(more, pa.string())]).dictionary_encode()
        flat, sizes = self._parts(words.dictionary)
        codes = words.indices.to_numpy()
        sizes, starts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        raw = _runs(flat, starts, sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])] * self.width
        begun = iter(self.tokenizer.encode_batch_fast([f for f in firsts if f], add_special_tokens=False))
        for i, first in enumerate(firsts):
            lead = np.array(next(begun).ids, f"<u{self.width}").tobytes() if first else b""
            at = later.get(i, i)
            yield lead + raw[ends[at] : ends[at + 1]]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _encoded(encode: WordEncoder, texts: pa.Array) -> Iterator[bytes]:
    for at in range(0, len(texts), BATCH_TEXTS):
        yield from encode.batch(texts.slice(at, BATCH_TEXTS))


def _pack(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        end = np.array([end_id], f"<u{encode.width}").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        docs, ends, ids, total = [], [], [], 0

        def shard():
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "n_docs": len(docs), "n_ids": total, "id_bytes": encode.width, "doc_ids": docs,
                  "ends": EliasFano.encode(ends).to_bytes(), "ids": b"".join(ids)}],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("ids", pa.binary())]),
            )

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), _encoded(encode, batch.column(1)), strict=True):
                got += end
                docs.append(doc_id)
                ids.append(got)
                total += len(got) // encode.width
                ends.append(total)
                if total >= shard_ids:
                    yield shard()
                    docs, ends, ids, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    return run


def write_store(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text and write the store to ``path``, a folder that all executors share.

    A null or empty text is its end id alone. Rows that repeat an id are kept,
    ordered by text; null ids come first. An empty table gives a store without
    shards. Spark commits the files, so a lost task is simply run again.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(_pack(tokenizer, end_id, shard_ids), SHARDS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/shards")
    shards = docs.sparkSession.read.schema(SHARDS).parquet(f"{path}/shards").select("part", "seq", "n_docs", "n_ids")
    running_total(shards, group=[], buckets={"part": F.col("part")}, order=["seq"], out="ids_before", value=F.col("n_ids")).write.mode("overwrite").parquet(f"{path}/index")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[EliasFano, np.ndarray, pa.Array, int]]:
    """Of each shard the boundaries, the ids (a view, no copy), the documents and the number of ids before it."""
    docs, ends, ids, width = (batch.column(c) for c in ("doc_ids", "ends", "ids", "id_bytes"))
    before = batch.column("ids_before") if "ids_before" in batch.schema.names else None
    for i in range(batch.num_rows):
        yield (
            EliasFano.from_bytes(ends[i].as_py()), np.frombuffer(ids[i].as_buffer(), f"<u{width[i].as_py()}"), docs[i].values,
            before[i].as_py() if before is not None else 0,
        )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bounds, ids, docs, before in _rows(batch):
            start = 0
            for at in range(0, bounds.n, 512):
                ends = bounds.select_range(at, min(at + 512, bounds.n))
                starts = np.concatenate([[start], ends[:-1]])
                start = int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.slice(at, 512), pa.array(starts + before), pa.array(ends - starts),
                        pa.array([zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: ``doc_id, start, n_tokens, ids_crc32``."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    index = spark.read.schema("part int, seq int, ids_before long").parquet(f"{path}/index")
    return shards.join(index, ["part", "seq"]).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bounds, ids, docs, _ in _rows(batch):
                start = 0
                for at in range(0, bounds.n, 512):
                    ends = bounds.select_range(at, min(at + 512, bounds.n))
                    parts = np.split(ids[start : int(ends[-1])].astype(np.int32), ends[:-1] - start)
                    start = int(ends[-1])
                    yield pa.RecordBatch.from_arrays([docs.slice(at, 512), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spark.read.schema(SHARDS).parquet(f"{path}/shards").mapInArrow(run, "doc_id long, ids array<int>")


def document_ids(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the documents in ``doc_ids(doc_id)``: in a shard, only their boundaries are selected and only their ids read."""
    wanted = doc_ids.select("doc_id").where("doc_id is not null").distinct()
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    hits = shards.select("part", "seq", F.posexplode("doc_ids").alias("at", "doc_id")).join(wanted, "doc_id")
    places = hits.groupBy("part", "seq").agg(F.collect_list("at").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (bounds, ids, docs, _), places in zip(_rows(batch), batch.column("places"), strict=True):
                for at in places.as_py():
                    start = bounds.select(at - 1) if at else 0
                    own = ids[start : bounds.select(at)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([docs.slice(at, 1), pa.array([own], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return shards.join(places, ["part", "seq"]).mapInArrow(run, "doc_id long, ids array<int>")
