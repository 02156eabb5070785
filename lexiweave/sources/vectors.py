"""Binary word vectors, read in parallel.

A file begins with a line ``count dimension``; then comes a record for each
word: the word, a space, the numbers as little-endian 32-bit floats and, from
some writers, a line feed. Records have no mark of their beginning, and any byte
may occur in the numbers.

Spark reads the file as lines, cut at line feeds in byte ranges, so it may lie
in any store that Spark reads. A range looks for a place from which ``TRUSTED``
records in a row fit, and reads records from there. What is left
over at the ends of ranges is put together in the order of the ranges and read
as well. If a range had begun at a wrong place, the left-over bytes before it
could not end just there; then reading fails instead of giving wrong rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records in a row that have to fit before a range believes that one begins where the first of them does.
TRUSTED = 8
#: So many records before them do not count.
PASSED = 4
#: Bytes that a task gathers before it reads the records in them.
PIECE = 1 << 22
#: No word has more bytes.
LONGEST = 1024
_ROWS = "word string, vec array<float>, file string, at long, head binary, tail binary"


def _word_end(data: bytes | bytearray, start: int) -> int | None:
    """Where the word that begins at ``start`` ends, -1 if none can begin there, None if the data ends too soon."""
    end = data.find(b" ", start, start + LONGEST + 1)
    if end < 0:
        return None if len(data) - start <= LONGEST else -1
    word = data[start:end]
    if not word or any(b < 33 for b in word):
        return -1
    try:
        word.decode()
    except UnicodeDecodeError:
        return -1
    return end


def _records(data: bytes | bytearray, start: int, dim: int) -> tuple[list[tuple[str, np.ndarray]], int]:
    """Whole records from ``start`` on, and where the first one begins that is not whole."""
    out = []
    while True:
        begin = start + 1 if data[start : start + 1] == b"\n" else start
        end = _word_end(data, begin)
        if end is None or end >= 0 and end + 1 + 4 * dim > len(data):
            return out, start
        if end < 0:
            raise ValueError("no word where a record should begin")
        out.append((data[begin:end].decode(), np.frombuffer(data, "<f4", dim, end + 1).astype(np.float32)))
        start = end + 1 + 4 * dim


def _first_record(data: bytes | bytearray, dim: int) -> int | None:
    """The first place from which ``TRUSTED`` records fit, behind ``PASSED`` more; None if the data ends before that can be told.

    Bytes of the numbers before a word may pass for its beginning, and its end for a word, so the first records that fit are not sure.
    """
    for start in range(len(data)):
        at, fitting, behind = start, 0, 0
        while 0 <= fitting < PASSED + TRUSTED:
            begin = at + 1 if fitting and data[at : at + 1] == b"\n" else at
            end = _word_end(data, begin)
            if end is None or end >= 0 and end + 1 + 4 * dim > len(data):
                return None
            at, fitting = (end + 1 + 4 * dim, fitting + 1) if end >= 0 else (at, -1)
            behind = at if fitting == PASSED else behind
        if fitting == PASSED + TRUSTED:
            return behind
    return None


def _read(dim: int):
    def batch_of(rows: list[tuple[str, np.ndarray]], loose: tuple | None = None) -> pa.RecordBatch:
        vecs = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * dim, np.concatenate([v for _, v in rows]) if rows else np.empty(0, np.float32))
        words = [w for w, _ in rows]
        if loose:
            vecs, words = pa.concat_arrays([vecs, pa.nulls(1, vecs.type)]), [*words, None]
        ends = [pa.array([None] * len(rows) + ([x] if loose else []), kind) for x, kind in zip(loose or (None,) * 4, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), vecs, *ends], names=["word", "vec", "file", "at", "head", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, head = None, bytearray(), None

        def records() -> list[tuple[str, np.ndarray]]:
            """Take the whole records off ``held``, and ``head`` first, as soon as it is known."""
            nonlocal head
            if head is None and (start := _first_record(held, dim)) is not None:
                head = bytes(held[:start])
                del held[:start]
            rows, end = _records(held, 0, dim) if head is not None else ([], 0)
            del held[:end]
            return rows

        for batch in batches:
            for line, *at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != block:
                    if block is not None:
                        rows = records()
                        yield batch_of(rows, (*block, bytes(held), None) if head is None else (*block, head, bytes(held)))
                    block, held, head = at, bytearray(), None
                    if at[1] == 0:  # the header, behind which the first record begins
                        head = b""
                        continue
                held += line
                held += b"\n"
                if len(held) > PIECE:
                    yield batch_of(records())
        if block is not None:
            rows = records()
            yield batch_of(rows, (*block, bytes(held), None) if head is None else (*block, head, bytes(held)))
    return run


def _stitch(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, end = _records(data, 0, dim)
                if data[end:].strip(b"\n"):
                    raise ValueError("the file is cut off within a record, or a range began within one")
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["word", "vec"])
    return run


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vec`` of a binary word-vector file, or of all those below a folder; a compressed file is read by one task.

    Files of one folder have the same dimension. A file of no words has no rows.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n")
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    header = lines.where("at = 0").first()
    if header is None:
        return spark.createDataFrame([], "word string, vec array<float>")
    dim = int(bytes(header["line"]).split()[1])
    read = lines.mapInArrow(_read(dim), _ROWS)
    # A group of loose ends begins with the tail of a range in which records begin; its head closes the group before. One row a range.
    begun = F.sum(F.col("tail").isNotNull().cast("int")).over(Window.partitionBy("file").orderBy("at"))
    ends = read.where("word is null").select("file", "at", "head", "tail", begun.alias("own"))
    before = F.col("own") - F.col("tail").isNotNull().cast("int")
    pieces = ends.select("file", before.alias("g"), "at", F.col("head").alias("piece")).union(ends.where("tail is not null").select("file", "own", "at", "tail"))
    joined = pieces.groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    joined = joined.select(F.aggregate("p", F.lit(bytearray()), lambda s, x: F.concat(s, x["piece"])).alias("data"))
    return read.where("word is not null").select("word", "vec").union(joined.mapInArrow(_stitch(dim), "word string, vec array<float>"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, vecs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        data = [w.encode() + b" " + np.array(v, "<f4").tobytes() for w, v in zip(words, vecs, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["file", "record"])


def write_binary_vectors(vectors: DataFrame, path: str, files: int = 8) -> None:
    """``files`` binary files below ``path``, each with its own header; words, which hold no white space, are dealt to them by hash."""
    rows = vectors.select(F.pmod(F.xxhash64("word"), F.lit(files)).alias("file"), "word", "vec").where("word is not null and vec is not null")
    heads = rows.groupBy("file").agg(F.concat_ws(" ", F.count("*"), F.max(F.size("vec"))).alias("line")).select("file", F.lit(0).alias("at"), "line")
    # Bytes pass through a string column as they are.
    records = rows.mapInArrow(_packed, "file long, record binary").select("file", F.lit(1).alias("at"), F.col("record").cast("string"))
    dealt = heads.union(records).repartition(files, "file").sortWithinPartitions("file", "at")
    dealt.select("file", F.col("line").alias("value")).write.partitionBy("file").option("lineSep", "\n").text(path)
