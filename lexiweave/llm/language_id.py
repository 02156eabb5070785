"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.batches import bounded
from lexiweave.runtime import Scratch

#: n-grams times languages that are looked up at a time.
PIECE = 1 << 21


@dataclass(frozen=True)
class Params:
    """n-grams of 1 to ``longest`` characters, hashed to ``buckets``; ``smooth`` is added to every count.

    At most ``model`` numbers are in memory and broadcast at a time: of more
    than ``model / buckets`` languages (512), so many are compared with all
    texts, then the next, and so on. Neither that nor other languages change
    what a language weighs.
    """

    longest: int = 3
    buckets: int = 1 << 16
    smooth: float = 0.5
    model: int = 1 << 25


def grams(text: str, p: Params) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased text."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(x), np.uint32)
        for n in range(1, min(p.longest, len(x)) + 1):
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
            g = (h ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)
            out.append((g >> np.uint32(8)) % np.uint32(p.buckets))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass(frozen=True)
class Part:
    """Some of the languages: ``weights[bucket, language]`` are log-probabilities, ``prior[language]`` as well."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray
    params: Params


class Model:
    """What was learned: the languages, their shares, and their counts as a table from which parts are loaded."""

    def __init__(self, languages: list[str], prior: np.ndarray, params: Params, counts: DataFrame | None = None, scratch: Scratch | None = None):
        self.languages, self.prior, self.params, self._counts, self._scratch = languages, prior, params, counts, scratch

    def parts(self) -> Iterator[Part]:
        """One part after another, in the order of the languages."""
        p, width = self.params, max(1, self.params.model // self.params.buckets)
        for at in range(0, len(self.languages), width):
            names = self.languages[at : at + width]
            weights = np.full((p.buckets, len(names)), p.smooth, np.float32)
            if self._counts is None:
                weights[:] = 0
            else:
                of = {lang: j for j, lang in enumerate(names)}
                own = self._counts.where((F.col("bucket") >= 0) & (F.col("lang") >= names[0]) & (F.col("lang") <= names[-1]))
                for row in own.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).toLocalIterator():
                    count = np.full(p.buckets, p.smooth)
                    real = np.array([(y["bucket"], y["n"]) for y in row["x"]], np.int64)
                    np.add.at(count, real[:, 0], real[:, 1])
                    weights[:, of[row["lang"]]] = np.log(count / count.sum())
            yield Part(names, self.prior[at : at + width], weights, p)

    def close(self) -> None:
        """Forget the counts; no part can be loaded any more."""
        if self._scratch is not None:
            self._scratch.close()


def _counts(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def flush():
            for lang, count in seen.items():
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(count[at], docs[lang]).astype(np.int64))],
                    names=["lang", "bucket", "n"],
                )

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in seen:
                    if len(seen) >= 64:
                        yield from flush()
                        seen.clear(), docs.clear()
                    seen[lang], docs[lang] = np.zeros(p.buckets, np.int64), 0
                g = grams(text.as_py(), p)
                docs[lang] += 1
                if len(g) * 8 > p.buckets:
                    seen[lang] += np.bincount(g, minlength=p.buckets)
                else:
                    np.add.at(seen[lang], g, 1)
        yield from flush()

    return run


def fit(docs: DataFrame, params: Params = Params(), text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with a text and a language.

    Tasks count n-grams, Spark sums the counts; what reaches the driver is one
    row a language, and the model part by part when it is used.
    """
    rows = bounded(docs).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counted = rows.mapInArrow(_counts(params), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession, "language")
    counted = scratch.keep(counted, "counts")
    languages = sorted(r["lang"] for r in counted.where("bucket = -1").select("lang").toLocalIterator())
    docs_of = {r["lang"]: r["n"] for r in counted.where("bucket = -1").toLocalIterator()}
    prior = np.array([docs_of[lang] for lang in languages], np.float64)
    return Model(languages, np.log(prior / prior.sum()) if languages else prior, params, counted, scratch)


def _logs(model: Part, texts: list[str]) -> np.ndarray:
    """Log-probability of each text (rows) in each language (columns).

    The n-grams of all texts are looked up one after another, in pieces of
    bounded size, whatever the length of a text, and summed by text.
    """
    found = [grams(t, model.params) for t in texts]
    buckets, ends = np.concatenate(found), np.cumsum([len(g) for g in found])
    logs = np.tile(model.prior, (len(texts), 1))
    step = max(1, PIECE // len(model.languages))
    for at in range(0, len(buckets), step):
        to = min(at + step, len(buckets))
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(ends, to - 1, "right")
        starts = np.concatenate([[0], ends[first:last] - at])
        # Texts without an n-gram have no letter and are not here, so no two starts are equal.
        logs[first : last + 1] += np.add.reduceat(model.weights[buckets[at:to]], starts, axis=0, dtype=np.float64)
    return logs


def _compare(part: Part, texts: list[str | None], best: tuple[list, list, list]) -> tuple[list[str], list[float], list[float]]:
    """The likeliest languages so far: name, log-probability, and the sum of all languages' probabilities in shares of its own."""
    names, logs, sums = map(list, best)
    at = [i for i, t in enumerate(texts) if has_letter(t)] if part.languages else []
    if at:
        own = _logs(part, [texts[i] for i in at])
        top = np.argmax(own, 1)
        most = own[np.arange(len(at)), top]
        total = np.exp(own - most[:, None]).sum(1)
        for i, j, x, n in zip(at, top.tolist(), most.tolist(), total.tolist(), strict=True):
            if names[i] == "und" or x > logs[i]:
                sums[i] = n + (sums[i] * float(np.exp(logs[i] - x)) if names[i] != "und" else 0.0)
                names[i], logs[i] = part.languages[j], x
            else:
                sums[i] += n * float(np.exp(x - logs[i]))
    return names, logs, sums


def predict(
    docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``keep`` columns with the two of ``out``, language and score, added from the text alone.

    A null text and one without a letter is ``und`` with score 0. So is every
    text when there is no labelled text to learn from: then there is no
    language to name. Ties go to the first language by name. A text may have
    any length; what is looked up at a time is bounded. Between two parts of a
    model the rows are written, so one part is in memory at a time.
    """
    context, scratch = bounded(docs).sparkSession.sparkContext, Scratch(docs.sparkSession, "predict")
    fields = list(docs.select(*keep).schema)
    # A text that is kept crosses to Python once.
    at_text = [f.name for f in fields].index(text_col) if text_col in keep else len(fields)
    rows = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("__text")]))
    kinds = lambda s: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s)
    parts = model.parts()
    part, first, before = next(parts, Part([], model.prior, np.empty((1, 0), np.float32), model.params)), True, None
    while part is not None:
        later = next(parts, None)
        shared, given = context.broadcast(part), len(rows.columns) - (0 if first else 3)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, given=given, first=first, last=later is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    own = batch.slice(at, 64)
                    n = own.num_rows
                    best = (["und"] * n, [0.0] * n, [0.0] * n) if first else tuple(own.column(given + i).to_pylist() for i in range(3))
                    names, logs, sums = _compare(shared.value, own.column(at_text).to_pylist(), best)
                    if last:
                        scores = [0.0 if name == "und" else 1 / total for name, total in zip(names, sums, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [*(own.column(i) for i in range(len(fields))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), *out]
                        )
                    else:
                        yield pa.RecordBatch.from_arrays(
                            [*(own.column(i) for i in range(given)), pa.array(names, pa.string()), pa.array(logs, pa.float64()), pa.array(sums, pa.float64())],
                            names=[*own.schema.names[:given], "__name", "__log", "__sum"],
                        )

        if later is None:
            return rows.mapInArrow(run, f"{kinds(fields)}, `{out[0]}` string, `{out[1]}` double")
        rows = scratch.keep(rows.mapInArrow(run, f"{kinds(list(rows.schema)[:given])}, `__name` string, `__log` double, `__sum` double"), "compared")
        shared.destroy()
        scratch.drop(before)
        part, first, before = later, False, rows


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from rows not held out.

    Null ids, repeated rows and an empty table are fine; columns other than
    doc_id, text and lang are ignored.
    """
    own = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(own.where("not held_out"), params)
    out = predict(own, model, ["doc_id", "held_out"])
    model.close()
    return out


def keep_known(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` whose text has a language, that is, not ``und``; all columns stay as they are.

    Every text with a letter has one, whatever its score, also when no language was learned.
    """
    model = fit(docs.where(~held_out()), params)
    if not model.languages:
        model = Model(["unknown"], np.zeros(1), params)
    cols = docs.columns
    known = predict(docs, model, cols, out=("__lang_pred", "__score")).where("__lang_pred <> 'und'").select(*cols)
    model.close()
    return known
