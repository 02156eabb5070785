"""Text expressions of the association pipeline: columns in, columns out, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RESPONSES = ("R1", "R2", "R3")
CELLS = ("cue", *RESPONSES)

# Quote marks that a response list may carry, and prefixes stripped from responses, in this order.
QUOTES = "[\"'`“”‘’]"
ARTICLES = ("a ", "an ", "the ", "to ")
# Filler words that both probe cleaners drop.
FILLERS = (
    "and", "the", "a", "an", "is", "format", "word", "of", "associations", "okay", "user", "sure", "let's", "wants", "three", "provide", "think", "see", "stimulus", "result",
)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_associations(text: Column, expected: int = 3) -> Column:
    """The first ``expected`` answers of a comma-separated reply; an empty or null reply has none."""
    flat = F.regexp_replace(strip(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " ")), QUOTES, "")
    return F.slice(F.filter(F.transform(F.split(flat, ","), strip), lambda x: x != ""), 1, expected)


def is_complete(parsed: Column, expected: int = 3) -> Column:
    return F.size(parsed) == expected


def join_pipe(parsed: Column) -> Column:
    return F.array_join(parsed, "|")


def split_pipe(joined: Column) -> Column:
    """Pipe-joined responses as an array of stripped, non-blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), r"\|"), strip), lambda x: x != "")


def request_id(cue: Column, trial: Column) -> Column:
    """Sixteen hex digits that name a (cue, trial) for good."""
    return F.substring(F.sha1(F.concat_ws("|", cue, trial.cast("string"))), 1, 16)


def normal_token(c: Column) -> Column:
    return F.lower(strip(F.replace(c, F.lit("_"), F.lit(" "))))


def legacy_responses(responses: Column, cue: Column) -> Column:
    """Normal tokens of a response array that are not the cue, first occurrences in order."""
    tokens = F.transform(F.filter(responses, lambda x: x.isNotNull()), normal_token)
    return distinct_tokens(F.filter(tokens, lambda x: x != cue))


def distinct_tokens(tokens: Column) -> Column:
    """First occurrences of non-empty tokens, in order."""
    return F.array_distinct(F.filter(tokens, lambda x: x != ""))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def wide(responses: Column) -> dict[str, Column]:
    """Columns R1..R3 of a response array, blank where it is short."""
    return {r: F.coalesce(F.get(responses, F.lit(i)), F.lit("")) for i, r in enumerate(RESPONSES)}


def drop_self(response: Column, cue: Column) -> Column:
    return F.when(response == cue, F.lit("")).otherwise(response)


def compact(*responses: Column) -> Column:
    """Non-blank responses, repeats dropped, moved to the left."""
    return F.array_distinct(F.filter(F.array(*responses), lambda x: x != ""))


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def one_line(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def probe_answers_a(text: Column) -> Column:
    """Three single-word answers of a reasoning model's reply; ``NaN`` where there are fewer."""
    text = blank(text)
    said = F.when(text.contains("</think>"), F.element_at(F.split(text, "</think>"), -1)).otherwise(F.replace(text, F.lit("<think>"), F.lit("")))
    bare = F.regexp_replace(said, r"[<>\n\-*0-9.,]", " ")
    words = F.filter(F.split(F.lower(strip(bare)), r"\s+"), lambda w: (w != "") & ~w.isin(*FILLERS))
    return F.transform(F.array(*[F.get(words, F.lit(i)) for i in range(3)]), lambda w: F.coalesce(w, F.lit("NaN")))


def probe_answers_b(text: Column) -> Column:
    """Three answers of up to two words of a chat model's reply; ``NaN`` where there are fewer."""
    said = F.regexp_replace(blank(text), "[^a-zA-Z, ]", " ")
    parts = F.when(said.contains(","), F.split(said, ",")).otherwise(F.split(strip(said), r"\s+"))
    words = F.filter(F.transform(parts, lambda x: F.lower(strip(x))), lambda w: (w != "") & ~w.isin(*FILLERS) & (F.size(F.split(w, r"\s+")) <= 2))
    return F.transform(F.array(*[F.get(words, F.lit(i)) for i in range(3)]), lambda w: F.coalesce(w, F.lit("NaN")))


def prompt(cue: Column) -> Column:
    return F.concat(F.lit("Input: "), cue, F.lit("\nOutput:"))


def graph_key(node: Column) -> Column:
    return F.replace(node, F.lit(" "), F.lit("_"))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; 1 where either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / norm)


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are per million tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def backoff_seconds(attempt: Column, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2.0), attempt))


def lemma_candidates(word: Column) -> Column:
    """What a noun may be the plural of, by its ending; the word itself first."""
    # Noun endings and what stands for them.
    rules: Sequence[tuple[str, str]] = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
    made = [F.when(word.endswith(e), F.concat(F.left(word, F.length(word) - len(e)), F.lit(r))) for e, r in rules]
    return F.filter(F.array(word, *made), lambda x: x.isNotNull() & (x != ""))
