"""The cleaning pipeline from raw trials to balanced, compact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions import text as T
from lexiweave.operators.balance import balance
from lexiweave.operators.lexicon import distinct_cells, lemma_pairs, lemmatise, map_cells, replace_cells
from lexiweave.runtime import Scratch


#: So many exceptions, some 60 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000


def strip_articles(trials: DataFrame, cues: DataFrame) -> DataFrame:
    """Responses without leading articles, where what has the article is not itself a cue.

    Only the distinct responses that begin with an article are looked up among
    the cues that do, once for each article in turn. What a cue holds back is
    written as a table of exceptions; all others lose their articles where they are.
    """
    def led(c: str):
        return F.expr(" or ".join(f"startswith({c}, '{a}')" for a in T.ARTICLES))

    def bare(c):
        return F.regexp_replace(c, "^" + "".join(f"(?:{a})?" for a in T.ARTICLES), "")

    known = cues.where(led("cue")).select(F.col("cue").alias("__c")).distinct()
    pairs = distinct_cells(trials, list(T.RESPONSES)).where(led("cell")).withColumn("out", F.col("cell"))
    for article in T.ARTICLES:
        step = F.when(F.col("out").startswith(article) & F.col("__c").isNull(), F.substring("out", len(article) + 1, 1 << 30)).otherwise(F.col("out"))
        pairs = pairs.join(known, pairs["out"] == known["__c"], "left").select("cell", step.alias("out"))
    held = Scratch(trials.sparkSession, "articles").keep(pairs.where(F.col("out") != bare(F.col("cell"))), "held")
    held = F.broadcast(held) if held.count() <= BROADCAST_CELLS else held
    rows = trials.withColumns({c: F.coalesce(c, F.lit("")) for c in T.RESPONSES})
    for c in T.RESPONSES:
        lookup = held.select(F.col("cell").alias("__k"), F.col("out").alias("__v"))
        rows = rows.join(lookup, rows[c] == lookup["__k"], "left").withColumn(c, F.coalesce("__v", bare(F.col(c)))).drop("__k", "__v")
    return rows


def normalise(trials: DataFrame) -> DataFrame:
    """Null cells blank, lower case, underscores as spaces."""
    return trials.withColumns({c: F.replace(F.lower(T.blank(F.col(c))), F.lit("_"), F.lit(" ")) for c in T.CELLS})


def unique_cues(trials: DataFrame, spelling: DataFrame, compounds: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct cues by their own chain: spelling before compounds, the other way round than rows. The trials are read once."""
    cues = trials.select(F.replace(F.lower("cue"), F.lit("_"), F.lit(" ")).alias("cue")).distinct()
    cues = Scratch(trials.sparkSession, "cues").keep(cues, "said")
    cues = lemmatise(replace_cells(replace_cells(cues, ["cue"], spelling), ["cue"], compounds), ["cue"], lexicon)
    return cues.where("cue <> ''").select("cue").distinct()


def compact_responses(trials: DataFrame) -> DataFrame:
    """No response equal to its cue, no repeats, blanks on the right."""
    kept = T.compact(*[T.drop_self(F.col(r), F.col("cue")) for r in T.RESPONSES])
    return trials.withColumn("__kept", kept).withColumns(T.wide(F.col("__kept"))).drop("__kept")


def clean(trials: DataFrame, spelling: DataFrame, compounds: DataFrame, lexicon: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``cue, R1, R2, R3``: ``n`` rows for each unique cue, cleaned in the order that the steps depend on.

    Compounds, spelling and lemmas are applied to the distinct cells; these and
    the dictionaries are written once, and rows are joined once for each column.
    """
    scratch = Scratch(trials.sparkSession, "clean")
    spelling, compounds, lexicon = (scratch.keep(x, n) for x, n in ((spelling, "spelling"), (compounds, "compounds"), (lexicon, "lexicon")))
    cues = scratch.keep(unique_cues(trials, spelling, compounds, lexicon), "cues")
    rows = strip_articles(normalise(trials), cues)
    pairs = distinct_cells(rows, list(T.CELLS)).withColumn("out", F.col("cell"))
    for dictionary in (compounds, spelling):
        pairs = replace_cells(pairs, ["out"], dictionary)
    rows = map_cells(rows, list(T.CELLS), lemma_pairs(pairs, lexicon))
    return compact_responses(balance(rows, cues, n, seed, key))
