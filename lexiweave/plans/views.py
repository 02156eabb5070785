"""Views of the driver's tables that stand in for association data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions import text as T

#: A task takes about so many bytes of text apart.
PIECE = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(text: str = "text"):
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")


def dealt(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, dealt anew in pieces of about ``PIECE`` bytes of text, so that a task holds as much in a large table as in a small one."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE)), "doc_id", "text")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trial, cue, R1, R2, R3``: the words of each document, four by four; the last row of a document may end in blanks.

    ``trial`` is the document's number and, in the last 32 bits, the row's.
    """
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}++(?:[^\p{L}]++\p{L}++){0,3}+"), F.lit(0))
    rows = dealt(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(runs).alias("i", "run"))
    own = rows.select((F.col("doc_id") * (1 << 32) + F.col("i")).alias("trial"), F.split("run", r"[^\p{L}]+").alias("w"))
    return own.select("trial", *[F.coalesce(F.get("w", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(T.CELLS)])


def _capitals(c: str):
    """ASCII letters as capitals; engines differ on others, such as the German sharp s."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with articles, underscores, capitals, nulls, self responses and repeats put in."""
    t, i = trials(spark, sf_dir), F.col("trial")
    return t.select(
        "trial", F.when(i % 7 == 0, F.concat(_capitals("cue"), F.lit("_"), "R1")).otherwise(F.col("cue")).alias("cue"),
        F.when(i % 6 == 0, F.concat(F.lit("the "), "R1")).when(i % 6 == 1, F.concat(F.lit("to the "), "R1")).when(i % 6 == 2, F.concat(F.lit("a "), "R1"))
        .when(i % 6 == 3, F.concat(_capitals("R1"), F.lit("_x"))).when(i % 6 == 5, F.col("R1")).alias("R1"),
        F.when(i % 4 == 0, F.col("cue")).when(i % 4 == 1, F.col("R1")).otherwise(F.col("R2")).alias("R2"),
        F.when(i % 3 == 0, F.col("R1")).otherwise(F.col("R3")).alias("R3"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word``: words of the benchmark, and of every four in a row one compound with ``_`` and one with ``-``."""
    items = table(spark, sf_dir, "benchmark").select(_words().alias("w")).where("size(w) > 0")
    rows = items.select("w", F.expr("transform(sequence(0, (size(w) - 1) div 4), i -> slice(w, cast(i * 4 + 1 as int), 4))").alias("r"))
    pairs = F.flatten(F.transform(F.filter("r", lambda r: F.size(r) == 4), lambda r: F.array(F.concat_ws("_", F.get(r, F.lit(0)), F.get(r, F.lit(1))), F.concat_ws("-", F.get(r, F.lit(2)), F.get(r, F.lit(3))))))
    return rows.select(F.explode_outer(F.concat("w", pairs)).alias("word")).distinct()


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wrong, correct``: lexicon words in -ing, to be written with -ed."""
    return lexicon(spark, sf_dir).where("word like '%_ing' and word not like '%\\_%' and word not like '%-%'").select(
        F.col("word").alias("wrong"), F.concat(F.left("word", F.length("word") - 3), F.lit("ed")).alias("correct")
    )


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between vector ids by arithmetic, over all ids; every 50th leads out of the vocabulary."""
    own, i = table(spark, sf_dir, "embeddings").select("vec_id"), F.col("vec_id")
    n = own.agg((F.max("vec_id") + 1).alias("n"))
    tgt = F.when(i % 50 == 0, F.lit("missing")).otherwise(((i * 7 + 13) % F.col("n")).cast("string"))
    return own.crossJoin(F.broadcast(n)).select(i.cast("string").alias("src"), tgt.alias("tgt"), (i % 97 + 1).alias("wt")).where("src <> tgt")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, cue`` of users, as cues."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("cue")).distinct()


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, cue, trial, custom_id, event_type, k`` of events, as results."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("cue"), (F.col("event_id") % 20).cast("int").alias("trial"), "event_type",
                                             F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.withColumn("custom_id", T.request_id(F.col("cue"), F.col("trial")))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')"
_CAPITALS = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
VIEWS = {
    "trials": f"""trials AS (SELECT doc_id * 4294967296 + i AS trial, w[4 * i + 1] AS cue, coalesce(w[4 * i + 2], '') AS R1, coalesce(w[4 * i + 3], '') AS R2, coalesce(w[4 * i + 4], '') AS R3
        FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 3) // 4)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents)))""",
    "messy": f"""messy AS (SELECT trial, CASE WHEN trial % 7 = 0 THEN {_CAPITALS.format('cue')} || '_' || R1 ELSE cue END AS cue,
        CASE trial % 6 WHEN 0 THEN 'the ' || R1 WHEN 1 THEN 'to the ' || R1 WHEN 2 THEN 'a ' || R1 WHEN 3 THEN {_CAPITALS.format('R1')} || '_x' WHEN 5 THEN R1 END AS R1,
        CASE trial % 4 WHEN 0 THEN cue WHEN 1 THEN R1 ELSE R2 END AS R2, CASE trial % 3 WHEN 0 THEN R1 ELSE R3 END AS R3 FROM trials)""",
    "lexicon": f"""lexicon AS (SELECT DISTINCT unnest(list_concat(w, flatten(list_transform(range(0, len(w) // 4), lambda i: [w[4 * i + 1] || '_' || w[4 * i + 2], w[4 * i + 3] || '-' || w[4 * i + 4]])))) AS word
        FROM (SELECT {_WORDS} AS w FROM benchmark))""",
    "spelling": "spelling AS (SELECT word AS wrong, left(word, length(word) - 3) || 'ed' AS correct FROM lexicon WHERE word LIKE '%_ing' AND NOT contains(word, '_') AND NOT contains(word, '-'))",
    "vectors": "vectors AS (SELECT vec_id::VARCHAR AS word, embedding AS vec FROM embeddings)",
    "vector_edges": "vector_edges AS (SELECT * FROM (SELECT vec_id::VARCHAR AS src, CASE WHEN vec_id % 50 = 0 THEN 'missing' ELSE ((vec_id * 7 + 13) % (SELECT max(vec_id) + 1 FROM embeddings))::VARCHAR END AS tgt, vec_id % 97 + 1 AS wt FROM embeddings) WHERE src <> tgt)",
    "requests": "requests AS (SELECT DISTINCT user_id AS pos, 'u' || user_id AS cue FROM events)",
    "ledger": "ledger AS (SELECT *, left(sha1(cue || '|' || trial), 16) AS custom_id FROM (SELECT event_id, 'u' || user_id AS cue, (event_id % 20)::INT AS trial, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events))",
    "compounds": """compounds AS (SELECT squashed, expanded FROM (SELECT squashed, expanded, row_number() OVER (PARTITION BY squashed ORDER BY rank DESC, expanded DESC) AS rn FROM
        (SELECT replace(word, '_', '') AS squashed, replace(word, '_', ' ') AS expanded, 0 AS rank FROM lexicon UNION ALL SELECT replace(word, '-', ''), word, 1 FROM lexicon)
        WHERE squashed NOT IN (SELECT word FROM lexicon)) WHERE rn = 1)""",
    "said": "said AS (SELECT cue AS src, unnest([R1, R2, R3]) AS tgt FROM trials)",
    "directed": "directed AS (SELECT src, tgt, count(*)::BIGINT AS wt FROM said WHERE src <> '' AND tgt <> '' AND src <> tgt GROUP BY ALL)",
    "pairs": "pairs AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, max(wt) AS wt FROM directed GROUP BY least(src, tgt), greatest(src, tgt))",
    "heavy": "heavy AS (SELECT * FROM pairs WHERE wt > 1)",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views, in their order of dependence."""
    need = {"messy": ["trials"], "spelling": ["lexicon"], "compounds": ["lexicon"], "said": ["trials"], "directed": ["said"], "pairs": ["directed"], "heavy": ["pairs"]}
    chosen: list[str] = []

    def add(n):
        for x in need.get(n, []):
            add(x)
        if n not in chosen:
            chosen.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(VIEWS[n] for n in chosen)
