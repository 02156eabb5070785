"""The registered queries of the association engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions import payloads
from lexiweave.functions import text as T
from lexiweave.operators import balance, compare, ledger, lexicon, network, stats
from lexiweave.plans import cleaning, views
from lexiweave.plans.views import with_views
from lexiweave.runtime import Scratch
from lexiweave.sources import commits, envelopes, files, memo, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Scalar functions

_FLAT = _STRIP.format("replace(coalesce(text, ''), chr(10), ' ')")
_PARSED = (
    "list_filter(list_transform(string_split(regexp_replace(" + _FLAT + ", '[\"''`“”‘’]', '', 'g'), ','), lambda x: "
    + _STRIP.format("x") + "), lambda x: x <> '')[1:3]"
)


@query(f"SELECT conv_id, turn, array_to_string({_PARSED}, '|') AS parsed, len({_PARSED}) = 3 AS ok FROM conversations")
def parse_associations(spark, d):
    p = T.parse_associations(F.col("text"))
    return views.raw_text(spark, d).select("conv_id", "turn", T.join_pipe(p).alias("parsed"), T.is_complete(p).alias("ok"))


@query(with_views("requests") + " SELECT left(sha1(cue || '|' || trial), 16) AS custom_id, cue, trial::INT AS trial FROM requests, range(20) r(trial)")
def request_ids(spark, d):
    return ledger.request_index(views.requests(spark, d), 20)


@query(with_views("messy") + """, n AS (SELECT trial, trim(lower(replace(cue, '_', ' '))) AS cue, list_transform(list_filter([R1, R2, R3], lambda x: x IS NOT NULL), lambda x: trim(lower(replace(x, '_', ' ')))) AS r FROM messy)
    SELECT trial, cue, array_to_string([x FOR i, x IN zipped], '|') AS responses FROM (SELECT trial, cue, list_filter(list_transform(range(1, len(k) + 1), lambda i: {'i': i, 'x': k[i]}), lambda s: list_position(k, s.x) = s.i) AS zipped
    FROM (SELECT trial, cue, list_filter(r, lambda x: x <> '' AND x <> cue) AS k FROM n))""".replace("[x FOR i, x IN zipped]", "list_transform(zipped, lambda s: s.x)"))
def normalize_legacy(spark, d):
    m = views.messy(spark, d)
    named = m.select("trial", T.normal_token(F.col("cue")).alias("cue"), F.array(*T.RESPONSES).alias("r"))
    return named.select("trial", "cue", T.join_pipe(T.legacy_responses(F.col("r"), F.col("cue"))).alias("responses"))


@query(f"SELECT conv_id, turn, coalesce(p[1], '') AS R1, coalesce(p[2], '') AS R2, coalesce(p[3], '') AS R3 FROM (SELECT conv_id, turn, {_PARSED} AS p FROM conversations)")
def wide_rows(spark, d):
    joined = views.raw_text(spark, d).withColumn("parsed", T.join_pipe(T.parse_associations(F.col("text"))))
    return joined.withColumn("p", T.split_pipe(F.col("parsed"))).select("conv_id", "turn", *[c.alias(k) for k, c in T.wide(F.col("p")).items()])


_NORMAL = ", ".join(f"replace(lower(coalesce({c}, '')), '_', ' ') AS {c}" for c in T.CELLS)


@query(with_views("messy") + f" SELECT trial, {_NORMAL} FROM messy")
def clean_case_underscore(spark, d):
    return cleaning.normalise(views.messy(spark, d)).select("trial", *T.CELLS)




def _article_steps() -> str:
    steps, last = [], "n"
    for k, a in enumerate(T.ARTICLES):
        cols = ", ".join(f"CASE WHEN starts_with({r}, '{a}') AND {r} NOT IN (SELECT cue FROM c) THEN substr({r}, {len(a) + 1}) ELSE {r} END AS {r}" for r in T.RESPONSES)
        steps.append(f"s{k} AS (SELECT trial, cue, {cols} FROM {last})")
        last = f"s{k}"
    return ", ".join(steps)


_ARTICLES = f", n AS (SELECT trial, {_NORMAL} FROM messy), c AS (SELECT DISTINCT cue FROM n), {_article_steps()}"


@query(with_views("messy") + _ARTICLES + " SELECT trial, cue, R1, R2, R3 FROM s3")
def strip_articles(spark, d):
    rows = cleaning.normalise(views.messy(spark, d))
    return cleaning.strip_articles(rows, rows.select("cue")).select("trial", *T.CELLS)


def _sql_map(src: str, table: str, k: str, v: str) -> str:
    cols = ", ".join(f"coalesce((SELECT {v} FROM {table} WHERE {k} = t.{c}), t.{c}) AS {c}" for c in T.CELLS)
    return f"SELECT trial, {cols} FROM {src} t"


@query(with_views("trials", "compounds") + " " + _sql_map("trials", "compounds", "squashed", "expanded"))
def compound_map(spark, d):
    return lexicon.replace_cells(views.trials(spark, d), list(T.CELLS), lexicon.compound_dictionary(views.lexicon(spark, d))).select("trial", *T.CELLS)


@query(with_views("trials", "spelling") + " " + _sql_map("trials", "spelling", "wrong", "correct"))
def spelling_map(spark, d):
    return lexicon.replace_cells(views.trials(spark, d), list(T.CELLS), views.spelling(spark, d)).select("trial", *T.CELLS)


_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
_TRIES = " UNION ALL ".join(["SELECT word, word AS lemma FROM cells"] + [f"SELECT word, left(word, length(word) - {len(e)}) || '{r}' FROM cells WHERE ends_with(word, '{e}')" for e, r in _RULES])


@query(with_views("trials", "lexicon") + f""", cells AS (SELECT DISTINCT unnest([cue, R1, R2, R3]) AS word FROM trials), tries AS ({_TRIES}),
    best AS (SELECT word, arg_min(lemma, (length(lemma), lemma)) AS lemma FROM tries WHERE lemma IN (SELECT word FROM lexicon) AND lemma <> '' GROUP BY word)
    SELECT word, CASE l WHEN 'men' THEN 'man' WHEN 'hands' THEN 'hand' ELSE l END AS lemma FROM (SELECT word, coalesce(lemma, word) AS l FROM cells LEFT JOIN best USING (word))""")
def lemma_rules(spark, d):
    t = views.trials(spark, d).select(F.explode(F.array(*T.CELLS)).alias("word")).distinct().withColumn("lemma", F.col("word"))
    return lexicon.lemmatise(t, ["lemma"], views.lexicon(spark, d)).select("word", "lemma")


@query(with_views("messy") + f", n AS (SELECT trial, {_NORMAL} FROM messy) SELECT trial, cue, " + ", ".join(f"CASE WHEN {r} = cue THEN '' ELSE {r} END AS {r}" for r in T.RESPONSES) + " FROM n")
def blank_self(spark, d):
    rows = cleaning.normalise(views.messy(spark, d))
    return rows.withColumns({r: T.drop_self(F.col(r), F.col("cue")) for r in T.RESPONSES}).select("trial", *T.CELLS)


@query(with_views("messy") + f""", n AS (SELECT trial, {_NORMAL} FROM messy), b AS (SELECT trial, cue, """ + ", ".join(f"CASE WHEN {r} = cue THEN '' ELSE {r} END AS {r}" for r in T.RESPONSES) + """ FROM n),
    u AS (SELECT trial, cue, R1, CASE WHEN R2 = R1 THEN '' ELSE R2 END AS R2, CASE WHEN R3 = R1 OR R3 = R2 THEN '' ELSE R3 END AS R3 FROM b),
    k AS (SELECT trial, cue, list_filter([R1, R2, R3], lambda x: x <> '') AS k FROM u)
    SELECT trial, cue, coalesce(k[1], '') AS R1, coalesce(k[2], '') AS R2, coalesce(k[3], '') AS R3 FROM k""")
def dedupe_and_shift(spark, d):
    return cleaning.compact_responses(cleaning.normalise(views.messy(spark, d))).select("trial", *T.CELLS)


def _lemma(p: str, words: str) -> str:
    """CTEs that end in ``{p}(word, lemma)`` of the distinct words that the SQL ``words`` gives as ``word``."""
    tries = " UNION ALL ".join([f"SELECT word, word AS lemma FROM {p}_w"] + [f"SELECT word, left(word, length(word) - {len(e)}) || '{r}' FROM {p}_w WHERE ends_with(word, '{e}')" for e, r in _RULES])
    return f"""{p}_w AS (SELECT DISTINCT word FROM ({words})), {p}_t AS ({tries}), {p}_b AS (SELECT word, arg_min(lemma, (length(lemma), lemma)) AS lemma FROM {p}_t WHERE lemma IN (SELECT word FROM lexicon) AND lemma <> '' GROUP BY word),
    {p} AS (SELECT word, CASE l WHEN 'men' THEN 'man' WHEN 'hands' THEN 'hand' ELSE l END AS lemma FROM (SELECT word, coalesce(lemma, word) AS l FROM {p}_w LEFT JOIN {p}_b USING (word)))"""


_UNIQUE = f""", c0 AS (SELECT DISTINCT replace(lower(cue), '_', ' ') AS cue FROM messy), c1 AS (SELECT coalesce(correct, cue) AS cue FROM c0 LEFT JOIN spelling ON wrong = cue),
    c2 AS (SELECT DISTINCT coalesce(expanded, cue) AS cue FROM c1 LEFT JOIN compounds ON squashed = cue), {_lemma("ul", "SELECT cue AS word FROM c2")}, u AS (SELECT DISTINCT lemma AS cue FROM ul WHERE lemma <> '')"""


@query(with_views("messy", "spelling", "compounds") + _UNIQUE + " SELECT cue FROM u")
def unique_cues(spark, d):
    lex = views.lexicon(spark, d)
    return cleaning.unique_cues(views.messy(spark, d), views.spelling(spark, d), lexicon.compound_dictionary(lex), lex)


_BOOL = "CASE event_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' YES ' WHEN 2 THEN '1' WHEN 3 THEN '0' END"


@query(f"SELECT event_id, coalesce(lower(trim({_BOOL})) IN ('true', '1', 'yes'), false) AS ok FROM events")
def bool_coerce(spark, d):
    return views.table(spark, d, "events").select("event_id", T.lenient_bool(F.expr(_BOOL)).alias("ok"))


@query("SELECT conv_id, turn, translate(text, chr(10) || chr(13), '  ') AS text FROM conversations")
def scrub_crlf(spark, d):
    return views.raw_text(spark, d).withColumn("text", T.one_line(F.col("text")))


@query("SELECT 'c' || conv_id || '-' || turn AS custom_id, turn % 3 <> 2 AS ok, CASE turn % 3 WHEN 2 THEN 'errored' ELSE " + _STRIP.format("text") + " END AS text, CASE WHEN turn % 3 <> 2 THEN conv_id END AS input_tokens, CASE WHEN turn % 3 <> 2 THEN turn END AS output_tokens FROM conversations")
def envelope_a(spark, d):
    c = views.raw_text(spark, d)
    body = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("custom_id"),
        F.struct(
            F.when(F.col("turn") % 3 == 2, "errored").otherwise("succeeded").alias("type"),
            F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("no").alias("text"))).alias("content"),
                     F.struct(F.col("conv_id").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage")).alias("message"),
        ).alias("result"),
    )
    return envelopes.from_a(c.select(F.to_json(body).alias("payload")))


@query("SELECT 'c' || conv_id || '-' || turn AS custom_id, turn % 3 <> 2 AS ok, CASE turn % 3 WHEN 2 THEN 'HTTP 500' ELSE " + _STRIP.format("text") + " END AS text, CASE WHEN turn % 3 <> 2 THEN conv_id END AS input_tokens, CASE WHEN turn % 3 <> 2 THEN turn END AS output_tokens FROM conversations")
def envelope_b(spark, d):
    c = views.raw_text(spark, d)
    body = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("custom_id"),
        F.struct(
            F.when(F.col("turn") % 3 == 2, 500).otherwise(200).alias("status_code"),
            F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"),
                     F.struct(F.col("conv_id").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")).alias("usage")).alias("body"),
        ).alias("response"),
    )
    return envelopes.from_b(c.select(F.to_json(body).alias("payload")))


_FILL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.FILLERS) + ")"
_THINK = "CASE WHEN conv_id % 2 = 0 THEN '<think>so</think> 1. ' || coalesce(text, '') ELSE '<think>' || coalesce(text, '') END"
_A = f"list_filter(regexp_split_to_array(lower(regexp_replace(CASE WHEN contains(t, '</think>') THEN string_split(t, '</think>')[-1] ELSE replace(t, '<think>', '') END, '[<>\\n\\-*0-9.,]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN {_FILL})"


@query(f"SELECT conv_id, turn, coalesce(w[1], 'NaN') AS R1, coalesce(w[2], 'NaN') AS R2, coalesce(w[3], 'NaN') AS R3 FROM (SELECT conv_id, turn, {_A} AS w FROM (SELECT conv_id, turn, {_THINK} AS t FROM conversations))")
def probe_clean_a(spark, d):
    p = views.raw_text(spark, d).select("conv_id", "turn", T.probe_answers_a(F.expr(_THINK)).alias("w"))
    return p.select("conv_id", "turn", *[F.get("w", F.lit(i)).alias(r) for i, r in enumerate(T.RESPONSES)])


_B = f"list_filter(list_transform(CASE WHEN contains(t, ',') THEN string_split(t, ',') ELSE regexp_split_to_array(trim(t), '\\s+') END, lambda x: lower(trim(x))), lambda w: w <> '' AND w NOT IN {_FILL} AND len(regexp_split_to_array(w, '\\s+')) <= 2)"


@query(f"SELECT conv_id, turn, coalesce(w[1], 'NaN') AS R1, coalesce(w[2], 'NaN') AS R2, coalesce(w[3], 'NaN') AS R3 FROM (SELECT conv_id, turn, {_B} AS w FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^a-zA-Z, ]', ' ', 'g') AS t FROM conversations))")
def probe_clean_b(spark, d):
    p = views.raw_text(spark, d).select("conv_id", "turn", T.probe_answers_b(F.col("text")).alias("w"))
    return p.select("conv_id", "turn", *[F.get("w", F.lit(i)).alias(r) for i, r in enumerate(T.RESPONSES)])


@query(with_views("compounds") + " SELECT squashed, expanded FROM compounds")
def compound_dictionary(spark, d):
    return lexicon.compound_dictionary(views.lexicon(spark, d))


@query(with_views("requests") + " SELECT cue, 'Input: ' || cue || chr(10) || 'Output:' AS prompt FROM requests")
def prompts(spark, d):
    return views.requests(spark, d).select("cue", T.prompt(F.col("cue")).alias("prompt"))


_SYSTEM = "'" + payloads.SYSTEM_PROMPT.replace("'", "''") + "'"
_LINE_A = f"{{'custom_id': custom_id, 'params': {{'model': 'm1', 'max_tokens': 32, 'temperature': 0.5::DOUBLE, 'system': [{{'type': 'text', 'text': {_SYSTEM}}}], 'messages': [{{'role': 'user', 'content': [{{'type': 'text', 'text': prompt}}]}}]}}}}"
_LINE_B = f"{{'custom_id': custom_id, 'method': 'POST', 'url': '/v1/chat/completions', 'body': {{'model': 'm2', 'max_completion_tokens': 64, 'temperature': 1.0::DOUBLE, 'messages': [{{'role': 'system', 'content': {_SYSTEM}}}, {{'role': 'user', 'content': prompt}}], 'reasoning_effort': 'low'}}}}"


@query(with_views("requests") + f", p AS (SELECT left(sha1(cue || '|' || trial), 16) AS custom_id, 'Input: ' || cue || chr(10) || 'Output:' AS prompt FROM requests, range(20) r(trial)) SELECT custom_id, to_json({_LINE_A})::VARCHAR AS line_a, to_json({_LINE_B})::VARCHAR AS line_b FROM p")
def request_payloads(spark, d):
    """A line of a batch file for each request, for either provider."""
    a, b = payloads.Settings("m1", 32, 0.5), payloads.Settings("m2", 64, 1.0, effort="low")
    line = lambda f, s: f(F.col("custom_id"), F.col("cue"), s)
    return ledger.request_index(views.requests(spark, d), 20).select("custom_id", line(payloads.batch_line_a, a).alias("line_a"), line(payloads.batch_line_b, b).alias("line_b"))


# Vectors and statistics

_COS = "1 - list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[])"
_DIST = f", dist AS (SELECT src, tgt, wt, CASE WHEN b.vec IS NOT NULL THEN {_COS} END AS distance FROM vector_edges JOIN vectors a ON src = a.word LEFT JOIN vectors b ON tgt = b.word)"


def _dist(spark, d, oov="skip"):
    return stats.edge_distances(views.vector_edges(spark, d), views.vectors(spark, d), oov, 64)


@query(with_views("vectors", "vector_edges") + _DIST + " SELECT src, tgt, wt, round(distance, 5) AS distance FROM dist")
def cosine_pairs(spark, d):
    return _dist(spark, d).withColumn("distance", F.round("distance", 5))


@query(with_views("vectors", "vector_edges") + _DIST + " SELECT src, tgt, wt, round(coalesce(distance, 1.0), 5) AS distance FROM dist")
def oov_zero(spark, d):
    return _dist(spark, d, "zero").withColumn("distance", F.round("distance", 5))


@query(with_views("vectors") + f" SELECT b.word, round({_COS}, 5) AS distance FROM vectors a, vectors b WHERE a.word = '3'")
def one_to_many_distance(spark, d):
    return stats.nearest("3", views.vectors(spark, d)).withColumn("distance", F.round("distance", 5))


@query(with_views("vectors", "vector_edges") + _DIST + ", words AS (SELECT src AS word FROM vector_edges UNION SELECT tgt FROM vector_edges) SELECT (SELECT count(*) FROM words WHERE word NOT IN (SELECT word FROM vectors)) AS missing_words, (SELECT count(*) FROM dist WHERE distance IS NULL) AS missing_edges")
def oov_counts(spark, d):
    e = views.vector_edges(spark, d)
    words = network.vocabulary(e).join(views.vectors(spark, d).select("word"), "word", "left_anti").agg(F.count("*").alias("missing_words"))
    return words.crossJoin(_dist(spark, d).agg(F.count_if(F.col("distance").isNull()).alias("missing_edges")))


_RANKED = ", r AS (SELECT wt, distance, rank() OVER (ORDER BY wt) + (count(*) OVER (PARTITION BY wt) - 1) / 2.0 AS rw, rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0 AS rd FROM dist WHERE distance IS NOT NULL)"


@query(with_views("vectors", "vector_edges") + _DIST + _RANKED + " SELECT count(*) AS n, round(corr(wt, distance), 5) AS pearson_r, round(corr(rw, rd), 5) AS spearman_r FROM r")
def correlations(spark, d):
    c = stats.correlations(_dist(spark, d))
    return c.withColumns({k: F.round(k, 5) for k in ("pearson_r", "spearman_r")})


@query(with_views("vectors", "vector_edges") + _DIST + _RANKED + """, words AS (SELECT src AS word FROM vector_edges UNION SELECT tgt FROM vector_edges), c AS (SELECT round(corr(wt, distance), 5) AS p, round(corr(rw, rd), 5) AS s FROM r)
    SELECT 'pearson_r' AS metric, p AS value FROM c UNION ALL SELECT 'spearman_r', s FROM c UNION ALL SELECT 'missing_words', (SELECT count(*) FROM words WHERE word NOT IN (SELECT word FROM vectors))::DOUBLE
    UNION ALL SELECT 'missing_edges', (SELECT count(*) FROM dist WHERE distance IS NULL)::DOUBLE""")
def correlation_figures(spark, d):
    """The rows of ``correlation_table`` but its two probabilities, which SQL has no function for."""
    rows = stats.correlation_table(views.vector_edges(spark, d), views.vectors(spark, d))
    return rows.where("metric not like '%_p'").withColumn("value", F.round("value", 5))


@query()
def correlation_table(spark, d):
    return stats.correlation_table(views.vector_edges(spark, d), views.vectors(spark, d)).withColumn("value", F.round("value", 6))


@query(with_views("vectors", "vector_edges") + _DIST + " SELECT round(quantile_cont(wt, 0.9), 5) AS wt_cut, round(quantile_cont(distance, 0.9), 5) AS distance_cut FROM dist WHERE distance IS NOT NULL")
def quantile_cutoffs(spark, d):
    rows = _dist(spark, d).where("distance is not null")
    cuts = [stats.quantile(rows, c, 0.9).select(F.round("value", 5).alias(f"{c}_cut")) for c in ("wt", "distance")]
    return cuts[0].crossJoin(cuts[1])


@query(with_views("vectors", "vector_edges") + _DIST + ", q AS (SELECT quantile_cont(wt, 0.6) AS qw, quantile_cont(distance, 0.6) AS qd FROM dist WHERE distance IS NOT NULL) SELECT src, tgt, wt, round(distance, 5) AS distance FROM dist, q WHERE wt >= qw AND distance >= qd")
def outliers(spark, d):
    return stats.outliers(_dist(spark, d), 0.6, 0.6).withColumn("distance", F.round("distance", 5))


# Requests and ledger

_INDEX = ", idx AS (SELECT left(sha1(cue || '|' || trial), 16) AS custom_id, cue, trial::INT AS trial FROM requests, range(20) r(trial))"


def _index(spark, d):
    return ledger.request_index(views.requests(spark, d), 20)


def _of_type(spark, d, kind):
    return views.ledger(spark, d).where(F.col("event_type") == kind)


@query(with_views("requests", "ledger") + _INDEX + " SELECT custom_id, cue, trial FROM idx WHERE custom_id NOT IN (SELECT custom_id FROM ledger WHERE event_type IN ('click', 'view', 'purchase'))")
def pending_requests(spark, d):
    return ledger.pending(_index(spark, d), *[_of_type(spark, d, k) for k in ("click", "view", "purchase")])


@query(with_views("requests", "ledger") + _INDEX + ", half AS (SELECT * FROM idx WHERE trial < 10) SELECT event_id, l.custom_id, h.cue, h.trial, h.custom_id IS NOT NULL AS known FROM ledger l LEFT JOIN half h USING (custom_id)")
def unmatched_results(spark, d):
    results = views.ledger(spark, d).select("event_id", "custom_id")
    return ledger.match_results(results, _index(spark, d).where("trial < 10"))


@query(with_views("ledger") + ", e AS (SELECT DISTINCT custom_id, cue, trial FROM ledger WHERE event_type = 'click'), l AS (SELECT DISTINCT custom_id, cue, trial FROM ledger WHERE event_type = 'view') SELECT * FROM e UNION ALL SELECT * FROM l WHERE custom_id NOT IN (SELECT custom_id FROM e) AND (cue, trial) NOT IN (SELECT (cue, trial) FROM e)")
def new_by_cue_trial(spark, d):
    rows = [_of_type(spark, d, k).select("custom_id", "cue", "trial").distinct() for k in ("click", "view")]
    return ledger.merge_late(*rows)


@query(with_views("requests", "ledger") + " SELECT cue, trial_id::INT AS trial_id FROM requests, range(1, 21) r(trial_id) WHERE (cue, trial_id) NOT IN (SELECT (cue, trial::BIGINT) FROM ledger)")
def probe_tasks(spark, d):
    tasks = ledger.request_index(views.requests(spark, d), 20, first=1).select("cue", F.col("trial").alias("trial_id"))
    done = views.ledger(spark, d).select("cue", F.col("trial").alias("trial_id"))
    return tasks.join(done, ["cue", "trial_id"], "left_anti")


@query(with_views("trials") + " SELECT trial, cue FROM trials WHERE cue IN (SELECT R1 FROM trials)")
def semi_cues(spark, d):
    t = views.trials(spark, d)
    return t.select("trial", "cue").join(t.select(F.col("R1").alias("cue")).distinct(), "cue", "left_semi").select("trial", "cue")


@query(with_views("trials") + " SELECT DISTINCT R1 AS cue FROM trials WHERE R1 NOT IN (SELECT cue FROM trials)")
def absent_cues(spark, d):
    t = views.trials(spark, d)
    return compare.unique(t.select(F.col("R1").alias("word")), t.select(F.col("cue").alias("word"))).withColumnRenamed("word", "cue")


@query(with_views("ledger") + " SELECT custom_id, cue, trial, event_id FROM ledger WHERE cue IN (SELECT cue FROM ledger GROUP BY cue HAVING count(*) >= 50)")
def complete_cues(spark, d):
    return ledger.complete_cues(views.ledger(spark, d), 50).select("custom_id", "cue", "trial", "event_id")


@query(with_views("ledger") + " SELECT cue, count(*) AS completed, count(DISTINCT custom_id) AS distinct_ids FROM ledger GROUP BY cue")
def completed_by_cue(spark, d):
    return ledger.completed_by_cue(views.ledger(spark, d))


@query(with_views("ledger") + " SELECT sum(coalesce(k, 0))::BIGINT AS input_tokens, sum(coalesce(k % 7, 0))::BIGINT AS output_tokens, round(sum(coalesce(k, 0)) / 1e6 * 0.25 + sum(coalesce(k % 7, 0)) / 1e6 * 2.0, 6) AS cost_usd FROM ledger")
def usage_cost(spark, d):
    u = views.ledger(spark, d).select(F.col("k").alias("input_tokens"), (F.col("k") % 7).alias("output_tokens"))
    return ledger.usage_cost(u, 0.25, 2.0)


_STATES = ", st AS (SELECT custom_id, CASE min(event_type) WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'errored' WHEN 'view' THEN 'skipped' ELSE 'failed' END AS state FROM ledger GROUP BY custom_id)"


@query(with_views("requests", "ledger") + _INDEX + _STATES + """, t AS (SELECT count(*) AS total, count(*) FILTER (state IN ('completed', 'errored')) AS completed, count(*) FILTER (state = 'errored') AS errored, count(*) FILTER (state = 'failed') AS failed,
    count(*) FILTER (state = 'skipped') AS skipped FROM idx LEFT JOIN st USING (custom_id)) SELECT *, total - skipped - completed - failed AS remaining, CASE WHEN total - skipped > 0 THEN round(100.0::DOUBLE * (completed + failed) / (total - skipped), 4) ELSE 0.0 END AS percent_complete FROM t""")
def run_progress(spark, d):
    kind = F.min("event_type")
    states = views.ledger(spark, d).groupBy("custom_id").agg(F.when(kind == "click", "completed").when(kind == "purchase", "errored").when(kind == "view", "skipped").otherwise("failed").alias("state"))
    return ledger.run_progress(_index(spark, d), states)


_MASTER = ", master AS (SELECT row_number() OVER (ORDER BY sha1('42|' || cue || '|' || pos), pos) - 1 AS position, cue FROM requests)"


@query(with_views("requests", "ledger") + _MASTER + ", h AS (SELECT cue, count(*) AS n FROM ledger GROUP BY cue), p AS (SELECT position, coalesce(n, 0) AS n FROM master LEFT JOIN h USING (cue)) SELECT count(*) AS total_cues, coalesce(sum(n), 0)::BIGINT AS completed, count(*) FILTER (n > 0) AS touched, count(*) FILTER (n >= 50) AS \"full\", coalesce(min(position) FILTER (n < 50), count(*))::BIGINT AS next_start FROM p")
def campaign_snapshot(spark, d):
    master = balance.master_order(views.requests(spark, d), 42)
    return ledger.campaign_snapshot(master, views.ledger(spark, d), 50)


@query(with_views("ledger") + ", s AS (SELECT DISTINCT custom_id FROM ledger WHERE event_type <> 'view'), b AS (SELECT DISTINCT custom_id FROM ledger WHERE event_type = 'click'), dn AS (SELECT custom_id FROM ledger WHERE event_type = 'purchase') SELECT custom_id FROM s WHERE custom_id NOT IN (SELECT custom_id FROM b WHERE custom_id NOT IN (SELECT custom_id FROM dn))")
def requeue(spark, d):
    submitted = views.ledger(spark, d).where("event_type <> 'view'").select("custom_id").distinct()
    return ledger.requeue(submitted, _of_type(spark, d, "click"), _of_type(spark, d, "purchase"))


# Windows, samples, order

@query(with_views("trials") + " SELECT trial, cue, R1 FROM (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY trial) AS rn FROM trials) WHERE rn <= 10")
def cap_per_cue(spark, d):
    return balance.cap_per_cue(views.trials(spark, d), 10, ["trial"]).select("trial", "cue", "R1")


@query(with_views("trials") + " SELECT cue, R1, (rn - 1)::INT AS trial FROM (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY trial) AS rn, count(*) OVER (PARTITION BY cue) AS n FROM trials) WHERE n >= 5 AND rn <= 5")
def cap_renumber(spark, d):
    rows = views.trials(spark, d).withColumnRenamed("trial", "at")
    return balance.cap_and_renumber(rows, 5, "at").select("cue", "R1", "trial")


_BALANCE = """, cues AS (SELECT DISTINCT cue FROM trials WHERE length(cue) > 2 UNION SELECT 'never said'), dr AS (SELECT cue, R1, R2, R3, row_number() OVER (PARTITION BY cue ORDER BY sha1('42|' || cue || '|' || trial), trial) AS rn FROM trials WHERE cue IN (SELECT cue FROM cues)),
    kept AS (SELECT cue, R1, R2, R3 FROM dr WHERE rn <= 10), h AS (SELECT cue, count(*) AS n FROM kept GROUP BY cue)"""


@query(with_views("trials") + _BALANCE + " SELECT * FROM kept UNION ALL SELECT cue, '', '', '' FROM (SELECT cue, unnest(range(10 - coalesce(n, 0))) FROM cues LEFT JOIN h USING (cue))")
def balance_n(spark, d):
    t = views.trials(spark, d)
    cues = t.where("length(cue) > 2").select("cue").union(spark.createDataFrame([("never said",)], "cue string"))
    return balance.balance(t, cues, 10, 42, ["trial"])


@query(with_views("trials") + """, dr AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY sha1('42|' || cue || '|' || trial), trial) AS rn FROM trials), kept AS (SELECT cue, trial, R1 || '|' || R2 || '|' || R3 AS responses FROM dr WHERE rn <= 8), h AS (SELECT cue, count(*) AS n FROM kept GROUP BY cue)
    SELECT * FROM kept UNION ALL SELECT cue, unnest(range(n, 8)) AS trial, '' FROM h WHERE n < 8""")
def balance_legacy(spark, d):
    rows = views.trials(spark, d).select("cue", "trial", F.array(*T.RESPONSES).alias("responses"))
    return balance.align(rows, 8, 42).select("cue", F.col("trial").cast("long").alias("trial"), T.join_pipe(F.col("responses")).alias("responses"))


@query(with_views("ledger") + " SELECT custom_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY event_id) AS rn FROM ledger) WHERE rn = 1")
def ledger_dedup(spark, d):
    return balance.first_wins(views.ledger(spark, d), "custom_id", "event_id").select("custom_id", "event_id")


@query(with_views("trials") + " SELECT trial, (unnest([1, 2, 3]))::INT AS position, unnest([R1, R2, R3]) AS response FROM trials")
def response_positions(spark, d):
    return views.trials(spark, d).select("trial", F.posexplode(F.array(*T.RESPONSES)).alias("p", "response")).select("trial", (F.col("p") + 1).alias("position"), "response")


@query(with_views("requests") + _INDEX + " SELECT (rn - 1) // 64 AS chunk, count(*) AS n, min(custom_id) AS first_id, max(custom_id) AS last_id FROM (SELECT custom_id, row_number() OVER (ORDER BY custom_id) AS rn FROM idx) GROUP BY 1")
def request_chunks(spark, d):
    return balance.chunks(_index(spark, d), 64, "custom_id")


@query(with_views("ledger") + " SELECT cue, trial, event_id, coalesce(event_type, '') AS state FROM ledger ORDER BY cue, trial, event_id")
def sorted_export(spark, d):
    return views.ledger(spark, d).select("cue", "trial", "event_id", T.blank(F.col("event_type")).alias("state")).orderBy("cue", "trial", "event_id")


@query(with_views("requests") + " SELECT pos, cue FROM requests ORDER BY sha1('7|' || cue || '|' || pos), pos LIMIT 25")
def sample_cues(spark, d):
    return balance.sample_cues(views.requests(spark, d), 25, 7)


@query(with_views("requests") + _MASTER + " SELECT position, cue FROM master")
def master_order(spark, d):
    return balance.master_order(views.requests(spark, d), 42)


@query(with_views("requests") + _MASTER + " SELECT position, cue FROM master WHERE position >= 10 AND position < 30")
def cue_window(spark, d):
    return balance.cue_window(balance.master_order(views.requests(spark, d), 42), 10, 20)


# Networks

@query(with_views("directed") + " SELECT * FROM directed")
def edges_directed(spark, d):
    return network.directed_edges(views.trials(spark, d))


@query(with_views("said") + " SELECT src, tgt, count(*) AS wt FROM said WHERE src <> '' AND tgt <> '' GROUP BY ALL")
def edges_legacy(spark, d):
    return network.response_edges(views.trials(spark, d).select("cue", F.array(*T.RESPONSES).alias("responses")))


@query(with_views("pairs") + " SELECT * FROM pairs")
def edges_undirected_max(spark, d):
    return network.undirected_edges(views.trials(spark, d))


@query(with_views("directed") + " SELECT DISTINCT src, tgt FROM directed")
def edge_set(spark, d):
    return network.directed_edges(views.trials(spark, d)).select("src", "tgt").distinct()


@query(with_views("trials") + """, n AS (SELECT cue, count(*) AS n FROM trials GROUP BY cue), w AS (SELECT cue FROM trials UNION SELECT R1 FROM trials)
    SELECT cue, coalesce(n, 0) AS n, CASE WHEN n > 5 THEN 'over' WHEN n = 5 THEN 'exact' WHEN n > 0 THEN 'under' ELSE 'missing' END AS class FROM w LEFT JOIN n USING (cue)""")
def cue_balance_class(spark, d):
    t = views.trials(spark, d)
    return balance.balance_class(t, t.select("cue").union(t.select("R1")), 5)


@query(with_views("pairs") + " SELECT (SELECT count(*) FROM (SELECT src FROM pairs UNION SELECT tgt FROM pairs)) AS nodes, (SELECT count(*) FROM pairs) AS edges")
def graph_size(spark, d):
    return network.graph_size(network.undirected_edges(views.trials(spark, d)))


@query(with_views("pairs") + " SELECT DISTINCT word FROM (SELECT src AS word FROM pairs UNION SELECT tgt FROM pairs)")
def vocabulary(spark, d):
    return network.vocabulary(network.undirected_edges(views.trials(spark, d)))


@query(with_views("pairs", "lexicon") + " SELECT * FROM pairs WHERE replace(src, ' ', '_') IN (SELECT word FROM lexicon) AND replace(tgt, ' ', '_') IN (SELECT word FROM lexicon)")
def lexicon_subgraph(spark, d):
    return lexicon.subgraph(network.undirected_edges(views.trials(spark, d)), views.lexicon(spark, d))


@query(with_views("heavy") + " SELECT * FROM heavy")
def idiosyncratic_filter(spark, d):
    return network.not_idiosyncratic(network.undirected_edges(views.trials(spark, d)))


_COMPONENTS = """, sym AS (SELECT src, tgt FROM heavy UNION SELECT tgt, src FROM heavy), comp(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM sym UNION
    SELECT s.tgt, min(c.component) FROM comp c JOIN sym s ON s.src = c.node JOIN recurring.comp k ON k.node = s.tgt WHERE c.component < k.component GROUP BY s.tgt)"""


def _heavy(spark, d):
    return network.not_idiosyncratic(network.undirected_edges(views.trials(spark, d)))


@query(with_views("heavy") + _COMPONENTS + " SELECT node, component FROM comp")
def components(spark, d):
    return network.components(_heavy(spark, d))


_LARGEST = ", best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"


@query(with_views("heavy") + _COMPONENTS + _LARGEST + " SELECT h.* FROM heavy h JOIN comp ON node = src JOIN best USING (component)")
def largest_component(spark, d):
    return network.largest_component(_heavy(spark, d))


def _known_pairs(known: str) -> str:
    """``heavy`` again, of pairs that a condition on ``{word}`` admits to the lexicon."""
    return with_views("pairs", "lexicon") + ", heavy AS (SELECT * FROM pairs WHERE wt > 1 AND " + " AND ".join(known.format(word=f"replace({c}, ' ', '_')") for c in ("src", "tgt")) + ")"


_LARGEST_EDGES = _COMPONENTS + _LARGEST + " SELECT h.* FROM heavy h JOIN comp ON node = src JOIN best USING (component)"
_DIRECT = "(" + " OR ".join(["{{word}} IN (SELECT word FROM lexicon)"] + [f"ends_with({{{{word}}}}, '{e}') AND left({{{{word}}}}, length({{{{word}}}}) - {len(e)}) || '{r}' IN (SELECT word FROM lexicon)" for e, r in _RULES]).replace("{{", "{").replace("}}", "}") + ")"


@query(_known_pairs("{word} IN (SELECT word FROM lexicon)") + _LARGEST_EDGES)
def full_graph(spark, d):
    return network.filtered_graph(views.trials(spark, d), views.lexicon(spark, d))


@query(_known_pairs(_DIRECT) + _LARGEST_EDGES)
def full_graph_direct(spark, d):
    return network.filtered_graph(views.trials(spark, d), views.lexicon(spark, d), direct=True)


@query(_known_pairs(_DIRECT).replace("wt > 1 AND", "") + " SELECT * FROM heavy")
def lexicon_subgraph_direct(spark, d):
    return lexicon.direct_subgraph(network.undirected_edges(views.trials(spark, d)), views.lexicon(spark, d))


@query(with_views("heavy") + ", near AS (SELECT CASE WHEN src = 'the' THEN tgt ELSE src END AS word, wt FROM heavy WHERE src = 'the' OR tgt = 'the') SELECT word, wt, round(wt / sum(wt) OVER (), 6) AS share FROM near ORDER BY wt DESC, word LIMIT 10")
def strongest(spark, d):
    return network.strongest(_heavy(spark, d), "the", 10).withColumn("share", F.round("share", 6))


@query(with_views("trials") + " SELECT cue AS word FROM trials INTERSECT SELECT R1 FROM trials")
def overlap_words(spark, d):
    t = views.trials(spark, d)
    return compare.overlap(t.select(F.col("cue").alias("word")), t.select(F.col("R1").alias("word")))


@query(with_views("trials") + " SELECT cue AS word FROM trials EXCEPT SELECT R1 FROM trials")
def unique_words(spark, d):
    t = views.trials(spark, d)
    return compare.unique(t.select(F.col("cue").alias("word")), t.select(F.col("R1").alias("word")))


@query(with_views("heavy") + " SELECT (SELECT count(*) FROM pairs) AS n_left, (SELECT count(*) FROM heavy) AS n_right, (SELECT count(*) FROM (FROM pairs EXCEPT FROM heavy)) AS only_left, (SELECT count(*) FROM (FROM heavy EXCEPT FROM pairs)) AS only_right, 'DIFF' AS verdict")
def edge_diff(spark, d):
    pairs = network.undirected_edges(views.trials(spark, d))
    return compare.edge_diff(pairs, network.not_idiosyncratic(pairs))


# Ledger guards, merges and metadata

_PROGRESS = ", pr AS (SELECT cue, CASE min(event_type) WHEN 'click' THEN 'running' WHEN 'view' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state, sum(coalesce(k, 0)) / 1000.0::DOUBLE AS cost_usd FROM ledger GROUP BY cue)"


def _progress(spark, d):
    kind = F.min("event_type")
    state = F.when(kind == "click", "running").when(kind == "view", "paused").when(kind == "purchase", "completed").otherwise("failed")
    return views.ledger(spark, d).groupBy("cue").agg(state.alias("state"), (F.sum(F.coalesce("k", F.lit(0))) / F.lit(1000.0)).alias("cost_usd"))


@query(with_views("ledger") + _PROGRESS + " SELECT cue, state, round(cost_usd, 6) AS cost_usd, CASE WHEN state IN ('completed', 'timed_out', 'failed') THEN 'stop' WHEN state = 'paused' THEN 'wait' WHEN cost_usd >= 3 THEN 'pause' ELSE 'run' END AS action FROM pr")
def guard_actions(spark, d):
    return ledger.guard(_progress(spark, d), 3.0).withColumn("cost_usd", F.round("cost_usd", 6))


@query(with_views("ledger") + " SELECT 'cue=' || cue || ' completed=' || count(*) || ' distinct_ids=' || count(DISTINCT custom_id) AS line FROM ledger GROUP BY cue")
def status_lines(spark, d):
    return ledger.status_line(ledger.completed_by_cue(views.ledger(spark, d)))


@query(with_views("ledger") + " SELECT sum(coalesce(k, 0))::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, round(sum(coalesce(k, 0)) / 1e6 * 0.25, 6) AS cost_usd FROM ledger WHERE custom_id IN (SELECT custom_id FROM ledger WHERE event_type = 'purchase')")
def usage_completed(spark, d):
    usage = views.ledger(spark, d).select("custom_id", F.col("k").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"))
    return ledger.usage_cost(ledger.usage_of(usage, _of_type(spark, d, "purchase")), 0.25, 2.0)


@query(with_views("requests", "ledger") + _MASTER + ", h AS (SELECT cue, count(*) AS n FROM ledger GROUP BY cue) SELECT position, cue, coalesce(n, 0) AS completed FROM master LEFT JOIN h USING (cue) WHERE coalesce(n, 0) < 60")
def open_cues(spark, d):
    return ledger.open_cues(balance.master_order(views.requests(spark, d), 42), views.ledger(spark, d), 60)


@query(with_views("requests", "ledger") + _INDEX + " SELECT count(*) AS skipped FROM idx WHERE custom_id IN (SELECT custom_id FROM ledger WHERE event_type = 'view')")
def skipped_requests(spark, d):
    return ledger.skipped_count(_index(spark, d), _of_type(spark, d, "view"))


@query(with_views("ledger") + ", s AS (SELECT DISTINCT event_type AS state, custom_id FROM ledger) SELECT state, row_number() OVER (PARTITION BY state ORDER BY custom_id) - 1 AS position, custom_id FROM s")
def sorted_ids(spark, d):
    return ledger.sorted_ids(views.ledger(spark, d).select("custom_id", F.col("event_type").alias("state")))


@query(with_views("requests") + _INDEX + " SELECT * FROM (SELECT (rn - 1) // 64 AS chunk, count(*) AS n, min(custom_id) AS first_id, max(custom_id) AS last_id FROM (SELECT custom_id, row_number() OVER (ORDER BY custom_id) AS rn FROM idx) GROUP BY 1) WHERE chunk < 3")
def open_slots(spark, d):
    return balance.open_slots(balance.chunks(_index(spark, d), 64, "custom_id"), 2, 5)


@query(with_views("ledger") + """, l AS (SELECT DISTINCT custom_id, cue, trial FROM ledger WHERE event_type = 'click'), r AS (SELECT DISTINCT custom_id, cue, trial FROM ledger WHERE event_type <> 'click'),
    t AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY trial, custom_id) AS rn FROM r) SELECT * FROM l UNION ALL SELECT custom_id, cue, trial FROM t WHERE rn <= 12 AND custom_id NOT IN (SELECT custom_id FROM l)""")
def sync_campaign(spark, d):
    own = views.ledger(spark, d)
    rows = [own.where(f"event_type {op} 'click'").select("custom_id", "cue", "trial").distinct() for op in ("<>", "=")]
    return ledger.sync_campaign(rows[0], rows[1], 12)


@query(with_views("ledger") + """, a AS (SELECT custom_id, cue, trial, min(event_id) AS position, 0 AS late FROM ledger WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT custom_id, cue, trial, min(event_id) AS position, 1 AS late FROM ledger WHERE event_type = 'view' GROUP BY ALL),
    m AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE custom_id NOT IN (SELECT custom_id FROM a) AND (cue, trial) NOT IN (SELECT (cue, trial) FROM a)),
    k AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY late, position) AS rn, count(*) OVER (PARTITION BY cue) AS n FROM m) SELECT left(sha1(cue || '|' || (rn - 1)), 16) AS custom_id, cue, (rn - 1)::INT AS trial, position FROM k WHERE n >= 10 AND rn <= 10""")
def reconcile_late(spark, d):
    a, b = (_of_type(spark, d, k).groupBy("custom_id", "cue", "trial").agg(F.min("event_id").alias("position")) for k in ("click", "view"))
    return ledger.reconcile(a, b, 10)


@query(with_views("lexicon") + " SELECT word, length(word) / 2.0::DOUBLE AS zipf FROM lexicon WHERE length(word) BETWEEN 5 AND 9 AND regexp_full_match(word, '[a-zA-Z-]+')")
def norms_filter(spark, d):
    return lexicon.within_norms(views.lexicon(spark, d).select("word", (F.length("word") / F.lit(2.0)).alias("zipf")))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at FROM events")
def run_times(spark, d):
    return views.table(spark, d, "events").select("event_id", files.run_id(F.col("ts")).alias("run_id"), files.iso_utc(F.col("ts")).alias("at"))


# Tolerant JSON

_KIND = "CASE conv_id % 5 WHEN 0 THEN '{bad' WHEN 1 THEN '' WHEN 2 THEN '[1]' END"


@query(f"SELECT 'c' || conv_id || '-' || turn AS id, text FROM conversations WHERE {_KIND} IS NULL")
def jsonl_scan(spark, d):
    body = F.to_json(F.struct(F.expr("'c' || conv_id || '-' || turn").alias("id"), "text"))
    path = f"{Scratch(spark, 'jsonl').root}/lines"
    views.raw_text(spark, d).select(F.coalesce(F.expr(_KIND), body).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "id string, text string")


@query("SELECT 'p' || conv_id || '-' || turn || '-' || i AS custom_id, true AS ok, 't' || i AS text, i AS input_tokens, NULL::BIGINT AS output_tokens FROM conversations, range(3) r(i) WHERE i < CASE turn % 4 WHEN 0 THEN 1 ELSE 3 END")
def envelope_payloads(spark, d):
    one = "to_json(struct('p' || conv_id || '-' || turn || '-' || i as custom_id, struct('succeeded' as type, struct(array(struct('text' as type, 't' || i as text)) as content, struct(cast(i as bigint) as input_tokens) as usage) as message) as result))"
    all_ = f"transform(sequence(0, 2), i -> {one})"
    shape = f"CASE turn % 4 WHEN 0 THEN {all_}[0] WHEN 1 THEN '[' || array_join({all_}, ',') || ']' WHEN 2 THEN '{{\"results\":[' || array_join({all_}, ',') || ']}}' ELSE array_join({all_}, '\n') END"
    return envelopes.from_a(views.raw_text(spark, d).select(F.expr(shape).alias("payload")))


_LIST = "CASE event_id % 4 WHEN 0 THEN '[\"a\", \"' || event_type || '\"]' WHEN 1 THEN '{\"a\": 1}' WHEN 2 THEN '[\"a' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a|' || event_type ELSE '' END AS items, CASE WHEN event_id % 4 = 1 THEN 1 ELSE -1 END::BIGINT AS a FROM events")
def json_defaults(spark, d):
    value = F.expr(_LIST)
    found = files.json_object(value, "a bigint", F.struct(F.lit(-1).cast("long").alias("a")))
    return views.table(spark, d, "events").select("event_id", T.join_pipe(files.json_strings(value)).alias("items"), found["a"].alias("a"))


@query("SELECT 'r1' AS run_id, 'running' AS state, count(*) AS total FROM events")
def manifest_kept(spark, d):
    """The first manifest wins over one made later."""
    path = f"{Scratch(spark, 'manifest').root}/manifest"
    row = lambda name: views.table(spark, d, "events").agg(F.lit(name).alias("run_id"), F.lit("running").alias("state"), F.count("*").alias("total"))
    files.create_or_load(row("r1"), path)
    return files.create_or_load(row("r2"), path)


# Whole pipelines and files

def _cells_by(src: str, table: str, k: str, v: str) -> str:
    joins = " ".join(f"LEFT JOIN {table} m{i} ON m{i}.{k} = t.{c}" for i, c in enumerate(T.CELLS))
    return f"SELECT trial, {', '.join(f'coalesce(m{i}.{v}, t.{c}) AS {c}' for i, c in enumerate(T.CELLS))} FROM {src} t {joins}"


_CLEAN = (
    _UNIQUE + f", n AS (SELECT trial, {_NORMAL} FROM messy), c AS (SELECT cue FROM u), {_article_steps()}, f1 AS ({_cells_by('s3', 'compounds', 'squashed', 'expanded')}), f2 AS ({_cells_by('f1', 'spelling', 'wrong', 'correct')}), "
    + _lemma("fl", "SELECT unnest([cue, R1, R2, R3]) AS word FROM f2") + f""", f3 AS ({_cells_by('f2', 'fl', 'word', 'lemma')}),
    f4 AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY sha1('42|' || cue || '|' || trial), trial) AS rn FROM f3),
    f5 AS (SELECT p.cue, coalesce(R1, '') AS R1, coalesce(R2, '') AS R2, coalesce(R3, '') AS R3 FROM (SELECT cue, unnest(range(1, 11)) AS rn FROM u) p LEFT JOIN f4 ON f4.cue = p.cue AND f4.rn = p.rn),
    f6 AS (SELECT cue, """ + ", ".join(f"CASE WHEN {r} = cue THEN '' ELSE {r} END AS {r}" for r in T.RESPONSES) + """ FROM f5),
    f7 AS (SELECT cue, list_filter([R1, CASE WHEN R2 = R1 THEN '' ELSE R2 END, CASE WHEN R3 = R1 OR R3 = R2 THEN '' ELSE R3 END], lambda x: x <> '') AS k FROM f6)"""
)


@query(with_views("messy", "spelling", "compounds") + _CLEAN + " SELECT cue, coalesce(k[1], '') AS R1, coalesce(k[2], '') AS R2, coalesce(k[3], '') AS R3 FROM f7")
def full_clean(spark, d):
    lex = views.lexicon(spark, d)
    return cleaning.clean(views.messy(spark, d), views.spelling(spark, d), lexicon.compound_dictionary(lex), lex, 10, 42, ["trial"])


@query(with_views("ledger") + " SELECT cue, count(DISTINCT custom_id) AS completed FROM ledger GROUP BY cue")
def stream_ledger(spark, d):
    from lexiweave.streaming.ledger import ledger_index, read_ledger, run_ledger

    s = Scratch(spark, "stream")
    rows = views.ledger(spark, d).select("custom_id", "cue", "trial", F.lit("").alias("raw_text"), F.lit("").alias("parsed"), F.lit(True).alias("ok"), F.lit("").alias("updated_at"))
    for _ in range(2):  # the second time adds nothing
        rows.write.mode("append").json(f"{s.root}/in")
        run_ledger(spark, f"{s.root}/in", f"{s.root}/ledger", f"{s.root}/state")
    return ledger_index(read_ledger(spark, f"{s.root}/ledger"))


_RECONCILED = """, a AS (SELECT custom_id, cue, trial, min(event_id) AS position, 0 AS late FROM ledger WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT custom_id, cue, trial, min(event_id) AS position, 1 AS late FROM ledger WHERE event_type = 'view' GROUP BY ALL),
    m AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE custom_id NOT IN (SELECT custom_id FROM a) AND (cue, trial) NOT IN (SELECT (cue, trial) FROM a)),
    k AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY late, position) AS rn, count(*) OVER (PARTITION BY cue) AS n FROM m), r AS (SELECT left(sha1(cue || '|' || (rn - 1)), 16) AS custom_id, cue, (rn - 1)::INT AS trial FROM k WHERE n >= 10 AND rn <= 10),
    u AS (SELECT custom_id, coalesce(k, 0) AS i, coalesce(k % 7, 0) AS o FROM ledger WHERE event_type = 'click' UNION ALL SELECT custom_id, coalesce(k, 0), coalesce(k % 7, 0) FROM ledger WHERE event_type = 'view' AND custom_id IN (SELECT custom_id FROM r)),
    t AS (SELECT coalesce(sum(i), 0) AS i, coalesce(sum(o), 0) AS o FROM u WHERE custom_id IN (SELECT custom_id FROM r)), n AS (SELECT count(*) AS total, count(*) FILTER (custom_id IN (SELECT custom_id FROM r)) AS done FROM idx)
    SELECT 'rows' AS artefact, custom_id, cue || '#' || trial AS detail FROM r UNION ALL SELECT 'index', custom_id, (row_number() OVER (ORDER BY custom_id) - 1)::VARCHAR FROM (SELECT DISTINCT custom_id FROM r)
    UNION ALL SELECT 'usage', custom_id, i || '|' || o FROM u UNION ALL SELECT DISTINCT 'checkpoint', custom_id, 'completed' FROM r
    UNION ALL SELECT 'checkpoint', custom_id, 'submitted' FROM (SELECT custom_id FROM r UNION SELECT custom_id FROM ledger WHERE event_type = 'purchase')
    UNION ALL SELECT 'progress', '', done || ' of ' || total || ', ' || i || ' ' || o || ', cost ' || round((i / 1e6 * 0.25 + o / 1e6 * 2.0) * 1e6)::BIGINT FROM n, t"""


@query(with_views("requests", "ledger") + _INDEX + _RECONCILED)
def reconciled_artefacts(spark, d):
    """The five artefacts of a reconciled run, as read from the version that was committed last."""
    own, versions = views.ledger(spark, d), commits.Versions(spark, f"{Scratch(spark, 'run').root}/run")
    a, b = (_of_type(spark, d, k).groupBy("custom_id", "cue", "trial").agg(F.min("event_id").alias("position")) for k in ("click", "view"))
    spent = [_of_type(spark, d, k).select("custom_id", F.coalesce("k", F.lit(0)).alias("input_tokens"), F.coalesce(F.col("k") % 7, F.lit(0)).alias("output_tokens")) for k in ("click", "view")]
    versions.commit({"rows": a, "usage": spent[0]})
    made = ledger.reconciled_artefacts(_index(spark, d), versions.read("rows"), b, versions.read("usage"), spent[1], own.where("event_type = 'purchase'"), 10, (0.25, 2.0))
    versions.commit(made)
    line = lambda name, detail, key="custom_id": versions.read(name).select(F.lit(name).alias("artefact"), F.expr(key).alias("custom_id"), F.expr(detail).alias("detail"))
    return (
        line("rows", "cue || '#' || trial").union(line("index", "string(position)")).union(line("usage", "input_tokens || '|' || output_tokens")).union(line("checkpoint", "state"))
        .union(line("progress", "completed || ' of ' || total || ', ' || input_tokens || ' ' || output_tokens || ', cost ' || cast(round(cost_usd * 1e6) as bigint)", "''"))
    )


_EVENT_KIND = "CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'result' WHEN 'error' THEN 'lost' ELSE 'poll' END"
_EVENT_ID = "CASE event_type WHEN 'click' THEN 'r' || event_id % 40 WHEN 'view' THEN 'r' || {} % 40 END"
_INSIDE = "flatten(list_transform(opened, lambda o: o.ids))"

#: One run's events, one after the other: the queue, the open batches, the ids with a result, how many batches there were, and what the event led to.
_ADMISSION = f"""WITH RECURSIVE ev AS (SELECT 'u' || user_id AS run, event_id AS seq, ts AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_EVENT_KIND} AS kind,
        {_EVENT_ID.format("json_extract_string(props, '$.k')::BIGINT")} AS id, CASE WHEN event_type = 'error' THEN (event_id % 6)::INT END AS batch, first_value(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS began FROM events),
    st(run, n, waiting, opened, done, batches, seq, moment, log) AS (SELECT DISTINCT run, 0::BIGINT, []::VARCHAR[], []::STRUCT(b INT, ids VARCHAR[])[], []::VARCHAR[], 0, 0::BIGINT, NULL::TIMESTAMP, []::STRUCT(action VARCHAR, batch INT, ids VARCHAR[], moment TIMESTAMP)[] FROM ev
      UNION ALL SELECT run, n, CASE kind WHEN 'request' THEN CASE WHEN known THEN waiting ELSE list_append(waiting, id) END WHEN 'result' THEN list_filter(waiting, lambda x: x <> id) WHEN 'lost' THEN list_concat(waiting, flatten(list_transform(hit, lambda o: o.ids)))
            ELSE waiting[3 * len(sent) + 1:] END,
        CASE kind WHEN 'result' THEN list_filter(fewer, lambda o: len(o.ids) > 0) WHEN 'lost' THEN list_filter(opened, lambda o: o.b <> batch) WHEN 'poll' THEN list_concat(opened, sent) ELSE opened END,
        CASE WHEN kind = 'result' AND NOT list_contains(done, id) THEN list_append(done, id) ELSE done END, batches + len(sent)::INT, seq, moment,
        list_concat(CASE WHEN over AND NOT before THEN [{{'action': 'timed_out', 'batch': NULL, 'ids': [], 'moment': began + INTERVAL 20 DAY}}] ELSE [] END, CASE kind
            WHEN 'result' THEN CASE WHEN list_contains(done, id) THEN [] ELSE list_concat([{{'action': CASE WHEN known THEN 'completed' ELSE 'failed' END, 'batch': list_filter(opened, lambda o: list_contains(o.ids, id))[1].b, 'ids': [id], 'moment': moment}}],
                list_transform(list_filter(fewer, lambda o: len(o.ids) = 0), lambda o: {{'action': 'closed', 'batch': o.b, 'ids': []::VARCHAR[], 'moment': moment}})) END
            WHEN 'lost' THEN list_transform(hit, lambda o: {{'action': 'requeued', 'batch': o.b, 'ids': o.ids, 'moment': moment}}) WHEN 'poll' THEN list_transform(sent, lambda o: {{'action': 'submitted', 'batch': o.b, 'ids': o.ids, 'moment': moment}}) ELSE [] END)
      FROM (SELECT *, list_contains(waiting, id) OR list_contains(done, id) OR list_contains({_INSIDE}, id) AS known, list_filter(opened, lambda o: o.b = batch) AS hit, list_transform(opened, lambda o: {{'b': o.b, 'ids': list_filter(o.ids, lambda x: x <> id)}}) AS fewer,
            CASE WHEN kind = 'poll' AND NOT over THEN list_transform(range(greatest(least(2 - len(opened), (len(waiting) + 2) // 3), 0)), lambda i: {{'b': (batches + i)::INT, 'ids': waiting[3 * i + 1:3 * i + 3]}}) ELSE [] END AS sent
        FROM (SELECT ev.*, st.waiting, st.opened, st.done, st.batches, ev.moment >= began + INTERVAL 20 DAY AS over, coalesce(st.moment >= began + INTERVAL 20 DAY, false) AS before FROM st JOIN ev ON ev.run = st.run AND ev.n = st.n + 1)))
    SELECT run, seq, step, l.moment AS moment, l.action AS action, l.batch AS batch, array_to_string(l.ids, '|') AS ids FROM (SELECT run, seq, unnest(log) AS l, generate_subscripts(log, 1)::INT - 1 AS step FROM st)"""


@query(_ADMISSION)
def admission_log(spark, d):
    """Every user is a run with two slots for batches of three; its events come in two goes."""
    from datetime import timedelta

    from lexiweave.streaming.admission import Limits, run_admission

    s, e = Scratch(spark, "admission"), views.table(spark, d, "events")
    kind = F.col("event_type")
    events = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.expr(_EVENT_KIND).alias("kind"),
        F.expr(_EVENT_ID.format("cast(get_json_object(props, '$.k') as bigint)")).alias("id"), F.when(kind == "error", F.col("event_id") % 6).cast("int").alias("batch"),
    )
    half = F.lit(e.agg(F.max("event_id")).first()[0] or 0) / 2
    for part in (events.where(F.col("seq") < half), events.where(F.col("seq") >= half)):
        part.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{s.root}/in")
        log = run_admission(spark, f"{s.root}/in", f"{s.root}/log", f"{s.root}/state", Limits(2, 3, timedelta(days=20)))
    return log.select("run", "seq", "step", F.col("at").cast("timestamp_ntz").alias("moment"), "action", "batch", T.join_pipe(F.col("ids")).alias("ids"))


@query(with_views("vectors") + " SELECT word, list_sum(list_transform(vec, lambda x: floor(x::DOUBLE * 1000000)::BIGINT))::BIGINT AS total, len(vec)::INT AS dim FROM vectors")
def binary_vectors(spark, d):
    """Vectors written as binary files and read back in ranges."""
    path = f"{Scratch(spark, 'vectors').root}/binary"
    vectors.write_binary_vectors(views.vectors(spark, d), path)
    back = vectors.read_binary_vectors(spark, path)
    return back.select("word", F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 1000000)).alias("total"), F.size("vec").alias("dim"))


@query(with_views("compounds") + " SELECT squashed, expanded, 1 AS made FROM compounds")
def memo_compounds(spark, d):
    """The compound dictionary, made by a first job and found by a second one."""
    root, lex = f"{Scratch(spark, 'memo').root}/memo", views.lexicon(spark, d)
    jobs = [memo.Memo(spark, root) for _ in range(2)]
    found = [job.table("compounds", {"lexicon": lex}, lambda: lexicon.compound_dictionary(lex)) for job in jobs]
    return found[-1].withColumn("made", F.lit(sum(job.made for job in jobs)))


def _echo():
    """A scorer for the test tables: the cue, a fixed word, and the cue with an ending."""
    def score(prompts: list[str]) -> list[str]:
        cues = [p.removeprefix("Input: ").removesuffix("\nOutput:") for p in prompts]
        return [f"<think>{c}</think> 1. {c}, 2. sea, {c}s" for c in cues]

    return score


@query(with_views("lexicon") + f""", c AS (SELECT DISTINCT word AS cue FROM lexicon WHERE NOT regexp_matches(word, '[-_]')), a AS (SELECT cue, list_filter([cue, 'sea', cue || 's'], lambda w: w NOT IN {_FILL}) AS w FROM c)
    SELECT cue, trial_id::INT AS trial_id, coalesce(w[1], 'NaN') AS R1, coalesce(w[2], 'NaN') AS R2, coalesce(w[3], 'NaN') AS R3 FROM a, range(1, 4) t(trial_id)""")
def probe_run(spark, d):
    """Three trials of each cue; the first one is there already when the run begins."""
    from lexiweave.streaming.probe import run_probe

    cues, path = views.lexicon(spark, d).where("word not rlike '[-_]'").select(F.col("word").alias("cue")), f"{Scratch(spark, 'probe').root}/answers"
    for repetitions in (1, 3):
        answers = run_probe(cues, repetitions, path, "echo", _echo, T.probe_answers_a)
    return answers


@query("""WITH n AS (SELECT (user_id % 4)::INT AS lane, count(*) AS n FROM events GROUP BY ALL) SELECT lane, f::BIGINT AS flush, least(64, n - 64 * f)::INT AS lines FROM (SELECT lane, n, unnest(range((n + 63) // 64)) AS f FROM n)""")
def flush_sizes(spark, d):
    """Events by lane, passed on 64 at a time, and what is left at the end."""
    from lexiweave.streaming.probe import end_lanes, start_flushes

    s, e = Scratch(spark, "flushes"), views.table(spark, d, "events")
    lines = e.select((F.col("user_id") % 4).cast("int").alias("lane"), F.col("event_id").cast("string").alias("line"), F.lit(False).alias("last"))
    for part in (lines.where("line % 2 = 0"), lines.where("line % 2 = 1")):
        part.write.mode("append").json(f"{s.root}/in")
        start_flushes(spark, f"{s.root}/in", f"{s.root}/out", f"{s.root}/state").awaitTermination()
    end_lanes(spark, f"{s.root}/in", 4)
    start_flushes(spark, f"{s.root}/in", f"{s.root}/out", f"{s.root}/state").awaitTermination()
    return spark.read.schema("lane int, flush long, lines array<string>").parquet(f"{s.root}/out").select("lane", "flush", F.size("lines").alias("lines"))


@query(with_views("requests", "ledger") + _INDEX + """, h AS (SELECT custom_id, min(event_id % 2) AS half FROM ledger GROUP BY custom_id), t AS (SELECT count(*) AS total FROM idx),
    b AS (SELECT half + 1 AS step, (SELECT count(*) FROM ledger WHERE event_id % 2 = half) AS rows_in, count(*) AS added, sum(count(*)) OVER (ORDER BY half) AS done FROM h GROUP BY half)
    SELECT step::INT AS step, rows_in, added, (total - done)::BIGINT AS remaining, CASE WHEN total > 0 THEN round(100.0::DOUBLE * done / total, 4) ELSE 0.0 END AS percent_complete FROM b, t""")
def stream_progress(spark, d):
    """How far a run had come after each of two batches of its ledger, as a listener saw it."""
    import time

    from lexiweave.streaming import progress
    from lexiweave.streaming.ledger import run_ledger

    s, own = Scratch(spark, "progress"), views.ledger(spark, d)
    rows = own.select("event_id", "custom_id", "cue", "trial", F.lit("").alias("raw_text"), F.lit("").alias("parsed"), F.lit(True).alias("ok"), F.lit("").alias("updated_at"))
    listener = progress.ProgressRows(spark, f"{s.root}/progress")
    spark.streams.addListener(listener)
    try:
        for half in (0, 1):
            rows.where(F.col("event_id") % 2 == half).drop("event_id").write.mode("append").json(f"{s.root}/in")
            run_ledger(spark, f"{s.root}/in", f"{s.root}/ledger", f"{s.root}/state", files_per_trigger=1_000_000)
        for _ in range(150):  # the listener hears of a batch a little later
            if progress.read_progress(spark, f"{s.root}/progress").count() >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    totals = ledger.run_progress(_index(spark, d), own.limit(0).select("custom_id", F.lit("").alias("state")))
    seen = progress.live_progress(progress.read_progress(spark, f"{s.root}/progress"), totals, 0.25, 2.0)
    return seen.select((F.col("batch") + 1).cast("int").alias("step"), "rows_in", "added", "remaining", "percent_complete")


@query(with_views("directed") + " SELECT * FROM directed")
def sink_roundtrip(spark, d):
    path = f"{Scratch(spark, 'files').root}/edges"
    files.write_edges(network.directed_edges(views.trials(spark, d)), path)
    return files.read_csv(spark, path, files.EDGES)


__all__ = ["QUERIES", "SQL"]
