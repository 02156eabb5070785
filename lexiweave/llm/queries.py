"""The numbered queries, their SQL, and the tables they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), n_shards=16)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexiweave.llm.token_store import read_store, write_store
    from lexiweave.runtime import Scratch

    path = f"{Scratch(spark, 'tokens').root}/store"
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path)


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.lm_scoring import score

    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("per_word", 6).alias("per_word"))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.pii import Params, pseudonymise_documents

    # The secret comes from the session; the test tables hold no real person's data and can do with a public one.
    key = spark.conf.get("spark.lexiweave.pseudonym.key", "key of the test tables")
    return pseudonymise_documents(table(spark, sf_dir, "documents"), Params(key.encode())).drop("spans")


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.decontamination import scan

    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.resampling import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiweave.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_balanced_sharding, op2_minhash_near_dedup, op3_token_store, op4_syncmer_fingerprints, op5_language_id, op6_stupid_backoff,
        op7_feistel_pseudonyms, op8_source_mix, op9_quality_bayes, op10_decontaminate, op11_multiprobe_neighbours, op12_importance_resampling, op13_merkle_manifest,
    )
}
#: CRC-32 in SQL: its table of 256 numbers, and the checksum of the text of a column.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"


def _crc(text: str) -> str:
    """Of a text column, beside the table ``crc``."""
    return (
        f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT), "
        "lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


def _leaf(text: str) -> str:
    """The leaf of a row of documents, with ``text`` as its text."""
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR)) || ':' || {v} END"
    return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_minhash_near_dedup": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
    r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
    c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, c.root = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id""",
    "op6_stupid_backoff": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    o AS (SELECT doc_id, n_words, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q FROM (SELECT doc_id, w, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i FROM d)),
    m1 AS (SELECT doc_id, x, count(*) AS n FROM o GROUP BY ALL), m2 AS (SELECT doc_id, p, x, count(*) AS n FROM o WHERE p IS NOT NULL GROUP BY ALL), m3 AS (SELECT doc_id, q, p, x, count(*) AS n FROM o WHERE q IS NOT NULL GROUP BY ALL),
    c1 AS (SELECT x, sum(n) AS n FROM m1 GROUP BY ALL), c2 AS (SELECT p, x, sum(n) AS n FROM m2 GROUP BY ALL), c3 AS (SELECT q, p, x, sum(n) AS n FROM m3 GROUP BY ALL),
    e1 AS (SELECT doc_id, x, c1.n - m1.n AS n FROM m1 JOIN c1 USING (x)), e2 AS (SELECT doc_id, p, x, c2.n - m2.n AS n FROM m2 JOIN c2 USING (p, x)), e3 AS (SELECT doc_id, q, p, x, c3.n - m3.n AS n FROM m3 JOIN c3 USING (q, p, x)),
    s AS (SELECT o.doc_id, ln(CASE WHEN e3.n > 0 THEN e3.n / b2.n WHEN e2.n > 0 THEN (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1 END) * e2.n / b1.n
            ELSE 0.4::DOUBLE ** least(i - 1, 2) * greatest(e1.n, 1) / greatest((SELECT sum(n) FROM c1) - n_words, 1) END) AS l
        FROM o JOIN e1 ON e1.doc_id = o.doc_id AND e1.x = o.x LEFT JOIN e2 ON e2.doc_id = o.doc_id AND e2.p = o.p AND e2.x = o.x LEFT JOIN e3 ON e3.doc_id = o.doc_id AND e3.q = o.q AND e3.p = o.p AND e3.x = o.x
        LEFT JOIN e1 b1 ON b1.doc_id = o.doc_id AND b1.x = o.p LEFT JOIN e2 b2 ON b2.doc_id = o.doc_id AND b2.p = o.q AND b2.x = o.p)
    SELECT doc_id, n_words, log_score, per_word FROM (SELECT doc_id, count(l) AS n_words, round(coalesce(sum(l), 0.0), 3) AS log_score, round(sum(l) / count(l), 6) AS per_word FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id)""",
    "op10_decontaminate": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    m AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id::VARCHAR AS item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM m WHERE len(w) > 0)),
    sz AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sz)),
    h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
    t AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op12_importance_resampling": rf"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    m AS (SELECT regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark), f AS (SELECT r, unnest(w) AS x FROM d), g AS (SELECT unnest(w) AS x FROM m),
    b AS (SELECT x, {_crc('x')} % 10000 AS b FROM (SELECT x FROM f UNION SELECT x FROM g), crc),
    s AS (SELECT b, count(*) AS s FROM f JOIN b USING (x) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN b USING (x) GROUP BY b),
    gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
    e AS (SELECT r, sum(gain) AS weight FROM f JOIN b USING (x) JOIN gain USING (b) GROUP BY r),
    o AS (SELECT r, doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight, ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h FROM d LEFT JOIN e USING (r)),
    z AS (SELECT r, doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
    k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () * 10 // 100 AS drawn FROM z WHERE n >= 20)
    SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM z LEFT JOIN k USING (r)""",
    "op13_merkle_manifest": f"""WITH RECURSIVE {_CRC_TABLE}, d AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other, coalesce({_crc('doc_id::VARCHAR')} % 3 = 0, false) AS hit FROM documents, crc),
    x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
    up(level, lang, pos, n, h) AS (SELECT 0, lang, pos, n, leaf FROM x UNION ALL SELECT level + 1, lang, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, lang, pos // 8),
    s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
    top(level, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s UNION ALL SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8),
    both_ AS (SELECT 0 AS tree, * FROM up UNION ALL SELECT 1, level, NULL, pos, n, h FROM top),
    run AS (SELECT tree, level, lang, pos // 8 AS run, list(h ORDER BY pos) AS h FROM both_ WHERE n > 1 GROUP BY ALL),
    own(tree, level, lang, pos, n, doc_id, leaf, place, node, proof) AS (SELECT 0, 0, lang, pos, n, doc_id, leaf, pos, CASE WHEN hit THEN other ELSE leaf END, '' FROM x
        UNION ALL SELECT CASE WHEN o.n > 1 THEN o.tree ELSE 1 END, CASE WHEN o.n > 1 THEN o.level + 1 ELSE 0 END, o.lang, CASE WHEN o.n > 1 THEN o.pos // 8 ELSE s.pos END, CASE WHEN o.n > 1 THEN (o.n + 7) // 8 ELSE s.n END, o.doc_id, o.leaf, o.place,
            CASE WHEN o.n > 1 THEN sha256(array_to_string(r.h[1:o.pos % 8], '') || o.node || array_to_string(r.h[o.pos % 8 + 2:], '')) ELSE o.node END,
            CASE WHEN o.n > 1 THEN o.proof || array_to_string(r.h[1:o.pos % 8], '') || array_to_string(r.h[o.pos % 8 + 2:], '') ELSE o.proof END
        FROM own o LEFT JOIN run r ON o.n > 1 AND r.tree = o.tree AND r.level = o.level AND r.run = o.pos // 8 AND (o.tree = 1 OR r.lang IS NOT DISTINCT FROM o.lang) LEFT JOIN s ON s.lang IS NOT DISTINCT FROM o.lang WHERE o.n > 1 OR o.tree = 0)
    SELECT o.doc_id, o.leaf, s.subroot, top.h AS root, sha256(o.proof) AS proof_sha256, o.node AS folded_root, o.node = top.h AS verified FROM own o JOIN s ON s.lang IS NOT DISTINCT FROM o.lang, top WHERE o.tree = 1 AND o.n = 1 AND top.n = 1""",
}
