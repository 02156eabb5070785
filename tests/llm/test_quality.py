import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lexiweave.llm.quality import Params, score, with_site


def test_held_out_accuracy_and_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    out = score(docs, labels.where(~test), Params(rounds=300)).join(labels.where(test).select("doc_id", "toxic", F.col("quality").alias("label")), "doc_id")
    clean = out.where("toxic = 0").select("kept", (F.col("label") == 1).alias("good"))
    right, n = clean.agg(F.avg((F.col("kept") == F.col("good")).cast("double")), F.count("*")).first()
    assert n > 500 and right > 0.97
    caught = out.where("toxic = 1").agg(F.avg((~F.col("kept")).cast("double"))).first()[0]
    assert caught > 0.6


def test_defined_results(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = score(docs.withColumn("host", F.lit(1)), labels, Params(rounds=5)).collect()
    assert len(out) == docs.count() and all(0 <= r.quality <= 1 and 0 < r.p_path < 1 for r in out)
    assert score(no_docs, labels, Params(rounds=5)).count() == 0


URLS = [None, "no url", "https://a.org", "https://A.org/x/1", "http://b.net/y?q=1", "https://b.net/z/2/3", "https://c.com/only"]
SITES = [(None, None), (None, None), ("a.org", ""), ("a.org", "x"), ("b.net", "y"), ("b.net", "z"), ("c.com", "only")]


def strength(groups, prior):
    """Prior sample size of groups ``(values, prior mean)`` by moments."""
    groups = [(g, prior(k)) for k, g in groups.items() if len(g) > 1]
    if not groups:
        return 50.0
    mean = lambda xs: sum(xs) / len(xs)
    within = [mean([x * x for x in g]) - mean(g) ** 2 for g, _ in groups]
    spread = mean([(mean(g) - m) ** 2 for g, m in groups])
    noise = mean([w / len(g) for w, (g, _) in zip(within, groups, strict=True)])
    return min(max(mean(within) / max(spread - noise, 1e-9), 1.0), 1e6)


def test_posteriors_against_plain_sums(spark):
    """Sites with URLs, one with two thirds of the rows, null ids and texts, clashing columns and a very long text."""
    rng = random.Random(6)
    which = [2 + i % 2 if i % 3 else rng.randrange(7) for i in range(150)] + [5, 6, 0, 1]
    texts = [" ".join(rng.choices(["good", "bad", "so", "WELL", "1999", "!!"], k=rng.randint(0, 30))) for _ in range(150)] + ["long text " * 100_000, None, "", "x"]
    rows = [(i if i < 153 else None, t, URLS[u]) for i, (t, u) in enumerate(zip(texts, which, strict=True))]
    labels = spark.createDataFrame([(i, int("good" in (t or "")), 0) for i, t, _ in rows[::3]], "doc_id long, quality int, toxic int")
    docs = with_site(spark.createDataFrame(rows, "doc_id long, text string, url string")).selectExpr("*", "1 as n", "2 as s", "3 as p_host", "4 as ss", "'k' as kept")
    assert [(r.host, r.path) for r in docs.collect()] == [SITES[u] for u in which]
    out = {r.doc_id: r for r in score(docs, labels, Params(rounds=40), "host", "path").collect()}
    assert len(out) == len(rows)
    site = {r[0]: SITES[u] for r, u in zip(rows, which, strict=True)}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, r in out.items():
        hosts[site[i][0]].append(r.p_doc)
        paths[site[i]].append(r.p_doc)
    mean = sum(r.p_doc for r in out.values()) / len(out)
    k_host = strength(hosts, lambda _: mean)
    p_host = {h: (sum(g) + k_host * mean) / (len(g) + k_host) for h, g in hosts.items()}
    k_path = strength(paths, lambda key: p_host[key[0]])
    logit = lambda x: math.log(x / (1 - x))
    for i, r in out.items():
        h, g = p_host[site[i][0]], paths[site[i]]
        p_path = (sum(g) - r.p_doc + k_path * h) / (len(g) - 1 + k_path) if len(g) > 1 else h
        quality = 1 / (1 + math.exp(-(logit(r.p_doc) + logit(p_path) - logit(mean))))
        assert abs(r.p_host - h) < 1e-9 and abs(r.p_path - p_path) < 1e-9 and abs(r.quality - quality) < 1e-9
        assert r.kept == (r.quality >= 0.5 and r.p_toxic < 0.5)
