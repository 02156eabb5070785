"""File sources and sinks with fixed schemas; nothing is inferred."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.text import strip
from lexiweave.sources import commits

RAW = "cue string, trial string, raw_text string, parsed string, ok string"
TRIALS = "cue string, R1 string, R2 string, R3 string"
EDGES = "src string, tgt string, wt bigint"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Processed trials; missing cells are blank, words like ``null`` stay words."""
    return read_csv(spark, path, TRIALS).na.fill("")


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, non-blank cues, repeats kept."""
    return read_csv(spark, path, "cue string").select(strip(F.col("cue")).alias("cue")).where("cue <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank, malformed and non-object lines are skipped, absent fields are null."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith("{"))
    parsed = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return lines.select(parsed.alias("r")).where("r is not null and r.__bad is null").select("r.*").drop("__bad")


def json_object(text: Column, schema: str, default: Column) -> Column:
    """The object that a text holds, or the default if it is missing, malformed or no object."""
    parsed = F.from_json(text, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return F.when(F.ltrim(text).startswith("{") & parsed["__bad"].isNull(), parsed.dropFields("__bad")).otherwise(default)


def json_strings(text: Column) -> Column:
    """The strings of a JSON list; none if the text is missing, malformed or no list."""
    return F.filter(F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>")), lambda x: x.isNotNull())


def discover_runs(spark: SparkSession, root: str, manifest: str = "manifest.json") -> DataFrame:
    """``run, modified``: folders under ``root`` that hold a manifest, the newest first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", manifest).load(root)
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("run"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), F.desc("run"))


def create_or_load(row: DataFrame, path: str) -> DataFrame:
    """A one-row table as a JSON file; one that is there already wins over ``row``, also one that comes first only just."""
    spark = row.sparkSession
    if not commits.exists(spark, path):
        with contextlib.suppress(commits.Conflict):
            commits.put_text(spark, _one_line(row), path, replace=False)
    return spark.read.schema(row.schema).json(path)


def rewrite(row: DataFrame, path: str) -> DataFrame:
    """Replace a one-row JSON file in one step, with a fresh ``updated_at`` if it has one; ``row`` may have been read from it."""
    fresh = row.withColumn("updated_at", utc_now()) if "updated_at" in row.columns else row
    commits.put_text(row.sparkSession, _one_line(fresh), path)
    return row.sparkSession.read.schema(fresh.schema).json(path)


def _one_line(row: DataFrame) -> str:
    first = row.select(F.to_json(F.struct(*row.columns)).alias("line")).first()
    return f"{first['line']}\n" if first else ""


def read_or_default(spark: SparkSession, path: str, schema: str, default: DataFrame) -> DataFrame:
    """The object of a JSON file as one row; ``default`` if the file is missing, malformed or no object."""
    if not commits.exists(spark, path):
        return default
    text = spark.read.text(path, wholetext=True).limit(1)
    found = text.select(json_object(F.col("value"), schema, F.lit(None)).alias("r")).where("r is not null").select("r.*")
    return default if found.isEmpty() else found


def utc_now() -> Column:
    """The time as ISO text in UTC."""
    return iso_utc(F.current_timestamp())


def iso_utc(at: Column) -> Column:
    """A time stamp as ISO text; sessions run in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def run_id(at: Column) -> Column:
    """The name of a run by the time of its start."""
    return F.date_format(at, "yyyyMMdd-HHmmss")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vec`` of a word2vec text file; its header line is skipped."""
    parts = F.split(F.rtrim("value"), " ")
    return spark.read.text(path).where(F.size(parts) > 2).select(
        F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("float")).alias("vec")
    )


def read_strengths(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table without quoting."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("quote", "").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_trials(df: DataFrame, path: str) -> None:
    write_csv(df.orderBy("cue", "R1", "R2", "R3"), path)


def write_edges(df: DataFrame, path: str) -> None:
    """Edges without a weight are left out."""
    write_csv(df.where("wt is not null").select("src", "tgt", F.col("wt").cast("long").alias("wt")), path)


def write_metrics(df: DataFrame, path: str) -> None:
    """``metric, value`` rows in their order."""
    write_csv(df.select("metric", "value").coalesce(1), path)


def write_outliers(df: DataFrame, path: str) -> None:
    write_csv(df.select("src", "tgt", "wt", "distance").orderBy("src", "tgt"), path)
