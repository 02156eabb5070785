"""Result envelopes of two providers, as one table of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE_A = (
    "custom_id:string,result:struct<type:string,message:struct<content:array<struct<type:string,text:string>>,"
    "usage:struct<input_tokens:bigint,output_tokens:bigint>>,error:struct<message:string>>"
)
ENVELOPE_B = (
    "custom_id:string,response:struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>,"
    "usage:struct<prompt_tokens:bigint,completion_tokens:bigint>,error:struct<message:string>>>,error:string"
)


def objects(payload: Column, fields: str) -> Column:
    """Objects of a payload that is one object, an array of them, one wrapped as ``results``, or one object a line; malformed ones: none."""
    many, no_id = f"array<struct<{fields}>>", lambda x: x["custom_id"].isNotNull()
    one = F.from_json(payload, f"struct<{fields}>")
    listed = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, many))
    wrapped = F.from_json(payload, f"struct<results:{many}>")["results"]
    lines = F.filter(F.transform(F.split(payload, "[\r\n]+"), lambda x: F.from_json(x, f"struct<{fields}>")), no_id)
    single = F.when(one["custom_id"].isNotNull(), F.array(one))
    return F.filter(F.coalesce(wrapped, listed, F.when(F.size(lines) > 0, lines), single, F.array().cast(many)), no_id)


def joined_files(*files: DataFrame) -> DataFrame:
    """Lines of an output file and an error file as one table."""
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out


def from_a(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``custom_id, ok, text, input_tokens, output_tokens`` of provider A's results.

    A result that did not succeed has its error message as text, else its type,
    else ``unknown_batch_result``, and no tokens.
    """
    e = rows.select(F.explode(objects(F.col(payload), ENVELOPE_A)).alias("e")).select("e.*")
    good = F.coalesce(F.col("result.type") == "succeeded", F.lit(False))
    parts = F.filter("result.message.content", lambda b: b["type"] == "text")
    text = F.regexp_replace(F.coalesce(F.array_join(F.transform(parts, lambda b: F.coalesce(b["text"], F.lit(""))), ""), F.lit("")), r"^\s+|\s+$", "")
    bad = F.coalesce(F.nullif(F.col("result.error.message"), F.lit("")), F.nullif(F.col("result.type"), F.lit("")), F.lit("unknown_batch_result"))
    return e.where("custom_id <> ''").select(
        "custom_id", good.alias("ok"), F.when(good, text).otherwise(bad).alias("text"),
        F.when(good, F.col("result.message.usage.input_tokens")).alias("input_tokens"), F.when(good, F.col("result.message.usage.output_tokens")).alias("output_tokens"),
    )


def from_b(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """The same table of provider B's results; an error may be an object or plain text."""
    e = rows.select(F.explode(objects(F.col(payload), ENVELOPE_B)).alias("e")).select("e.*")
    code = F.col("response.status_code")
    own = F.nullif(F.col("error"), F.lit(""))
    good = F.coalesce(code == 200, F.lit(False)) & own.isNull()
    text = F.regexp_replace(F.coalesce(F.get("response.body.choices", F.lit(0))["message"]["content"], F.lit("")), r"^\s+|\s+$", "")
    bad = F.coalesce(
        F.nullif(F.get_json_object("error", "$.message"), F.lit("")), own, F.nullif(F.col("response.body.error.message"), F.lit("")), F.concat(F.lit("HTTP "), code.cast("string")),
    )
    return e.where("custom_id <> ''").select(
        "custom_id", good.alias("ok"), F.when(good, text).otherwise(bad).alias("text"),
        F.when(good, F.col("response.body.usage.prompt_tokens")).alias("input_tokens"), F.when(good, F.col("response.body.usage.completion_tokens")).alias("output_tokens"),
    )


def batch_status(status: Column) -> Column:
    """Provider B's final states under one name."""
    return F.when(status.isin("completed", "failed", "expired", "cancelled"), "ended").otherwise(status)
