"""Request payloads of two providers as JSON columns; sending them is not part of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiweave.functions.text import prompt

# The instructions that every request begins with.
SYSTEM_PROMPT = """Task:
 - You will be provided with an input word: write the first 3 words you associate to it separated by a comma.
 - No additional output text is allowed.

Constraints:
 - no carriage return characters are allowed in the answers.
 - answers should be as short as possible.

Example:
Input: sea
Output: water,beach,sun
"""


@dataclass(frozen=True)
class Settings:
    """``effort`` is for provider B, and left out if None."""

    model: str
    max_tokens: int
    temperature: float = 1.0
    system: str = SYSTEM_PROMPT
    effort: str | None = None


def _blocks(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


def params_a(cue: Column, s: Settings) -> Column:
    """What provider A gets for a cue; texts are lists of blocks, the instructions stand apart."""
    return F.struct(
        F.lit(s.model).alias("model"), F.lit(s.max_tokens).alias("max_tokens"), F.lit(s.temperature).alias("temperature"),
        _blocks(F.lit(s.system)).alias("system"), F.array(F.struct(F.lit("user").alias("role"), _blocks(prompt(cue)).alias("content"))).alias("messages"),
    )


def params_b(cue: Column, s: Settings) -> Column:
    """What provider B gets for a cue; texts are plain, the instructions are the first message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    fields = [
        F.lit(s.model).alias("model"), F.lit(s.max_tokens).alias("max_completion_tokens"), F.lit(s.temperature).alias("temperature"),
        F.array(message("system", F.lit(s.system)), message("user", prompt(cue))).alias("messages"),
    ]
    return F.struct(*fields, *([F.lit(s.effort).alias("reasoning_effort")] if s.effort else []))


def batch_line_a(custom_id: Column, cue: Column, s: Settings) -> Column:
    """An item of provider A's batches."""
    return F.to_json(F.struct(custom_id.alias("custom_id"), params_a(cue, s).alias("params")))


def batch_line_b(custom_id: Column, cue: Column, s: Settings) -> Column:
    """A line of provider B's batch files."""
    # How provider B names the call.
    call = [F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url")]
    return F.to_json(F.struct(custom_id.alias("custom_id"), *call, params_b(cue, s).alias("body")))
