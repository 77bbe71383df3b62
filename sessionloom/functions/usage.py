"""Usage vectors: six counts of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("input", "output", "cache_read", "cache_write", "reasoning", "total")
TYPE = "struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint,reasoning:bigint,total:bigint>"
# The names under which logs give each count, in the order they are tried.
ALIASES = {
    "input": ("input", "input_tokens", "inputTokens", "prompt_tokens", "promptTokens"),
    "output": ("output", "output_tokens", "outputTokens", "completion_tokens", "completionTokens"),
    "cache_read": (
        "cache_read", "cacheRead", "cached_input_tokens", "cachedInputTokens", "cache_read_input_tokens", "cacheReadInputTokens", "cache_read_tokens", "prefill_read_tokens", "prefillReadTokens",
        "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens", "input_tokens_details.cache_read_tokens", "prompt_tokens_details.cache_read_tokens",
    ),
    "cache_write": ("cache_write", "cacheWrite", "cache_creation_input_tokens", "cacheCreationInputTokens", "cache_write_input_tokens", "cacheWriteInputTokens", "cache_write_tokens", "prefill_write_tokens", "prefillWriteTokens"),
    "reasoning": (
        "reasoning", "reasoning_output_tokens", "reasoningOutputTokens", "reasoning_tokens", "reasoningTokens",
        "output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoningTokens", "completion_tokens_details.reasoningTokens",
    ),
    "total": ("total", "total_tokens", "totalTokens"),
}


def usage(**fields: Column) -> Column:
    """A vector of the given counts; missing, null and negative ones are 0, a total of 0 is input plus output."""
    at = {f: F.greatest(F.coalesce(fields[f].cast("bigint"), F.lit(0)), F.lit(0)) if f in fields else F.lit(0).cast("bigint") for f in FIELDS}
    at["total"] = F.when(at["total"] > 0, at["total"]).otherwise(at["input"] + at["output"])
    return F.struct(*[at[f].alias(f) for f in FIELDS])


def normalize_usage(v: Column) -> Column:
    """The vector of a variant: for each count the first positive number among its names."""
    numbers = {}
    for field, names in ALIASES.items():
        found = [F.try_variant_get(v, f"$.{name}", "double") for name in names]
        usable = [F.when((x > 0) & (x < float("inf")), x) for x in found]
        numbers[field] = F.floor(F.coalesce(*usable, F.lit(0.0))).cast("bigint")
    return usage(**numbers)


def delta(current: Column, previous: Column, fallback: Column) -> Column:
    """What was used since the previous running total: all of the current one after a reset (any count fell), the
    fallback if there is no current total."""
    before = {f: F.coalesce(previous[f], F.lit(0)) for f in FIELDS}
    reset = F.lit(False)
    for f in FIELDS:
        reset = reset | (current[f] < before[f])
    step = F.struct(*[F.when(reset, current[f]).otherwise(current[f] - before[f]).alias(f) for f in FIELDS])
    return F.when(current.isNull(), fallback).otherwise(step)


def sums(column: str) -> list[Column]:
    return [F.coalesce(F.sum(f"{column}.{f}"), F.lit(0)).cast("bigint").alias(f) for f in FIELDS]
