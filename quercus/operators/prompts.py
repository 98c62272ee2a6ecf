"""Generation columns: prompts, token counts and the empty result columns beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quercus.functions.text import count_tokens

REQUIRED = ["context", "description"]


def prepare_prompts(df: DataFrame, prompt: Column, mode: str = "auto", query: str = "query", prefix: str = "basic_") -> DataFrame:
    """Adds ``{prefix}prompt``, ``{prefix}num_tokens`` and the columns a generation run fills.

    ``yes`` always builds prompts, ``auto`` only what is missing, ``no`` expects them to be there.
    """
    missing = [c for c in [query, *REQUIRED] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    mode = mode.lower()
    for name, make in (("prompt", lambda: prompt), ("num_tokens", lambda: count_tokens(F.col(f"{prefix}prompt")))):
        column = f"{prefix}{name}"
        if mode == "yes" or (mode == "auto" and column not in df.columns):
            df = df.withColumn(column, make())
        elif column not in df.columns:
            raise ValueError(f"missing columns: {column}")
    kinds = {"result": "array<string>", "full_answer": "string", "is_skipped": "boolean", "is_prompt_too_long": "boolean"}
    return df.withColumns({f"{prefix}{c}": F.lit(None).cast(t) for c, t in kinds.items()})


def generation_result(df: DataFrame, sentences: Column, answer: Column, acceptable: Column, context_length: int, prefix: str = "basic_") -> DataFrame:
    """Fills the generation columns from an answer: too long, unacceptable, or kept."""
    too_long = F.col(f"{prefix}num_tokens") > context_length
    kept = ~too_long & acceptable
    return df.withColumns(
        {
            f"{prefix}result": F.when(kept, sentences),
            f"{prefix}full_answer": F.when(kept, answer),
            f"{prefix}is_skipped": ~kept,
            f"{prefix}is_prompt_too_long": too_long,
        }
    )
