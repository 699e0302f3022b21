"""Prompts: the cleaned text, who wrote it, and what it asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text

TEXT_CHARS, PREVIEW_CHARS = 6000, 300


def derived(rows: DataFrame) -> DataFrame:
    """Adds text, slash_name, is_slash, is_human, chars, words, preview and intents to raw prompts.

    ``rows`` has raw_text, source, origin_kind, is_meta, transcript and, where
    it is known, entrypoint and is_sidechain.
    """
    optional = lambda name, other: F.col(name) if name in rows.columns else other
    nested = (F.coalesce(F.col("transcript"), F.lit("main")) != "main") | (F.coalesce(optional("is_sidechain", F.lit(0)), F.lit(0)) == 1)
    # One element exploded is worked out once; plain columns would be worked out anew by each of the many patterns over them.
    out = rows.select("*", F.explode(F.array(text.clean_prompt(F.col("raw_text")))).alias("__clean"))
    clean = F.col("__clean.text")
    human = (clean != "") & ~nested & text.is_human(F.col("source"), F.col("origin_kind"), clean, F.coalesce(F.col("is_meta"), F.lit(0)) == 1, optional("entrypoint", F.lit("cli")))
    stored = F.when(clean != "", clean).otherwise(F.col("raw_text"))
    by_default = F.when(clean == "", "harness").when(nested, "subagent")
    out = out.select("*", F.explode(F.array(human.cast("int"))).alias("is_human")).withColumns(
        {
            "text": F.when(clean != "", F.left(clean, F.lit(TEXT_CHARS))), "slash_name": F.col("__clean.slash"), "is_slash": F.col("__clean.slash").isNotNull().cast("int"),
            "source": F.coalesce(F.nullif(F.col("source"), F.lit("")), by_default), "chars": F.length(stored), "words": text.word_count(stored), "preview": F.left(stored, F.lit(PREVIEW_CHARS)),
            "intents": F.when(F.col("is_human") == 1, text.intents(clean)).otherwise(F.array().cast("array<string>")),
            "tickets": F.when(F.col("is_human") == 1, text.tickets(F.left(clean, F.lit(4000)))).otherwise(F.array().cast("array<string>")),
        }
    )
    return out.drop("__clean", "raw_text")
