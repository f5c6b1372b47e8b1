"""Training examples: captions to conversations, conversations to prefix and next part."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinery.functions import chat
from joinery.functions.keys import strip
from joinery.operators.references import listed_captions
from joinery.operators.tables import at_most

# The categories that are kept.
KEEP = ("Bed", "Chair", "Table", "StorageFurniture")
MOST_PARTS = 100
MOST_EXAMPLES = 1_000_001


def caption_rows(captions: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, row_id, place, caption): one row per caption that is not blank, without outer white space and quotes."""
    rows = captions.select(key, "row_id", F.posexplode(listed_captions(F.col("captions"))).alias("place", "caption"))
    tidy = strip(F.regexp_replace(strip(F.col("caption")), "^'+|'+$", ""))
    return rows.withColumn("caption", tidy).filter("caption <> ''")


def conversations(captioned: DataFrame, text: str = "design") -> DataFrame:
    """Adds `messages` to rows with a caption and a design text."""
    return captioned.withColumn("messages", chat.conversation(F.col("caption"), F.col(text)))


def keep_models(catalogue: DataFrame, most_parts: int = MOST_PARTS, categories: tuple[str, ...] = KEEP) -> DataFrame:
    """Models of the kept categories with not too many parts; a missing category or part count rejects the model."""
    return catalogue.filter(F.col("model_cat").isin(*categories) & (F.col("part_count") <= most_parts))


def prefixes(examples: DataFrame, keep: list[str], mode: str = "one", seed: int = 42) -> DataFrame:
    """(keep, cut, prompt, prefix, next_line): the assistant's text cut before a line, and that line or the end mark.

    mode "one" takes one cut per example, at random by a seeded hash; "all" takes every cut. The prompt is all other
    messages; a non-empty prefix follows as an assistant message.
    """
    rows = examples.select(*keep, chat.not_of_role(F.col("messages"), "assistant").alias("_others"), chat.lines(chat.said(F.col("messages"))).alias("_lines"))
    n = F.size("_lines")
    cut = F.explode(F.sequence(F.lit(0), n)) if mode == "all" else F.pmod(F.xxhash64(F.lit(seed), *keep), n + 1).cast("int")
    rows = rows.select("*", cut.alias("cut"))
    rows = rows.withColumn("prefix", chat.prefix(F.col("_lines"), F.col("cut"))).withColumn("next_line", chat.next_line(F.col("_lines"), F.col("cut")))
    with_prefix = F.concat("_others", F.when(F.col("prefix") != "", F.array(chat.message("assistant", F.col("prefix")))).otherwise(F.slice("_others", 1, 0)))
    return rows.select(*keep, "cut", with_prefix.alias("prompt"), "prefix", "next_line")


def expand_splits(splits: dict[str, DataFrame | None], keep: list[str], mode: str = "one", seed: int = 42, names: tuple[str, ...] = ("train", "test")) -> dict[str, DataFrame]:
    """The prefixes of each named split, MOST_EXAMPLES rows of it at most; a split that is missing is warned of and left out."""
    out = {}
    for name in names:
        rows = splits.get(name)
        if rows is None:
            warnings.warn(f"no split {name}", stacklevel=2)
            continue
        out[name] = at_most(prefixes(rows, keep, mode, seed), MOST_EXAMPLES)
    return out
