"""Rewards of generated next parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinery.functions.chat import END
from joinery.functions.keys import strip
from joinery.operators import designs as D
from joinery.operators import solids as S


def completion_rewards(rows: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, reward, reason) of (key, prefix, completion, target): what a generated next line is worth after a design's first lines.

    In this order: a prefix that is not empty and can't be read gives 0; where the target is the end, ending gives 1 and not
    ending 0; a last line that is no part gives 0; without a prefix a part gives 0.5; else the geometry of the part decides.
    Null texts count as empty.
    """
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    line = F.element_at(F.split(text(F.col("completion")), "\n"), -1)
    t = rows.select(key, text(F.col("prefix")).alias("p"), line.alias("line"), F.coalesce(F.col("completion").contains(END), F.lit(False)).alias("ended"), (F.coalesce("target", F.lit("")) == END).alias("last"))
    result = lambda value, reason: F.struct(value.cast("double").alias("reward"), F.lit(reason).alias("reason"))
    # The names of the reasons
    early = (
        F.when((F.col("p") != "") & ~D.readable(F.col("p")), result(F.lit(0), "error_parsing_prompt"))
        .when(F.col("last"), result(F.col("ended").cast("int"), "termination"))
        .when(~D.readable(F.col("line")), result(F.lit(0), "invalid_syntax"))
        .when(F.col("p") == "", result(F.lit(0.5), "first_part"))
    )
    t = t.select(key, early.alias("early"), D.parts_of(F.when(early.isNull(), F.concat_ws("\n", "p", "line"))).alias("parts"))
    return S.rewards(t, key).select(key, "reward", "reason")


def summary(rewarded: DataFrame) -> DataFrame:
    """(mean, std, reasons) of a batch: population standard deviation, and how often each reason occurs."""
    by = rewarded.groupBy("reason").agg(F.count("*").alias("n"), F.sum("reward").alias("s"), F.sum(F.col("reward") * F.col("reward")).alias("q"))
    mean = F.sum("s") / F.sum("n")
    return by.agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - mean * mean)).alias("std"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
