"""Ratings by an injected judge, and designs by an injected generator; the engine holds no model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions.chat import END
from joinery.functions.scalars import fenced

METRICS = ("assemblability", "prompt_satisfaction", "design_quality")
# Limits of the generation loop.
MOST_PARTS = 40


def parse_reply(reply: Column) -> Column:
    """struct of the three ratings in a reply, fenced or bare JSON; null unless all three are 1, 2 or 3."""
    got = F.from_json(fenced(reply), ", ".join(f"{m} string" for m in METRICS))
    ok = F.lit(True)
    for m in METRICS:
        ok = ok & F.coalesce(got[m].isin("1", "2", "3", "1.0", "2.0", "3.0"), F.lit(False))
    return F.when(ok, F.struct(*[got[m].cast("double").cast("int").alias(m) for m in METRICS]))


def judge(designs: DataFrame, reply: Callable[[pd.Series], pd.Series], on: list[str], done: DataFrame | None = None) -> DataFrame:
    """(on, the metrics): ratings of the designs that `done` doesn't have yet; replies that can't be read give no row.

    reply gets a batch of prompts and returns as many texts; it is called once per Arrow batch on the executors.
    """
    todo = designs.join(done.select(*on), on, "left_anti") if done is not None else designs
    schema = ", ".join(f"`{c}` {t}" for c, t in todo.select(*on).dtypes) + ", reply string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[on].assign(reply=list(reply(pdf["prompt"])))

    out = todo.select(*on, "prompt").mapInPandas(run, schema).withColumn("r", parse_reply(F.col("reply")))
    return out.filter("r is not null").select(*on, "r.*")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The old rows with those of the same key replaced by the new ones."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new, allowMissingColumns=True)


def generate(prompts: DataFrame, next_part: Callable[[str, str], str | None], on: list[str], tries: int = MOST_PARTS) -> DataFrame:
    """(on, design, parts, ended, generation_time): designs written part by part by an injected generator.

    next_part(prompt, text so far) gives a line, or the end mark anywhere in it. Each call is a try; a line that is
    no part is dropped and asked for again. A design ends at the end mark or after `tries` tries.
    """
    from joinery.functions.designs import PIECE

    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.select(*on).dtypes) + ", design string, parts int, ended boolean, generation_time double"

    def one(prompt: str) -> tuple[str, int, bool, float]:
        import re

        began, lines, ended = time.monotonic(), [], False
        for _ in range(tries):
            got = next_part(prompt, "".join(x + "\n" for x in lines))
            if got is not None and END in got:
                ended = True
                break
            flat = " ".join((got or "").split())
            if re.fullmatch(PIECE, flat) and all(x.isdecimal() for x in flat.split()):
                lines.append(flat)
        return "\n".join(lines), len(lines), ended, time.monotonic() - began

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pd.DataFrame([one(p) for p in pdf["prompt"]], columns=["design", "parts", "ended", "generation_time"])
            yield pd.concat([pdf[on].reset_index(drop=True), made], axis=1)

    return prompts.select(*on, "prompt").mapInPandas(run, schema)
