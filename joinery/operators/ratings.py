"""Ratings of designs: cleaning, joining with prompt metadata, and grouped, pivoted and distribution reports.

Null group keys are left out, as reports by model or reviewer have no row for them. Standard deviations are of the
sample, null for one row. Every report is one aggregation over the cleaned rows; reports by several keys share one
pass as grouping sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions.keys import letters
from joinery.functions.scalars import round_even, whole

METRICS = ("prompt_satisfaction", "assemblability", "design_quality")
# Models in display order with their display names.
MODELS = (("sft", "SFT"), ("grpo", "GRPO"), ("web-auto", "Designer-QA"), ("web-single", "Designer"))


def clean(ratings: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows of which every metric is a number, with the metrics as doubles; unreadable ones count as missing."""
    filled = ratings.na.drop(subset=list(metrics)).filter(reduce(Column.__and__, [F.col(m) != "" for m in metrics]))
    return filled.withColumns({m: F.col(m).try_cast("double") for m in metrics}).na.drop(subset=list(metrics))


def fully_rated(ratings: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows with a truthy value in every metric: not null, empty or 0."""
    return ratings.filter(reduce(Column.__and__, [F.coalesce(~F.trim(m).isin("", "0"), F.lit(False)) for m in metrics]))


def means(rows: DataFrame, *keys: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """The mean of each metric per group."""
    return rows.na.drop(subset=list(keys)).groupBy(*keys).agg(*[round_even(F.avg(m), 3).alias(m) for m in metrics])


def spread(rows: DataFrame, key: str, metrics: tuple[str, ...] = METRICS, stats: tuple[str, ...] = ("mean", "std", "count")) -> DataFrame:
    """Several statistics of each metric per group, as metric_stat."""
    one = {
        "mean": lambda m: round_even(F.avg(m), 3),
        "std": lambda m: round_even(F.stddev_samp(m), 3),
        "min": F.min,
        "max": F.max,
        "count": F.count,
    }
    return rows.na.drop(subset=[key]).groupBy(key).agg(*[one[s](m).alias(f"{m}_{s}") for m in metrics for s in stats])


def overall(metrics: tuple[str, ...] = METRICS) -> Column:
    """The row's mean over the metrics."""
    return sum((F.col(m) for m in metrics), F.lit(0.0)) / len(metrics)


def prompt_metadata(experiments: DataFrame) -> DataFrame:
    """(prompt_id, distribution, difficulty_level): one row per prompt; blank, unknown and out-of-range values are null."""
    d = letters(F.col("distribution"))
    known = F.when(d.isin("indistribution", "outofdistribution"), d)
    level = F.when(F.col("difficulty_level").between(1, 3), F.col("difficulty_level"))
    return experiments.filter("prompt_id is not null").groupBy("prompt_id").agg(F.max(known).alias("distribution"), F.max(level).alias("difficulty_level"))


def with_metadata(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """Left join by the prompt that the experiment id names; ids that are no whole number match nothing."""
    return rows.withColumn("prompt_id", whole(F.col("experiment_id"))).join(prompt_metadata(experiments).withColumn("prompt_id", F.col("prompt_id").cast("bigint")), "prompt_id", "left")


def mean_sets(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means by model, distribution and level in the five usual groupings, in one pass; `grouping` names the keys used."""
    keys = ["model_type", "distribution", "difficulty_level"]
    sets = [["model_type", "distribution"], ["distribution"], ["model_type", "difficulty_level"], ["difficulty_level"], keys]
    grouped = rows.na.drop(subset=keys).groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    used = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]).alias("grouping")
    return grouped.agg(used, *[round_even(F.avg(m), 3).alias(m) for m in metrics])


def pivot_means(rows: DataFrame, key: str, by: str, values: list, value: Column) -> DataFrame:
    """Mean of a value by key and the given values of a second column, one column each."""
    out = rows.na.drop(subset=[key, by]).groupBy(key).agg(*[round_even(F.avg(F.when(F.col(by) == v, value)), 3).alias(f"{by}_{v}") for v in values])
    return out


def ordered(stats: DataFrame, models: tuple[tuple[str, str], ...] = MODELS, fill: dict | None = None, by: tuple[str, list] | None = None) -> DataFrame:
    """The known models in display order, with their display names; models without a row get nulls or the fill values. With `by`, a column and its values, once per value."""
    rows, keys = [(m, d, i) for i, (m, d) in enumerate(models)], ["model_type"]
    schema = "model_type string, display string, ord int"
    if by:
        name, values = by
        rows, keys = [(*r, v) for v in values for r in rows], ["model_type", name]
        schema += f", {name} {dict(stats.dtypes)[name]}"
    dim = stats.sparkSession.createDataFrame(rows, schema)
    out = F.broadcast(dim).join(stats, keys, "left")  # a handful of fixed rows
    return out.na.fill(fill) if fill else out


def pivot_reviewers(rows: DataFrame, models: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, reviewer, a column per model): mean ratings by reviewer and model, one table per metric; no rows unless there are several reviewers."""
    known = rows.na.drop(subset=["reviewer", "model_type"])
    long = known.select("reviewer", "model_type", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    out = long.groupBy("metric", "reviewer").agg(*[round_even(F.avg(F.when(F.col("model_type") == v, F.col("value"))), 3).alias(f"model_type_{v}") for v in models])
    return out.filter(known.agg(F.count_distinct("reviewer")).scalar() > 1)


def box_stats(rows: DataFrame, key: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(key, metric, n, q1, median, q3, low, high, outliers): quartiles, whiskers at the last value within 1.5 quartile ranges, and how many lie outside.

    The values are counted first, so that a group of any size is as many rows as it has distinct values.
    """
    long = rows.na.drop(subset=[key]).select(key, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    counted = long.groupBy(key, "metric", "value").agg(F.count("*").alias("w"))
    q = counted.groupBy(key, "metric").agg(F.sum("w").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("w")).alias("q"))
    fenced = counted.join(q, [key, "metric"]).withColumn("inside", F.col("value").between(F.expr("q[0] - 1.5 * (q[2] - q[0])"), F.expr("q[2] + 1.5 * (q[2] - q[0])")))
    return fenced.groupBy(key, "metric").agg(
        F.first("n").alias("n"),
        F.first(F.expr("q[0]")).alias("q1"),
        F.first(F.expr("q[1]")).alias("median"),
        F.first(F.expr("q[2]")).alias("q3"),
        F.min(F.when(F.col("inside"), F.col("value"))).alias("low"),
        F.max(F.when(F.col("inside"), F.col("value"))).alias("high"),
        F.coalesce(F.sum(F.when(~F.col("inside"), F.col("w"))), F.lit(0)).alias("outliers"),
    )


def latest(ratings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an explicit order; ties go to the greater remaining columns."""
    rest = [c for c in ratings.columns if c not in keys and c not in order]
    top = ratings.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in order + rest]).select(*ratings.columns)


def first_unrated(designs: DataFrame, rated: DataFrame, on: list[str], index: str) -> DataFrame:
    """(index): the first design that has no full rating; 0 if all have one."""
    return designs.join(rated.select(*on).distinct(), on, "left_anti").agg(F.coalesce(F.min(index), F.lit(0)).alias(index))


def rating_sheet(designs: DataFrame, rated: DataFrame, on: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """All designs with their ratings, blank where there is none."""
    return designs.join(rated.select(*on, *metrics), on, "left").na.fill("", list(metrics))


