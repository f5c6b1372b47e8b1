"""Rating reports over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.functions.scalars import reviewer_of, round_even, title
from joinery.operators import ratings as R
from joinery.session import table

SHOWN = (("sft", "SFT"), ("grpo", "GRPO"), ("base", "Base"), ("library", "Library"), ("web-auto", "Designer-QA"))
DIST = ["indistribution", "outofdistribution"]
LEVELS = [1, 2, 3]


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return R.clean(table(spark, d, "ratings"))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return R.with_metadata(_clean(spark, d), table(spark, d, "experiments"))


def clean_ratings(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("reviewer", "model_type", "experiment_id", *R.METRICS)


def fully_rated_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.fully_rated(table(spark, d, "ratings")).groupBy("reviewer").agg(F.count("*").alias("n"))


def reviewer_from_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ratings").select(reviewer_of(F.col("file_name")).alias("reviewer")).groupBy("reviewer").agg(F.count("*").alias("n"))


def mean_by_reviewer_model(spark: SparkSession, d: str) -> DataFrame:
    return R.means(_clean(spark, d), "reviewer", "model_type")


def stats_by_model(spark: SparkSession, d: str) -> DataFrame:
    return R.spread(_clean(spark, d), "model_type")


def min_max_by_model(spark: SparkSession, d: str) -> DataFrame:
    return R.spread(_clean(spark, d), "model_type", stats=("mean", "std", "min", "max", "count"))


def mean_by_model(spark: SparkSession, d: str) -> DataFrame:
    return R.means(_clean(spark, d), "model_type")


def overview(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).agg(F.count("*").alias("ratings"), F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("model_type").alias("models"))


def rating_boxes(spark: SparkSession, d: str) -> DataFrame:
    return R.box_stats(_clean(spark, d), "model_type")


def pivot_reviewer_model(spark: SparkSession, d: str) -> DataFrame:
    return R.pivot_reviewers(_clean(spark, d), [m for m, _ in SHOWN])


def overall_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = _clean(spark, d).withColumn("overall", R.overall())
    return R.ordered(R.spread(rows, "model_type", ("overall",), ("mean", "std")), SHOWN)


def mean_by_model_distribution(spark: SparkSession, d: str) -> DataFrame:
    return R.means(_meta(spark, d).na.drop(subset=["difficulty_level"]), "model_type", "distribution")


def mean_sets(spark: SparkSession, d: str) -> DataFrame:
    return R.mean_sets(_meta(spark, d)).withColumn("difficulty_level", F.col("difficulty_level").cast("int"))


def match_counts(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).agg(F.count("*").alias("ratings"), F.count("distribution").alias("matched"))


def bars_by_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = _meta(spark, d).na.drop(subset=["difficulty_level"]).withColumn("overall", R.overall())
    means = R.means(rows, "model_type", "distribution", metrics=(*R.METRICS, "overall"))
    return R.ordered(means, SHOWN, dict.fromkeys((*R.METRICS, "overall"), 0.0), ("distribution", DIST))


def bars_by_level(spark: SparkSession, d: str) -> DataFrame:
    rows = _meta(spark, d).na.drop(subset=["distribution"]).withColumn("overall", R.overall())
    means = R.means(rows, "model_type", "difficulty_level", metrics=(*R.METRICS, "overall"))
    return R.ordered(means, SHOWN, dict.fromkeys((*R.METRICS, "overall"), 0.0), ("difficulty_level", LEVELS))


def pivot_distribution(spark: SparkSession, d: str) -> DataFrame:
    return R.pivot_means(_meta(spark, d).na.drop(subset=["difficulty_level"]), "model_type", "distribution", DIST, R.overall())


def pivot_level(spark: SparkSession, d: str) -> DataFrame:
    return R.pivot_means(_meta(spark, d).na.drop(subset=["distribution"]), "model_type", "difficulty_level", LEVELS, R.overall())


def trend_by_level(spark: SparkSession, d: str) -> DataFrame:
    rows = _meta(spark, d).na.drop(subset=["distribution"]).withColumn("overall", R.overall())
    return R.means(rows, "model_type", "difficulty_level", metrics=("overall",)).orderBy("model_type", "difficulty_level")


def latest_ratings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ratings").filter("model_type is not null and experiment_id is not null")
    return R.latest(rows.select("reviewer", "model_type", "experiment_id", "rated_at", "loaded_at", *R.METRICS), ["reviewer", "model_type", "experiment_id"], ["rated_at", "loaded_at"])


def rating_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All designs, with autojudge's latest rating or blanks."""
    rows = table(spark, d, "ratings").filter("model_type is not null and experiment_id is not null")
    designs = rows.select("model_type", "experiment_id").distinct()
    mine = R.latest(rows.filter("reviewer = 'autojudge'").select("model_type", "experiment_id", "rated_at", "loaded_at", *R.METRICS), ["model_type", "experiment_id"], ["rated_at", "loaded_at"])
    return R.rating_sheet(designs, mine, ["model_type", "experiment_id"])


def first_unrated(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "experiments").select("prompt_id").distinct()
    rated = R.fully_rated(table(spark, d, "ratings").filter("reviewer = 'autojudge'")).select(F.expr("try_cast(experiment_id as int)").alias("prompt_id"))
    return R.first_unrated(prompts, rated, ["prompt_id"], "prompt_id")


def metric_labels(spark: SparkSession, d: str) -> DataFrame:
    long = _clean(spark, d).select(F.explode(F.create_map(*[x for m in R.METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return long.groupBy("metric").agg(round_even(F.avg("value"), 3).alias("mean")).select(title(F.col("metric")).alias("label"), "mean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            clean_ratings, fully_rated_counts, reviewer_from_file, mean_by_reviewer_model, stats_by_model, min_max_by_model, mean_by_model, overview, rating_boxes, pivot_reviewer_model,
            overall_by_model, mean_by_model_distribution, mean_sets, match_counts, bars_by_distribution, bars_by_level, pivot_distribution, pivot_level, trend_by_level, latest_ratings,
            rating_lookup, first_unrated, metric_labels,
        )
    }


_M = R.METRICS
_CLEAN = "clean as (select reviewer, model_type, experiment_id, " + ", ".join(f"try_cast({m} as double) as {m}" for m in _M) + " from ratings where " + " and ".join(f"{m} <> '' and try_cast({m} as double) is not null" for m in _M) + ")"
_META = (
    "meta as (select prompt_id, max(case when d in ('indistribution', 'outofdistribution') then d end) as distribution, max(case when difficulty_level between 1 and 3 then difficulty_level end) as difficulty_level "
    "from (select *, lower(regexp_replace(distribution, '[^\\p{L}]', '', 'g')) as d from experiments) group by prompt_id), "
    "joined as (select c.*, distribution, difficulty_level from clean c left join meta on prompt_id = case when regexp_full_match(experiment_id, '\\s*[+-]?[0-9]+\\s*') then trim(experiment_id)::bigint end)"
)
_OVER = "(prompt_satisfaction + assemblability + design_quality) / 3"
_r = lambda e, a: f"round_even({e}, 3) as {a}"
_avg = ", ".join(_r(f"avg({m})", m) for m in _M)
_DIM = "dim(model_type, display, ord) as (values " + ", ".join(f"('{m}', '{x}', {i})" for i, (m, x) in enumerate(SHOWN)) + ")"


def oracle_sql() -> dict[str, str]:
    truthy = " and ".join(f"trim({m}) not in ('', '0')" for m in _M)
    last = "row_number() over (partition by {k} order by rated_at desc nulls last, loaded_at desc nulls last, prompt_satisfaction desc nulls last, assemblability desc nulls last, design_quality desc nulls last) = 1"
    long = " union all ".join(f"select model_type, '{m}' as metric, {m} as value from clean" for m in _M)
    return {
        "clean_ratings": f"with {_CLEAN} select * from clean",
        "fully_rated_counts": f"select reviewer, count(*) as n from ratings where {truthy} group by reviewer",
        "reviewer_from_file": "select replace(regexp_replace(file_name, '\\.[^.]*$', ''), '_ratings', '') as reviewer, count(*) as n from ratings group by 1",
        "mean_by_reviewer_model": f"with {_CLEAN} select reviewer, model_type, {_avg} from clean where reviewer is not null and model_type is not null group by all",
        "stats_by_model": f"with {_CLEAN} select model_type, " + ", ".join(f"{_r(f'avg({m})', f'{m}_mean')}, {_r(f'stddev_samp({m})', f'{m}_std')}, count({m}) as {m}_count" for m in _M) + " from clean where model_type is not null group by all",
        "min_max_by_model": f"with {_CLEAN} select model_type, "
        + ", ".join(f"{_r(f'avg({m})', f'{m}_mean')}, {_r(f'stddev_samp({m})', f'{m}_std')}, min({m}) as {m}_min, max({m}) as {m}_max, count({m}) as {m}_count" for m in _M)
        + " from clean where model_type is not null group by all",
        "mean_by_model": f"with {_CLEAN} select model_type, {_avg} from clean where model_type is not null group by all",
        "overview": f"with {_CLEAN} select count(*) as ratings, count(distinct reviewer) as reviewers, count(distinct model_type) as models from clean",
        "rating_boxes": f"""with {_CLEAN}, long as ({long}), q as (select model_type, metric, count(*) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from long where model_type is not null group by all)
select model_type, metric, any_value(n) as n, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3,
    min(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as low, max(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as high,
    count(*) filter (not value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers from long join q using (model_type, metric) group by model_type, metric""",
        "pivot_reviewer_model": f"with {_CLEAN}, long as (" + " union all ".join(f"select reviewer, model_type, '{m}' as metric, {m} as value from clean where reviewer is not null and model_type is not null" for m in _M) + ") select metric, reviewer, " + ", ".join(_r(f"avg(value) filter (model_type = '{m}')", f'"model_type_{m}"') for m, _ in SHOWN) + " from long where (select count(distinct reviewer) from long) > 1 group by all",
        "overall_by_model": f"with {_CLEAN}, {_DIM}, s as (select model_type, {_r(f'avg({_OVER})', 'overall_mean')}, {_r(f'stddev_samp({_OVER})', 'overall_std')} from clean group by all) select * from dim left join s using (model_type)",
        "mean_by_model_distribution": f"with {_CLEAN}, {_META} select model_type, distribution, {_avg} from joined where model_type is not null and distribution is not null and difficulty_level is not null group by all",
        "mean_sets": f"""with {_CLEAN}, {_META} select model_type, distribution, difficulty_level, {_avg},
    concat_ws('+', case when grouping(model_type) = 0 then 'model_type' end, case when grouping(distribution) = 0 then 'distribution' end, case when grouping(difficulty_level) = 0 then 'difficulty_level' end) as "grouping"
from joined where model_type is not null and distribution is not null and difficulty_level is not null
group by grouping sets ((model_type, distribution), (distribution), (model_type, difficulty_level), (difficulty_level), (model_type, distribution, difficulty_level))""",
        "match_counts": f"with {_CLEAN}, {_META} select count(*) as ratings, count(distribution) as matched from joined",
        **{
            f"bars_by_{n}": f"with {_CLEAN}, {_META}, {_DIM}, v({k}) as (values {values}), s as (select model_type, {k}, {_avg}, {_r(f'avg({_OVER})', 'overall')} from joined where distribution is not null and difficulty_level is not null group by all) select model_type, display, ord, {k}, "
            + ", ".join(f"coalesce({m}, 0) as {m}" for m in (*_M, "overall")) + f" from dim cross join v left join s using (model_type, {k})"
            for n, k, values in (("distribution", "distribution", ", ".join(f"('{x}')" for x in DIST)), ("level", "difficulty_level", ", ".join(f"({x})" for x in LEVELS)))
        },
        "pivot_distribution": f"with {_CLEAN}, {_META} select model_type, " + ", ".join(_r(f"avg({_OVER}) filter (distribution = '{x}')", f"distribution_{x}") for x in DIST) + " from joined where model_type is not null and distribution is not null and difficulty_level is not null group by all",
        "pivot_level": f"with {_CLEAN}, {_META} select model_type, " + ", ".join(_r(f"avg({_OVER}) filter (difficulty_level = {x})", f"difficulty_level_{x}") for x in LEVELS) + " from joined where model_type is not null and distribution is not null and difficulty_level is not null group by all",
        "trend_by_level": f"with {_CLEAN}, {_META} select model_type, difficulty_level, {_r(f'avg({_OVER})', 'overall')} from joined where model_type is not null and distribution is not null and difficulty_level is not null group by all",
        "latest_ratings": f"select reviewer, model_type, experiment_id, rated_at, loaded_at, {', '.join(_M)} from ratings where model_type is not null and experiment_id is not null qualify " + last.format(k="reviewer, model_type, experiment_id"),
        "rating_lookup": f"""with designs as (select distinct model_type, experiment_id from ratings where model_type is not null and experiment_id is not null),
mine as (select * from ratings where model_type is not null and experiment_id is not null and reviewer = 'autojudge' qualify {last.format(k='model_type, experiment_id')})
select model_type, experiment_id, {", ".join(f"coalesce({m}, '') as {m}" for m in _M)} from designs left join mine using (model_type, experiment_id)""",
        "first_unrated": f"""with rated as (select distinct try_cast(experiment_id as int) as prompt_id from ratings where reviewer = 'autojudge' and {truthy} and regexp_full_match(experiment_id, '\\s*[0-9]+\\s*'))
select coalesce(min(prompt_id), 0) as prompt_id from experiments where prompt_id not in (select prompt_id from rated where prompt_id is not null)""",
        "metric_labels": f"with {_CLEAN}, long as ({long}) select case metric when 'assemblability' then 'Assemblability' when 'design_quality' then 'Design Quality' else 'Prompt Satisfaction' end as label, {_r('avg(value)', 'mean')} from long group by metric",
    }
