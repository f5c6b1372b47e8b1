"""Queries of the training-data operators over the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm import consensus, leaks, overlap, quality, sampling, splits, tokens
from joinery.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.unreliable(table(spark, sf_dir, "ratings"))


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "ratings"))


def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliabilities(table(spark, sf_dir, "ratings"))


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per metric the designs rated, their ratings, and the mean agreement of those rated twice or more."""
    rows = p1_consensus(spark, sf_dir).groupBy("metric")
    return rows.agg(F.count("*").alias("designs"), F.sum("ratings").cast("bigint").alias("ratings"), F.round(F.avg("agreement"), 6).alias("agreement"))


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.usable(table(spark, sf_dir, "experiments"), table(spark, sf_dir, "partnet_meta")), table(spark, sf_dir, "sample_targets")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.unmet(*_pool(spark, sf_dir))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(*_pool(spark, sf_dir))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.report(*_pool(spark, sf_dir))


def p3_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_report(spark, sf_dir).select("request_id", "target_id", "goal", "have", "can_be_met")


def p3_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each request's sample, and those of them that meet no target."""
    sample, outside = p3_sample(spark, sf_dir).groupBy("request_id").agg(F.count("*").alias("rows")), p3_report(spark, sf_dir).groupBy("request_id").agg(F.max("outside").alias("outside"))
    return sample.join(outside, "request_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.related(splits.records(table(spark, sf_dir, "partnet_meta")))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(splits.records(table(spark, sf_dir, "partnet_meta")), table(spark, sf_dir, "split_targets"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.report(splits.records(table(spark, sf_dir, "partnet_meta")), table(spark, sf_dir, "split_targets"))


def p4_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each category over all splits."""
    return p4_report(spark, sf_dir).groupBy("category").agg(F.sum("records").cast("bigint").alias("records"))


def p4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of related records there are, and how many of them are cut by the splits."""
    split = p4_splits(spark, sf_dir)
    root = p4_found(spark, sf_dir).select("dir_id_a", F.col("dir_id_b").alias("dir_id"))
    groups = split.join(root, "dir_id", "left").groupBy(F.coalesce("dir_id_a", "dir_id").alias("root")).agg(F.countDistinct("split_name").alias("n"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("cut"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(table(spark, sf_dir, "finetuning_data"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "finetuning_data"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.membership(table(spark, sf_dir, "finetuning_data"))


def p5_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation entries per split and source, and those whose design stands in training exactly."""
    return p5_report(spark, sf_dir).select("split_name", "source", "entries", "same")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_table(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_consensus, p1_reliability, p1_agreement, p3_found, p3_sample, p3_report, p3_goals, p3_outside, p4_found, p4_splits, p4_report, p4_categories, p4_whole, p5_found, p5_report, p5_same, p5_classes, p6_ids, p7_found, p7_report, p8_found, p8_scores)}


_POOL = r"""e as (select prompt_id, min(lower(regexp_replace(distribution, '[^\p{L}]', '', 'g')) || difficulty_level::varchar) as c from experiments
    where lower(regexp_replace(distribution, '[^\p{L}]', '', 'g')) in ('indistribution', 'outofdistribution') and difficulty_level between 1 and 3 group by prompt_id),
m as (select nullif(lower(regexp_replace(model_cat, '[^\p{L}]', '', 'g')), '') as c from partnet_meta),
pool as (select 'experiments' as pool, c from e union all select 'partnet_meta', c from m where c is not null),
n as (select pool, count(*) as n from pool group by pool), have as (select pool, c, count(*) as have from pool group by pool, c),
t as (select *, coalesce(lower(regexp_replace(model_cat, '[^\p{L}]', '', 'g')), lower(regexp_replace(distribution, '[^\p{L}]', '', 'g')) || difficulty_level::varchar) as c from sample_targets),
g as (select request_id, target_id, coalesce(have, 0) as have, greatest(min_rows, floor(target_share * floor(sample_frac * n + 1e-9) + 1e-9)::bigint) as goal, floor(sample_frac * n + 1e-9)::bigint as size
    from t left join n using (pool) left join have using (pool, c))"""


_GROUPS = """with recursive k as (select distinct dir_id, 'm' || nullif(lower(regexp_replace(model_id, '[^0-9A-Fa-f]', '', 'g')), '') as key from partnet_meta
    union select dir_id, 'u' || lower(regexp_replace(upload_id, '[^0-9A-Za-z]', '', 'g')) from partnet_meta where regexp_full_match(lower(regexp_replace(upload_id, '[^0-9A-Za-z]', '', 'g')), 'up[0-9]*[1-9][0-9]*')),
reach(a, b) as (select dir_id, dir_id from partnet_meta union select r.a, y.dir_id from reach r join k x on x.dir_id = r.b join k y on y.key = x.key)"""
_CELL = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}\x{{000B}}]+|[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}\x{{000B}}]+$', '', 'g')"
_AGREEMENT = rf"""with raw as (select reviewer, lower({_CELL.format("model_type")}) as model, try_cast({_CELL.format("experiment_id")} as double) as item, rated_at, loaded_at,
    unnest([row('assemblability', {_CELL.format("assemblability")}), row('prompt_satisfaction', {_CELL.format("prompt_satisfaction")}), row('design_quality', {_CELL.format("design_quality")})]) as m from ratings),
cell as (select reviewer, model, item, m[1] as metric, try_cast(m[2] as double) as v, coalesce(rated_at, timestamp '0001-01-01') as t1, coalesce(loaded_at, timestamp '0001-01-01') as t2 from raw),
kept as (select reviewer, model, item, metric, arg_max(v, row(t1, t2, v)) as v from cell where reviewer is not null and model is not null and item is not null and v in (1, 2, 3) group by all),
design as (select model, item, metric, count(*) as n, count(*) filter (v = 1) as a, count(*) filter (v = 2) as b, count(*) filter (v = 3) as c from kept group by all)
select metric, count(*) as designs, sum(n)::bigint as ratings, round(avg(case when n > 1 then (a * (a - 1) + b * (b - 1) + c * (c - 1)) / (n * (n - 1)) end), 6) as agreement from design group by metric"""
_SAME = rf"""with said as (select entry_id, lower({_CELL.format("split_name")}) as split_name, source, [m.content for m in messages if lower({_CELL.format("m.role")}) = 'assistant'][-1] as design from finetuning_data where entry_id is not null),
line as (select entry_id, split_name, source, unnest(regexp_split_to_array(design, '\r\n|[\n\r\x{{0085}}\x{{2028}}\x{{2029}}]')) as raw from said where split_name in ('train', 'val', 'test') and design is not null),
flat as (select entry_id, split_name, source, trim(regexp_replace(raw, '[\s,\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{000B}}]+', ' ', 'g')) as t from line),
good as (select * from flat where regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)( [+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)){{8}}')),
piece as (select entry_id, split_name, source, string_split(t, ' ')::double[] as p from good),
design as (select entry_id, split_name, any_value(source) as source, list_sort(list(p)) as d from (select * from piece) group by entry_id, split_name)
select split_name, source, count(*) as entries, count(*) filter (d in (select d from design where split_name = 'train')) as same from design where split_name <> 'train' group by split_name, source"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"with {_POOL} select target_id from g where have < goal",
        "p3_goals": f"with {_POOL} select request_id, target_id, goal, have, have >= goal as can_be_met from g",
        # every request of the tables has shares that add to 1, so rows outside are drawn only where all requested rows are taken
        "p3_outside": f"with {_POOL} select request_id, max(size)::bigint as rows, greatest(0, max(size) - sum(have))::bigint as outside from g group by request_id",
        "p4_found": f"{_GROUPS} select min(b) as dir_id_a, a as dir_id_b from reach group by a having min(b) <> a",
        "p4_categories": r"""with r as (select dir_id, min(coalesce(lower(regexp_replace(model_cat, '[^\p{L}]', '', 'g')), '')) as category from partnet_meta where dir_id is not null group by dir_id)
select category, count(*) as records from r group by category""",
        "p4_whole": f"{_GROUPS}, root as (select a, min(b) as r from reach group by a) select count(distinct r) as groups, 0::bigint as cut from root",
        "p1_agreement": _AGREEMENT,
        "p5_same": _SAME,
    }
