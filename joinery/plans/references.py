"""Queries on references to records that do not exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joinery.operators.references import Cascade, furniture_keys
from joinery.session import table


def _cascade(spark: SparkSession, sf_dir: str) -> Cascade:
    return Cascade(furniture_keys(*[table(spark, sf_dir, t) for t in ("finetuning_data", "partnet_meta", "stabletext2brick")]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's orphans that are orphans by themselves."""
    return _cascade(spark, sf_dir).orphans().filter("kind = 'direct'").select("ref_table", "ref_field", "row_id").distinct()


def p2_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).orphans().select("ref_table", "ref_field", "row_id", "kind", "depth").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).report()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_cascade, p2_report)}


_PLACES = r"""
text as (select row_id, nullif(lower(regexp_replace(object_id, '[^0-9A-Fa-f]', '', 'g')), '') as id, captions, added_at,
    len(captions) = 1 and regexp_matches(captions[1], '^\s*\[') and regexp_matches(captions[1], '\]\s*$') as printed from stabletext2brick),
listed as (select row_id, id, added_at, case when printed then [q[2:-2] for q in regexp_extract_all(captions[1], '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"')] else captions end as captions from text),
places as (select row_id, id, added_at, generate_subscripts(captions, 1) - 1 as place, unnest(captions) as caption from listed),
entry as (select entry_id, nullif(lower(regexp_replace(model_id, '[^0-9A-Fa-f]', '', 'g')), '') as id, caption_no, created_at from finetuning_data),
models as (select nullif(lower(regexp_replace(model_id, '[^0-9A-Fa-f]', '', 'g')), '') as id, added_at, removed_at from partnet_meta)
"""


_BLANK = "trim(p.caption, ' ' || chr(160) || chr(9) || chr(10) || chr(13))"
_DIRECT = f"""direct as (select distinct 'finetuning_data' as ref_table, 'model_id' as ref_field, entry_id as row_id, created_at as ts from entry e where id is not null
    and not exists (select 1 from models m where m.id = e.id and m.added_at <= e.created_at and (m.removed_at is null or m.removed_at > e.created_at))
union select distinct 'stabletext2brick', 'object_id', row_id, added_at from text t where id is not null
    and not exists (select 1 from models m where m.id = t.id and m.added_at <= t.added_at and (m.removed_at is null or m.removed_at > t.added_at))
union select distinct 'finetuning_data', 'caption_no', entry_id, created_at from entry e where id is not null and caption_no is not null
    and not exists (select 1 from places p where p.id = e.id and p.place = e.caption_no and p.added_at <= e.created_at and {_BLANK} <> ''))"""
# only captions hang on records that refer to something themselves, so there is one round of inherited orphans
_INHERITED = f"""lost as (select row_id from direct where ref_table = 'stabletext2brick'),
inherited as (select distinct 'finetuning_data' as ref_table, 'caption_no' as ref_field, entry_id as row_id, created_at as ts from entry e where id is not null and caption_no is not null
    and not exists (select 1 from places p where p.id = e.id and p.place = e.caption_no and p.added_at <= e.created_at and {_BLANK} <> '' and p.row_id not in (from lost))
    and not exists (select 1 from direct d where d.ref_field = 'caption_no' and d.row_id = e.entry_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"with {_PLACES}, {_DIRECT} select ref_table, ref_field, row_id from direct",
        "p2_cascade": f"with {_PLACES}, {_DIRECT}, {_INHERITED} select ref_table, ref_field, row_id, 'direct' as kind, 0::int as depth from direct union select ref_table, ref_field, row_id, 'inherited', 1 from inherited",
        "p2_report": f"""with {_PLACES}, {_DIRECT}, {_INHERITED},
every as (select 'finetuning_data' as ref_table, 'model_id' as ref_field, created_at as ts, 'any' as kind from entry where id is not null
    union all select 'stabletext2brick', 'object_id', added_at, 'any' from text where id is not null
    union all select 'finetuning_data', 'caption_no', created_at, 'any' from entry where id is not null and caption_no is not null
    union all select ref_table, ref_field, ts, 'direct' from direct union all select ref_table, ref_field, ts, 'inherited' from inherited)
select ref_table, ref_field, strftime(ts, '%Y-%m') as month, count(*) filter (kind = 'any') as refs, count(*) filter (kind = 'direct') as direct, count(*) filter (kind = 'inherited') as inherited from every group by all""",
    }
