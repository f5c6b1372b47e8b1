"""Queries of dataset building, voxels, run lengths and scalar functions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.functions import chat
from joinery.functions import scalars as X
from joinery.functions.designs import last_content
from joinery.functions.keys import hex_id
from joinery.operators import dataset as D
from joinery.operators import ratings as R
from joinery.operators import tables as T
from joinery.operators import voxels as V
from joinery.session import table

WOODS = tuple((w, w.title()) for w in ("oak", "ash", "beech", "birch", "none such"))


def captions_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "stabletext2brick").filter("object_id is not null").select("object_id", "row_id", "captions", "category", "added_at")
    return T.first_by(t, ["object_id"], ["added_at", "row_id"])


def captions_last(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "stabletext2brick").filter("object_id is not null").select("object_id", "row_id", "captions", "category", "added_at")
    return T.first_by(t, ["object_id"], ["added_at", "row_id"], last=True)


def captioned_models(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "stabletext2brick").select(F.col("object_id").alias("model_id"))
    return T.only_ids(table(spark, d, "partnet_meta").select("dir_id", "model_id", "model_cat"), ids, "model_id")


def models_with_captions(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "stabletext2brick").filter("object_id is not null").select(F.col("object_id").alias("model_id"), "row_id", F.size("captions").alias("n_captions"))
    return T.left_join_first(table(spark, d, "partnet_meta").select("dir_id", "model_id"), right, "model_id", ["row_id"])


def caption_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stabletext2brick").agg(F.count_if(F.col("captions").isNull()).alias("missing"), F.count("captions").alias("present"))


def uncaptioned_categories(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "stabletext2brick").filter("captions is not null").select(F.col("object_id").alias("model_id"))
    rest = table(spark, d, "partnet_meta").join(ids, "model_id", "left_anti")
    return T.value_counts(rest, "model_cat")


def kept_models(spark: SparkSession, d: str) -> DataFrame:
    return D.keep_models(table(spark, d, "partnet_meta")).select("dir_id", "model_cat", "part_count")


def parts_by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "partnet_meta").groupBy("model_cat").agg(F.count("*").alias("models"), F.sum("part_count").cast("bigint").alias("parts"), F.count_distinct("upload_id").alias("uploads"))


def caption_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.caption_rows(table(spark, d, "stabletext2brick"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """Each caption with the design of its model: that of the model's first entry that has one; captions of other models are left out."""
    said = table(spark, d, "finetuning_data").select("entry_id", hex_id(F.col("model_id")).alias("id"), last_content(F.col("messages")).alias("design"))
    first = T.first_by(said.filter("id is not null and design is not null"), ["id"], ["entry_id"]).select("id", "design")
    c = D.caption_rows(table(spark, d, "stabletext2brick")).withColumn("id", hex_id(F.col("object_id")))
    return D.conversations(c.join(first, "id")).select("row_id", "place", "messages")


def training_sets(spark: SparkSession, d: str) -> DataFrame:
    """How many of the captions' conversations go to each split, a tenth to the test split."""
    rows = T.train_test(conversations(spark, d).select("row_id", "place"), ["row_id", "place"])
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def generation_times_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Generation times of the log lines, in a fixed order of woods; woods without a line get nulls."""
    t = generation_times(spark, d).withColumnRenamed("wood", "model_type")
    return R.ordered(t, WOODS).withColumnRenamed("model_type", "wood")


def updated_ratings(spark: SparkSession, d: str) -> DataFrame:
    """The designs' ratings of autojudge, replaced by those of rows saved in 2025."""
    from joinery.operators.judge import upsert

    on = ["model_type", "experiment_id"]
    rows = table(spark, d, "ratings").filter("reviewer = 'autojudge' and model_type is not null and experiment_id is not null").select(*on, "loaded_at", *R.METRICS)
    late = F.coalesce(F.year("loaded_at") >= 2025, F.lit(False))
    return upsert(R.latest(rows.filter(~late), on, ["loaded_at"]), R.latest(rows.filter(late), on, ["loaded_at"]), on)


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field of the events' JSON properties, and one that is missing, with defaults."""
    t = table(spark, d, "events")
    return t.groupBy(X.json_or(F.col("props"), "$.k", "none").alias("k"), X.json_or(F.col("props"), "$.absent", "none").alias("absent")).agg(F.count("*").alias("n"))


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = T.train_test(table(spark, d, "finetuning_data").select("entry_id"), ["entry_id"])
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def chat_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "finetuning_data").filter("messages is not null").select("entry_id", chat.said(F.col("messages")).alias("said"), F.size(chat.not_of_role(F.col("messages"), "assistant")).alias("others"))


def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = D.prefixes(table(spark, d, "finetuning_data").filter("messages is not null"), ["entry_id"], mode="all")
    return rows.groupBy("entry_id").agg(F.count("*").alias("cuts"), F.sum(F.length("prefix")).alias("prefix_chars"), F.count_if(F.col("next_line") == chat.END).alias("ends"))


def prefix_one(spark: SparkSession, d: str) -> DataFrame:
    return D.prefixes(table(spark, d, "finetuning_data").filter("messages is not null"), ["entry_id"])


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.value_counts(table(spark, d, "finetuning_data"), "source")


def union_of_prompts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "experiments").select(F.lit("experiments").alias("origin"), "prompt", F.col("prompt_id").cast("string").alias("ref"))
    b = table(spark, d, "ratings").select(F.lit("ratings").alias("origin"), "prompt", "reviewer")
    return T.union_all([a, b]).groupBy("origin").agg(F.count("*").alias("n"), F.count("ref").alias("refs"), F.count("reviewer").alias("reviewers"), F.count_distinct("prompt").alias("prompts"))


def voxel_iou(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j"), F.col("l_linenumber").alias("k"), "l_returnflag")
    a, b = (t.filter(F.col("l_returnflag") == x).select("i", "j", "k") for x in ("A", "N"))
    return T.iou(a, b)


def voxel_places(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in zip("ijk", V.unravel(F.pmod(F.col("p_partkey"), F.lit(60)), (3, 4, 5)))])
    return t.select("*", V.to_world(F.col("i"), 3, -0.5, 2.0).alias("x"), V.to_voxel(V.to_world(F.col("i"), 3, -0.5, 2.0), 3, -0.5, 2.0).alias("back"))


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    return T.run_ends(T.run_lengths(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 3), ["user_id"])


def generation_times(spark: SparkSession, d: str) -> DataFrame:
    """Generation times by wood, from the JSON log lines in the documents."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", r"\r?\n")).alias("line")).filter(F.col("line").startswith('{"generation_time"'))
    rows = lines.select(F.from_json("line", "generation_time double, exp string, wood string, ok boolean").alias("r")).select("r.*").filter("generation_time is not null")
    g = F.col("generation_time")
    return rows.groupBy("wood").agg(X.round_even(F.avg(g), 3).alias("mean"), X.round_even(F.stddev_samp(g), 3).alias("std"), F.min(g).alias("low"), F.max(g).alias("high"), F.count("*").alias("n"))


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Ratings read back from fenced JSON replies; a reply with a missing or wrong rating counts for nothing."""
    from joinery.operators.judge import parse_reply

    t = table(spark, d, "ratings")
    cells = [F.concat(F.lit(f'"{m}": '), F.coalesce(F.nullif(m, F.lit("")), F.lit("null"))) for m in ("assemblability", "prompt_satisfaction", "design_quality")]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))
    reply = F.concat(F.lit("Here you are.\n```json\n"), body, F.lit("\n```"))
    return t.select(parse_reply(reply).alias("r")).groupBy(F.col("r.assemblability").alias("assemblability"), F.col("r.prompt_satisfaction").alias("prompt_satisfaction"), F.col("r.design_quality").alias("design_quality")).agg(F.count("*").alias("n"))


def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ratings").select("file_name").distinct()
    f = F.col("file_name")
    return t.select(
        "file_name", X.stem(f).alias("stem"), X.suffix(f).alias("suffix"), X.title(X.stem(f)).alias("title"), X.mime_type(F.concat(f, F.lit(".JPG"))).alias("mime"), F.base64(f.cast("binary")).alias("coded"),
        X.is_digits(F.substring(f, 5, 1)).alias("digit"), X.with_prompt("Rate {prompt} now", f).alias("asked"), X.padded(F.length(f)).alias("padded"), X.fixed(F.length(f) / 8).alias("fixed"),
    )


def number_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    v = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(X.truncated(v)).alias("truncated"), F.sum(F.rint(v).cast("bigint")).alias("rounded"), F.sum(F.pmod(X.truncated(v), F.lit(360))).alias("angles"), X.round_even(F.avg(F.tanh(F.col("l_tax"))), 6).alias("tanh"),
        X.round_even(F.avg(F.sin(F.radians("l_quantity"))), 6).alias("sine"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            captions_first, captions_last, captioned_models, models_with_captions, caption_counts, uncaptioned_categories, kept_models, parts_by_category, caption_rows, conversations, training_sets, generation_times_ordered, updated_ratings, json_fields, split_sizes,
            chat_concat, prefix_counts, prefix_one, source_counts, union_of_prompts, voxel_iou, voxel_places, event_runs, generation_times, judge_replies, text_scalars, number_scalars,
        )
    }


_LISTED = r"""(select object_id, row_id, case when len(captions) = 1 and regexp_matches(captions[1], '^\s*\[') and regexp_matches(captions[1], '\]\s*$')
    then [q[2:-2] for q in regexp_extract_all(captions[1], '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"')] else captions end as captions from stabletext2brick)"""
_WS = r"[\s\x{00A0}\x{2003}\x{3000}]"
_CAPTIONS = f"""(select object_id, row_id, place, regexp_replace(regexp_replace(regexp_replace(c, '^{_WS}+|{_WS}+$', '', 'g'), '^''+|''+$', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g') as caption
    from (select object_id, row_id, unnest(captions) as c, (generate_subscripts(captions, 1) - 1)::int as place from {_LISTED}))"""
_SAID = "(select entry_id, coalesce(array_to_string([m.content for m in messages if m.role = 'assistant'], ''), '') as said, len([m.content for m in messages if m.role <> 'assistant'])::int as others from finetuning_data where messages is not null)"


_TIMES = """with l as (select unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line from documents), r as (select json_extract_string(line, '$.wood') as wood, json_extract(line, '$.generation_time')::double as g from l where starts_with(line, '{"generation_time"') and json_valid(line))
select wood, round_even(avg(g), 3) as mean, round_even(stddev_samp(g), 3) as std, min(g) as low, max(g) as high, count(*) as n from r where g is not null group by wood"""
_ROLE = r"lower(regexp_replace(m.role, '^[\s\x{00A0}\x{2003}\x{3000}]+|[\s\x{00A0}\x{2003}\x{3000}]+$', '', 'g'))"
_FIRST = f"""with said as (select entry_id, nullif(lower(regexp_replace(model_id, '[^0-9A-Fa-f]', '', 'g')), '') as id, [m.content for m in messages if {_ROLE} = 'assistant'][-1] as design from finetuning_data),
first as (select id, arg_min(design, entry_id) as design from said where id is not null and design is not null group by id),
pairs as (select row_id, place, caption, design from {_CAPTIONS} c join first f on f.id = nullif(lower(regexp_replace(c.object_id, '[^0-9A-Fa-f]', '', 'g')), '') where caption <> '')"""


def oracle_sql() -> dict[str, str]:
    first = "select object_id, row_id, captions, category, added_at from stabletext2brick where object_id is not null qualify row_number() over (partition by object_id order by added_at {x}, row_id {x}) = 1"
    return {
        "captions_first": first.format(x=""),
        "captions_last": first.format(x="desc"),
        "captioned_models": "select dir_id, model_id, model_cat from partnet_meta where model_id in (select object_id from stabletext2brick where object_id is not null)",
        "models_with_captions": "select dir_id, model_id, row_id, n_captions from partnet_meta left join (select object_id as model_id, row_id, len(captions)::int as n_captions from stabletext2brick qualify row_number() over (partition by object_id order by row_id) = 1) using (model_id)",
        "caption_counts": "select count(*) filter (captions is null) as missing, count(captions) as present from stabletext2brick",
        "uncaptioned_categories": "select model_cat, count(*) as n from partnet_meta p where not exists (select 1 from stabletext2brick s where s.object_id = p.model_id and captions is not null) group by model_cat",
        "kept_models": "select dir_id, model_cat, part_count from partnet_meta where model_cat in ('Bed', 'Chair', 'Table', 'StorageFurniture') and part_count <= 100",
        "parts_by_category": "select model_cat, count(*) as models, sum(part_count)::bigint as parts, count(distinct upload_id) as uploads from partnet_meta group by model_cat",
        "caption_rows": f"select object_id, row_id, place, caption from {_CAPTIONS} where caption <> ''",
        "conversations": f"{_FIRST} select row_id, place, [{{'role': 'system', 'content': '{chat.SYSTEM}'}}, {{'role': 'user', 'content': '{chat.INSTRUCTION}' || caption}}, {{'role': 'assistant', 'content': design}}] as messages from pairs",
        "training_sets": f"{_FIRST} select 'test' as split, ceil(count(*) * 0.1)::bigint as n from pairs union all select 'train', (count(*) - ceil(count(*) * 0.1))::bigint from pairs",
        "updated_ratings": f"""with r as (select *, coalesce(year(loaded_at) >= 2025, false) as late from ratings where reviewer = 'autojudge' and model_type is not null and experiment_id is not null)
select model_type, experiment_id, loaded_at, {", ".join(R.METRICS)} from r qualify row_number() over (partition by model_type, experiment_id order by late desc, loaded_at desc nulls last, {", ".join(f"{m} desc nulls last" for m in R.METRICS)}) = 1""",
        "json_fields": "select coalesce(json_extract_string(props, '$.k'), 'none') as k, 'none' as absent, count(*) as n from events group by 1",
        "judge_replies": """with c as (select trim(assemblability, ' ') as a, trim(prompt_satisfaction, ' ') as p, trim(design_quality, ' ') as q from ratings),
r as (select case when regexp_full_match(a, '[123]([.]0+)?') and regexp_full_match(p, '[123]([.]0+)?') and regexp_full_match(q, '[123]([.]0+)?') then [a::double::int, p::double::int, q::double::int] end as x from c)
select x[1] as assemblability, x[2] as prompt_satisfaction, x[3] as design_quality, count(*) as n from r group by all""",
        "split_sizes": "select 'test' as split, ceil(count(*) * 0.1)::bigint as n from finetuning_data union all select 'train', (count(*) - ceil(count(*) * 0.1))::bigint from finetuning_data",
        "chat_concat": f"select * from {_SAID}",
        "prefix_counts": f"""with l as (select entry_id, case when said = '' then []::varchar[] else string_split(regexp_replace(replace(said, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) end as lines from {_SAID}),
cuts as (select entry_id, lines, unnest(range(0, len(lines) + 1)) as cut from l)
select entry_id, count(*) as cuts, sum(list_sum([length(x) + 1 for x in lines[1:cut]]))::bigint as prefix_chars, count(*) filter (cut = len(lines)  or lines[cut + 1] = 'EOS') as ends
from (select entry_id, cut, lines, case when cut = 0 then [''] else lines end as z from cuts) group by entry_id""".replace("list_sum([length(x) + 1 for x in lines[1:cut]])", "coalesce(list_sum([length(x) + 1 for x in lines[1:cut]]), 0)"),
        "source_counts": "select source, count(*) as n from finetuning_data group by source",
        "union_of_prompts": "select 'experiments' as origin, count(*) as n, count(prompt_id) as refs, 0::bigint as reviewers, count(distinct prompt) as prompts from experiments union all select 'ratings', count(*), 0, count(reviewer), count(distinct prompt) from ratings",
        "voxel_iou": """with v as (select distinct l_partkey % 64 as i, l_suppkey % 64 as j, l_linenumber as k, l_returnflag as f from lineitem where l_returnflag in ('A', 'N')), c as (select i, j, k, count(*) as n from v group by all)
select count(*) filter (n = 2) as common, count(*) as either, count(*) filter (n = 2) / count(*) as iou from c""",
        "voxel_places": "select p_partkey, ((p_partkey % 60) // 20)::int as i, ((p_partkey % 60) // 5 % 4)::int as j, (p_partkey % 5)::int as k, ((p_partkey % 60) // 20 + 0.5::double) / 3 * 2 - 0.5 as x, ((p_partkey % 60) // 20)::int as back from part",
        "event_runs": """with s as (select user_id, event_type, row_number() over w - 1 as i, row_number() over w - row_number() over (partition by user_id, event_type order by ts, event_id) as g from events window w as (partition by user_id order by ts, event_id)),
r as (select user_id, event_type as value, min(i) as s, count(*) as n from s group by user_id, event_type, g),
c as (select user_id, value, s + 3 * k as start, least(3, n - 3 * k)::int as length from (select *, unnest(range(0, (n - 1) // 3 + 1)) as k from r))
select user_id, (row_number() over (partition by user_id order by start) - 1)::int as run, value, start::int as start, length, (sum(length) over (partition by user_id order by start))::bigint as upto from c""",
        "generation_times": _TIMES,
        "generation_times_ordered": f"with t as ({_TIMES}), w(wood, display, ord) as (values {', '.join(str((a, b, i)) for i, (a, b) in enumerate(WOODS))}) select * from w left join t using (wood)",
        "text_scalars": """select distinct file_name, replace(file_name, '.csv', '') as stem, 'csv' as suffix, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(replace(replace(file_name, '.csv', ''), '_', ' '), ' ')], ' ') as title, 'image/jpeg' as mime, base64(file_name::blob) as coded,
    regexp_matches(file_name[5], '[0-9]') as digit, 'Rate ' || file_name || ' now' as asked, lpad(length(file_name)::varchar, 3, '0') as padded, printf('%.2f', round(length(file_name) / 8.0::double + 1e-9, 2)) as fixed from ratings""",
        "number_scalars": """select l_returnflag, l_linestatus, sum(trunc(l_extendedprice * (l_discount - 0.05::double))::bigint)::bigint as truncated, sum(round_even(l_extendedprice * (l_discount - 0.05::double), 0)::bigint)::bigint as rounded,
    sum(((trunc(l_extendedprice * (l_discount - 0.05::double))::bigint % 360) + 360) % 360)::bigint as angles, round_even(avg(tanh(l_tax)), 6) as tanh, round_even(avg(sin(radians(l_quantity))), 6) as sine from lineitem group by all""",
    }
