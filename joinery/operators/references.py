"""References to records that do not exist: direct orphans, and orphans by inheritance.

A reference is (row, key, time); a target is (record, key, start, end) and holds at a time t if start <= t and end is
null or > t. A reference is a direct orphan if no target of its key holds at its time. The targets of a key, however many, are
reduced to the times at which it begins and ceases to be held; a reference then looks up its key once. The references are neither sorted nor
paired with targets: keys that change up to FEW times bring one array of these times, keys that change more often
one array per day, with the state the day begins with. The lookup table is broadcast after its rows are counted; beyond the bound it is
a hash join, whose hot keys adaptive execution splits.

The cascade treats children of orphaned records as orphaned too: the references to the keys of newly orphaned records
(a semi join along each foreign key) are tested again against the targets that are left; those without one are
inherited orphans, and their records are the next round's, until a round finds none.

Defined results: a null key refers to nothing; a reference without a time and a target without a start never match, so
the former is an orphan; targets that end before they start never hold; repeated rows count once per row id; empty
tables give empty results; other columns do not matter, since references and targets are selected by position of role.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions.keys import hex_id, strip
from joinery.session import cut, small

#: Changes of a key between held and not held up to which they are kept in one array.
FEW = 32
#: Most rows of a broadcast lookup table; a row is a key and mostly one or two times, below 200 bytes.
BROADCAST_KEYS = 200_000


@dataclass
class ForeignKey:
    """refs: (row_id, key, at) of child_table.field. targets: (record, key, start, end) of parent_table."""

    child_table: str
    field: str
    parent_table: str
    refs: DataFrame
    targets: DataFrame


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c)).cast("int")


def changes(targets: DataFrame) -> DataFrame:
    """(key, t, up): the times at which a key begins (up = 1) or ceases (-1) to have a target.

    Starts and ends are counted per key and time, then summed up per key and month with the sums of earlier months as offsets, so
    that a sort covers one key in one month.
    """
    held = targets.filter("key is not null and start is not null and (`end` is null or `end` > start)")
    begins = held.select("key", F.col("start").alias("t"), F.lit(1).alias("d"))
    ends = held.filter("`end` is not null").select("key", F.col("end").alias("t"), F.lit(-1).alias("d"))
    steps = begins.union(ends).groupBy("key", "t").agg(F.sum("d").alias("d")).filter("d <> 0").withColumn("month", _month(F.col("t")))
    net = steps.groupBy("key", "month").agg(F.sum("d").alias("net"))  # at most one row per key and month
    before = net.selectExpr("key", "month", "coalesce(sum(net) over (partition by key order by month rows between unbounded preceding and 1 preceding), 0L) as held_before")
    within = steps.selectExpr("*", "sum(d) over (partition by key, month order by t) as held_since").join(before, ["key", "month"])
    now = within.select("key", "t", "d", (F.col("held_before") + F.col("held_since")).alias("n"))
    return now.select("key", "t", F.when((F.col("n") > 0) & (F.col("n") - F.col("d") <= 0), 1).when((F.col("n") <= 0) & (F.col("n") - F.col("d") > 0), -1).alias("up")).filter("up is not null")


def _state(times: str, at: str) -> str:
    """SQL: the sum of the changes up to a time."""
    return f"aggregate({times}, 0, (n, x) -> n + if(x.t <= {at}, x.up, 0))"


def without_target(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The references (row_id, key, at) whose key has no target at that time."""
    refs = refs.filter("key is not null").select("row_id", "key", "at")
    flips = cut(changes(targets))
    per_key = flips.groupBy("key").agg(F.count("*").alias("n"))
    busy = cut(per_key.filter(f"n > {FEW}").select("key"))
    n_busy = busy.count()
    often = small(busy, n_busy)
    few = flips.join(often, "key", "left_anti") if n_busy else flips
    arrays = cut(few.groupBy("key").agg(F.collect_list(F.struct("t", "up")).alias("times")))  # FEW times at most
    out = refs.join(small(arrays, arrays.count(), BROADCAST_KEYS), "key", "left").withColumn("state", F.expr(f"if(times is null, 0, {_state('times', 'at')})")).drop("times")
    if n_busy:
        # per day of a busy key the changes of that day, and the state it begins with; days without a change get the state of the day before
        by_day = flips.join(often, "key", "left_semi").withColumn("day", F.to_date("t")).groupBy("key", "day").agg(F.collect_list(F.struct("t", "up")).alias("times"), F.sum("up").alias("net"))
        last = refs.agg(F.max(F.to_date("at"))).first()[0]
        w = "over (partition by key order by day"  # a key has no more rows than days
        days = by_day.selectExpr(
            "key", "day", "times", f"coalesce(sum(net) {w} rows between unbounded preceding and 1 preceding), 0L) as base", "net", f"coalesce(date_sub(lead(day) {w}), 1), greatest(day, cast({'null' if last is None else repr(str(last))} as date)), day) as until"
        ).selectExpr("key", "times", "base", "net", "day as first", "explode(sequence(day, until)) as day")
        days = cut(days.selectExpr("key", "day", "if(day = first, base, base + net) as base", "if(day = first, times, slice(times, 1, 0)) as times"))
        dated = out.withColumn("day", F.to_date("at")).join(small(days, days.count(), BROADCAST_KEYS), ["key", "day"], "left")
        out = dated.withColumn("state", F.expr(f"state + if(times is null, 0, base + {_state('times', 'at')})"))
    return out.filter("at is null or state <= 0").select("row_id", "key", "at")


class Cascade:
    """Direct and inherited orphans along a graph of foreign keys."""

    def __init__(self, keys: list[ForeignKey]) -> None:
        self.keys = keys

    def direct(self) -> DataFrame:
        """(ref_table, ref_field, row_id, at): references without a target."""
        parts = [without_target(k.refs, k.targets).select(F.lit(k.child_table).alias("ref_table"), F.lit(k.field).alias("ref_field"), "row_id", "at") for k in self.keys]
        return reduce(DataFrame.unionByName, parts)

    def orphans(self) -> DataFrame:
        """(ref_table, ref_field, row_id, at, kind, depth): kind is direct or inherited, depth the number of rounds."""
        found = cut(self.direct().select("*", F.lit("direct").alias("kind"), F.lit(0).alias("depth")))
        new, depth, tables = found, 0, {k.child_table for k in self.keys}
        while not new.isEmpty():
            depth += 1
            parts = []
            for k in [k for k in self.keys if k.parent_table in tables]:  # records of other tables are never orphans
                lost = found.filter(F.col("ref_table") == k.parent_table).select(F.col("row_id").alias("record")).distinct()
                fresh = new.filter(F.col("ref_table") == k.parent_table).select(F.col("row_id").alias("record")).distinct()
                touched = k.targets.join(fresh, "record", "left_semi").select("key").distinct()
                children = k.refs.join(touched, "key", "left_semi").select("row_id", "key", "at")
                mine = found.filter((F.col("ref_table") == k.child_table) & (F.col("ref_field") == k.field)).select("row_id")
                left = k.targets.join(lost, "record", "left_anti").join(touched, "key", "left_semi")
                parts.append(
                    without_target(children, left)
                    .join(mine, "row_id", "left_anti")
                    .select(F.lit(k.child_table).alias("ref_table"), F.lit(k.field).alias("ref_field"), "row_id", "at", F.lit("inherited").alias("kind"), F.lit(depth).alias("depth"))
                )
            if not parts:
                break
            new = cut(reduce(DataFrame.unionByName, parts))
            found = found.unionByName(new)
        return found

    def report(self) -> DataFrame:
        """(ref_table, ref_field, month, refs, direct, inherited): counts per table, field and month of the reference."""
        every = reduce(
            DataFrame.unionByName,
            [k.refs.filter("key is not null").select(F.lit(k.child_table).alias("ref_table"), F.lit(k.field).alias("ref_field"), F.date_format("at", "yyyy-MM").alias("month"), F.lit("any").alias("kind")) for k in self.keys],
        )
        bad = self.orphans().select("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month"), "kind")
        return every.unionByName(bad).groupBy("ref_table", "ref_field", "month").agg(*[F.count(F.when(F.col("kind") == kind, 1)).alias(name) for kind, name in (("any", "refs"), ("direct", "direct"), ("inherited", "inherited"))])


#: A quoted string as a printed list has it.
QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def listed_captions(captions: Column) -> Column:
    """The captions; a one-element list with a printed list in it stands for the quoted captions printed there."""
    only = strip(F.try_element_at(captions, F.lit(1)))
    printed = (F.size(captions) == 1) & only.startswith("[") & only.endswith("]")
    quoted = F.regexp_extract_all(only, F.lit(QUOTED), F.lit(0))
    return F.when(printed, F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))).otherwise(captions)


def furniture_keys(finetuning: DataFrame, catalogue: DataFrame, captions: DataFrame) -> list[ForeignKey]:
    """The foreign keys between training entries, the model catalogue and the captions table."""
    models = catalogue.select(F.col("dir_id").alias("record"), hex_id(F.col("model_id")).alias("key"), F.col("added_at").alias("start"), F.col("removed_at").alias("end"))
    entry = finetuning.select(F.col("entry_id").alias("row_id"), hex_id(F.col("model_id")).alias("id"), "caption_no", F.col("created_at").alias("at"))
    text = captions.select(F.col("row_id").alias("record"), hex_id(F.col("object_id")).alias("id"), "captions", F.col("added_at").alias("start"))
    places = text.select("record", "id", "start", F.posexplode(listed_captions(F.col("captions"))).alias("place", "caption")).filter(strip(F.col("caption")) != "")
    place_key = lambda id_, place: F.concat(id_, F.lit("/"), place.cast("string"))  # noqa: E731  null if either is
    return [
        ForeignKey("finetuning_data", "model_id", "partnet_meta", entry.select("row_id", F.col("id").alias("key"), "at"), models),
        ForeignKey("stabletext2brick", "object_id", "partnet_meta", text.select(F.col("record").alias("row_id"), F.col("id").alias("key"), F.col("start").alias("at")), models),
        ForeignKey(
            "finetuning_data",
            "caption_no",
            "stabletext2brick",
            entry.select("row_id", place_key(F.col("id"), F.col("caption_no")).alias("key"), "at"),
            places.select("record", place_key(F.col("id"), F.col("place")).alias("key"), "start", F.lit(None).cast("timestamp_ntz").alias("end")),
        ),
    ]
