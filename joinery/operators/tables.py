"""Table operators of dataset building: de-duplication by an explicit order, set operations, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.operators.pick import pick


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, with all their columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_by(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row of each key: the first (or last) by the given order, which should tell all rows apart. An aggregation, so nothing is sorted."""
    names = rows.columns
    pick_one = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick_one(F.struct(*[c for c in names if c not in keys]), F.struct(*order)).alias("_x")).select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in names])


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids."""
    return rows.join(ids.select(key), key, "left_semi")


def left_join_first(rows: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each row with the first row of its key on the right, or nulls."""
    return rows.join(first_by(right, [key], order), key, "left")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common, either, iou): distinct rows in both and in either; iou is 0 where there are none.

    One aggregation over both sides instead of an intersection and a union.
    """
    names = a.columns
    marks = a.select(*names, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*names, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    seen = marks.groupBy(*names).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n = seen.agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("common"), F.count("*").alias("either"))
    return n.withColumn("iou", F.when(F.col("either") > 0, F.col("common") / F.col("either")).otherwise(F.lit(0.0)))


def train_test(rows: DataFrame, ids: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds `split`: exactly ceil(share * n) rows, at random by a seeded hash of the ids, are test, the others train."""
    n = rows.count()
    quota = rows.sparkSession.createDataFrame([(0, -int(-share * n // 1))], "_one int, quota bigint")
    marked = rows.withColumn("_one", F.lit(0))
    test = pick(marked.select("_one", *ids), quota, ["_one"], ids, seed).select(*ids, F.lit("test").alias("split"))
    return rows.join(test, ids, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def shuffled(rows: DataFrame, ids: list[str], seed: int = 42) -> DataFrame:
    """All rows in a seeded random order: a range-partitioned sort by hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *ids), *ids)


def some(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows at random; a top-n by a random key, so no full sort."""
    return rows.orderBy(F.rand(seed)).limit(n)


def run_lengths(rows: DataFrame, key: list[str], order: list[str], value: str, longest: int = 255) -> DataFrame:
    """(key, run, value, start, length): maximal runs of equal values in order, cut to at most `longest`.

    The value changes number the runs (gaps and islands); a key's rows are one window, so a key should be one
    sequence, such as one voxel model or one user.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*key).orderBy(*order)
    seq = rows.select(*key, F.col(value).alias("value"), (F.row_number().over(w) - 1).alias("_i"), F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1)).alias("_new"))
    seq = seq.withColumn("_run", F.sum("_new").over(Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = seq.groupBy(*key, "_run").agg(F.first("value").alias("value"), F.min("_i").alias("start"), F.count("*").alias("n"))
    cut = runs.withColumn("_k", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / longest).cast("int"))))
    cut = cut.select(*key, "value", (F.col("start") + F.col("_k") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("_k") * longest).cast("int").alias("length"))
    return cut.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("start")) - 1).alias("run"), "value", "start", "length")


def run_ends(runs: DataFrame, key: list[str]) -> DataFrame:
    """Adds `upto`, the number of elements up to the end of each run: the prefix sum of the lengths."""
    from pyspark.sql.window import Window

    return runs.withColumn("upto", F.sum("length").over(Window.partitionBy(*key).orderBy("run")))


def not_among(a: Column, b: Column) -> Column:
    """The elements of an array that are not in another."""
    return F.array_except(a, b)


def every_nth(rows: DataFrame, index: str, n: int) -> DataFrame:
    """The rows of which the index is a multiple of n."""
    return rows.filter(F.col(index) % n == 0)


def at_most(rows: DataFrame, n: int) -> DataFrame:
    """No more than n rows."""
    return rows.limit(n)
