"""Exactly k rows of each group, at random by a seeded hash, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups are cut into this many buckets of hash values; only the one that the k-th row falls into is sorted.
BUCKETS = 4096


def pick(rows: DataFrame, quotas: DataFrame, keys: list[str], order: list[str], seed: int = 42) -> DataFrame:
    """The columns of rows, for the `quota` rows of each group with the smallest hash of (seed, order).

    quotas: (keys, quota), one row per group. Rows equal in all of `order` are interchangeable. A quota of 0 or less and
    a missing or null quota pick nothing; one beyond the group picks all of it. Null keys are a group like any other.
    """
    names = rows.columns
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *order)).withColumn("_bucket", F.shiftrightunsigned("_hash", 52).cast("int"))
    sizes = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))  # at most BUCKETS rows per group
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")))
    on = [upto[k].eqNullSafe(F.col(f"_q_{k}")) for k in keys]
    quota = quotas.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("quota").alias("_quota"))
    wanted = upto.join(quota, on).withColumn("_left", F.col("_quota") - (F.col("_upto") - F.col("_n"))).filter("_left > 0")
    wanted = wanted.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("_bucket").alias("_b"), F.least("_left", "_n").alias("_take"), (F.col("_left") >= F.col("_n")).alias("_whole"))
    kept = hashed.join(wanted, [hashed[k].eqNullSafe(F.col(f"_q_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b")])
    whole = kept.filter("_whole").select(*names)
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", *order))
    part = kept.filter("not _whole").withColumn("_rank", rank).filter("_rank <= _take").select(*names)
    return whole.unionByName(part)
