"""Samples whose categories have target shares, by swap repair over category signatures.

The signature of a row, in one request, is the set of the request's targets it meets; rows that meet none share the
empty signature. Rows are counted by signature, at most one row per set of targets that occurs. A request then starts
from a random sample that satisfies the floors (floors first, the rest drawn from what is left, as counts a multivariate
hypergeometric draw), and exchanges counts between two signatures as long as that lowers the deviation from what is wanted,
each time by the best exchange, as many at once as help. The counts are then drawn as rows, at random.

A target's goal is max(min_rows, floor(target_share * n)), n = floor(sample_frac * usable rows); products within 1e-9
of a whole number count as that number. Wanted of a target is its goal, or all rows of its category if these are fewer; what is then missing
from n is wanted of the targets with rows left, in proportion to their shares. The empty signature counts as one more target,
whose share is what the shares leave of 1, mostly nothing: so a row outside all targets is drawn only where such a share
asks for it or the requested categories have no row left.

A target is unmet if the repaired sample falls short of its goal and the pool itself has fewer rows of its category.

Defined results: null shares, floors and fractions count as 0; a target without any category field is met by no row;
of repeated prompts one row is used, the smallest; requests whose floors exceed n keep the floors and so exceed n;
empty pools make all positive goals unmet; empty targets give empty results; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinery.functions.keys import letters
from joinery.operators.pick import pick
from joinery.session import cut, small

SEED = 42
POOLS = ("experiments", "partnet_meta")
DISTRIBUTIONS = ("indistribution", "outofdistribution")


def usable(experiments: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(pool, row_id, distribution, difficulty_level, model_cat): the rows that may be sampled; names as they compare."""
    e = experiments.select("prompt_id", letters(F.col("distribution")).alias("distribution"), "difficulty_level").filter(
        F.col("distribution").isin(*DISTRIBUTIONS) & F.col("difficulty_level").between(1, 3) & F.col("prompt_id").isNotNull()
    )
    one = e.groupBy("prompt_id").agg(F.min(F.struct("distribution", "difficulty_level")).alias("x"))
    left = one.select(F.lit(POOLS[0]).alias("pool"), F.col("prompt_id").cast("bigint").alias("row_id"), "x.distribution", F.col("x.difficulty_level").cast("int").alias("difficulty_level"), F.lit(None).cast("string").alias("model_cat"))
    right = catalogue.select(
        F.lit(POOLS[1]).alias("pool"), F.col("dir_id").cast("bigint").alias("row_id"), F.lit(None).cast("string").alias("distribution"), F.lit(None).cast("int").alias("difficulty_level"), letters(F.col("model_cat")).alias("model_cat")
    ).filter("model_cat is not null")
    return left.unionByName(right)


def _whole(c: str) -> str:
    return f"cast(floor({c} + 1e-9) as bigint)"


def signatures(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(request_id, pool, distribution, difficulty_level, model_cat, rows, met): the categories of each request's pool, with the targets each meets."""
    cells = pool.groupBy("pool", "distribution", "difficulty_level", "model_cat").agg(F.count("*").alias("rows"))  # one row per category
    requests = targets.select("request_id", "pool").distinct()
    n = targets.count()
    base = cells.join(small(requests, n), "pool")
    t = targets.select(
        "request_id", F.col("pool").alias("t_pool"), "target_id", letters(F.col("distribution")).alias("t_d"), F.col("difficulty_level").alias("t_l"), letters(F.col("model_cat")).alias("t_c")
    ).filter("t_d is not null or t_l is not null or t_c is not null")
    fits = (
        (F.col("pool") == F.col("t_pool"))
        & (F.col("t_d").isNull() | (F.col("t_d") == F.col("distribution")))
        & (F.col("t_l").isNull() | (F.col("t_l") == F.col("difficulty_level")))
        & (F.col("t_c").isNull() | (F.col("t_c") == F.col("model_cat")))
    )
    t = t.withColumnRenamed("request_id", "t_request")
    joined = base.join(small(t, n), (F.col("request_id") == F.col("t_request")) & fits, "left")
    return joined.groupBy("request_id", "pool", "distribution", "difficulty_level", "model_cat").agg(F.first("rows").alias("rows"), F.array_sort(F.collect_set("target_id")).alias("met"))


def goals(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(request_id, pool, target_id, goal, floor, have, n): have counts the pool's rows of the category."""
    size = pool.groupBy("pool").agg(F.count("*").alias("usable"))  # a row per pool
    have = signatures(pool, targets).select("request_id", "rows", F.explode("met").alias("target_id")).groupBy("request_id", "target_id").agg(F.sum("rows").alias("have"))
    t = targets.join(F.broadcast(size), "pool", "left").join(have, ["request_id", "target_id"], "left")
    t = t.selectExpr(
        "request_id", "pool", "target_id", "coalesce(target_share, 0D) as share", "coalesce(min_rows, 0) as floor", "coalesce(have, 0L) as have", f"coalesce({_whole('coalesce(sample_frac, 0D) * coalesce(usable, 0L)')}, 0L) as n"
    )
    return t.selectExpr("request_id", "pool", "target_id", "share", f"greatest(cast(floor as bigint), {_whole('share * n')}) as goal", "floor", "have", "n")


def unmet(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id): targets whose goal the repaired sample does not reach, since the pool holds too few rows of their category."""
    return report(pool, targets).filter("not met and not can_be_met").select("target_id").distinct()


def wanted(have: np.ndarray, goal: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """How many rows each target should get: its goal as far as its rows go, and its part of what the others lack."""
    want = np.minimum(goal, have)
    while (lack := n - int(want.sum())) > 0 and (open_ := (want < have) & (share > 0)).any():
        part = np.where(open_, share, 0.0) * (lack / share[open_].sum())
        add = np.minimum(np.floor(part + 1e-9).astype(np.int64), have - want)
        if not add.any():  # less than one each: the largest parts get one
            order = np.flatnonzero(open_)[np.argsort(-part[open_], kind="stable")]
            add[order[:lack]] = 1
        want = want + add
    return want


def repair(size: np.ndarray, meets: np.ndarray, goal: np.ndarray, floor: np.ndarray, n: int, rng: np.random.Generator, share: np.ndarray | None = None) -> np.ndarray:
    """How many rows of each signature to draw. size: rows by signature; meets: signature x target; goal, floor, share: by target."""
    share = goal / max(1, n) if share is None else share
    # the rows outside all targets are one more target
    outside = (meets.sum(axis=1) == 0).astype(meets.dtype)
    spare = max(0.0, 1 - float(share.sum()))
    spare = spare if spare > 1e-9 else 0.0
    meets = np.column_stack([meets, outside])
    goal, share, floor = np.append(goal, int(spare * n + 1e-9)), np.append(share, spare), np.append(floor, 0)
    take = np.zeros(len(size), dtype=np.int64)
    for t in np.argsort(meets.T @ size):
        lack = int(min(floor[t], meets[:, t] @ size) - meets[:, t] @ take)
        if lack > 0:
            free = np.where(meets[:, t], size - take, 0)
            take += rng.multivariate_hypergeometric(free, lack, method="marginals")
    rest = int(min(n - take.sum(), (size - take).sum()))
    if rest > 0:
        take += rng.multivariate_hypergeometric(size - take, rest, method="marginals")
    want = wanted(meets.T @ size, goal, share, n)
    least = np.minimum(floor, meets.T @ size)
    while True:
        # the deviation after moving 1, 2, 4 ... or as many rows as possible from one signature to another
        over = meets.T @ take - want
        best = (int(np.abs(over).sum()), 0, 0, 0)
        for a in np.flatnonzero(take):
            for b in np.flatnonzero(size - take):
                change = meets[b] - meets[a]
                if a == b or not change.any():
                    continue
                most = int(min(take[a], size[b] - take[b]))
                steps = np.unique(np.append(1 << np.arange(most.bit_length()), most))
                after = over + steps[:, None] * change
                value = np.where((after + want >= least).all(axis=1), np.abs(after).sum(axis=1), best[0])
                k = int(np.argmin(value))
                if value[k] < best[0]:
                    best = (int(value[k]), a, b, int(steps[k]))
        if not best[3]:
            return take
        take[best[1]] -= best[3]
        take[best[2]] += best[3]


def allocation(pool: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(request_id, pool, met, quota): rows to draw of each signature.

    One task has one request's signatures: no more than the sets of its targets that occur.
    """
    sig = signatures(pool, targets)
    by_set = sig.groupBy("request_id", "pool", "met").agg(F.sum("rows").alias("rows"))
    g = goals(pool, targets).withColumnRenamed("request_id", "request")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.assign(_k=[tuple(x) for x in left["met"]]).sort_values("_k").reset_index(drop=True)
        right = right.sort_values("target_id").reset_index(drop=True)
        meets = np.array([[t in k for t in right["target_id"]] for k in left["_k"]], dtype=np.int64).reshape(len(left), len(right))
        n = int(right["n"].max()) if len(right) else 0
        take = repair(left["rows"].to_numpy(np.int64), meets, right["goal"].to_numpy(np.int64), right["floor"].to_numpy(np.int64), n, np.random.default_rng([seed, int(key[0])]), right["share"].to_numpy(float))
        return left.assign(quota=take)[["request_id", "pool", "met", "quota"]]

    return by_set.groupBy("request_id").cogroup(g.groupBy("request")).applyInPandas(run, "request_id int, pool string, met array<int>, quota bigint")


def sample(pool: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(request_id, pool, row_id): the rows drawn for each request."""
    sig = signatures(pool, targets).select("request_id", "pool", "distribution", "difficulty_level", "model_cat", F.array_join("met", ",").alias("signature"))
    sig = cut(sig)
    # null-safe on the category fields, by one text that names them
    cell = F.concat_ws("|", F.coalesce("distribution", F.lit("-")), F.coalesce(F.col("difficulty_level").cast("string"), F.lit("-")), F.coalesce("model_cat", F.lit("-"))).alias("cell")
    rows = pool.select("pool", "row_id", cell).join(sig.select("request_id", "pool", cell, "signature"), ["pool", "cell"]).select("request_id", "pool", "signature", "row_id")
    quotas = allocation(pool, targets, seed).select("request_id", "pool", F.array_join("met", ",").alias("signature"), "quota")
    return pick(rows, quotas, ["request_id", "pool", "signature"], ["row_id"], seed).select("request_id", "pool", "row_id")


def report(pool: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(request_id, target_id, goal, have, drawn, outside, can_be_met, met): goals, and what the repaired sample has of each; outside: the request's drawn rows that meet no target."""
    taken = allocation(pool, targets, seed).select("request_id", F.explode_outer("met").alias("target_id"), "quota").groupBy("request_id", "target_id").agg(F.sum("quota").alias("drawn"))
    drawn, outside = taken.filter("target_id is not null"), taken.filter("target_id is null").select("request_id", F.col("drawn").alias("outside"))
    g = goals(pool, targets).join(drawn, ["request_id", "target_id"], "left").join(outside, "request_id", "left")
    return g.selectExpr("request_id", "target_id", "goal", "have", "coalesce(drawn, 0L) as drawn", "coalesce(outside, 0L) as outside", "have >= goal as can_be_met", "coalesce(drawn, 0L) >= goal as met")
