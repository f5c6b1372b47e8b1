"""Consensus from several annotators, weighted by spectral reliability.

A rating is a point: its label's unit vector less the shares of the labels in that metric, so that two annotators who
label independently agree 0 on average. Entry (i, j) of the agreement matrix is the mean product of the points that i
and j gave the same items; under the one-coin model it is r_i * r_j * (1 - sum of squared shares), with r the
reliability, the chance-corrected share of right answers. The leading eigenvector of that matrix, each entry counted
by its overlap and the diagonal left out, gives r. The matrix is never formed: with per-item sums of the present
weights, one step of the power iteration is a join of the ratings with the annotators' weights, a sum per item, a join
back, and a sum per annotator of numerators and overlap-weighted denominators.

Votes are then weighted by the log-odds of the reliabilities; the label of an item is the most likely one.

Items and annotators are iterated over by 64-bit hashes of their names; names are counted per hash, and should two share one, all are
hashed anew with the next seed, so no two are ever taken for one. The ratings are kept partitioned by item; an item with more than HOT ratings is cut into slices by annotator, whose
sums are added up before the join back. Memory per task does not depend on the size of an item.

Defined results: cells that don't read as a label, null models, unreadable items and null annotators are left out; of
several rows of an annotator for an item the one with the latest time counts, of equally late ones the one loaded last,
then the higher label; rows without a time come before all others; equally likely labels give the smaller one; an
annotator whose items nobody else rated keeps the initial reliability; empty tables give empty results; other columns
do not matter.
"""

from __future__ import annotations

import itertools
import math
import warnings

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions.keys import number, strip
from joinery.session import cut, small

METRICS = ("assemblability", "prompt_satisfaction", "design_quality")
LABELS = (1, 2, 3)
#: Ratings of one item from which it is cut into slices.
HOT = 50_000
START, STEPS, CLOSE = 0.6, 60, 1e-3


def usable_ratings(ratings: DataFrame) -> DataFrame:
    """(reviewer, model, item, one label column per metric): one row per reviewer and design, labels null where unusable."""

    def label(m: str) -> Column:
        v = number(F.col(m))
        return F.when(v.isin(*[float(x) for x in LABELS]), v.cast("long"))

    def micros(c: str) -> Column:
        return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-(1 << 60)))

    rows = ratings.select(
        "reviewer", F.lower(strip(F.col("model_type"))).alias("model"), number(F.col("experiment_id")).alias("item"), micros("rated_at").alias("at"), micros("loaded_at").alias("late"), *[label(m).alias(m) for m in METRICS]
    ).filter("reviewer is not null and model is not null and item is not null")

    def best(m: str) -> Column:
        """The row with the latest usable cell, of equally late ones the one loaded last, then the higher label."""
        return F.max(F.when(F.col(m).isNotNull(), F.struct("at", "late", m))).alias(m)

    got = rows.groupBy("reviewer", "model", "item").agg(*[best(m) for m in METRICS])
    return got.select("reviewer", "model", "item", *[F.col(f"{m}.{m}").cast("int").alias(m) for m in METRICS]).filter(" or ".join(f"{m} is not null" for m in METRICS))


def _of_label(m: str, names: list[str]) -> str:
    """SQL: of one column per label, the one of the row's label; null without a label."""
    return f"case {m} " + " ".join(f"when {k} then {n}" for k, n in zip(LABELS, names)) + " end"


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _hashed(seed: int, *names: str) -> Column:
    return F.xxhash64(F.lit(seed), *names)


class Consensus:
    """Reliabilities and labels of one table of ratings."""

    def __init__(self, ratings: DataFrame) -> None:
        parts = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # whole rows by name, and the rows that are iterated over, by hashes of the names
        usable = cut(usable_ratings(ratings))
        for seed in itertools.count(42):
            rows = usable.withColumn("who", _hashed(seed, "reviewer")).withColumn("cell", _hashed(seed, "model", "item"))
            name = F.struct("model", "item")
            sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("count"), (F.min(name) != F.max(name)).alias("shared")).filter(f"shared or count > {HOT}"))  # at most one row per HOT ratings, but for shared hashes
            if sizes.filter("shared").isEmpty() and rows.groupBy("who").agg(F.min("reviewer").alias("a"), F.max("reviewer").alias("b")).filter("a <> b").isEmpty():
                break
        hot = sizes.select("cell", F.ceil(F.col("count") / HOT).cast("int").alias("slices"))
        self.hot, self.n_hot = hot, hot.count()
        rows = rows.join(small(hot, self.n_hot), "cell", "left") if self.n_hot else rows.withColumn("slices", F.lit(None).cast("int"))
        rows = rows.withColumn("slice", F.coalesce(F.pmod("who", F.col("slices")), F.lit(0)).cast("int")).drop("slices")
        self.named = rows.select("reviewer", "who", "model", "item", "cell", "slice", *METRICS)
        self.rows = rows.select("who", "cell", "slice", *METRICS).repartition(parts, "cell", "slice").persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.count(F.when(F.col(m) == k, 1)).alias(f"{m}{k}") for m in METRICS for k in LABELS]
        per_annotator = cut(self.rows.groupBy("who").agg(*counts))
        self.n_reviewers = per_annotator.count()
        total = per_annotator.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_annotator.columns[1:]]).first()
        self.shares = {m: [total[f"{m}{k}"] / max(1, sum(total[f"{m}{j}"] for j in LABELS)) for k in LABELS] for m in METRICS}
        self.scale = {m: math.sqrt(max(1e-9, 1 - sum(p * p for p in self.shares[m]))) for m in METRICS}
        self.weights = self._iterate(per_annotator)

    def per_item(self, sums: list[str], weighted: DataFrame) -> DataFrame:
        """Sums per item and slice; the slices of a hot item all get its total."""
        by_slice = weighted.groupBy("cell", "slice").agg(*map(F.expr, sums))
        if not self.n_hot:
            return by_slice
        names = [c for c in by_slice.columns if c not in ("cell", "slice")]
        total = by_slice.join(small(self.hot.select("cell"), self.n_hot), "cell").groupBy("cell").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
        return by_slice.join(small(total, self.n_hot), "cell", "left").select("cell", "slice", *[F.coalesce(f"all_{c}", c).alias(c) for c in names])

    def _iterate(self, per_annotator: DataFrame) -> DataFrame:
        """(who, a weight per metric): the leading eigenvector, scaled so that products of weights are expected agreements.

        Per item, `h_k` is the weighted sum of all its points times the point of label k. An annotator's numerator is the sum of
        h over the own labels, less the own share of it; the denominator is the sum of squared weights of the others.
        """
        own = []
        for m in METRICS:
            p = self.shares[m]
            p2 = sum(x * x for x in p)
            own += [f"{_sum([f'{m}{k}' for k in LABELS])} as n_{m}", f"{_sum([f'{m}{k} * {1 - 2 * p[i] + p2!r}D' for i, k in enumerate(LABELS)])} as o_{m}"]
        fixed = cut(per_annotator.selectExpr("who", *own))
        weights = fixed.selectExpr("who", *[f"{START * self.scale[m]!r}D as v_{m}" for m in METRICS])
        for step in range(STEPS):
            weighted = self.rows.join(small(weights, self.n_reviewers), "who")
            sums, points, steps = [], [], []
            for m in METRICS:
                p = self.shares[m]
                p2 = sum(x * x for x in p)
                sums += [f"sum(if({m} = {k}, v_{m}, 0D)) as s{k}_{m}" for k in LABELS] + [f"sum(if({m} is not null, v_{m} * v_{m}, 0D)) as q_{m}"]
                # h_k = s_k - p_k * T - sum(p * s) + p2 * T, with T the sum of s
                points += [f"{_sum([f's{j}_{m} * {(j == k) - p[i] - p[n] + p2!r}D' for n, j in enumerate(LABELS)])} as h{k}_{m}" for i, k in enumerate(LABELS)] + [f"q_{m}"]
                num, den = f"(h_{m} - v_{m} * o_{m})", f"(q_{m} - v_{m} * v_{m} * n_{m})"
                steps += [f"v_{m}", f"n_{m}", f"if({den} > 1e-9, {num} / {den}, v_{m}) as t_{m}"]
            items = self.per_item(sums, weighted).selectExpr("cell", "slice", *points)
            both = self.rows.join(items.hint("shuffle_hash"), ["cell", "slice"])
            got = both.groupBy("who").agg(*[F.expr(x) for m in METRICS for x in (f"sum({_of_label(m, [f'h{k}_{m}' for k in LABELS])}) as h_{m}", f"sum(if({m} is not null, q_{m}, null)) as q_{m}")])
            new = got.join(weights, "who").join(fixed, "who")
            raw = cut(new.selectExpr("who", *steps))
            # from weights c times too large the step leads to weights c times too small; c is the root of this ratio
            size = raw.agg(*[F.sum(F.expr(f"n_{m} * v_{m} * {x}_{m}")).alias(f"{x}_{m}") for m in METRICS for x in ("v", "t")]).first()
            new_v = []
            for m in METRICS:
                v, t = size[f"v_{m}"] or 0.0, size[f"t_{m}"] or 0.0
                c = math.sqrt(v / t) if v > 0 and t > 0 else 1.0
                new_v.append(f"greatest(-1D, least(1D, t_{m} * {c!r}D))")
            # the largest move of an annotator; the last weights are kept as they are, since a half step would not be tested
            moves = [f"if(n_{m} > 0, abs({x} - v_{m}), 0D)" for x, m in zip(new_v, METRICS)]
            self.steps, self.moved = step + 1, raw.selectExpr(f"max(greatest({', '.join(moves)}))").first()[0] or 0.0
            # every other step goes half way: a community apart from the others has its own scale, which whole steps would turn over for ever
            weights = raw.selectExpr("who", *[f"{x} as v_{m}" if step % 2 == 0 or self.moved < CLOSE else f"(v_{m} + {x}) / 2 as v_{m}" for x, m in zip(new_v, METRICS)])
            if self.moved < CLOSE:
                return weights
        warnings.warn(f"reliabilities still move by {self.moved:.4f} after {STEPS} steps", stacklevel=3)
        return weights

    def items(self) -> DataFrame:
        """(cell, slice, and per metric the label, each label's probability, the number of ratings and their agreement)."""
        cols, sums, out = [], [], []
        for m in METRICS:
            r = f"least(greatest(v_{m} / {self.scale[m]!r}D, -0.3D), 0.97D)"
            for i, k in enumerate(LABELS):
                p = f"{min(max(self.shares[m][i], 1e-6), 1 - 1e-6)!r}D"
                cols.append(f"ln(greatest({r} + (1 - {r}) * {p}, 0.02D) / greatest((1 - {r}) * {p}, 1e-6D)) as w{k}_{m}")
            sums += [f"sum(if({m} = {k}, w{k}_{m}, 0D)) as s{k}_{m}" for k in LABELS] + [f"count(if({m} = {k}, 1, null)) as c{k}_{m}" for k in LABELS]
            score = [f"(s{k}_{m} + {math.log(max(self.shares[m][i], 1e-9))!r}D)" for i, k in enumerate(LABELS)]
            top = f"greatest({', '.join(score)})"
            norm = _sum([f"exp({x} - {top})" for x in score])
            n = _sum([f"c{k}_{m}" for k in LABELS])
            out.append(f"case when {n} = 0 then null " + " ".join(f"when {x} = {top} then {k}" for x, k in zip(score, LABELS)) + f" end as label_{m}")
            out += [f"if({n} > 0, exp({x} - {top}) / {norm}, null) as p{k}_{m}" for x, k in zip(score, LABELS)]
            out += [f"{n} as n_{m}", f"if({n} > 1, {_sum([f'c{k}_{m} * (c{k}_{m} - 1)' for k in LABELS])} / ({n} * ({n} - 1)), null) as agree_{m}"]
        weighted = self.rows.join(small(self.weights.selectExpr("who", *cols), self.n_reviewers), "who")
        return self.per_item(sums, weighted).selectExpr("cell", "slice", *out)

    def labels(self) -> DataFrame:
        """(model_type, experiment_id, metric, label, probability, ratings, agreement): agreement is the share of pairs of ratings that are equal."""
        names = self.named.groupBy("cell").agg(F.first("model").alias("model_type"), F.first("item").cast("long").alias("experiment_id"))
        once = self.items().dropDuplicates(["cell"]) if self.n_hot else self.items()
        each = [
            F.struct(
                F.lit(m).alias("metric"), F.col(f"label_{m}").alias("label"), F.greatest(*[F.col(f"p{k}_{m}") for k in LABELS]).alias("probability"), F.col(f"n_{m}").alias("ratings"), F.col(f"agree_{m}").alias("agreement")
            )
            for m in METRICS
        ]
        return once.join(names, "cell").select("model_type", "experiment_id", F.explode(F.array(*each)).alias("x")).select("model_type", "experiment_id", "x.*").filter("ratings > 0")

    def reliability(self) -> DataFrame:
        """(reviewer, metric, ratings, right_share, consensus_share, reliability, steps, last_move).

        right_share is the expected share of ratings equal to what the item deserves, consensus_share that of ratings equal to
        the consensus label. steps and last_move say how the iteration ended: after how many steps, and the largest move of an annotator in the last.
        """
        both = self.rows.join(self.items().hint("shuffle_hash"), ["cell", "slice"])
        aggs = [x for m in METRICS for x in (f"count({m}) as n_{m}", f"avg({_of_label(m, [f'p{k}_{m}' for k in LABELS])}) as r_{m}", f"avg(cast({m} = label_{m} as int)) as h_{m}")]
        names = self.named.groupBy("who").agg(F.first("reviewer").alias("reviewer"))
        got = both.groupBy("who").agg(*map(F.expr, aggs)).join(self.weights, "who").join(names, "who")
        each = [
            F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("ratings"), F.col(f"r_{m}").alias("right_share"), F.col(f"h_{m}").alias("consensus_share"), (F.col(f"v_{m}") / self.scale[m]).alias("reliability"))
            for m in METRICS
        ]
        long = got.select("reviewer", F.explode(F.array(*each)).alias("x")).select("reviewer", "x.*").filter("ratings > 0")
        return long.withColumns({"steps": F.lit(self.steps), "last_move": F.lit(float(self.moved))})

    def finished(self, result: DataFrame) -> DataFrame:
        """A result of this table in the shared folder, and the ratings taken out of memory."""
        out = cut(result)
        self.rows.unpersist()
        return out


def consensus(ratings: DataFrame) -> DataFrame:
    """The labels of `Consensus`, finished."""
    c = Consensus(ratings)
    return c.finished(c.labels())


def reliabilities(ratings: DataFrame) -> DataFrame:
    """The reliabilities of `Consensus`, finished."""
    c = Consensus(ratings)
    return c.finished(c.reliability())


def unreliable(ratings: DataFrame, least: int = 12, share: float = 0.55) -> DataFrame:
    """(reviewer, metric): annotators with at least `least` usable ratings, of which fewer than `share` are right."""
    return reliabilities(ratings).filter((F.col("ratings") >= least) & (F.col("right_share") < share)).select("reviewer", "metric")
