"""Same or near-same designs across splits, by a weighted cosine join.

Equal designs (the same pieces in any order) are one class. The vector of a class has a term for each cell of a grid
that its pieces fall in, weighted by how many do; on the evaluation side a piece counts in every cell that a piece
within the tolerance of it could fall in. So if m pieces match one to one, the dot product of the two vectors is m or
more, and a pair counts only if that reaches `share` of the longer design: each vector needs a dot product of at
least `share` of its own pieces.

Terms are ordered from rare to frequent. A vector's inverted-list entries are only as many of its rarest terms as it
takes until the rest can't bring more than a set part of what it needs; the rest is bounded by the weights times the
largest weight of the term on the other side, and by the norm of the rest times the largest norm on the other side.
Both sides are cut by the same order, so a pair that reaches its need shares entries worth at least the other part.
Vectors that can't reach their need at all drop out, and pairs whose numbers of pieces are too unlike are never made. Pairs of classes
with enough in common get their dot product from the whole vectors, and the exact matching of pieces decides. The cosine
of a pair is that of its two plain vectors, pieces per cell on both sides: 1 for equal designs.

Classes are joined, not their copies: a group of copies is one vector however large it is. Only the result of
`found` lists entries pair by pair, as its form asks.

Defined results: null or empty messages, designs without a piece, and null ids or splits are in no pair; numbers may be
written with decimals; repeated rows give a pair once; empty tables give an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.functions.designs import LINES, last_content, piece_line, piece_numbers
from joinery.functions.keys import strip
from joinery.session import cut

#: Width of a grid cell, in the numbers' unit. Cells are centred on 0 so that upright pieces (angles 0 and 90) fall inside one.
WIDTH = 16.0
#: The part of its need that a vector may leave outside its inverted-list entries.
OUTSIDE = 0.6
TRAIN, EVALUATION = ("train",), ("val", "test")


def design_classes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry_id, class, side, split_name, source) and (class, n, pieces, trained, evaluated); a class is named by its smallest entry."""
    split = F.lower(strip(F.col("split_name")))
    side = F.when(split.isin(*TRAIN), "t").when(split.isin(*EVALUATION), "e")
    rows = entries.select("entry_id", split.alias("split_name"), "source", side.alias("side"), last_content(F.col("messages")).alias("design")).filter("entry_id is not null and side is not null and design is not null")
    lines = F.filter(F.transform(F.split("design", LINES), piece_line), lambda x: x.isNotNull())
    numbers = F.array_sort(F.transform(lines, piece_numbers))
    rows = rows.withColumn("pieces", numbers).filter("size(pieces) > 0").withColumn("text", F.sha2(F.to_json("pieces"), 256).cast("binary")).drop("design")
    rows = cut(rows)
    classes = rows.groupBy("text").agg(
        F.min("entry_id").cast("bigint").alias("class"), F.first("pieces").alias("pieces"), F.max((F.col("side") == "t").cast("int")).alias("trained"), F.max((F.col("side") == "e").cast("int")).alias("evaluated")
    )
    classes = cut(classes.withColumn("n", F.size("pieces")))
    member = rows.select("entry_id", "text", "side", "split_name", "source").join(classes.select("text", "class"), "text").drop("text")
    return member, classes.drop("text")


def _cells(number: Column, tolerance: float, width: float) -> Column:
    """The one or more cells that hold a number within the tolerance."""
    low, high = (F.floor((number + d) / width + 0.5) for d in (-tolerance, tolerance))
    return F.sequence(low, high)


def vectors(classes: DataFrame, tolerance: float, width: float = WIDTH) -> DataFrame:
    """(class, term, weight): pieces per cell; with a tolerance, pieces per cell within reach."""
    piece = classes.select("class", F.explode("pieces").alias("p"))
    cells = [F.transform("p", lambda x: F.floor(x / width + 0.5))]
    if tolerance:
        piece = piece.select("class", *[_cells(F.col("p")[i], tolerance, width).alias(f"c{i}") for i in range(9)])
        for i in range(9):
            piece = piece.withColumn(f"c{i}", F.explode(f"c{i}"))
        cells = [F.array(*[f"c{i}" for i in range(9)])]
    return piece.select("class", F.xxhash64(*cells).alias("term")).groupBy("class", "term").agg(F.count("*").cast("double").alias("weight"))


def _entries(vec: DataFrame, needs: DataFrame, other_most: str, other_norm: float, outside: float) -> DataFrame:
    """The rarest terms of each vector, until the rest is worth less than `outside` of its need; (class, term, weight, need, rest)."""
    vec = vec.join(needs, "class")
    after = Window.partitionBy("class").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.least(F.sum(F.col("weight") * F.col(other_most)).over(after), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(after)) * other_norm)
    whole = F.sum(F.col("weight") * F.col(other_most)).over(Window.partitionBy("class"))
    rest = vec.withColumn("bound", bound).withColumn("whole", whole).filter("whole >= need")
    return rest.filter(F.col("bound") >= F.col("need") * outside).select("class", "term", "weight", "need", "n")


def candidates(left: DataFrame, right: DataFrame, needs: DataFrame, share: float, outside: float = OUTSIDE) -> DataFrame:
    """(left, right, dot): pairs of vectors whose dot product reaches what both need; needs: (class, n, need)."""
    left, right = cut(left), cut(right)
    side = lambda v, s: v.groupBy("term").agg(F.max("weight").alias(f"most_{s}"), F.count("*").alias(f"df_{s}"))
    terms = side(left, "l").join(side(right, "r"), "term").selectExpr("term", "most_l", "most_r", "df_l + df_r as df")
    terms = cut(terms)
    norms = [v.groupBy("class").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")) for v in (left, right)]
    top = [x.agg(F.max("norm")).first()[0] or 0.0 for x in norms]
    live_l, live_r = left.join(terms, "term"), right.join(terms, "term")
    el = _entries(live_l, needs, "most_r", top[1], outside).select("term", F.col("class").alias("left"), F.col("weight").alias("wl"), F.col("need").alias("need_l"), F.col("n").alias("nl"))
    er = _entries(live_r, needs, "most_l", top[0], outside).select("term", F.col("class").alias("right"), F.col("weight").alias("wr"), F.col("need").alias("need_r"), F.col("n").alias("nr"))
    alike = f"least(nl, nr) >= {share!r}D * greatest(nl, nr) - 1e-9"  # the pieces of the shorter design must do for the longer one
    met = el.join(er, "term").filter(alike).groupBy("left", "right").agg(F.sum(F.col("wl") * F.col("wr")).alias("part"), F.first(F.greatest("need_l", "need_r")).alias("need"))
    # what is outside the entries of the vector whose entries end first is below `outside` of its need
    met = met.filter(F.col("part") >= F.col("need") * (1 - outside) - 1e-9).select("left", "right", "need")
    met = cut(met)
    full_l = left.select(F.col("class").alias("left"), "term", F.col("weight").alias("wl"))
    full_r = right.select(F.col("class").alias("right"), "term", F.col("weight").alias("wr"))
    dots = met.join(full_l, "left").join(full_r, ["right", "term"]).groupBy("left", "right").agg(F.sum(F.col("wl") * F.col("wr")).alias("dot"), F.first("need").alias("need"))
    return dots.filter("dot >= need - 1e-9").select("left", "right", "dot")


#: Pairs of pieces that are compared at once.
PAIRS = 200_000


def partners(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[np.ndarray]:
    """Per piece of a the pieces of b that match it; b is searched in the order of its most varied number, some pieces of a at a time."""
    axis = int(np.argmax(np.ptp(b, axis=0))) if len(b) else 0
    order = np.argsort(b[:, axis], kind="stable")
    low, high = np.searchsorted(b[order, axis], a[:, axis] - tolerance, "left"), np.searchsorted(b[order, axis], a[:, axis] + tolerance, "right")
    out: list[np.ndarray] = []
    upto = np.concatenate([[0], np.cumsum(high - low)])
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, "right")) - 1)
        n = (high - low)[first:last]
        at = np.repeat(np.arange(first, last), n)
        other = order[np.repeat(low[first:last] - (upto[first:last] - upto[first]), n) + np.arange(len(at))]
        fits = (np.abs(a[at] - b[other]) <= tolerance).all(axis=1)
        out += np.split(other[fits], np.searchsorted(at[fits], np.arange(first + 1, last)))
        first = last
    return out


def matched(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """The most pieces of a and b that match one to one, by augmenting paths."""
    fits = partners(a, b, tolerance)
    owner = np.full(len(b), -1)
    done = 0
    for start in range(len(a)):
        came: dict[int, int] = {}  # piece of b: the piece of a it was reached from
        todo, end = [start], -1
        while todo and end < 0:
            i = todo.pop()
            for j in fits[i]:
                j = int(j)
                if j not in came:
                    came[j] = i
                    if owner[j] < 0:
                        end = j
                        break
                    todo.append(int(owner[j]))
        if end >= 0:
            done += 1
            took = {v: k for k, v in enumerate(owner) if v >= 0} if owner[end] >= 0 or came[end] != start else {}
            while True:
                i = came[end]
                before = took.get(i, -1)
                owner[end] = i
                if i == start:
                    break
                end = before
    return done


def cosine(a: np.ndarray, b: np.ndarray, width: float = WIDTH) -> float:
    """The cosine of the pieces per cell of two designs."""
    cells, back = np.unique(np.floor(np.concatenate([a, b]) / width + 0.5), axis=0, return_inverse=True)
    x, y = (np.bincount(part, minlength=len(cells)).astype(float) for part in (back[: len(a)], back[len(a) :]))
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))


def class_pairs(classes: DataFrame, share: float = 0.8, tolerance: float = 2.0) -> DataFrame:
    """(left, right, cosine, matched): classes of the training and of the evaluation side that are the same or nearly so."""
    needs = classes.select("class", "n", F.ceil(F.col("n") * share - 1e-9).cast("double").alias("need"))
    pairs = candidates(vectors(classes.filter("trained = 1"), 0.0), vectors(classes.filter("evaluated = 1"), tolerance), needs, share)
    text = classes.select("class", "n", "pieces")
    both = pairs.join(text.select(F.col("class").alias("left"), F.col("pieces").alias("a")), "left").join(text.select(F.col("class").alias("right"), F.col("pieces").alias("b")), "right")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = [matched(np.stack(a), np.stack(b), tolerance) for a, b in zip(pdf["a"], pdf["b"])]
            need = [share * max(len(a), len(b)) - 1e-9 for a, b in zip(pdf["a"], pdf["b"])]
            kept = [x >= y for x, y in zip(m, need)]
            out = pdf[["left", "right"]].assign(cosine=0.0, matched=m)[kept]
            out["cosine"] = [cosine(np.stack(a), np.stack(b)) for a, b, k in zip(pdf["a"], pdf["b"], kept) if k]
            yield out

    return both.select("left", "right", "a", "b").mapInPandas(check, "left bigint, right bigint, cosine double, matched int")


def found(entries: DataFrame, share: float = 0.8, tolerance: float = 2.0) -> DataFrame:
    """(entry_id_a, entry_id_b): a training entry and a val or test entry of the same or nearly the same design."""
    member, classes = design_classes(entries)
    pairs = cut(class_pairs(classes, share, tolerance).select("left", "right"))
    t = member.filter("side = 't'").select(F.col("class").alias("left"), F.col("entry_id").alias("x")).distinct()
    e = member.filter("side = 'e'").select(F.col("class").alias("right"), F.col("entry_id").alias("y")).distinct()
    return pairs.join(t, "left").join(e, "right").select(F.least("x", "y").alias("entry_id_a"), F.greatest("x", "y").alias("entry_id_b")).filter("entry_id_a <> entry_id_b").distinct()


def report(entries: DataFrame, share: float = 0.8, tolerance: float = 2.0) -> DataFrame:
    """(split_name, source, entries, overlapping, same): evaluation entries, those with a training entry of nearly the same design, and of exactly the same.

    Works on classes: nothing is listed pair by pair.
    """
    member, classes = design_classes(entries)
    pairs = class_pairs(classes, share, tolerance).groupBy("right").agg(F.max((F.col("left") == F.col("right")).cast("int")).alias("same"))
    e = member.filter("side = 'e'").dropDuplicates(["entry_id"]).join(pairs, F.col("class") == F.col("right"), "left")
    return e.groupBy("split_name", "source").agg(F.count("*").alias("entries"), F.count("right").alias("overlapping"), F.coalesce(F.sum("same"), F.lit(0)).cast("bigint").alias("same"))


def membership(entries: DataFrame, share: float = 0.8, tolerance: float = 2.0) -> DataFrame:
    """(entry_id, class, links): each entry with its class of equal designs and the number of classes across splits it is linked to."""
    member, classes = design_classes(entries)
    pairs = cut(class_pairs(classes, share, tolerance))
    ends = pairs.select(F.col("left").alias("class"), F.lit("t").alias("side")).unionByName(pairs.select(F.col("right").alias("class"), F.lit("e").alias("side")))
    links = ends.groupBy("class", "side").agg(F.count("*").alias("links"))
    return member.join(links, ["class", "side"], "left").selectExpr("entry_id", "class", "coalesce(links, 0L) as links")
