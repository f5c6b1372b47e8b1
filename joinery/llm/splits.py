"""Splits that keep related records together.

Records that share a key are joined to the smallest record of the key: at most one edge per record and key, however
many records a key has. Components come by parallel hooking and shortcutting: every vertex takes its smallest neighbour
as parent where that is smaller than itself, parents are replaced by their parents until they are roots, and the edges
are carried over to the roots, without loops and repetitions. Each round leaves a smaller graph; the rounds' parent
tables, joined from the last to the first, give each record the smallest record of its component.

Splits are chosen per category, so that each category is spread alike: a component belongs to the category that most
of its rows have. Per category, a subset-sum bitset over the sizes of its components, each size as often as it occurs,
gives the reachable totals; the total closest to the smallest split's share is taken, then the next split's from what is
left, and the largest split gets the rest. How many components of each size go to a split follows; which ones is random.

Defined results: a null or placeholder key relates nothing; null record ids are left out; repeated rows are one record;
null and letterless categories are one category; missing or non-positive shares get nothing; without shares all records
go to no split (null); ties between totals take the smaller; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinery.functions.keys import hex_id, letters, upload_key
from joinery.operators.pick import pick
from joinery.session import cut


def records(catalogue: DataFrame) -> DataFrame:
    """(id, keys, category) of the model catalogue."""
    keys = F.array_compact(F.array(F.concat(F.lit("m"), hex_id(F.col("model_id"))), F.concat(F.lit("u"), upload_key(F.col("upload_id")))))
    return catalogue.filter("dir_id is not null").select(F.col("dir_id").cast("bigint").alias("id"), keys.alias("keys"), F.coalesce(letters(F.col("model_cat")), F.lit("")).alias("category"))


def components(rows: DataFrame) -> DataFrame:
    """(id, root) for each record that is not alone and not the smallest of its component, from (id, keys)."""
    keyed = rows.select("id", F.explode("keys").alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min("id").alias("to"))
    edges = cut(keyed.join(least, "key").filter("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        # hooking: the smallest of the neighbours and oneself
        parent = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")))
        while True:  # shortcutting, until every parent is a root
            up = parent.select(F.col("v").alias("w"), F.col("p").alias("q"))
            new = cut(parent.join(up, parent["p"] == up["w"]).select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moved = not new.filter("moved").isEmpty()
            parent = new.drop("moved")
            if not moved:
                break
        levels.append(parent.filter("v <> p"))
        left, right = (parent.select(F.col("v").alias(x), F.col("p").alias(f"r{x}")) for x in ("a", "b"))
        edges = cut(edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = levels.pop().select(F.col("v").alias("id"), F.col("p").alias("root"))
    while levels:
        level = levels.pop().select(F.col("v").alias("id"), F.col("p").alias("mid"))
        above = out.select(F.col("id").alias("mid"), F.col("root").alias("top"))
        out = out.unionByName(level.join(above, "mid", "left").select("id", F.coalesce("top", "mid").alias("root")))
    return out


def related(rows: DataFrame) -> DataFrame:
    """(dir_id_a, dir_id_b): the smallest record of each group with each of its others."""
    return components(rows).select(F.col("root").alias("dir_id_a"), F.col("id").alias("dir_id_b"))


def closest_subset(sizes: list[int], counts: list[int], target: int) -> list[int]:
    """How many of each size to take so that the total is as close to the target as can be; of two totals the smaller.

    Filling up from the largest size on gives a first choice. Some best choice differs from it by no more components than a few times
    the largest size (the proximity of integer to fractional choices), so all others stay as they are. A bitset has a bit for
    each total of the rest, up to twice what is left of the target; for each total, the step that reached it first is kept. So memory
    depends on the sizes of components and not on how many there are.
    """
    usable = [s for s in sizes if s <= 2 * target]
    reach = 3 * max(usable, default=0) + 3
    room, kept = target, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if sizes[k] > 2 * target:
            continue
        n = min(counts[k], room // sizes[k])
        kept[k], room = n, room - n * sizes[k]
        if n < counts[k]:
            break
    fixed = [max(0, n - reach) for n in kept]
    free = [min(c, n + reach) - f for c, n, f in zip(counts, kept, fixed)]
    if any(fixed) or free != list(counts):
        more = closest_subset_of_few(sizes, free, target - sum(s * f for s, f in zip(sizes, fixed)))
        return [f + m for f, m in zip(fixed, more)]
    return closest_subset_of_few(sizes, counts, target)


def closest_subset_of_few(sizes: list[int], counts: list[int], target: int) -> list[int]:
    """The same by one bitset over all totals up to twice the target."""
    top = min(2 * target, sum(s * c for s, c in zip(sizes, counts)))
    mask, bits = (1 << (top + 1)) - 1, 1
    pieces: list[tuple[int, int]] = []  # (index of the size, how many of it)
    first = np.full(top + 1, -1, dtype=np.int32)
    for k, (size, count) in enumerate(zip(sizes, counts)):
        if size > top:
            continue
        many = 1
        while count > 0:
            n = min(many, count)
            count, many = count - n, many * 2
            if n * size > top:
                break
            new = (bits << (n * size)) & mask & ~bits
            if new:
                raw = np.frombuffer(new.to_bytes((top >> 3) + 1, "little"), dtype=np.uint8)
                first[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: top + 1])] = len(pieces)
                bits |= new
            pieces.append((k, n))
    raw = np.frombuffer(bits.to_bytes((top >> 3) + 1, "little"), dtype=np.uint8)
    reached = np.flatnonzero(np.unpackbits(raw, bitorder="little")[: top + 1])
    total = int(reached[np.argmin(np.abs(reached - target))])
    taken = [0] * len(sizes)
    while total:
        k, n = pieces[first[total]]
        taken[k] += n
        total -= n * sizes[k]
    return taken


def groups(rows: DataFrame) -> DataFrame:
    """(id, root, category): every record once, with its component's smallest record and its component's main category."""
    once = rows.groupBy("id").agg(F.min("category").alias("category"))
    rooted = once.join(components(rows), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = cut(rooted)
    share = rooted.groupBy("root", "category").agg(F.count("*").alias("n"))
    main = share.groupBy("root").agg(F.sum("n").alias("size"), F.max_by("category", F.struct("n", "category")).alias("main"))
    return rooted.join(main, "root")


def assign(rows: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(dir_id, split_name): one split per record, by the targets (split_name, target_share)."""
    g = cut(groups(rows))
    shares = {r["split_name"]: float(r["target_share"]) for r in targets.filter("split_name is not null and target_share > 0").collect()}  # one row per split
    order = sorted(shares, key=lambda s: (shares[s], s))
    whole = sum(shares.values())
    comps = g.groupBy("root").agg(F.first("main").alias("main"), F.first("size").alias("size"))
    by_size = comps.groupBy("main", "size").agg(F.count("*").alias("many"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False).reset_index(drop=True)
        sizes, left = [int(x) for x in pdf["size"]], [int(x) for x in pdf["many"]]
        total, out = sum(s * c for s, c in zip(sizes, left)), []
        for k, name in enumerate(order):
            if k == len(order) - 1:
                taken = list(left)
            else:
                taken = closest_subset(sizes, left, round(total * shares[name] / whole))
            left = [a - b for a, b in zip(left, taken)]
            out += [(pdf["main"][i], sizes[i], k, n) for i, n in enumerate(taken) if n]
        return pd.DataFrame(out, columns=["main", "size", "split", "quota"])

    # one task has the distinct sizes of one category: at most about the square root of twice its rows
    counts = cut(by_size.groupBy("main").applyInPandas(run, "main string, size bigint, split int, quota bigint")) if order else None
    left, out = comps, None
    for k, name in enumerate(order[:-1]):
        got = cut(pick(left, counts.filter(F.col("split") == k).select("main", "size", "quota"), ["main", "size"], ["root"], seed + k))
        left = left.join(got.select("root"), "root", "left_anti")
        part = got.select("root", F.lit(name).alias("split_name"))
        out = part if out is None else out.unionByName(part)
    rest = order[-1] if order else None
    if out is None:
        return g.select(F.col("id").alias("dir_id"), F.lit(rest).cast("string").alias("split_name"))
    return g.select("id", "root").join(out, "root", "left").select(F.col("id").alias("dir_id"), F.coalesce("split_name", F.lit(rest)).alias("split_name"))


def report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, split_name, records): how the records of each category are spread."""
    once = rows.groupBy("id").agg(F.min("category").alias("category"))
    return assign(rows, targets).join(once.withColumnRenamed("id", "dir_id"), "dir_id").groupBy("category", "split_name").agg(F.count("*").alias("records"))
