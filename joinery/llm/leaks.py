"""Evaluation passages inside corpus texts, by a Wu-Manber search over words.

A pattern is a run of at least ten consecutive words of one sentence of one item that stands in no other item. From
each start in a sentence the shortest such run is enough: every longer one contains it. Which runs stand in several items is
counted by Spark over all items, so nothing about the items is held on the driver: first the runs of ten words; where such a run
stands in another item too, the shortest longer run that does not is searched for, WAYS lengths at a time, since a run that
stands in one item only stays so when it grows.

The search window is as long as the shortest pattern. A table over blocks of two words gives how far the window may move
without missing a pattern; a block that ends the window of some pattern gives 0 and names the bucket of patterns to
compare directly. Patterns are cut into shards of about SHARD by hash, each with its own tables; every document is searched with each
shard, so the result doesn't depend on their number, and a worker holds one shard at a time. Evaluation sets are small beside the
corpus; ordinary ones are one shard.

Defined results: null, empty and blank texts contain nothing and items without ten words leak nowhere; repeated rows
give one (document, item) pair; rows whose id is null are left out; texts of one item id are one item; empty tables give an
empty result; other columns do not matter. Texts are searched whole, whatever their length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.llm.words import sentences, words
from joinery.session import cut, small

BLOCK = 2
#: Patterns of one shard; one takes about 2 KB of a worker's memory.
SHARD = 50_000
#: Lengths that are tried at once for a run that also stands in another item.
WAYS = 32


def _word_rows(items: DataFrame) -> DataFrame:
    """(item_id, sentence, w): the words of each item's whole text (sentence is null) and of each of its sentences."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("item_id", pa.int32()), ("sentence", pa.int32()), ("w", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((item, None, words(text)))
                rows += [(item, k, w) for k, w in enumerate(sentences(text))]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("int").alias("item_id"), "text").distinct()
    return rows.mapInArrow(run, "item_id int, sentence int, w array<string>")


def _digest(w: str, start: Column, n: Column) -> Column:
    """A digest of n words from a start (counted from 0)."""
    return F.unhex(F.sha2(F.array_join(F.slice(w, start + 1, n), " "), 256))


def patterns(items: DataFrame, least: int = 10) -> DataFrame:
    """(item_id, run): the shortest runs of at least `least` words, from each start in a sentence, that stand in one item only."""
    rows = cut(_word_rows(items).filter(F.size("w") >= least))
    place = F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("i")
    stands = rows.filter("sentence is null").select("item_id", "w", place).withColumn("head", _digest("w", F.col("i"), F.lit(least)))
    owners = cut(stands.groupBy("head").agg(F.min("item_id").alias("lo_item"), F.max("item_id").alias("hi_item")))
    starts = rows.filter("sentence is not null").select("item_id", "sentence", "w", place).withColumn("head", _digest("w", F.col("i"), F.lit(least)))
    elsewhere = F.coalesce((F.col("lo_item") != F.col("item_id")) | (F.col("hi_item") != F.col("item_id")), F.lit(False))
    met = cut(starts.join(owners, "head", "left").withColumn("elsewhere", elsewhere).drop("lo_item", "hi_item"))
    run = lambda n: F.slice("w", F.col("i") + 1, n).alias("run")
    found = met.filter("not elsewhere").select("item_id", run(F.lit(least)))
    # starts whose run of `low` words stands elsewhere too; the run to the sentence's end is tried as the longest
    size = F.size("w") - F.col("i")
    open_ = met.filter("elsewhere").select("item_id", "w", "i", "head", F.lit(least).alias("low"), (size + 1).alias("high"))
    while True:
        open_ = cut(open_.filter("high - low > 1"))
        if open_.isEmpty():
            return found.distinct()
        tries = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(WAYS)), lambda k: F.col("low") + F.ceil((F.col("high") - 1 - F.col("low")) * k / WAYS).cast("int")))
        asked = open_.select("*", F.explode(tries).alias("n")).withColumn("digest", _digest("w", F.col("i"), F.col("n")))
        # every occurrence of a longer run begins with the same ten words
        lengths = asked.select("head", "n").distinct()
        seen = stands.join(lengths, "head").filter(F.size("w") - F.col("i") >= F.col("n")).select("item_id", "n", _digest("w", F.col("i"), F.col("n")).alias("digest"))
        owners = seen.groupBy("n", "digest").agg(F.min("item_id").alias("lo_item"), F.max("item_id").alias("hi_item"))
        tried = asked.join(owners, ["n", "digest"], "left").withColumn("elsewhere", elsewhere)
        bounds = tried.groupBy("item_id", "w", "i", "head").agg(
            F.greatest(F.first("low"), F.max(F.when(F.col("elsewhere"), F.col("n")))).alias("low"), F.least(F.first("high"), F.min(F.when(~F.col("elsewhere"), F.col("n")))).alias("high")
        )
        bounds = cut(bounds)
        # high is one more than the sentence has where no run of it is its item's alone
        found = found.unionByName(bounds.filter((F.col("high") - F.col("low") == 1) & (F.col("high") <= size)).select("item_id", run(F.col("high"))))
        open_ = bounds


class WuManber:
    """Finds which of many word patterns a list of words contains."""

    def __init__(self, found: dict[tuple[str, ...], set[int]]) -> None:
        self.m = m = min(map(len, found), default=0)
        self.free = m - BLOCK + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[tuple[str, ...], set[int]]]] = defaultdict(list)
        for p, items in found.items():
            for end in range(BLOCK, m + 1):
                block = p[end - BLOCK : end]
                self.shift[block] = min(self.shift.get(block, self.free), m - end)
            self.bucket[p[m - BLOCK : m]].append((p, items))

    def search(self, w: list[str]) -> set[int]:
        """The items of which a pattern stands in w."""
        hits: set[int] = set()
        if not self.m:
            return hits
        m, free, shift, bucket, at, n = self.m, self.free, self.shift, self.bucket, self.m, len(w)
        while at <= n:
            block = (w[at - 2], w[at - 1])
            move = shift.get(block, free)
            if not move:
                for p, items in bucket[block]:
                    if w[at - m] == p[0] and tuple(w[at - m : at - m + len(p)]) == p:
                        hits |= items
                move = 1
            at += move
        return hits


def _hits(docs: DataFrame, items: DataFrame, keep: list[str], least: int = 10, shard: int = SHARD) -> DataFrame:
    """(doc_id, keep, item_id): the items of which a pattern stands in a document; a pair may come once per shard and row."""
    spark = docs.sparkSession
    found = cut(patterns(items, least))
    shards = -(-found.count() // shard)
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep)
    types = ["doc_id bigint", *(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), "item_id int"]

    def searched(k: int) -> DataFrame:
        mine: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for r in found.filter(F.pmod(F.xxhash64("run"), F.lit(shards)) == k).collect():  # about SHARD rows
            mine[tuple(r["run"])].add(r["item_id"])
        shared = spark.sparkContext.broadcast(WuManber(dict(mine)))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            engine = shared.value
            for batch in batches:
                at, hit = [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    for item in engine.search(words(text)):
                        at.append(n)
                        hit.append(item)
                rows = batch.take(pa.array(at, pa.int64()))
                yield pa.record_batch([rows.column(0), *rows.columns[2:], pa.array(hit, pa.int32())], names=["doc_id", *keep, "item_id"])

        return docs.mapInArrow(run, ", ".join(types))

    return reduce(DataFrame.unionByName, map(searched, range(shards))) if shards else spark.createDataFrame([], ", ".join(types))


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 10, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id): each document that contains a passage of an item."""
    return _hits(docs, items, [], least, shard).distinct()


def leak_report(docs: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """(benchmark, source, items, documents): how many items leaked into how many documents of each source."""
    names = items.select("item_id", "benchmark").distinct()
    named = _hits(docs, items, ["source"], least).distinct().join(small(names, names.count()), "item_id")
    return named.groupBy("benchmark", "source").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))
