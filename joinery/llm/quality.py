"""Text quality: statistics per document, exact ranks per language, outlier scores by empirical tails.

Learning: the words and word pairs that tell sentences apart are counted over all documents, each different text once
(`learn`). Words that are kept for the tables must be in a set share of the documents of a language group, which bounds how
many there can be: a share of 1/n allows n times the mean number of different words of a document.

Ranks: the values of each statistic are counted per (language, statistic, value), so that ties and copies are one row
however many documents share them, then range-partitioned and sorted; each task counts on within its partition, and
the totals of the partitions before it, a table of one row per partition, language and statistic, are added as
offsets. Statistics are rounded (see `prose.measure`), so the table of ranks is bounded and is looked up by broadcast
after its rows are counted; no document is shuffled for it.

Scores: a document's surprise in a statistic is minus the logarithm of its empirical tail, the share of documents of its
language with as large (or as small) a value or one beyond. `outlier` combines the surprises of all statistics: the largest of
the sum of the left ones, the sum of the right ones and the sum of the larger ones. `score` combines those of the statistics
that have a limit beyond which a text can't be prose: each surprise is measured by the surprise of the
language's documents beyond the limit, and the largest counts. A document is not natural prose if its score is 1 or more, that is, if
its tail is no larger than that of the documents beyond the limit. The score alone decides; nothing checks it afterwards.

Languages are groups of documents by the first two letters of `lang`; since the column is often wrong, a document belongs to
the group whose documents have most of its words, whatever its own label.

Defined results: null, empty and blank texts have statistics 0, language `none`, scores 0, and are no cases; repeated rows
are separate documents in the statistics and one in p8_found; null ids are left out; without labels all documents are
language `other`; without a column `lang` too; an empty table gives empty results; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinery.functions.keys import strip
from joinery.llm import prose
from joinery.llm.prose import STATS, Lexicon, measure
from joinery.session import cut, small, spread

_SCHEMA = "doc_id bigint, language string, " + ", ".join(f"{s} double" for s in STATS)
#: Share of a group's documents that must have a word, for its odds and for its pairs to be kept; share of all documents that makes a group.
KNOWN, FREQUENT, GROUP = 1 / 1000, 1 / 100, 1 / 200
#: Counts that a task keeps before it passes them on.
HELD = 500_000
#: Values beyond which a text can't be prose.
LIMITS = {"outside": 0.5, "digit_ratio": 0.5, "symbol_ratio": 0.5}


def _each_text_once(docs: DataFrame) -> DataFrame:
    """(text, label) of every different text that is not blank; the ids of copies are found by digests, the texts stay where they are."""
    label = F.lower(F.regexp_extract(strip(F.col("lang")), r"^([A-Za-z]{2})", 1)) if "lang" in docs.columns else F.lit("")
    # "undetermined" and the like name no language
    label = F.when(F.lower(strip(F.col("lang"))).isin("und", "mul", "mis", "zxx"), "").otherwise(F.coalesce(label, F.lit(""))) if "lang" in docs.columns else label
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", label.alias("label"))
    digest = rows.select("doc_id", F.sha2("text", 256).cast("binary").alias("digest"))
    copies = digest.join(digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "digest").filter("doc_id <> first").select("doc_id").distinct()
    copies = cut(copies)
    return rows.join(small(copies, copies.count()), "doc_id", "left_anti").select("text", "label")


def _counted(texts: DataFrame, count: Callable[[Counter, str, str], None], fields: str, names: list[str]) -> DataFrame:
    """Sums over all texts of what `count` adds to a task's counter, by key; a task passes on its counts when it holds HELD of them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(zip(*held)) if held else [[] for _ in names]
            out = pa.record_batch([pa.array(k) if held else pa.array([], t) for k, t in zip(keys, types)] + [pa.array(list(held.values()), pa.int64())], names=[*names, "n"])
            held.clear()
            return out

        types = [pa.int64() if f.endswith("bigint") else pa.string() for f in fields.split(", ")]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count(held, text, label)
            if len(held) > HELD:
                yield rows()
        yield rows()

    return texts.mapInArrow(run, f"{fields}, n bigint").groupBy(*names).agg(F.sum("n").alias("n"))


def _count_words(held: Counter, text: str, label: str) -> None:
    """Documents with each word by label, the documents themselves as the word "", and the words of lines whose form tells."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    lines = prose.lines_of(text)
    for sentence, words in prose.seeds(lines):
        (inside if sentence else outside).update(words)
    for w in set().union(*[x.words for x in lines]):
        held[w, label, "d"] += 1
    held["", label, "d"] += 1
    for kind, counts in (("s", inside), ("o", outside)):
        for w, n in counts.items():
            held[w, "", kind] += n


def learn(docs: DataFrame) -> Lexicon:
    """The words and pairs of the documents' sentences, counted over all of them."""
    texts = spread(_each_text_once(docs))
    counted = cut(_counted(texts, _count_words, "word string, label string, kind string", ["word", "label", "kind"]))
    sizes = {r["label"]: r["n"] for r in counted.filter("word = '' and kind = 'd'").collect()}  # one row per pair of letters
    whole = sum(sizes.values())
    if not whole:
        return Lexicon()
    groups = sorted(g for g, n in sizes.items() if g and n >= whole * GROUP)
    names = groups or ["other"]
    # documents without a group of their own are counted together
    placed = counted.withColumn("label", F.when(F.col("label").isin(*groups), F.col("label")).otherwise("")) if groups else counted.withColumn("label", F.lit("other"))
    n = {g: sizes.get(g, 0) for g in groups} | {"": whole - sum(sizes[g] for g in groups)} if groups else {"other": whole}
    by_word = placed.filter("word <> ''").groupBy("word").agg(
        *[F.sum(F.when((F.col("kind") == "d") & (F.col("label") == g), F.col("n")).otherwise(0)).alias(f"d{i}") for i, g in enumerate(n)],
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("s", "o")],
    )
    total = counted.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("s", "o")]).first()
    known = " or ".join(f"d{i} >= {max(2, n[g] * KNOWN)}" for i, g in enumerate(n))
    rows = by_word.filter(known).collect()  # at most 1 / KNOWN times the mean number of words of a document, per group
    lex = Lexicon({r["word"]: prose.log_odds(r["s"], r["o"], total["s"], total["o"]) for r in rows if r["s"] + r["o"]})
    lex.languages = names
    size = np.array([n[g] for g in names], float)
    lex.prior = np.log(size / whole)
    lex.known = {r["word"]: k for k, r in enumerate(rows)}
    lex.rates = np.log((np.array([[r[f"d{i}"] for i in range(len(names))] for r in rows]).reshape(len(rows), len(names)) + 0.5) / (size + 1))
    often = sorted(r["word"] for r in rows if any(r[f"d{i}"] >= max(3, n[g] * FREQUENT) for i, g in enumerate(n)))
    lex.frequent = {w: k for k, w in enumerate(often)}
    if not often:
        return lex
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(frequent=lex.frequent))

    def count_pairs(held: Counter, text: str, label: str) -> None:
        for code in shared.value.pair_codes(prose.pair_lines(text)):
            held[code, label] += 1

    k = len(often)
    pairs = _counted(texts, count_pairs, "code bigint, label string", ["code", "label"]).withColumns({"a": F.expr(f"code div {k}"), "b": F.expr(f"code % {k}")})
    pairs = cut(pairs.withColumn("label", F.when(F.col("label").isin(*names), F.col("label")).otherwise("" if groups else names[0])))
    lex.left, lex.right = np.zeros((len(n), k)), np.zeros((len(n), k))
    for side, matrix in (("a", lex.left), ("b", lex.right)):
        for r in pairs.groupBy("label", side).agg(F.sum("n").alias("n")).collect():  # a row per frequent word and group
            matrix[list(n).index(r["label"]), r[side]] = r["n"]
    lex.languages = list(n)
    # only pairs that are as frequent as chance would make them in some group, or nearly so, need their counts: others are broken or say nothing
    sides = []
    for side, matrix in (("a", lex.left), ("b", lex.right)):
        sides.append(docs.sparkSession.createDataFrame([(w, [float(x) for x in matrix[:, w]]) for w in range(k)], f"{side} bigint, n{side} array<double>"))
    size = F.array(*[F.lit(max(1.0, float(x))) for x in lex.left.sum(axis=1)])
    chance = F.array_min(F.filter(F.zip_with(F.zip_with("na", "nb", lambda x, y: x * y), size, lambda x, y: x / y), lambda x: x >= prose.TESTABLE))
    summed = pairs.groupBy("code", "a", "b").agg(F.sum("n").alias("n")).join(small(sides[0], k), "a").join(small(sides[1], k), "b")
    kept = sorted(tuple(x) for x in summed.filter(F.col("n") >= chance * prose.BROKEN).select("code", "n").collect())
    lex.codes, lex.counts = np.array([c for c, _ in kept], np.int64), np.array([x for _, x in kept], float)
    return lex


def document_stats(docs: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """(doc_id, language, the statistics): one row for each row of the documents with an id."""
    shared = docs.sparkSession.sparkContext.broadcast(lex or learn(docs))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [measure(t, shared.value) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([lang for lang, _ in found], pa.string())]
            columns += [pa.array([stats[s] for _, stats in found], pa.float64()) for s in STATS]
            yield pa.record_batch(columns, names=["doc_id", "language", *STATS])

    rows = spread(docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.mapInArrow(run, _SCHEMA)


def ranks(stats: DataFrame) -> DataFrame:
    """(language, stat, value, below, upto, total): how many documents lie below a value, up to it, and in all."""
    long = stats.filter("language <> 'none'").select("language", F.explode(F.create_map(*[x for s in STATS for x in (F.lit(s), F.col(s))])).alias("stat", "value"))
    counted = long.groupBy("language", "stat", "value").agg(F.count("*").alias("n"))
    ordered = counted.repartitionByRange("language", "stat", "value").sortWithinPartitions("language", "stat", "value")

    def count_on(batches: Iterator) -> Iterator:
        part, group, base = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            pdf["part"] = part
            run = pdf.groupby(["language", "stat"], sort=False)["n"].cumsum()
            first = (pdf["language"].iloc[0], pdf["stat"].iloc[0])
            if first == group:
                same = (pdf["language"] == first[0]) & (pdf["stat"] == first[1])
                run = run.where(~same, run + base)
            pdf["run"] = run
            group, base = (pdf["language"].iloc[-1], pdf["stat"].iloc[-1]), int(run.iloc[-1])
            yield pdf

    local = cut(ordered.mapInPandas(count_on, "language string, stat string, value double, n bigint, part int, run bigint"))
    by_part = local.groupBy("language", "stat", "part").agg(F.max("run").alias("size"))  # one row per partition and group in it
    before = by_part.selectExpr(
        "language",
        "stat",
        "part",
        "coalesce(sum(size) over (partition by language, stat order by part rows between unbounded preceding and 1 preceding), 0L) as offset",
        "sum(size) over (partition by language, stat) as total",
    )
    joined = local.join(before, ["language", "stat", "part"])
    return joined.selectExpr("language", "stat", "value", "offset + run - n as below", "offset + run as upto", "total")


def scored(docs: DataFrame) -> DataFrame:
    """The statistics of each document with `outlier` and `score`."""
    stats = cut(document_stats(docs))
    place = cut(ranks(stats))
    # a row per language and value of a statistic, with its surprises and, where the statistic has a limit, that of the documents beyond it
    limit = F.create_map(*[x for s, v in LIMITS.items() for x in (F.lit(s), F.lit(v))])[F.col("stat")]
    beyond = place.withColumn("limit", limit).groupBy("language", "stat").agg(F.sum(F.when(F.col("value") > F.col("limit"), F.col("upto") - F.col("below"))).alias("beyond"))
    tails = cut(
        place.join(F.broadcast(beyond), ["language", "stat"]).selectExpr("language", "stat", "value", "-ln(upto / total) as lo", "-ln((total - below) / total) as hi", "-ln(beyond / total) as least")
    )  # `beyond` has a row per language and statistic
    n = tails.count()
    out = stats
    for s in STATS:
        one = tails.filter(F.col("stat") == s).selectExpr("language", f"value as {s}", f"lo as lo_{s}", f"hi as hi_{s}", f"least as least_{s}")
        out = out.join(small(one, n), ["language", s], "left")
    lo, hi = [" + ".join(f"{side}_{s}" for s in STATS) for side in ("lo", "hi")]
    both = " + ".join(f"greatest(lo_{s}, hi_{s})" for s in STATS)
    # the surprise in units of the least one beyond the limit; where all documents are beyond it, any surprise will do
    ratio = [f"case when hi_{s} >= least_{s} then greatest(1D, coalesce(hi_{s} / nullif(least_{s}, 0D), 1D)) when least_{s} > 0 then hi_{s} / least_{s} else 0D end" for s in LIMITS]
    return out.selectExpr("doc_id", "language", *STATS, f"coalesce(greatest({lo}, {hi}, {both}), 0D) as outlier", f"coalesce(greatest({', '.join(ratio)}), 0D) as score")


def not_prose(docs: DataFrame) -> DataFrame:
    """(doc_id): the documents whose outlier score says that they are not natural prose."""
    return scored(docs).filter("score >= 1").select("doc_id").distinct()
