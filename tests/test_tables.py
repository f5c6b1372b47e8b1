import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joinery.functions import chat, keys
from joinery.functions import scalars as X
from joinery.operators import dataset as D
from joinery.operators import judge as J
from joinery.operators import ratings as R
from joinery.operators import tables as T
from joinery.operators.pick import pick

RATING = "reviewer string, model_type string, experiment_id string, prompt_satisfaction string, assemblability string, design_quality string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keys(spark):
    df = spark.createDataFrame([(" {AB-c1} ", "UP 0012", "In-Distribution", " 02.0 "), ("?!", "up-000", " ", "1e"), (None, None, None, None), ("", "unknown", "　", "")], "a string, u string, d string, n string")
    got = df.select(keys.hex_id(F.col("a")), keys.upload_key(F.col("u")), keys.letters(F.col("d")), keys.number(F.col("n"))).collect()
    assert tuple(got[0]) == ("abc1", "up0012", "indistribution", 2.0)
    assert all(tuple(r) == (None,) * 4 for r in got[1:])


def test_ratings_cleaning_and_reports(spark):
    rows = [("a", "sft", "001", "1", "2", "3"), ("a", "sft", "abc", "2", "2", "2"), ("b", None, "1", "3", "3", "3"), ("b", "new", "2", "", "1", "1"), ("b", "new", "2", None, "1", "1"), ("b", "new", "2", "x", "1", "1"), ("c", "old", None, "3", "1", "2")]
    df = spark.createDataFrame(rows, RATING)
    clean = R.clean(df)
    assert clean.count() == 4
    assert R.means(clean, "model_type").count() == 2  # the null model is left out
    s = {r["model_type"]: r for r in R.spread(clean, "model_type").collect()}
    assert s["old"]["assemblability_std"] is None and s["sft"]["prompt_satisfaction_mean"] == 1.5
    meta = spark.createDataFrame([(1, "p", "in-distribution", 1), (1, "p", "IN distribution", 1), (2, "q", "unknown", 9)], "prompt_id int, prompt string, distribution string, difficulty_level int")
    joined = R.with_metadata(clean, meta)
    assert joined.count() == 4 and joined.filter("distribution is not null").count() == 2
    out = R.ordered(R.means(clean, "model_type"), (("sft", "SFT"), ("none", "None")), dict.fromkeys(R.METRICS, 0.0)).orderBy("ord").collect()
    assert [r["model_type"] for r in out] == ["sft", "none"] and out[1]["assemblability"] == 0
    assert R.fully_rated(df).count() == 5  # "x" is truthy, blanks and nulls are not
    b = {(r["model_type"], r["metric"]): r for r in R.box_stats(clean, "model_type").collect()}
    assert b["sft", "prompt_satisfaction"]["median"] == 1.5 and b["sft", "prompt_satisfaction"]["outliers"] == 0
    for empty in (R.means(clean.filter("false"), "model_type"), R.box_stats(clean.filter("false"), "model_type"), R.mean_sets(joined.filter("false"))):
        assert empty.count() == 0
    designs = spark.createDataFrame([("sft", "001", 0), ("x", "9", 1)], "model_type string, experiment_id string, idx int")
    rated = clean.select("model_type", "experiment_id", *R.METRICS)
    assert R.first_unrated(designs, rated, ["model_type", "experiment_id"], "idx").first()[0] == 1
    sheet = {r["model_type"]: r for r in R.rating_sheet(designs, df.filter("reviewer = 'a'"), ["model_type", "experiment_id"]).collect()}
    assert sheet["x"]["assemblability"] == "" and sheet["sft"]["assemblability"] == "2"


def test_latest_is_by_time(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "m", t, "1"), ("a", "m", t + dt.timedelta(1), "2"), ("a", "n", None, "3")], "r string, m string, at timestamp, v string")
    assert rows_of(R.latest(df, ["r", "m"], ["at"]).select("m", "v")) == [("m", "2"), ("n", "3")]


def test_first_last_union_iou(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 1, "z")], "k string, o int, v string")
    assert rows_of(T.first_by(df, ["k"], ["o"]).select("k", "v")) == [("k", "a"), (None, "z")]
    assert rows_of(T.first_by(df, ["k"], ["o"], last=True).select("k", "v")) == [("k", "b"), (None, "z")]
    u = T.union_all([df, spark.createDataFrame([("k", 1.5)], "k string, w double")])
    assert u.columns == ["k", "o", "v", "w"] and u.count() == 4
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert tuple(T.iou(a, b).first()) == (1, 3, pytest.approx(1 / 3))
    assert T.left_join_first(a, spark.createDataFrame([(2, 9), (2, 8)], "x int, y int"), "x", ["y"]).filter("y = 8").count() == 1
    assert T.only_ids(a, b, "x").count() == 1
    assert spark.range(1).select(T.not_among(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))).first()[0] == [1]
    assert T.some(a, 2).count() == 2 and rows_of(T.shuffled(a, ["x"])) == [(1,), (1,), (2,)]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11])
def test_train_test_counts(spark, n):
    got = T.train_test(spark.range(n), ["id"])
    assert got.count() == n and got.filter("split = 'test'").count() == -(-n // 10)
    assert rows_of(got) == rows_of(T.train_test(spark.range(n), ["id"]))


def test_pick_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id").withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    q = spark.createDataFrame([(0, 7), (1, 10_000), (None, 1000)], "g bigint, quota bigint")
    got = {r["g"]: r["n"] for r in pick(df, q, ["g"], ["id"]).groupBy("g").agg(F.count_distinct("id").alias("n")).collect()}
    assert got == {0: 7, 1: 1667, None: 1000}
    same = spark.createDataFrame([(1, 5)] * 50, "g bigint, id bigint")
    assert pick(same, q.withColumn("quota", F.lit(20)), ["g"], ["id"]).count() == 20  # repeated rows
    assert pick(df, q.withColumn("quota", F.lit(0)), ["g"], ["id"]).count() == 0
    assert pick(df.filter("false"), q, ["g"], ["id"]).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40), st.integers(1, 6))
def test_run_lengths_round_trip(spark, values, longest):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v int")
    runs = T.run_ends(T.run_lengths(df, ["k"], ["i"], "v", longest), ["k"]).orderBy("run").collect()
    assert [r["value"] for r in runs for _ in range(r["length"])] == values
    assert all(0 < r["length"] <= longest for r in runs) and (not runs or runs[-1]["upto"] == len(values))


def test_chat(spark):
    m = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "l1\r\nl2\n"}, {"role": "assistant", "content": "l3"}]
    df = spark.createDataFrame([(1, m), (2, m[:2]), (3, [])], "id int, messages array<struct<role:string,content:string>>")
    got = D.prefixes(df, ["id"], mode="all").filter("id = 1").orderBy("cut").collect()
    assert [r["next_line"] for r in got] == ["l1", "l2", "l3", "EOS"] and got[2]["prefix"] == "l1\nl2\n"
    assert len(got[0]["prompt"]) == 2 and got[2]["prompt"][2]["role"] == "assistant"
    one = D.prefixes(df, ["id"])
    assert one.count() == 3 and rows_of(one.select("id", "cut")) == rows_of(D.prefixes(df, ["id"]).select("id", "cut"))
    assert one.filter("id > 1").select("next_line").distinct().collect()[0][0] == "EOS"
    ls = spark.createDataFrame([("",), ("a",), ("a\n\n",), ("a b\x0bc",)], "t string").select(chat.lines(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in ls] == [[], ["a"], ["a", ""], ["a", "b", "c"]]


def test_captions(spark):
    rows = [("a", 1, ["x", None, " "]), ("b", 2, ["['p q'\n \"it's\"]"]), ("c", 3, None), ("d", 4, []), ("e", 5, ["[1] plain"]), ("f", 6, ["['']"])]
    got = rows_of(D.caption_rows(spark.createDataFrame(rows, "object_id string, row_id int, captions array<string>")))
    assert got == [("a", 1, 0, "x"), ("b", 2, 0, "p q"), ("b", 2, 1, "it's"), ("e", 5, 0, "[1] plain")]
    c = D.conversations(spark.createDataFrame([("cap", "1 2")], "caption string, design string")).first()["messages"]
    assert [x["role"] for x in c] == ["system", "user", "assistant"] and c[1]["content"].endswith("cap")
    m = spark.createDataFrame([(1, "Bed", 5), (2, "bed", 5), (3, "Chair", 101), (4, None, 5), (5, "Table", None)], "dir_id int, model_cat string, part_count int")
    assert rows_of(D.keep_models(m).select("dir_id")) == [(1,)]


def test_scalars(spark):
    vals = spark.createDataFrame([(2.5,), (-2.5,), (0.0005,), (2.0625,)], "x double").select(X.round_even(F.col("x")).alias("a"), X.round_even(F.col("x"), 3).alias("b"), X.truncated(F.col("x")).alias("c")).collect()
    assert [r["a"] for r in vals] == [2, -2, 0, 2] and [r["c"] for r in vals] == [2, -2, 0, 2] and vals[3]["b"] == 2.062
    f = spark.createDataFrame([("a_ratings_ratings.csv", 7, "nine_lives"), ("/x/y.b/pic.JPEG", 1234, "a")], "f string, n int, s string")
    got = f.select(X.reviewer_of(F.col("f")), X.suffix(F.col("f")), X.mime_type(F.col("f")), X.padded(F.col("n")), X.title(F.col("s")), X.fixed(F.col("n") / 8)).collect()
    assert tuple(got[0]) == ("a", "csv", "image/png", "007", "Nine Lives", "0.88") and tuple(got[1])[:4] == ("pic", "jpeg", "image/jpeg", "1234")
    assert spark.range(1).select(X.linspace(F.lit(1.0), F.lit(2.0), 3), X.linspace(F.lit(1.0), F.lit(2.0), 1), X.grid_side(F.lit(10))).first()[:] == ([1, 1.5, 2], [1], 4)
    w = spark.createDataFrame([(" 000 ",), ("1.0",), ("abc",), (None,), ("-7",)], "s string").select(X.whole(F.col("s")).alias("w")).collect()
    assert [r["w"] for r in w] == [0, None, None, None, -7]
    j = spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,)], "j string").select(X.json_or(F.col("j"), "$.a", "").alias("x")).collect()
    assert [r["x"] for r in j] == ["1", "", ""]


def test_judge_replies_read_every_rating(spark, tmp_path):
    """The third rating comes from its column; a reply without it, or with a wrong one, counts for nothing."""
    from joinery.plans import datasets as P

    rows = [("1", "2", "3"), ("1", "2", "1.0"), ("1", "2", ""), ("1", "2", None), ("1", "2", "7"), ("", "2", "2")]
    spark.createDataFrame(rows, "assemblability string, prompt_satisfaction string, design_quality string").write.parquet(f"{tmp_path}/ratings.parquet")
    got = {tuple(r)[:3]: r["n"] for r in P.judge_replies(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 3): 1, (1, 2, 1): 1, (None, None, None): 4}


def test_judge_and_upsert(spark):
    replies = ['```json\n{"assemblability": 1, "prompt_satisfaction": 2, "design_quality": 3}\n```', '{"assemblability": 0, "prompt_satisfaction": 2, "design_quality": 3}', '{"assemblability": 1}', "sorry", None, '{"assemblability": 3, "prompt_satisfaction": 3, "design_quality": 3}']
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(J.parse_reply(F.col("r")).alias("p")).collect()
    assert [r["p"] is not None for r in got] == [True, False, False, False, False, True]
    designs = spark.createDataFrame([("m", "1", "good"), ("m", "2", "bad"), ("n", "1", "good")], "model_type string, experiment_id string, prompt string")
    on = ["model_type", "experiment_id"]
    done = spark.createDataFrame([("n", "1", 1, 1, 1)], "model_type string, experiment_id string, assemblability int, prompt_satisfaction int, design_quality int")
    new = J.judge(designs, lambda p: [replies[0] if x == "good" else "?" for x in p], on, done)
    assert rows_of(new) == [("m", "1", 1, 2, 3)]
    assert J.upsert(done, new.unionByName(done.withColumn("assemblability", F.lit(3))), on).count() == 2


def test_generation_loop(spark):
    prompts = spark.createDataFrame([("a", "p"), ("b", "never"), ("c", "bad")], "id string, prompt string")

    def part(prompt, so_far):
        if prompt == "bad":
            return "nonsense"
        if prompt == "p" and so_far.count("\n") == 2:
            return "EOS"
        return "1 2 3 4 5 6 7 8 9\n"

    got = {r["id"]: r for r in J.generate(prompts, part, ["id"]).collect()}
    assert (got["a"]["parts"], got["a"]["ended"]) == (2, True) and (got["b"]["parts"], got["b"]["ended"]) == (40, False)
    assert got["c"]["design"] == "" and got["a"]["generation_time"] >= 0
