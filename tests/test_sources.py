import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinery.functions.geometry import FIELDS
from joinery.sources import binvox, files, sinks
from joinery.streaming import ratings as stream


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_tables_and_ratings(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(str(tmp_path / "p/a.parquet"))
    put(tmp_path / "prompts.csv", 'prompt_id,prompt,distribution,difficulty_level\n0,"a chair, low",in-distribution,1\n')
    assert files.prompts(spark, str(tmp_path / "prompts.csv")).first()[:] == (0, "a chair, low", "in-distribution", 1)
    head = "model_type,experiment_id,prompt,assemblability,prompt_satisfaction,design_quality\n"
    put(tmp_path / "r/ann_ratings.csv", head + "sft,000,p,1,,3\n")
    put(tmp_path / "r/bob_ratings_ratings.csv", head + "sft,001,\"p, q\",1,2,3\n")
    put(tmp_path / "r/other.csv", head + "x,1,1,1,1,1\n")
    got = {r["reviewer"]: r for r in files.ratings(spark, str(tmp_path / "r")).collect()}
    assert set(got) == {"ann", "bob"} and got["ann"]["prompt_satisfaction"] is None and got["bob"]["prompt"] == "p, q"
    assert files.parquet_folder(spark, str(tmp_path / "p/a.parquet")).count() == 1


def test_design_folders(spark, tmp_path):
    put(tmp_path / "sft/000/info.json", json.dumps({"generation_time": 1.5, "prompt": "p"}))
    put(tmp_path / "sft/001/info.json", "{broken")
    put(tmp_path / "sft/002/info.json", json.dumps({"generation_time": None, "prompt": "q"}))
    put(tmp_path / "grpo/000/design.txt", "1")
    put(tmp_path / ".hidden/000/info.json", "{}")
    put(tmp_path / "analytics/table.csv", "x")
    got = [tuple(r) for r in files.designs(spark, str(tmp_path)).collect()]
    assert got == [("grpo", "000", "", None), ("sft", "000", "p", 1.5), ("sft", "001", "", None), ("sft", "002", "q", None)]
    assert files.generation_times(spark, str(tmp_path)).count() == 1


def test_models_trees_meshes(spark, tmp_path):
    put(tmp_path / "12/meta.json", json.dumps({"model_cat": "Bed", "model_id": "m1"}))
    put(tmp_path / "13/meta.json", "{}")
    put(tmp_path / "x/meta.json", "{}")
    put(tmp_path / "12/objs/a.obj", "# c\nv 0 0 0\nv  1 2 3\nv 1 2 3\nf 1 2 3\nvn 1 1 1\n")
    put(tmp_path / "12/objs/b.obj", "v 5 5 5\n")
    for i in range(3):
        put(tmp_path / f"13/objs/{i}.obj", "v 1 1 1\n")
    assert {r[0] for r in files.numeric_folders(spark, str(tmp_path)).collect()} == {"12", "13"}
    meta = {r["dir_id"]: r for r in files.model_meta(spark, str(tmp_path)).collect()}
    assert meta["12"]["model_cat"] == "Bed" and meta["13"]["model_id"] == ""
    cat = {r["dir_id"]: r["part_count"] for r in files.object_catalogue(spark, str(tmp_path)).collect()}
    assert cat == {"12": 2, "13": 3, "x": 0}
    pts = files.meshes(spark, str(tmp_path), most_parts=2).collect()
    assert sorted((r["mesh_id"], r["x"], r["z"]) for r in pts) == [("a", 0, 0), ("a", 1, 3), ("b", 5, 5)]
    tree = [{"id": 0, "name": "root", "children": [{"ori_id": 4, "name": "leaf", "objs": ["a"]}, {"name": "lost", "children": [{"id": 9}]}]}]
    put(tmp_path / "12/result_after_merging.json", json.dumps(tree))
    put(tmp_path / "13/result_after_merging.json", json.dumps(tree[0]))
    put(tmp_path / "x/result_after_merging.json", "{no")
    nodes = files.part_trees(spark, str(tmp_path)).collect()
    assert sorted((r["dir_id"], r["node_id"], r["parent_id"], r["depth"]) for r in nodes) == [(d, n, p, k) for d in ("12", "13") for n, p, k in ((0, None, 0), (4, 0, 1))]


def test_catalogues_and_images(spark, tmp_path):
    put(tmp_path / "s/0123/o1/models/m.obj", "v 1 1 1")
    put(tmp_path / "s/abc/o2/models/m.obj", "v 1 1 1")
    put(tmp_path / "z/0123.zip", b"PK")
    put(tmp_path / "z/readme.zip", b"PK")
    put(tmp_path / "i/a.png", b"\x89PNG")
    dim = spark.createDataFrame([("0123", "chair", "a seat")], "category_id string, name string, definition string")
    assert [tuple(r) for r in files.shape_catalogue(spark, str(tmp_path / "s"), dim).collect()] == [("o1", "0123", "chair")]
    assert [tuple(r) for r in files.archive_words(spark, str(tmp_path / "z"), dim).collect()] == [("0123", "chair")]
    assert files.images(spark, str(tmp_path / "i")).first()["data"] == "iVBORw=="
    assert files.words_of(spark.createDataFrame([("9",)], "category_id string"), dim).first()["name"] is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("train", [{"role": "user", "content": "ü"}]), ("test", [])], "split string, messages array<struct<role:string,content:string>>")
    sinks.write_jsonl(rows, str(tmp_path / "j"), split="split")
    assert files.conversations(spark, str(tmp_path / "j/split=train")).first()["messages"][0]["content"] == "ü"
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert json.loads(spark.read.csv(str(tmp_path / "c"), header=True, escape='"').filter("split = 'train'").first()["messages"])[0]["role"] == "user"
    sinks.write_stats({"a": rows.groupBy("split").count()}, str(tmp_path / "stats"))
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    part = dict(zip(FIELDS, map(float, (10, 20, 30, 0, 0, 15, 0, 0, 30))))
    d = spark.createDataFrame([("sft", "000", "p", "10 20 30 0 0 15 0 0 30", 2.0, [part]), ("sft", "001", None, None, None, None)], f"model_type string, experiment_id string, prompt string, design string, generation_time double, parts array<struct<{', '.join(f + ': double' for f in FIELDS)}>>")
    assert sinks.write_designs(d, str(tmp_path / "out")).agg({"files": "sum"}).first()[0] == 6
    assert files.generation_times(spark, str(tmp_path / "out")).first()["generation_time"] == 2.0
    raw = (tmp_path / "out/sft/000/model.stl").read_bytes()
    assert len(raw) == 84 + 12 * 50
    tri = np.frombuffer(raw[84:], dtype=np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))["v"].astype(float)
    assert np.einsum("ij,ij->i", tri[:, 0], np.cross(tri[:, 1], tri[:, 2])).sum() / 6 == pytest.approx(6000, rel=1e-5)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 9), st.data())
def test_binvox_round_trip(d, h, w, data):
    cells = data.draw(st.lists(st.tuples(st.integers(-1, d), st.integers(-1, w), st.integers(-1, h)), max_size=60))
    head = binvox.Header((d, h, w), (0.5, -1.0, 2.0), 1.5)
    got, v = binvox.decode(binvox.encode(head, np.array(cells).reshape(-1, 3)))
    assert got == head and sorted(map(tuple, v.tolist())) == sorted({c for c in cells if 0 <= c[0] < d and 0 <= c[1] < w and 0 <= c[2] < h})


@pytest.mark.parametrize("n", [255, 256, 510, 511])
def test_binvox_long_runs(n):
    raw = binvox.encode(binvox.Header((n, 1, 1), (0, 0, 0), 1), np.array([[i, 0, 0] for i in range(n)]))
    assert len(binvox.decode(raw)[1]) == n
    with pytest.raises(ValueError):
        binvox.decode(b"#other")


def test_binvox_source(spark, tmp_path):
    head = binvox.Header((4, 4, 4), (0.0, 0.0, 0.0), 1.0)
    vox = spark.createDataFrame([("a", 0, 1, 2), ("a", 3, 3, 3), ("a", 9, 0, 0), ("b", 1, 1, 1)], "m string, i int, j int, k int")
    for r in binvox.encoded(vox, ["m"], head).collect():
        put(tmp_path / f"{r['m']}.binvox", bytes(r["data"]))
    got = binvox.read(spark, str(tmp_path)).select("i", "j", "k").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2), (1, 1, 1), (3, 3, 3)]


def test_rating_stream_upserts(spark, tmp_path):
    head = "model_type,experiment_id,prompt,assemblability,prompt_satisfaction,design_quality\n"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put(tmp_path / "in/ann_ratings.csv", head + "sft,1,p,1,1,1\nsft,2,p,1,1,1\n")
    stream.upsert_stream(stream.rating_stream(spark, src), out, ck).awaitTermination(120)
    assert stream.current(spark, out).count() == 2
    time.sleep(1.1)
    put(tmp_path / "in/new/ann_ratings.csv", "")
    put(tmp_path / "in/bob_ratings.csv", head + "sft,1,p,2,2,2\n")
    stream.upsert_stream(stream.rating_stream(spark, src), out, ck).awaitTermination(120)
    now = stream.current(spark, out)
    assert now.count() == 3 and len(stream.versions(spark, out)) == 2
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert stream.windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_folders_and_special_names(spark, tmp_path):
    """Empty folders, plus signs and blanks in names, files at other depths."""
    for at, text in {"m+x/001/info.json": '{"generation_time": 1.5, "prompt": "p"}', "m y/a b/design.txt": "x", ".git/001/info.json": "{}", "loose.txt": "x", "m+x/notes.txt": "x", "123/objs/a.obj": "v 0 0 0", "124/9/a.txt": "x"}.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    (tmp_path / "m+x" / "002").mkdir()
    (tmp_path / "7").mkdir()
    got = {(r[0], r[1]): (r[2], r[3]) for r in files.designs(spark, str(tmp_path)).collect()}
    assert got == {("m+x", "001"): ("p", 1.5), ("m+x", "002"): ("", None), ("m y", "a b"): ("", None), ("123", "objs"): ("", None), ("124", "9"): ("", None)}
    assert {r[0] for r in files.numeric_folders(spark, str(tmp_path)).collect()} == {"123", "124", "7"}
    assert files.numeric_folders(spark, str(tmp_path / "7")).count() == 0


def test_faces(spark, tmp_path):
    at = tmp_path / "5" / "objs"
    at.mkdir(parents=True)
    (at / "p.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\nf 1/4/2 3//1 2/2\nf -1 -2 -3\nf 1 2\nf a b c\n# f 1 2 3\n")
    got = [(r["face"], list(r["corners"])) for r in files.faces(spark, str(tmp_path)).orderBy("face").collect()]
    assert got == [(0, [0, 1, 2]), (1, [0, 2, 1]), (2, [2, 1, 0])]
    assert {r["dir_id"] for r in files.faces(spark, str(tmp_path)).collect()} == {"5"}


def test_escaped_lines(spark, tmp_path):
    import json

    rows = [("train", 'é "x" \U0001f600\n', 1), ("test", None, 2), ("test", "plain", 3)]
    sinks.write_jsonl(spark.createDataFrame(rows, "split string, text string, n int"), str(tmp_path / "o"), split="split", ascii_only=True)
    raw = "".join(p.read_text("utf-8") for p in (tmp_path / "o").rglob("*.txt"))
    assert raw.isascii() and "\\u00e9" in raw and "\\ud83d\\ude00" in raw
    assert sorted((json.loads(x) for x in raw.splitlines()), key=lambda r: r["n"]) == [{"text": rows[0][1], "n": 1}, {"n": 2}, {"text": "plain", "n": 3}]


def test_dense_grid(spark):
    from joinery.operators import voxels as V

    pts = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 2, 3), ("a", 1, 2, 3), ("a", 9, 0, 0), ("b", 1, 0, 0)], "m string, i int, j int, k int")
    grid = V.dense(pts, ["m"], (2, 3, 4))
    assert grid.count() == 48 and sorted(map(tuple, V.sparse(grid, ["m"]).collect())) == [("a", 0, 0, 0), ("a", 1, 2, 3), ("b", 1, 0, 0)]
    big = V.dense(pts.limit(1), ["m"], (128, 128, 128))
    assert big.count() == 128**3 and big.filter("filled").count() == 1


def test_expand_splits(spark, monkeypatch):
    from joinery.operators import dataset as D

    rows = spark.createDataFrame([(i, [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a\nb"}]) for i in range(4)], "entry_id bigint, messages array<struct<role:string,content:string>>")
    with pytest.warns(UserWarning, match="no split test"):
        got = D.expand_splits({"train": rows}, ["entry_id"], "all")
    assert set(got) == {"train"} and got["train"].count() == 12
    monkeypatch.setattr(D, "MOST_EXAMPLES", 5)
    assert D.expand_splits({"train": rows, "test": rows}, ["entry_id"], "all")["test"].count() == 5
