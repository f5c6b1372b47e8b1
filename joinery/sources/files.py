"""Readers of the file layouts of furniture data: tables, rating sheets, design folders, part trees, meshes, images."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.functions.scalars import is_digits, mime_type, reviewer_of

PROMPTS = "prompt_id int, prompt string, distribution string, difficulty_level int"
RATINGS = "model_type string, experiment_id string, prompt string, assemblability string, prompt_satisfaction string, design_quality string"
MESSAGES = "messages array<struct<role: string, content: string>>"


def parquet_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All parquet files of a folder, with all their columns."""
    return spark.read.option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PROMPTS, multiLine=True, escape='"')


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """All `*_ratings.csv` of a folder as text cells, with the reviewer each file is named after; unreadable files are passed over."""
    rows = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*_ratings.csv").csv(folder, header=True, schema=RATINGS, multiLine=True, escape='"', mode="PERMISSIVE")
    return rows.select("*", F.col("_metadata.file_name").alias("file_name")).withColumn("reviewer", reviewer_of(_from_url(F.col("file_name"))))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length): the files below a folder that are not empty; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")


def whole_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, value): the files below a folder as texts."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(_from_url(F.col("_metadata.file_path")).alias("path"), "value")


def _part(n: int, column: str = "path") -> F.Column:
    """The n-th folder from the end of a plain path, the file itself being 0."""
    return F.element_at(F.split(column, "/"), -1 - n)


def _from_url(c: F.Column) -> F.Column:
    """A path of the metadata column, whose special characters are percent-encoded, as a plain path; a plus sign stays one."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def folders(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    """(path): the folders `depth` steps below a folder, empty ones too, by the file system's own listing; each level is one listing per folder above it."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level = [top] if fs.exists(top) else []
    for _ in range(depth):
        level = [s.getPath() for at in level for s in fs.listStatus(at) if s.isDirectory()]
    root = fs.makeQualified(top).toUri().getPath().rstrip("/")
    return spark.createDataFrame([(p.toUri().getPath()[len(root) + 1 :],) for p in level], "path string")


def designs(spark: SparkSession, folder: str) -> DataFrame:
    """(model_type, experiment_id, prompt, generation_time) of `<model>/<experiment>/info.json`, sorted.

    A folder without a readable info.json keeps its row, with an empty prompt and no time, even if it is empty; folders whose name
    begins with a dot are passed over.
    """
    found = folders(spark, folder, 2).select(_part(1).alias("model_type"), _part(0).alias("experiment_id"))
    found = found.filter(~F.col("model_type").startswith(".") & ~F.col("experiment_id").startswith("."))
    info = whole_files(spark, folder, "info.json").select(_part(2).alias("model_type"), _part(1).alias("experiment_id"), F.from_json("value", "generation_time double, prompt string").alias("x"))
    return found.join(info, ["model_type", "experiment_id"], "left").select("model_type", "experiment_id", F.coalesce("x.prompt", F.lit("")).alias("prompt"), "x.generation_time").orderBy("model_type", "experiment_id")


def generation_times(spark: SparkSession, folder: str) -> DataFrame:
    """The designs that have a generation time."""
    return designs(spark, folder).filter("generation_time is not null")


def model_meta(spark: SparkSession, folder: str) -> DataFrame:
    """(dir_id, model_cat, model_id) of `<dir>/meta.json`; missing keys are empty."""
    x = F.from_json("value", "model_cat string, model_id string")
    return whole_files(spark, folder, "meta.json").select(_part(1).alias("dir_id"), F.coalesce(x["model_cat"], F.lit("")).alias("model_cat"), F.coalesce(x["model_id"], F.lit("")).alias("model_id"))


def numeric_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(dir_id): folders just below a folder whose name is a number, empty ones too."""
    return folders(spark, folder, 1).select(F.col("path").alias("dir_id")).filter(is_digits(F.col("dir_id")))


def object_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(object_id, category, dir_id, model_dir, part_count): models with their folder and their number of part meshes."""
    counts = listing(spark, folder, "*.obj").select(_part(2).alias("dir_id")).groupBy("dir_id").agg(F.count("*").cast("int").alias("part_count"))
    meta = model_meta(spark, folder)
    return meta.join(counts, "dir_id", "left").select(F.col("model_id").alias("object_id"), F.col("model_cat").alias("category"), "dir_id", F.concat(F.lit(folder.rstrip("/") + "/"), "dir_id").alias("model_dir"), F.coalesce("part_count", F.lit(0)).alias("part_count"))


def shape_catalogue(spark: SparkSession, folder: str, synsets: DataFrame) -> DataFrame:
    """(object_id, category_id, category): `<category>/<object>/...*.obj`, with the categories' names from (category_id, name)."""
    found = listing(spark, folder, "*.obj").withColumn("below", F.element_at(F.split("path", F.lit(folder.rstrip("/") + "/")), -1))
    rows = found.select(F.get(F.split("below", "/"), F.lit(0)).alias("category_id"), F.get(F.split("below", "/"), F.lit(1)).alias("object_id")).filter(is_digits(F.col("category_id"))).distinct()
    return rows.join(synsets.select("category_id", F.col("name").alias("category")), "category_id", "left").select("object_id", "category_id", "category")


def archive_words(spark: SparkSession, folder: str, synsets: DataFrame) -> DataFrame:
    """(category_id, name): names of the zip files of a folder that are numbers, with their words."""
    ids = listing(spark, folder, "*.zip").select(F.regexp_replace(_part(0), r"\.zip$", "").alias("category_id")).filter(F.col("category_id").rlike("^[0-9]+$"))
    return ids.join(synsets.select("category_id", "name"), "category_id", "left")


def part_trees(spark: SparkSession, folder: str, name: str = "result_after_merging.json") -> DataFrame:
    """(dir_id, node_id, parent_id, name, objs, depth): one row per node of each model's part tree.

    The root may be an object or a list; of a node without id and ori_id the whole subtree is left out. The JSON is recursive, so
    it has no fixed schema and is read by Arrow batches.
    """
    schema = "dir_id string, node_id bigint, parent_id bigint, name string, objs array<string>, depth int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dir_id, text in zip(pdf["dir_id"], pdf["value"]):
                try:
                    root = json.loads(text)
                except ValueError:
                    continue
                todo = [(x, None, 0) for x in (root if isinstance(root, list) else [root])]
                while todo:
                    node, parent, depth = todo.pop()
                    me = node.get("id", node.get("ori_id")) if isinstance(node, dict) else None
                    if me is None:
                        continue
                    out.append((dir_id, int(me), parent, node.get("name"), list(node.get("objs") or []), depth))
                    todo += [(x, int(me), depth + 1) for x in node.get("children") or []]
            frame = pd.DataFrame(out, columns=["dir_id", "node_id", "parent_id", "name", "objs", "depth"])
            yield frame.astype({"node_id": "Int64", "parent_id": "Int64"})

    return whole_files(spark, folder, name).select(_part(1).alias("dir_id"), "value").mapInPandas(run, schema)


def meshes(spark: SparkSession, folder: str, most_parts: int = 100) -> DataFrame:
    """(dir_id, mesh_id, pt_idx, x, y, z): the distinct vertices of each part's OBJ file.

    Models with more than `most_parts` files are left out before any file is read. Lines are parsed JVM-side.
    """
    few = listing(spark, folder, "*.obj").select(_part(2).alias("dir_id")).groupBy("dir_id").count().filter(f"count <= {most_parts}").select("dir_id")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.obj").text(folder).select(_from_url(F.col("_metadata.file_path")).alias("path"), "value").filter("value like 'v %'")
    t = F.split(F.trim(F.regexp_replace(F.expr("substring(value, 2)"), r"\s+", " ")), " ")
    v = lines.select(_part(2).alias("dir_id"), F.regexp_replace(_part(0), r"\.obj$", "").alias("mesh_id"), *[F.get(t, F.lit(i)).try_cast("double").alias(a) for i, a in enumerate("xyz")])
    v = v.filter("x is not null and y is not null and z is not null").distinct().join(few, "dir_id", "left_semi")
    from pyspark.sql.window import Window

    w = Window.partitionBy("dir_id", "mesh_id").orderBy("x", "y", "z")
    return v.withColumn("pt_idx", F.row_number().over(w) - 1).select("dir_id", "mesh_id", "pt_idx", "x", "y", "z")


def faces(spark: SparkSession, folder: str) -> DataFrame:
    """(dir_id, mesh_id, face, corners): the faces of each part's OBJ file in file order, as numbers of vertices counted from 0.

    Of a corner `v/vt/vn` only the vertex is kept. Numbers below 0 count back from the vertices read so far. An OBJ file is read whole, since the
    order of its lines matters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dir_id, mesh_id, text in zip(pdf["dir_id"], pdf["mesh_id"], pdf["value"]):
                vertices = n = 0
                for line in text.splitlines():
                    kind, *rest = line.split() or [""]
                    vertices += kind == "v"
                    if kind == "f" and len(rest) >= 3 and all(c.split("/")[0].lstrip("-").isdecimal() for c in rest):
                        numbers = [int(c.split("/")[0]) for c in rest]
                        out.append((dir_id, mesh_id, n, [k - 1 if k > 0 else vertices + k for k in numbers]))
                        n += 1
            yield pd.DataFrame(out, columns=["dir_id", "mesh_id", "face", "corners"])

    rows = whole_files(spark, folder, "*.obj").select(_part(2).alias("dir_id"), F.regexp_replace(_part(0), r"\.obj$", "").alias("mesh_id"), "value")
    return rows.mapInPandas(run, "dir_id string, mesh_id string, face int, corners array<int>")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Training conversations of a JSON-lines file or folder."""
    return spark.read.schema(MESSAGES).json(path)


def continuations(spark: SparkSession, path: str) -> DataFrame:
    """Prompts with their next line of a JSON-lines file or folder."""
    return spark.read.schema("prompt array<struct<role: string, content: string>>, next_brick string").json(path)


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, mime, data): images in base64."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", mime_type(F.col("path")).alias("mime"), F.base64("content").alias("data"))


def words_of(ids: DataFrame, synsets: DataFrame, key: str = "category_id") -> DataFrame:
    """Adds name and definition of a category from the supplied dimension; unknown ids keep nulls."""
    return ids.join(synsets.select(key, "name", "definition"), key, "left")
