"""Writers: tables as CSV and JSON lines, rating sheets, statistics, design folders, STL solids."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from joinery.functions.geometry import FIELDS
from joinery.operators.solids import euler_matrix


def flat(df: DataFrame) -> DataFrame:
    """The rows with nested columns as JSON texts, as CSV needs."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).csv(path, header=True, escape='"')


def escaped(text: F.Column) -> F.Column:
    """A JSON text with every character beyond ASCII as `\\uXXXX`, those beyond the basic plane as two."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(c: str) -> str:
            raw = c.encode("utf-16-be")
            return "".join(f"\\u{raw[k]:02x}{raw[k + 1]:02x}" for k in range(0, len(raw), 2))

        return x.map(lambda t: t if t is None or t.isascii() else "".join(c if c.isascii() else one(c) for c in t))

    return run(text)


def write_jsonl(df: DataFrame, path: str, split: str | None = None, mode: str = "overwrite", ascii_only: bool = False) -> None:
    """JSON lines; with a split column, one folder `split=...` per split. With ascii_only, other characters are written as escapes."""
    if ascii_only:
        names = [c for c in df.columns if c != split]
        line = escaped(F.to_json(F.struct(*names))).alias("value")
        rows = df.select(line, *([split] if split else []))
        (rows.write.mode(mode).partitionBy(split) if split else rows.write.mode(mode)).text(path)
        return
    w = df.write.mode(mode)
    (w.partitionBy(split) if split else w).json(path)


def write_stats(tables: dict[str, DataFrame], folder: str) -> None:
    """Each report as a CSV folder of its name."""
    for name, df in tables.items():
        write_csv(df.coalesce(1), f"{folder}/{name}")  # reports have one row per group


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def stl(boxes: np.ndarray) -> bytes:
    """A binary STL of boxes (n x 9: dx..rz), twelve triangles each."""
    unit = np.array([[x, y, z] for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5)])
    quads = ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))
    out = []
    for b in np.atleast_2d(boxes):
        v = (unit * b[:3]) @ euler_matrix(*b[6:9]).T + b[3:6]
        for a, c, d, e in quads:
            out += [(v[a], v[c], v[d]), (v[a], v[d], v[e])]
    data = bytearray(b"\0" * 80 + struct.pack("<I", len(out)))
    for t in out:
        n = np.cross(t[1] - t[0], t[2] - t[0])
        n = n / (np.linalg.norm(n) or 1)
        data += struct.pack("<12fH", *n, *t[0], *t[1], *t[2], 0)
    return bytes(data)


def write_designs(designs: DataFrame, folder: str) -> DataFrame:
    """Writes `<folder>/<model_type>/<experiment_id>/` with design.txt, info.json and model.stl for each design; returns (path, files).

    designs: model_type, experiment_id, prompt, design, generation_time, parts (array of box structs). The folder must be shared by
    all executors; a task writes each file under a temporary name and renames it, so a repeated task leaves whole files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for r in pdf.itertuples():
                at = os.path.join(folder, str(r.model_type), str(r.experiment_id))
                os.makedirs(at, exist_ok=True)
                info = {"generation_time": None if pd.isna(r.generation_time) else float(r.generation_time), "prompt": r.prompt}
                boxes = np.array([[p[f] for f in FIELDS] for p in r.parts], dtype=float) if r.parts is not None and len(r.parts) else np.zeros((0, 9))
                files = {"design.txt": (r.design or "").encode(), "info.json": json.dumps(info).encode(), "model.stl": stl(boxes) if len(boxes) else b"\0" * 84}
                for name, data in files.items():
                    with open(tmp := os.path.join(at, f".{name}.{os.getpid()}"), "wb") as f:
                        f.write(data)
                    os.replace(tmp, os.path.join(at, name))
                done.append((at, len(files)))
            yield pd.DataFrame(done, columns=["path", "files"])

    return designs.select("model_type", "experiment_id", "prompt", "design", "generation_time", "parts").mapInPandas(run, "path string, files int")
