"""The binvox voxel format, after its public specification.

A text header (`#binvox 1`, `dim d h w`, `translate x y z`, `scale s`, `data`), then pairs of bytes (value, count). The flat
index runs over x slowest, then z, then y.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Header:
    dims: tuple[int, int, int]
    translate: tuple[float, float, float]
    scale: float


def decode(raw: bytes) -> tuple[Header, np.ndarray]:
    """The header, and the filled voxels as rows of (x, y, z); ValueError if it is no binvox file."""
    if not raw.startswith(b"#binvox"):
        raise ValueError("no binvox file")
    at = raw.index(b"data\n") + 5
    fields = {w[0]: w[1:] for line in raw[:at].decode("ascii").splitlines() if (w := line.split())}
    d, h, w = (int(v) for v in fields["dim"])
    header = Header((d, h, w), tuple(float(v) for v in fields.get("translate", "0 0 0".split())), float(fields.get("scale", ["1"])[0]))
    pairs = np.frombuffer(raw[at:], dtype=np.uint8)
    pairs = pairs[: len(pairs) // 2 * 2].reshape(-1, 2)
    flat = np.flatnonzero(np.repeat(pairs[:, 0], pairs[:, 1]))
    x, rest = np.divmod(flat, w * h)
    z, y = np.divmod(rest, w)
    return header, np.stack([x, y, z], axis=1)


def encode(header: Header, voxels: np.ndarray) -> bytes:
    """The file of a voxel model; voxels outside the dimensions are dropped. Runs are cut at 255."""
    d, h, w = header.dims
    v = np.asarray(voxels, dtype=np.int64).reshape(-1, 3)
    v = v[((v >= 0) & (v < np.array([d, w, h]))).all(axis=1)]
    cells = np.zeros(d * h * w, dtype=np.uint8)
    cells[v[:, 0] * w * h + v[:, 2] * w + v[:, 1]] = 1
    out = bytearray()
    if len(cells):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
        for a, b in zip(starts[:-1], starts[1:]):
            n = int(b - a)
            while n:
                out += bytes((cells[a], min(n, 255)))
                n -= min(n, 255)
    text = f"#binvox 1\ndim {d} {h} {w}\ntranslate {' '.join(map(str, header.translate))}\nscale {header.scale}\ndata\n"
    return text.encode("ascii") + bytes(out)


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        at = Path(self.path.removeprefix("file://"))
        return [_Part(str(p)) for p in (sorted(at.rglob("*.binvox")) if at.is_dir() else [at])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            header, voxels = decode(f.read())
        for x, y, z in voxels.tolist():
            yield partition.path, x, y, z, list(header.dims), list(header.translate), header.scale


class BinvoxSource(DataSource):
    """`spark.read.format("binvox").load(path)`: one row per filled voxel, one task per file."""

    @classmethod
    def name(cls) -> str:
        return "binvox"

    def schema(self) -> str:
        return "path string, i int, j int, k int, dims array<int>, translate array<double>, scale double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BinvoxSource)
    return spark.read.format("binvox").load(path)


def encoded(voxels: DataFrame, key: list[str], header: Header) -> DataFrame:
    """(key, data): the binvox file of each model of (key, i, j, k); one task holds one model's voxels, which its dimensions bound."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), encode(header, pdf[["i", "j", "k"]].to_numpy())]], columns=[*key, "data"])

    schema = ", ".join(f"`{c}` {t}" for c, t in voxels.select(*key).dtypes) + ", data binary"
    return voxels.select(*key, "i", "j", "k").distinct().groupBy(*key).applyInPandas(run, schema)
