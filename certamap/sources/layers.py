"""Readers and writers: GeoParquet points and polygons, shapefiles, CSV, and the catalogue of layers."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from certamap.functions.certainty import nan_to_null

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
#: Columns of the scored address table.
MASTER_COLUMNS = ("geometry", "GCI", "MCI", "LCI", "PCI", "match_distance", "COD_SETOR", "COD_ESPECIE", "COD_TIPO_ESPECI", "NOME_REGIO", "COMPLETUDE", "NOME_BAIRR", "NV_GEO_COORD", "SITUACAO_P", "EXISTENCIA")


def _coordinates(raw: np.ndarray, little: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of doubles, each row in its own byte order."""
    out = raw.copy().view("<f8").astype(float)
    out[~little] = raw[~little].copy().view(">f8")
    return out


def wkb_point(column: str):
    """struct<x, y> of a WKB point column; null for null, short or empty points."""

    @F.pandas_udf("struct<x:double,y:double>")
    def parse(s: pd.Series) -> pd.DataFrame:
        out = np.full((len(s), 2), np.nan)
        whole = np.fromiter((b is not None and len(b) >= 21 for b in s), bool, len(s))
        raw = np.frombuffer(b"".join(b[:21] for b in s[whole]), np.uint8).reshape(-1, 21)
        if len(raw):
            out[whole] = _coordinates(raw[:, 5:], raw[:, 0] == 1)
        return pd.DataFrame(out, columns=["x", "y"]).astype(object).where(~np.isnan(out), None)

    return parse(F.col(column))


def point_wkb(x: str, y: str):
    """WKB points of two columns of doubles; null where either is."""

    @F.pandas_udf("binary")
    def pack(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = np.stack([x.to_numpy("<f8"), y.to_numpy("<f8")], axis=1).view(np.uint8).reshape(-1, 16)
        none = x.isna() | y.isna()
        return pd.Series([None if gone else b"\x01\x01\0\0\0" + row.tobytes() for row, gone in zip(rows, none, strict=True)])

    return pack(F.col(x), F.col(y))


def wkb_ring(column: str):
    """Outer ring of a WKB polygon column; null for what is no polygon. Coordinates are read a batch at a time."""

    @F.arrow_udf(RING)
    def parse(s: pa.Array) -> pa.Array:
        sizes, bodies, gone = [], [], []
        for b in s.to_pylist():
            order = "<" if b and b[0] == 1 else ">"
            kind, rings, n = struct.unpack_from(f"{order}III", b, 1) if b is not None and len(b) >= 13 else (0, 0, 0)
            fits = kind & 0xFF == 3 and rings > 0 and len(b) >= 13 + 16 * n
            gone.append(not fits)
            sizes.append(n if fits else 0)
            bodies.append(np.frombuffer(b, f"{order}f8", 2 * n, 13).astype(float) if fits else np.zeros(0))
        v = np.concatenate(bodies) if bodies else np.zeros(0)
        xy = pa.StructArray.from_arrays([pa.array(v[::2]), pa.array(v[1::2])], names=["x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), xy, mask=pa.array(gone, pa.bool_()))

    return parse(F.col(column))


def read_points(spark: SparkSession, path: str, columns: list[str] | None = None, geometry: str = "geometry") -> DataFrame:
    """GeoParquet points as x, y beside the other columns, of which only `columns` are scanned; NaN becomes null."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    if geometry in df.columns:
        df = df.withColumn("_p", wkb_point(geometry)).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", geometry)
    return nan_to_null(df)


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def filter_city(df: DataFrame, column: str, code: str) -> DataFrame:
    """Rows of one municipality."""
    return df.where(F.col(column).cast("string") == code)


def register(spark: SparkSession, layers: dict[str, str]) -> None:
    """A temporary view for every layer of a catalogue {name: path}."""
    for name, path in layers.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def dbf_rows(raw: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """Records of a dBASE table as text; deleted ones are None-valued, to keep step with the shapes."""
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, raw[at + 16]))
        at += 32
    for k in range(n):
        pos = head + k * size + 1
        row = {}
        for name, width in fields:
            row[name] = raw[pos : pos + width].decode(encoding, "replace").strip() or None
            pos += width
        yield row


def shp_shapes(raw: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """Parts of every shape: one point, the lines of a polyline, or the rings of a polygon."""
    at = 100
    while at + 8 <= len(raw):
        _, words = struct.unpack_from(">II", raw, at)
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack_from("<I", body)[0]
        if kind == 1:
            yield [[struct.unpack_from("<dd", body, 4)]]
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<II", body, 36)
            starts = [*struct.unpack_from(f"<{parts}I", body, 44), points]
            v = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
            xy = list(zip(v[::2], v[1::2], strict=True))
            yield [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield []


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").load(path): shape_id, part_id, ring, and the attributes as a map. `path` is the .shp; the .dbf lies beside it."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("shape_id", T.LongType()), T.StructField("part_id", T.IntegerType()), T.StructField("ring", RING), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShapefileReader(self.options["path"])


class _ShapefileReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            shapes = shp_shapes(f.read())
        try:
            with open(self.path[:-4] + ".dbf", "rb") as f:
                rows = dbf_rows(io.BytesIO(f.read()).getvalue())
        except FileNotFoundError:
            rows = iter(())
        for k, parts in enumerate(shapes):
            attrs = next(rows, {})
            for j, ring in enumerate(parts):
                yield k, j, [(float(x), float(y)) for x, y in ring], attrs


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").load(path)
