"""VTK XML files: a Spark data source for cell data (.vti, .vtu), and writers for meshes and surfaces."""

from __future__ import annotations

import base64
import io
import logging
import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..stages import cut

log = logging.getLogger(__name__)
_TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}
SCHEMA = "file string, cell_id long, cx double, cy double, cz double, field string, value array<double>"
ARROW = pa.schema([("file", pa.string()), ("cell_id", pa.int64()), *[(c, pa.float64()) for c in ("cx", "cy", "cz")], ("field", pa.string()), ("value", pa.list_(pa.float64()))])


_APPENDED = b"<AppendedData"


class _Arrays:
    """Decodes the DataArrays of one file: ASCII, inline base64, or appended (raw or base64), zlib-compressed or not.

    The header is read first; of appended arrays only those asked for are read, at their offsets.
    """

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        head, start = bytearray(), -1
        while start < 0 and (more := file.read(1 << 16)):
            head += more
            start = head.find(_APPENDED, max(0, len(head) - len(more) - len(_APPENDED)))
        self.begin, self.encoding = 0, "base64"
        if start >= 0:
            while (mark := head.find(b"_", start)) < 0 and (more := file.read(1 << 10)):
                head += more
            self.begin = mark + 1
            self.encoding = "raw" if b'encoding="raw"' in head[start : mark + 1] else "base64"
            head = head[:start] + b"</VTKFile>"
        self.root = ElementTree.fromstring(bytes(head))
        self.order = "<" if self.root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
        self.head = self.order + _TYPES[self.root.get("header_type", "UInt32")]
        self.zipped = bool(self.root.get("compressor"))

    def _appended(self, at: int, n: int) -> bytes:
        self.file.seek(self.begin + at)
        return self.file.read(n)

    def _blocks(self, data: Callable[[int, int], bytes], plain: bool) -> bytes:
        """Payload behind its header; ``plain`` bytes, or base64 in which header and payload are encoded apart."""
        unit = np.dtype(self.head).itemsize
        size = (lambda n: n) if plain else (lambda n: 4 * -(-n // 3))
        take = data if plain else (lambda at, n: base64.b64decode(data(at, size(n))))
        count = int(np.frombuffer(take(0, unit), self.head, 1)[0])
        if not self.zipped:
            return take(0, unit + count)[unit : unit + count]
        header = np.frombuffer(take(0, unit * (3 + count)), self.head, 3 + count)
        at, lengths = size(unit * (3 + count)), header[3:].tolist()
        body = take(at, sum(lengths))
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
        return b"".join(zlib.decompress(body[edges[k] : edges[k + 1]]) for k in range(count))

    def values(self, node: ElementTree.Element) -> np.ndarray:
        kind = self.order + _TYPES[node.get("type")]
        form = node.get("format", "ascii")
        if form == "ascii":
            return np.array((node.text or "").split(), kind)
        if form == "binary":
            text = (node.text or "").strip().encode()
            return np.frombuffer(self._blocks(lambda at, n: text[at : at + n], False), kind)
        begin = int(node.get("offset", "0"))
        return np.frombuffer(self._blocks(lambda at, n: self._appended(begin + at, n), self.encoding == "raw"), kind)


def parse_cells(file: BinaryIO | bytes, wanted: Callable[[str], bool] = lambda name: True) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Cell centres (n, 3) and the wanted cell data (n, components) of an image or an unstructured grid.

    Where no field is wanted, no array is decoded, and there are no centres either.
    """
    arrays = _Arrays(io.BytesIO(file) if isinstance(file, bytes) else file)
    piece = arrays.root.find(".//Piece")
    if piece is None or (arrays.root.find("ImageData") is None and piece.find("Points/DataArray") is None):
        raise ValueError("no piece with points or an extent")
    nodes = [node for node in piece.findall("CellData/DataArray") if wanted(node.get("Name"))]
    if not nodes:
        return np.empty((0, 3)), {}
    image = arrays.root.find("ImageData")
    if image is not None:
        extent = list(map(int, piece.get("Extent", image.get("WholeExtent")).split()))
        origin, spacing = (list(map(float, image.get(k, d).split())) for k, d in (("Origin", "0 0 0"), ("Spacing", "1 1 1")))
        axes = [origin[a] + spacing[a] * (np.arange(extent[2 * a], max(extent[2 * a + 1], extent[2 * a] + 1)) + 0.5) for a in range(3)]
        z, y, x = np.meshgrid(*axes[::-1], indexing="ij")
        centres = np.stack([x.ravel(), y.ravel(), z.ravel()], axis=1)
    else:
        points = arrays.values(piece.find("Points/DataArray")).reshape(-1, 3)
        named = {n.get("Name"): arrays.values(n) for n in piece.findall("Cells/DataArray")}
        ends = named["offsets"].astype(int)
        starts = np.concatenate([[0], ends[:-1]])
        # the mean of a cell's bounding box, as cell centres of regular cells are
        own = points[named["connectivity"].astype(int)]
        centres = (np.minimum.reduceat(own, starts) + np.maximum.reduceat(own, starts)) / 2
    fields = {}
    for node in nodes:
        n = int(node.get("NumberOfComponents", "1"))
        fields[node.get("Name")] = arrays.values(node).astype(float).reshape(-1, n)
    return centres, fields


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class VtkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.fields = {f for f in options.get("fields", "").split(",") if f}
        self.mode = options.get("mode", "PERMISSIVE").upper()

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            if os.path.isdir(path):
                found += sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith((".vti", ".vtu")))
            else:
                found.append(path)
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Rows of one file, a batch a field. Files that can't be opened or parsed, or have no cell data or none of the
        fields, are logged and skipped, or raise with mode FAILFAST. Appended arrays of other fields aren't read."""
        try:
            with open(partition.value, "rb") as file:
                centres, wanted = parse_cells(file, lambda name: not self.fields or name in self.fields)
            if not wanted:
                raise ValueError(f"{partition.value} has none of the fields")
        except (OSError, OverflowError, ValueError, KeyError, struct.error, zlib.error, ElementTree.ParseError) as error:
            if self.mode == "FAILFAST":
                raise
            log.warning("skipped %s: %s", partition.value, error)
            return
        for name, values in wanted.items():
            n = len(centres)
            columns = [pa.array([partition.value] * n), pa.array(np.arange(n)), *(pa.array(centres[:, a]) for a in range(3)), pa.array([name] * n), pa.array(values.tolist())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class VtkDataSource(DataSource):
    """``spark.read.format("vtk")``: one partition per file, one row per cell and field."""

    @classmethod
    def name(cls) -> str:
        return "vtk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VtkReader:
        return VtkReader(self.options)


def read_vtk(spark: SparkSession, paths: Sequence[str], fields: Sequence[str] = (), mode: str = "PERMISSIVE") -> DataFrame:
    """Cell data of files on a path that all executors see; of appended arrays only those of ``fields`` are read.

    Fields are an option and not pushed filters: Spark 4.1 keeps what was pushed with the frame, so that a later query of
    the same frame without such a filter lost rows.
    """
    spark.dataSource.register(VtkDataSource)
    return spark.read.format("vtk").option("path", ",".join(paths)).option("fields", ",".join(fields)).option("mode", mode).load()


def gridded(cells: DataFrame, digits: int = 9) -> DataFrame:
    """file, field, i, j, k, value: cells on the regular grid that their centres imply; 3-vectors run z to x as axes do.

    Indices are ranks of the rounded coordinates within each file.
    """
    from pyspark.sql import Window

    from ..operators.grids import flip_vectors

    out = cells
    for c, index in zip(("cx", "cy", "cz"), "ijk", strict=True):
        out = out.withColumn("_at", F.round(c, digits))
        axis = out.select("file", "_at").distinct().withColumn(index, (F.row_number().over(Window.partitionBy("file").orderBy("_at")) - 1).cast("int"))
        out = out.join(axis, ["file", "_at"]).drop("_at")
    return out.select("file", "field", "i", "j", "k", flip_vectors(F.col("value")).alias("value"))


def is_regular(cells: DataFrame, digits: int = 9) -> DataFrame:
    """file, regular: whether the distinct coordinates of a file's cells make a full grid."""
    one = cells.select("file", "cell_id", *[F.round(c, digits).alias(c) for c in ("cx", "cy", "cz")]).distinct()
    sizes = one.groupBy("file").agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"n{c}") for c in ("cx", "cy", "cz")])
    return sizes.select("file", (F.col("n") == F.col("ncx") * F.col("ncy") * F.col("ncz")).alias("regular"))


def grid_headers(cells: DataFrame, digits: int = 9) -> DataFrame:
    """file, n_cells, nx, ny, nz, lx, ly, lz: shape and extent (spacing times cells) of each file's grid."""
    rounded = cells.select("file", "cell_id", *[F.round(c, digits).alias(c) for c in ("cx", "cy", "cz")])
    whole = rounded.groupBy("file").agg(
        F.countDistinct("cell_id").alias("n_cells"),
        *[f(c).alias(f"{n}{c[1]}") for c in ("cx", "cy", "cz") for n, f in (("n", F.countDistinct), ("_low", F.min), ("_high", F.max))],
    )
    length = {c: F.when(F.col(f"n{c}") > 1, (F.col(f"_high{c}") - F.col(f"_low{c}")) * F.col(f"n{c}") / (F.col(f"n{c}") - 1)).otherwise(2 * F.col(f"_low{c}")) for c in "xyz"}
    return whole.select("file", "n_cells", "nx", "ny", "nz", *[length[c].alias(f"l{c}") for c in "xyz"])


def _data_array(kind: str, name: str | None, lines: Iterator[str], components: int | None = None) -> Iterator[str]:
    attributes = f"type={quoteattr(kind)}" + (f" Name={quoteattr(name)}" if name else "") + (f' NumberOfComponents="{components}"' if components else "")
    yield f'<DataArray {attributes} format="ascii">\n'
    for line in lines:
        yield line + "\n"
    yield "</DataArray>\n"


def write_tessellation(faces: DataFrame, path: str) -> None:
    """A tessellation as polyhedra, a plane one as polygons (.vtu): vertices, cells, their faces, and ``crystal_id``.

    Vertices are numbered and cells described in Spark; the sorted texts stream to the file.
    """
    from ..operators.voronoi import cell_polygons, vertex_places

    plane = faces.where(F.size("verts") > 2).limit(1).count() == 0
    if plane:
        faces = cell_polygons(faces).select(F.col("seed_id").alias("seed_a"), F.col("seed_id").alias("seed_b"), *[F.lit(0).alias(f"o{c}") for c in "xyz"], "verts")
    faces = cut(faces, "faces")
    corners = vertex_places(faces)
    vertices = corners.where("least")
    at = [F.col(f"p.{c}").alias(c) for c in "xyz"]
    placed = faces.select("seed_a", "seed_b", "ox", "oy", "oz", F.posexplode("verts").alias("n", "p")).select("seed_a", "seed_b", "ox", "oy", "oz", "n", *at).join(corners, ["x", "y", "z"])
    loops = placed.groupBy("seed_a", "seed_b", "ox", "oy", "oz").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "vertex"))), lambda v: v["vertex"]).alias("loop"))
    cells = loops.groupBy("seed_a").agg(F.array_sort(F.collect_list("loop")).alias("loops")).select("seed_a", "loops", (F.get("loops", 0) if plane else F.array_sort(F.array_distinct(F.flatten("loops")))).alias("own"))
    held = cut(cells, "cells").orderBy("seed_a")
    n_points, n_cells = vertices.count(), held.count()
    rows = lambda: held.toLocalIterator()

    def running(step) -> Iterator[str]:
        total = 0
        for r in rows():
            total += step(r)
            yield str(total)

    with open(path, "w", encoding="ascii") as out:
        out.write('<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian">\n<UnstructuredGrid>\n')
        out.write(f'<Piece NumberOfPoints="{n_points}" NumberOfCells="{n_cells}">\n<Points>\n')
        out.writelines(_data_array("Float32", None, (f"{round(r['x'], 9)} {round(r['y'], 9)} {round(r['z'], 9)}" for r in vertices.orderBy("vertex").toLocalIterator()), 3))
        out.write("</Points>\n<Cells>\n")
        out.writelines(_data_array("Int32", "connectivity", (" ".join(map(str, r["own"])) for r in rows())))
        out.writelines(_data_array("Int32", "offsets", running(lambda r: len(r["own"]))))
        out.writelines(_data_array("UInt8", "types", ("7" if plane else "42" for _ in range(n_cells))))
        if not plane:
            out.writelines(_data_array("Int32", "faces", (" ".join([str(len(r["loops"])), *[f"{len(p)} {' '.join(map(str, p))}" for p in r["loops"]]]) for r in rows())))
            out.writelines(_data_array("Int32", "faceoffsets", running(lambda r: 1 + sum(1 + len(p) for p in r["loops"]))))
        out.write('</Cells>\n<CellData Scalars="crystal_id">\n')
        out.writelines(_data_array("Int32", "crystal_id", (str(r["seed_a"]) for r in rows())))
        out.write("</CellData>\n</Piece>\n</UnstructuredGrid>\n</VTKFile>\n")


def write_surface(points: DataFrame, path: str, thetas: int, phis: int, value: str = "E") -> None:
    """A modulus surface (t, p, sx, sy, sz, value) as quads of a legacy VTK file."""
    rows = points.select("t", "p", "sx", "sy", "sz", value).orderBy("t", "p").toPandas()
    with open(path, "w", encoding="ascii") as out:
        out.write(f"# vtk DataFile Version 3.0\nsurface\nASCII\nDATASET POLYDATA\nPOINTS {len(rows)} double\n")
        out.writelines(f"{x!r} {y!r} {z!r}\n" for x, y, z in rows[["sx", "sy", "sz"]].itertuples(index=False))
        quads = (thetas - 1) * (phis - 1)
        out.write(f"POLYGONS {quads} {5 * quads}\n")
        for t in range(thetas - 1):
            for p in range(phis - 1):
                a = t * phis + p
                out.write(f"4 {a} {a + 1} {a + phis + 1} {a + phis}\n")
        out.write(f"POINT_DATA {len(rows)}\nSCALARS {value} double 1\nLOOKUP_TABLE default\n")
        out.writelines(f"{v!r}\n" for v in rows[value])


def pack_inline(values: np.ndarray) -> str:
    """Inline base64 text of an array, as VTK files without compression hold it."""
    body = values.tobytes()
    return base64.b64encode(struct.pack("<I", len(body)) + body).decode()
