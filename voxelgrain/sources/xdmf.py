"""XDMF descriptions of dataset catalogs, with a command line."""

from __future__ import annotations

import argparse
import logging
import os
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.results import component_kind, time_of, without_time

log = logging.getLogger(__name__)


def described(catalog: DataFrame, time_series: bool = False, keyword: str = "time_step") -> DataFrame:
    """Datasets that can be shown: path, shape, name, kind, centre, time, and the grid (nx, ny, nz) they belong to."""
    out = catalog.select("path", "shape", component_kind(F.col("shape")).alias("kind"), time_of("path", keyword).alias("time")).where("kind is not null")
    if time_series:
        out = out.where("time is not null")
    name = without_time("path", keyword) if time_series else F.col("path")
    # displacements live on nodes, whatever else the path says
    centre = F.when(F.col("path").contains("displacement"), "Node").otherwise("Cell")
    return out.select("path", "shape", "kind", "time", name.alias("name"), centre.alias("centre"), *[F.get("shape", a).alias(n) for a, n in enumerate(("nx", "ny", "nz"))])


def xdmf_tree(catalog: DataFrame, data_file: str, lengths=(1.0, 1.0, 1.0), time_series: bool = False, keyword: str = "time_step") -> ElementTree.ElementTree:
    """The description: a grid for each size, or a temporal collection for each size with its steps in numeric order."""
    grids = described(catalog, time_series, keyword)
    keys = ["nx", "ny", "nz", "time"] if time_series else ["nx", "ny", "nz"]
    rows = grids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", "name", "kind", "centre", "shape"))).alias("sets")).orderBy(*keys)
    root = ElementTree.Element("Xdmf", Version="2.0")
    domain = ElementTree.SubElement(root, "Domain")
    collections: dict[tuple, ElementTree.Element] = {}
    item = {"NumberType": "Float", "Precision": "4"}
    for row in rows.toLocalIterator():
        size = (row["nx"], row["ny"], row["nz"])
        name = "x".join(map(str, size))
        parent = domain
        if time_series:
            if size not in collections:
                collections[size] = ElementTree.SubElement(domain, "Grid", Name=name, GridType="Collection", CollectionType="Temporal")
            parent = collections[size]
        grid = ElementTree.SubElement(parent, "Grid", Name=name, GridType="Uniform")
        if time_series:
            ElementTree.SubElement(grid, "Time", Type="Single", Value=str(row["time"]))
        ElementTree.SubElement(grid, "Topology", TopologyType="3DCoRectMesh", NumberOfElements=" ".join(map(str, size)))
        geometry = ElementTree.SubElement(grid, "Geometry", GeometryType="ORIGIN_DXDYDZ")
        for values in ((0, 0, 0), tuple(length / n for length, n in zip(lengths, size, strict=True))):
            ElementTree.SubElement(geometry, "DataItem", Dimensions="3", Format="XML", **item).text = " ".join(map(str, values))
        for one in row["sets"]:
            attribute = ElementTree.SubElement(grid, "Attribute", Name=one["name"], AttributeType=one["kind"], Center=one["centre"])
            ElementTree.SubElement(attribute, "DataItem", Dimensions=" ".join(map(str, one["shape"])), Format="HDF", **item).text = f"{data_file}:{one['path']}"
            log.info("described %s", one["path"])
    return ElementTree.ElementTree(root)


def write_xdmf(catalog: DataFrame, data_file: str, path: str | None = None, **options) -> str:
    """Write the description beside the working directory by default; returns its path."""
    data_file = os.path.abspath(data_file)
    path = path or os.path.join(os.getcwd(), os.path.splitext(os.path.basename(data_file))[0] + ".xdmf")
    tree = xdmf_tree(catalog, data_file, **options)
    ElementTree.indent(tree)
    tree.write(path, encoding="utf-8", xml_declaration=True)
    return path


def main(argv: list[str] | None = None) -> None:
    """Describe HDF5 files (needs h5py for their catalogs)."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("files", nargs="+")
    parser.add_argument("-x", "--xdmf", action="append", default=[], help="output path, one for each file in turn")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("-c", "--cube-length", nargs=3, type=float, default=(1.0, 1.0, 1.0))
    parser.add_argument("-t", "--time-series", action="store_true")
    parser.add_argument("-k", "--time-keyword", default="time_step")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    from ..session import local_session
    from .hdf5 import catalog

    spark = local_session()
    for n, file in enumerate(args.files):
        out = args.xdmf[n] if n < len(args.xdmf) else None
        print(write_xdmf(catalog(spark, [file]), file, out, lengths=tuple(args.cube_length), time_series=args.time_series, keyword=args.time_keyword))


if __name__ == "__main__":
    main()
