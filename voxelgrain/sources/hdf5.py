"""HDF5 files, where h5py is installed: catalogs, images, merging, and a command line for merging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import permute_axes
from ..operators.results import clashes, merge

try:
    import h5py
except ImportError:  # the format is optional
    h5py = None

log = logging.getLogger(__name__)
CATALOG = "file string, file_ord int, path string, shape array<int>, dtype string, attrs map<string, string>"


def _needed() -> None:
    if h5py is None:
        raise ImportError("HDF5 files need h5py, which is not installed; Parquet is the native format")


def catalog(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """One row per dataset of the files, which all executors see; each file is crawled by its own task."""
    _needed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for name, order in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []

                def visit(path, node, rows=rows, name=name, order=order):
                    if isinstance(node, h5py.Dataset):
                        attrs = {k: json.dumps(v.tolist() if isinstance(v, np.ndarray | np.generic) else str(v)) for k, v in node.attrs.items()}
                        rows.append({"file": name, "file_ord": order, "path": f"/{path}", "shape": list(node.shape), "dtype": str(node.dtype), "attrs": list(attrs.items())})

                with h5py.File(name, "r") as file:
                    file.visititems(visit)
                types = pa.schema([("file", pa.string()), ("file_ord", pa.int32()), ("path", pa.string()), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])
                yield pa.RecordBatch.from_pylist(rows, types)

    listed = spark.createDataFrame([(f, n) for n, f in enumerate(files)], "file string, file_ord int").repartition(max(1, len(files)))
    return listed.mapInArrow(run, CATALOG)


def read_image(spark: SparkSession, file: str, dataset: str, slabs: int = 16) -> tuple[DataFrame, dict]:
    """(i, j, k, label) in xyz order and the attributes; slabs of the first axis are read by as many tasks."""
    _needed()
    with h5py.File(file, "r") as held:
        if dataset not in held:
            raise ValueError(f"{file} has no dataset {dataset!r}")
        shape, attrs = held[dataset].shape, dict(held[dataset].attrs)
        real = held[dataset].dtype.kind == "f"
    order = attrs.get("permute_order", "zyx")
    order = order.decode() if isinstance(order, bytes) else str(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(file, "r") as held:
            for batch in batches:
                for a in batch.column(0).to_pylist():
                    plane = held[dataset][a]
                    j, k = np.indices(plane.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(plane.size, a, np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(k.ravel().astype(np.int32)), pa.array(plane.ravel().astype(float if real else np.int32))], ["i", "j", "k", "label"])

    voxels = spark.range(0, shape[0], 1, min(slabs, shape[0])).mapInArrow(run, f"i int, j int, k int, label {'double' if real else 'int'}")
    out = permute_axes(voxels, order)
    return out, {"shape": shape[::-1] if order == "zyx" else shape, "lengths": [float(v) for v in attrs.get("L", (1, 1, 1))], "attrs": attrs}


def write_image(voxels: DataFrame, file: str, dataset: str, shape, lengths=(1.0, 1.0, 1.0), order: str = "zyx", compression: int = 6, metadata: dict | None = None) -> None:
    """One dataset, replaced if it is there; planes stream to the file in order."""
    _needed()
    if not 0 <= compression <= 9:
        raise ValueError("compression levels go from 0 to 9")
    out = permute_axes(voxels, order)
    # labels as 32-bit integers, fields as they are
    kind = {"double": np.float64, "float": np.float32}.get(dict(out.dtypes)["label"], np.int32)
    dims = tuple(shape)[::-1] if order == "zyx" else tuple(shape)
    with h5py.File(file, "a") as held:
        if dataset in held:
            del held[dataset]
        made = held.create_dataset(dataset, dims, dtype=np.dtype(kind).str, compression="gzip", compression_opts=compression, chunks=(1, *dims[1:]))
        for row in out.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k", "label"))).alias("plane")).orderBy("i").toLocalIterator():
            made[row["i"]] = np.array([p["label"] for p in row["plane"]], kind).reshape(dims[1:])
        for k, v in (metadata or {}).items():
            made.attrs[k] = v
        made.attrs["permute_order"], made.attrs["L"] = order, list(map(float, lengths))


def merge_files(spark: SparkSession, output: str, inputs: Sequence[str], overwrite: bool = True) -> int:
    """Copy all datasets into ``output``; of equal paths the last file wins, or the first (``overwrite`` off). Returns how many."""
    _needed()
    import os

    files = ([output] if os.path.exists(output) else []) + list(inputs)
    rows = catalog(spark, files)
    if bad := clashes(rows).limit(5).collect():
        raise ValueError(f"dataset and group of one name: {[r['path'] for r in bad]}")
    chosen = merge(rows, overwrite).select("file", "path").orderBy("file", "path")
    copied = 0
    with h5py.File(output, "a") as out:
        for row in chosen.toLocalIterator():
            if row["file"] == output:
                continue
            with h5py.File(row["file"], "r") as held:
                if row["path"] in out:
                    del out[row["path"]]
                held.copy(row["path"], out, name=row["path"])
            copied += 1
            log.info("copied %s of %s", row["path"], row["file"])
    return copied


def main(argv: list[str] | None = None) -> None:
    """Merge HDF5 files."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("-i", "--inputs", nargs="+", required=True)
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--no-overwrite", dest="overwrite", action="store_false")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    from ..session import local_session

    print(merge_files(local_session(), args.output, args.inputs, args.overwrite), "datasets copied")


if __name__ == "__main__":
    main()
