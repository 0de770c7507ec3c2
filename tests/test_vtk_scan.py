"""VTK scans that read only the arrays asked for."""

import io
import struct
import zlib

import numpy as np
import pytest

from voxelgrain.sources import vtk


def image(fields, raw, zipped, n=(20, 10, 5)):
    import base64

    tail, nodes = b"", ""
    for name, values in fields.items():
        body = values.astype("<f8").tobytes()
        if zipped:
            packed = [zlib.compress(body[: len(body) // 2]), zlib.compress(body[len(body) // 2 :])]
            head, body = struct.pack("<5I", 2, len(body) // 2, 0, *map(len, packed)), b"".join(packed)
        else:
            head = struct.pack("<I", len(body))
        if raw:
            data = head + body
        else:
            data = base64.b64encode(head) + base64.b64encode(body) if zipped else base64.b64encode(head + body)
        nodes += f'<DataArray type="Float64" Name="{name}" format="appended" offset="{len(tail)}"/>'
        tail += data
    kind = ' compressor="vtkZLibDataCompressor"' if zipped else ""
    extent = f"0 {n[0]} 0 {n[1]} 0 {n[2]}"
    head = f'<VTKFile type="ImageData" byte_order="LittleEndian"{kind}><ImageData WholeExtent="{extent}"><Piece Extent="{extent}"><CellData>{nodes}</CellData></Piece></ImageData>'
    return head.encode() + f'<AppendedData encoding="{"raw" if raw else "base64"}">_'.encode() + tail + b"</AppendedData></VTKFile>"


@pytest.fixture
def fields():
    rng = np.random.default_rng(3)
    return {name: rng.random(1000) for name in "abcdefgh"} | {f"n{k}": rng.random(1000) for k in range(40)}


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("raw", [True, False])
@pytest.mark.parametrize("zipped", [True, False])
def test_only_wanted_arrays_are_read(fields, raw, zipped):
    data = image(fields, raw, zipped)
    whole = vtk.parse_cells(data)[1]
    assert set(whole) == set(fields) and all((whole[k][:, 0] == v).all() for k, v in fields.items())
    file = Counted(data)
    centres, one = vtk.parse_cells(file, lambda name: name == "c")
    assert list(one) == ["c"] and (one["c"][:, 0] == fields["c"]).all() and len(centres) == 1000
    assert file.taken < 0.4 * len(data)
    assert vtk.parse_cells(data, lambda name: False)[1] == {}


def test_one_frame_may_be_filtered_in_many_ways(spark, tmp_path, fields):
    for k in range(3):
        (tmp_path / f"{k}.vti").write_bytes(image(fields, True, False))
    paths = [str(tmp_path / f"{k}.vti") for k in range(3)]
    cells = vtk.read_vtk(spark, paths, ["a", "b", "c"], mode="FAILFAST")
    got = cells.where(f"field = 'c' and file = '{paths[1]}' and cell_id < 10").collect()
    assert len(got) == 10 and all(r["value"] == [fields["c"][r["cell_id"]]] for r in got)
    assert cells.where("field = 'a' and field = 'b'").count() == 0 and cells.where("field = 'none'").count() == 0
    assert cells.where("field = 'a' or field = 'b'").count() == 6000 and cells.where("field <> 'a'").count() == 6000 and cells.count() == 9000
    with pytest.raises(Exception, match="none of the fields"):
        vtk.read_vtk(spark, paths, ["none"], mode="FAILFAST").count()
