"""Spark-native analytics for periodic voxel images: generation, labelling, measurement and export."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Public names and where they live; a module is loaded when a name of it is first used.
_WHERE = {
    "Image": "model",
    "local_session": "session", "ship_package": "session",
    "tpms_field": "operators.tpms", "phase": "operators.tpms", "threshold_for_fraction": "operators.tpms",
    "spinodal_field": "operators.spectral", "spinodal_image": "operators.spectral", "correlation_lengths": "operators.spectral",
    "voronoi_seeds": "operators.seeds", "tessellate": "operators.voronoi", "foam": "operators.voronoi",
    "label_nearest_seed": "operators.raster", "erode_boundaries": "operators.erosion", "lattice_image": "operators.lattices",
    "coarse_grained": "operators.combo", "resize_image": "operators.stencils", "volume_fractions": "operators.fractions",
    "linear_paths": "operators.loadpaths", "equal_area_directions": "operators.loadpaths",
    "voigt_bound": "operators.elastic", "reuss_bound": "operators.elastic", "youngs_modulus": "operators.elastic",
    "rank2_measures": "functions.tensors", "elastic_constants": "functions.tensors",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__() -> list[str]:
    return sorted([*globals(), *__all__])
