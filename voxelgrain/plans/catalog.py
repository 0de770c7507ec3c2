"""All registered queries over the reference operators, and their DuckDB SQL."""

from __future__ import annotations

from . import boundary_plans, field_plans, geometry_plans, result_plans, tensor_plans, voxel_plans  # noqa: F401  they register their queries
from .fixtures import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
