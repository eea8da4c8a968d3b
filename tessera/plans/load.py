"""Imports the modules that register queries."""

from __future__ import annotations


def all_plans() -> None:
    from tessera.plans import raster, evaluation, stats, colours, shapes, vectors, comparisons, dense, grounds, intake  # noqa: F401
