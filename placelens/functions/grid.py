"""Latitude-band grid for exact radius joins, valid at the poles and across the date line."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens.functions.columns import EARTH_RADIUS_KM

_SLACK = 1.0 + 1e-9


def band_height(radius_km: float) -> float:
    """Degrees of latitude no smaller than the radius."""
    return math.degrees(radius_km / EARTH_RADIUS_KM) * _SLACK


def _band(lat: str, radius_km: float) -> str:
    return f"floor({lat} / {band_height(radius_km)!r}D)"


def _cells_in_band(row: str, radius_km: float) -> str:
    """Number of equal longitude cells in a band.

    Two points within the radius whose bands touch differ in longitude by at most one cell width, taken at the
    edge nearest a pole of this band and its two neighbours.
    """
    edge = f"least(greatest(abs({row} - 1), abs({row} + 2)) * {band_height(radius_km)!r}D, 90D)"
    reach = f"least(1D, {math.sin(radius_km / (2 * EARTH_RADIUS_KM))!r}D / cos(radians({edge})))"
    return f"greatest(1L, floor(360D / (degrees(2D * asin({reach})) * {_SLACK!r}D)))"


def _column(lon: str, n: str) -> str:
    return f"pmod(floor(({lon} + 180D) / (360D / {n})), {n})"


def _cell_id(row: str, column: str) -> str:
    return f"{row} * {1 << 32}L + {column}"


def home_cell(lat: str, lon: str, radius_km: float) -> Column:
    """Cell of a point given by two column names."""
    row = _band(lat, radius_km)
    return F.expr(_cell_id(row, _column(lon, _cells_in_band(row, radius_km))))


def nearby_cells(lat: str, lon: str, radius_km: float) -> Column:
    """Array of the cells that can hold points within the radius."""
    row = _band(lat, radius_km)
    bands = f"transform(sequence({row} - 1, {row} + 1), r -> named_struct('r', r, 'n', {_cells_in_band('r', radius_km)}))"
    middle = f"transform({bands}, b -> named_struct('r', b.r, 'n', b.n, 'c', {_column(lon, 'b.n')}))"
    steps = f"transform(array(0, 1, -1), d -> {_cell_id('m.r', 'pmod(m.c + d, m.n)')})"
    return F.expr(f"array_distinct(flatten(transform({middle}, m -> {steps})))")
