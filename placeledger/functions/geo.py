"""Distances in miles and grid cells, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeledger import catalogs as cat

MILES_PER_DEGREE = 69.0


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null when a coordinate is missing or out of range."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lng1, lng2), 2)
    h = F.least(h, F.lit(1.0))
    ok = lat1.between(-90, 90) & lat2.between(-90, 90) & lng1.between(-180, 180) & lng2.between(-180, 180)
    return F.when(ok, F.lit(2 * cat.EARTH_RADIUS_MILES) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h)))


def arc_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the clamped arc cosine, as the radius search orders by it."""
    c = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(
        F.radians(lat1)
    ) * F.sin(F.radians(lat2))
    return F.lit(cat.EARTH_RADIUS_MILES) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def band_height(radius_miles: float) -> float:
    """Latitude band height in degrees: one radius (a little over, so rounding cannot lose an edge)."""
    return radius_miles / MILES_PER_DEGREE * 1.001


def lat_band(lat: Column, radius_miles: float) -> Column:
    return F.floor(lat / F.lit(band_height(radius_miles)))


def lng_cell(lng: Column, band: Column, radius_miles: float) -> Column:
    """Longitude cell within a latitude band, at least one radius wide at the edges of the bands next to it.

    The width grows towards the poles; beyond 89 degrees a band is one cell.
    """
    height = band_height(radius_miles)
    far_edge = F.greatest(F.abs((band - 1) * height), F.abs((band + 2) * height))
    shrink = F.cos(F.radians(F.least(far_edge, F.lit(89.9))))
    width = F.lit(radius_miles / MILES_PER_DEGREE * 1.01) / shrink
    cells = F.floor(F.lit(360.0) / width)
    cell = F.floor((lng + 180.0) / F.lit(360.0) * cells)
    return F.when((cells < 3) | (far_edge > 89.0), F.lit(0)).otherwise(F.pmod(cell, cells))


def lng_cell_count(band: Column, radius_miles: float) -> Column:
    height = band_height(radius_miles)
    far_edge = F.greatest(F.abs((band - 1) * height), F.abs((band + 2) * height))
    width = F.lit(radius_miles / MILES_PER_DEGREE * 1.01) / F.cos(F.radians(F.least(far_edge, F.lit(89.9))))
    cells = F.floor(F.lit(360.0) / width)
    return F.when((cells < 3) | (far_edge > 89.0), F.lit(1)).otherwise(cells)


def own_cell(lat: Column, lng: Column, radius_miles: float) -> Column:
    band = lat_band(lat, radius_miles)
    return F.struct(band.alias("band"), lng_cell(lng, band, radius_miles).alias("cell"))


def nearby_cells(lat: Column, lng: Column, radius_miles: float) -> Column:
    """Array of cells that can hold a point within one radius: three bands, three cells in each (with wrap)."""
    home = lat_band(lat, radius_miles)
    out = []
    for step in (-1, 0, 1):
        band = home + step
        cell, count = lng_cell(lng, band, radius_miles), lng_cell_count(band, radius_miles)
        for side in (-1, 0, 1):
            out.append(F.struct(band.alias("band"), F.pmod(cell + side, count).alias("cell")))
    return F.array_distinct(F.array(*out))


def degrees_of_longitude(radius_miles: float, lat: float) -> float:
    return radius_miles / (MILES_PER_DEGREE * math.cos(math.radians(lat)))
