"""Radius searches: around one point, and around every row of a table of points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeledger.functions import geo
from placeledger.operators import filters as fl
from placeledger.session import cut


def clamp(value: float, low: float, high: float) -> float:
    return min(max(value, low), high)


def nearby(stores: DataFrame, refs: DataFrame, lat: float, lng: float, radius: float = 25, limit: int = 50) -> DataFrame:
    """Visible stores within ``radius`` miles of one point, nearest first.

    The latitude and longitude box is a plain column filter, so it reaches the scan. Neither radius nor limit has a bound of its own.
    """
    if not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise ValueError("latitude or longitude out of range")
    if radius <= 0 or limit < 1:
        raise ValueError("radius and limit must be positive")
    dlat, dlng = radius / geo.MILES_PER_DEGREE, geo.degrees_of_longitude(radius, lat)
    boxed = stores.filter(
        F.col("latitude").between(lat - dlat, lat + dlat) & F.col("longitude").between(lng - dlng, lng + dlng)
    )
    miles = geo.arc_miles(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude"))
    found = fl.visible(boxed, refs).withColumn("distance_miles", miles)
    return found.orderBy("distance_miles", "id").limit(limit).filter(F.col("distance_miles") <= radius)


def nearby_join(points: DataFrame, stores: DataFrame, refs: DataFrame, radius: float = 25, limit: int = 50) -> DataFrame:
    """The same search for every point: (point_id, rank, id, distance_miles).

    Points at one position have one answer, and of the stores at one position only the first ``limit`` can count, so positions
    meet instead of rows. They are copied to the grid cells that can hold a match and joined by cell. A narrow search comes first:
    a position with ``limit`` stores in a part of the radius is done, and only the others look farther, so that pairs grow with the
    positions and the limit and not with how dense the stores are.
    """
    if radius <= 0 or limit < 1:
        raise ValueError("radius and limit must be positive")
    lat, lng = F.col("latitude"), F.col("longitude")
    first = Window.partitionBy("s_lat", "s_lng").orderBy("id")
    held = cut(fl.visible(stores.filter(lat.isNotNull() & lng.isNotNull()), refs).select(
        "id", lat.alias("s_lat"), lng.alias("s_lng")
    ).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= limit).drop("r"))
    asked = points.filter(lat.between(-90, 90) & lng.between(-180, 180)).select("point_id", "latitude", "longitude")
    left, parts = asked.select("latitude", "longitude").distinct(), []
    for part in (radius / 16, radius / 4):
        if part >= 0.5:  # far above the rounding of the distances
            found = cut(_nearest(left, held, part, radius, limit))
            done = found.filter(F.col("rank") == limit).select("latitude", "longitude")
            parts.append(found.join(done, ["latitude", "longitude"], "left_semi"))
            left = left.join(done, ["latitude", "longitude"], "left_anti")
    every = reduce(DataFrame.unionByName, [*parts, _nearest(left, held, radius, radius, limit)])
    return asked.join(every, ["latitude", "longitude"]).select("point_id", "rank", "id", "distance_miles")


def _nearest(spots: DataFrame, held: DataFrame, reach: float, radius: float, limit: int) -> DataFrame:
    """(latitude, longitude, rank, id, distance_miles) of the first ``limit`` stores within ``reach`` and the box of ``radius``."""
    lat, lng = F.col("latitude"), F.col("longitude")
    stores = held.withColumn("c", geo.own_cell(F.col("s_lat"), F.col("s_lng"), reach)).select("id", "s_lat", "s_lng", "c.band", "c.cell")
    asks = spots.withColumn("c", F.explode(geo.nearby_cells(lat, lng, reach))).select("latitude", "longitude", "c.band", "c.cell")
    miles = geo.arc_miles(lat, lng, F.col("s_lat"), F.col("s_lng"))
    dlat = F.lit(radius / geo.MILES_PER_DEGREE)
    dlng = dlat / F.cos(F.radians(lat))
    in_box = F.col("s_lat").between(lat - dlat, lat + dlat) & F.col("s_lng").between(lng - dlng, lng + dlng)
    pairs = stores.join(asks, ["band", "cell"]).filter(in_box).withColumn("distance_miles", miles).filter(
        F.col("distance_miles") <= reach
    )
    w = Window.partitionBy("latitude", "longitude").orderBy("distance_miles", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(
        "latitude", "longitude", "rank", "id", "distance_miles"
    )
