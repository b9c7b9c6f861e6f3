"""Geographic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plakat.operators.near import haversine_m

__all__ = ["coordinate", "haversine_m", "in_box", "rounded", "walk_minutes"]

WALK_M_PER_MINUTE = 80


def coordinate(*cs: Column) -> Column:
    """First coordinate that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cs])


def walk_minutes(metres: Column, up: bool = False) -> Column:
    """At least one minute; half-even rounding, or up."""
    m = metres / WALK_M_PER_MINUTE
    return F.greatest(F.lit(1), (F.ceil(m) if up else F.bround(m, 0)).cast("int"))


def rounded(lat: Column, lon: Column, places: int = 3) -> Column:
    """Bucket key of a point."""
    return F.concat_ws(",", F.round(lat, places).cast("string"), F.round(lon, places).cast("string"))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
