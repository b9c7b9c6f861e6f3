"""Points near other points: latitude strips with overlap, a local longitude sweep, one owner per pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Rows of one side that one strip block may hold before the strip is split into blocks.
BLOCK_ROWS = 50_000
#: Lowest strip height in degrees: at most 180 / 0.005 = 36,000 strips, which bounds the strip table.
MIN_STRIP_DEG = 0.005
_PAIR_CHUNK = 1_000_000


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, arctangent form."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = p2 - p1, F.radians(lon2) - F.radians(lon1)
    a = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def usable_point(lat: Column, lon: Column) -> Column:
    """Both coordinates there, finite, and not both zero."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < 1e6) & (F.abs(lon) < 1e6)
    return ok & ~((lat == 0) & (lon == 0))


def _folded(df: DataFrame) -> DataFrame:
    """Add ``_y``/``_x``: the same spot on the sphere with latitude in [-90, 90] and longitude in [-180, 180]."""
    p, q = F.radians("_lat"), F.radians("_lon")
    inside = (F.abs("_lat") <= 90) & (F.abs("_lon") <= 180)
    y = F.when(inside, F.col("_lat")).otherwise(F.degrees(F.asin(F.sin(p))))
    x = F.when(inside, F.col("_lon")).otherwise(F.degrees(F.atan2(F.cos(p) * F.sin(q), F.cos(p) * F.cos(q))))
    return df.withColumn("_y", y).withColumn("_x", x)


def _window_deg(top_deg: np.ndarray, radius_m: float) -> np.ndarray:
    """Longitude half-window that surely holds every point within the radius, given the highest |latitude|."""
    s = math.sin(min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2))
    c = np.cos(np.radians(np.minimum(top_deg, 90.0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.degrees(2 * np.arcsin(np.minimum(1.0, s / np.maximum(c, 1e-12))))
    return np.where(s >= c, 360.0, w * 1.000001 + 1e-7)


def sweep(radius_m: float, strip_deg: float, best: int | None = None, exclude_self: bool = False):
    """Make the sweep over rows sorted by block and longitude.

    The active set holds the rows of the current block whose longitude is still
    within the window; each pair is emitted when its later row arrives.
    """
    reach = math.degrees(radius_m / EARTH_RADIUS_M)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        active: pd.DataFrame | None = None
        for new in batches:
            if not len(new):
                continue
            new = new.assign(_old=False)
            buf = new if active is None else pd.concat([active, new], ignore_index=True)
            g = buf[["strip", "bi", "bj"]].ne(buf[["strip", "bi", "bj"]].shift()).any(axis=1).cumsum().to_numpy() - 1
            strip, x, right = buf["strip"].to_numpy(), buf["_x"].to_numpy(), buf["right_side"].to_numpy()
            top = np.maximum(np.abs(strip * strip_deg), np.abs((strip + 1) * strip_deg)) + reach
            win = _window_deg(top, radius_m)
            key = g * 2000.0 + x
            order_r, order_l = np.flatnonzero(right), np.flatnonzero(~right)
            rk = key[order_r]
            base = g[order_l] * 2000.0
            lo = np.searchsorted(rk, np.maximum(key[order_l] - win[order_l], base - 999), "left")
            hi = np.searchsorted(rk, np.minimum(key[order_l] + win[order_l], base + 999), "right")
            old = buf["_old"].to_numpy()
            n = hi - lo
            lat, lon = np.radians(buf["_lat"].to_numpy()), np.radians(buf["_lon"].to_numpy())
            ids = buf["id"].to_numpy()
            ends = np.cumsum(n)
            start = 0
            while start < len(n):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + _PAIR_CHUNK, "right")))
                m = n[start:stop]
                if m.sum():
                    a = np.repeat(order_l[start:stop], m)
                    off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    b = order_r[np.repeat(lo[start:stop], m) + off]
                    fresh = ~(old[a] & old[b])
                    a, b = a[fresh], b[fresh]
                    h = np.sin((lat[b] - lat[a]) / 2) ** 2 + np.cos(lat[a]) * np.cos(lat[b]) * np.sin((lon[b] - lon[a]) / 2) ** 2
                    h = np.clip(h, 0.0, 1.0)
                    d = 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
                    near = d <= radius_m
                    if exclude_self:
                        near &= ids[a] != ids[b]
                    if near.any():
                        out = pd.DataFrame({"left_id": ids[a[near]], "right_id": ids[b[near]], "distance_m": d[near]})
                        if best is not None:
                            # What isn't among the best of a part isn't among the best of the whole.
                            out = out.sort_values(["left_id", "distance_m", "right_id"]).drop_duplicates(["left_id", "right_id"]).groupby("left_id").head(best)
                        yield out
                start = stop
            keep = (g == g[-1]) & (x >= x[-1] - win)
            active = buf[keep].assign(_old=True)

    return run


def near_pairs(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_lat: str, left_lon: str, right_lat: str, right_lon: str, radius_m: float, block_rows: int = BLOCK_ROWS, best: int | None = None, exclude_self: bool = False,
) -> DataFrame:
    """All pairs (left_id, right_id, distance_m) within ``radius_m``, each pair of input rows at most once.

    Latitude is cut into strips of fixed height; a left row lies in the one
    strip that owns its pairs, a right row in every strip within the radius.
    Strips with more than ``block_rows`` rows of a side are split into
    blocks by key hash, so that a strip with a third of all rows is spread
    over tasks. Rows inside a block are sorted by longitude and swept.

    Rows with a null, non-finite or (0, 0) coordinate take no part; null ids
    likewise. Exact repeats of a row count once; equal ids at several
    coordinates give the pair once with the smallest distance. Longitudes
    meet across the date line, and latitudes beyond the poles are folded.
    Other columns of the inputs are ignored, whatever their names.
    With ``best``, parts of the sweep keep only that many right rows a left row (the nearest, ties by id), so that dense places don't
    shuffle all their pairs; the caller still takes the best of all parts.
    """
    reach = math.degrees(radius_m / EARTH_RADIUS_M)
    strip_deg = max(4 * reach, MIN_STRIP_DEG)

    def side(df: DataFrame, i: str, la: str, lo: str) -> DataFrame:
        out = df.select(F.col(i).cast("string").alias("id"), F.col(la).cast("double").alias("_lat"), F.col(lo).cast("double").alias("_lon"))
        return _folded(out.where(F.col("id").isNotNull() & usable_point(F.col("_lat"), F.col("_lon"))).distinct())

    low, high = F.floor((F.col("_y") - reach * 1.000001) / strip_deg), F.floor((F.col("_y") + reach * 1.000001) / strip_deg)
    a = side(left, left_id, left_lat, left_lon).withColumn("strip", F.floor(F.col("_y") / strip_deg))
    b = side(right, right_id, right_lat, right_lon).withColumn("strip", F.explode(F.sequence(low, high)))
    top = F.least(F.lit(90.0), F.abs("_y") + reach)
    # Copies across the date line; near a pole the window is the whole circle and no copy is needed.
    w = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2))) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9))))) * 1.1 + 2 * strip_deg
    turns = F.concat(
        F.array(F.lit(0.0)),
        F.when((w < 170) & (F.col("_x") > 180 - w), F.array(F.lit(-360.0))).otherwise(F.array().cast("array<double>")),
        F.when((w < 170) & (F.col("_x") < w - 180), F.array(F.lit(360.0))).otherwise(F.array().cast("array<double>")),
    )
    b = b.withColumn("_turn", F.explode(turns)).withColumn("_x", F.col("_x") + F.col("_turn")).drop("_turn")
    # One small row a strip: at most 180 / MIN_STRIP_DEG rows, so broadcasting it is safe at any size.
    na = a.groupBy("strip").agg(F.count("*").alias("na"))
    nb = b.groupBy("strip").agg(F.count("*").alias("nb"))
    blocks = na.join(nb, "strip").select("strip", F.ceil(F.col("na") / block_rows).cast("int").alias("ka"), F.ceil(F.col("nb") / block_rows).cast("int").alias("kb"))
    blocks = F.broadcast(blocks)
    h = F.xxhash64("id", "_lat", "_lon")
    cols = ["strip", "bi", "bj", "_x", "_lat", "_lon", "id"]
    seq = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    a = a.join(blocks, "strip").withColumn("bi", F.pmod(h, F.col("ka")).cast("int")).withColumn("bj", F.explode(seq("kb"))).select(*cols, F.lit(False).alias("right_side"))
    b = b.join(blocks, "strip").withColumn("bj", F.pmod(h, F.col("kb")).cast("int")).withColumn("bi", F.explode(seq("ka"))).select(*cols, F.lit(True).alias("right_side"))
    rows = a.unionByName(b).repartition("strip", "bi", "bj").sortWithinPartitions("strip", "bi", "bj", "_x")
    pairs = rows.mapInPandas(sweep(radius_m, strip_deg, best, exclude_self), "left_id string, right_id string, distance_m double")
    return pairs.groupBy("left_id", "right_id").agg(F.min("distance_m").alias("distance_m"))
