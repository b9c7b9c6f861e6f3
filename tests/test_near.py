import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plakat.operators.near import near_pairs

COLS = ("id", "id", "lat", "lon", "lat", "lon")


def brute(a, b, r):
    out = set()
    for i, la, lo in a:
        for j, mb, nb in b:
            if None in (la, lo, mb, nb) or (la, lo) == (0, 0) or (mb, nb) == (0, 0):
                continue
            p, q = math.radians(la), math.radians(mb)
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(nb - lo) / 2) ** 2
            if 2 * 6371000.0 * math.atan2(math.sqrt(max(h, 0)), math.sqrt(max(0, 1 - h))) <= r:
                out.add((i, j))
    return out


def run(spark, a, b, r, **kw):
    schema = "id string, lat double, lon double"
    got = near_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), *COLS, r, **kw).select("left_id", "right_id").collect()
    assert len(got) == len({tuple(x) for x in got})
    return {tuple(x) for x in got}


@pytest.mark.parametrize("radius", [250.0, 5_000.0])
def test_against_brute_force(spark, radius):
    rng = np.random.default_rng(1)
    spots = np.r_[rng.uniform([49, 17], [49.2, 17.3], (150, 2)), np.repeat([[49.1, 17.1]], 60, 0), rng.uniform([-1, 179.95], [1, 180], (40, 2)), rng.uniform([-1, -180], [1, -179.95], (40, 2)), rng.uniform([89.98, -180], [90, 180], (40, 2))]
    a = [(f"a{i}", float(x), float(y)) for i, (x, y) in enumerate(spots[::2])] + [("n", None, 17.0), ("z", 0.0, 0.0), ("far", 17.1, 49.1), ("odd", 90.01, 20.0)]
    b = [(f"b{i}", float(x), float(y)) for i, (x, y) in enumerate(spots[1::2])] + [("m", 49.0, None), ("y", 0.0, 0.0)]
    assert run(spark, a, b, radius) == brute(a, b, radius)


def test_hot_strip_is_split_and_whole(spark):
    rng = np.random.default_rng(2)
    a = [(f"a{i}", 50.0, float(x)) for i, x in enumerate(rng.uniform(20, 20.05, 90))]
    b = [(f"b{i}", 50.0001, float(x)) for i, x in enumerate(rng.uniform(20, 20.05, 70))]
    assert run(spark, a, b, 300.0, block_rows=10) == brute(a, b, 300.0)


def test_repeats_nulls_empty_and_clashing_columns(spark):
    schema = "id string, lat double, lon double, strip int, bi string, _x int"
    a = spark.createDataFrame([("p", 50.0, 20.0, 1, "x", 3)] * 2 + [(None, 50.0, 20.0, 1, "x", 3)], schema)
    b = spark.createDataFrame([("q", 50.0, 20.0, 1, "x", 3), ("q", 50.001, 20.0, 1, "x", 3)], schema)
    rows = near_pairs(a, b, *COLS, 250.0).collect()
    assert [(r.left_id, r.right_id, r.distance_m) for r in rows] == [("p", "q", 0.0)]
    assert near_pairs(a.where(F.lit(False)), b, *COLS, 250.0).count() == 0
