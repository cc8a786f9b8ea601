"""Projections against published examples, round trips, and files in other systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import projection as p


def forward(spark, system, lon, lat):
    return tuple(spark.range(1).select(*system.forward(F.lit(lon), F.lit(lat))).first())


def dms(d, m=0.0, s=0.0):
    return d + m / 60 + s / 3600


def test_published_examples(spark):
    british = p.TransverseMercator(-2.0, 49.0, 400_000.0, -100_000.0, (6377563.396, 299.32496), scale=0.9996012717)
    assert np.allclose(forward(spark, british, 0.5, 50.5), (577274.99, 69740.50), atol=0.006)
    texas = p.LambertConic(-99.0, dms(27, 50), 2_000_000.0 * p.US_FOOT, 0.0, (6378206.4, 294.97870), p.US_FOOT, lat1=dms(28, 23), lat2=dms(30, 17))
    assert np.allclose(forward(spark, texas, -96.0, 28.5), (2963503.91, 254759.80), atol=0.02)
    tower = forward(spark, p.system_of("EPSG:32617"), -dms(79, 23, 13.7), dms(43, 38, 33.24))
    assert np.allclose(tower, (630084, 4833438), atol=1.0)
    assert np.allclose(forward(spark, p.system_of(32734), 21.0, 0.0), (500_000.0, 10_000_000.0), atol=1e-6)


@pytest.mark.parametrize("code", [25830, 32633, 32755, 2180, 3006, 3763, 2154])
def test_round_trip_under_a_millimetre(spark, code):
    system = p.system_of(code)
    middle = system.lon0
    grid = spark.range(41).select((middle - 4 + F.col("id") * 0.2).alias("lon")).crossJoin(spark.range(40).select(((F.col("id") * 2 + 1.0) * (-1 if code == 32755 else 1)).alias("lat")))
    x, y = system.forward(F.col("lon"), F.col("lat"))
    there = grid.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = system.inverse(F.col("x"), F.col("y"))
    back = there.select("x", "y", lon.alias("lon"), lat.alias("lat"), (F.hypot(lon - F.col("lon"), lat - F.col("lat")) * 111_320).alias("off"))
    assert back.agg(F.max("off")).first()[0] < 1e-4
    again = system.forward(F.col("lon"), F.col("lat"))
    assert back.agg(F.max(F.hypot(again[0] - F.col("x"), again[1] - F.col("y")))).first()[0] < 1e-3


FEET = (
    'PROJCS["NAD83 / Georgia West (ftUS)",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],'
    'PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",30],PARAMETER["central_meridian",-84.1666666666667],PARAMETER["scale_factor",0.9999],'
    'PARAMETER["false_easting",2296583.333],PARAMETER["false_northing",0],UNIT["US survey foot",0.304800609601219],AUTHORITY["EPSG","2240"]]'
)


def test_systems_from_text(spark):
    feet = p.system_of(FEET)
    assert feet.unit == 0.304800609601219 and feet.scale == 0.9999 and p.is_feet(FEET) and not p.is_feet(25830)
    x, y = forward(spark, feet, -84.4, 33.7)
    metres = forward(spark, p.TransverseMercator(-84.1666666666667, 30.0, 2296583.333 * p.US_FOOT, 0.0, p.GRS80, scale=0.9999), -84.4, 33.7)
    assert np.allclose((x * p.US_FOOT, y * p.US_FOOT), metres, atol=1e-3)
    for unknown in (27700, "EPSG:1", "no text", 'PROJCS["x",PROJECTION["Oblique"]]'):
        with pytest.raises(ValueError):
            p.system_of(unknown)
    assert p.utm_of(-84.4, 33.7) == 32616 and p.utm_of(180.0, -1.0) == 32760


def test_points_in_another_system(spark):
    there = spark.createDataFrame([(2_200_000.0, 1_300_000.0, 1000.0, 2), (None, None, None, 1)], "X double, Y double, Z double, lon int")
    out = p.reproject(there, FEET, 32616)
    assert out.columns == there.columns
    one = out.first()
    assert abs(one["Z"] - 304.8006096) < 1e-6 and 600_000 < one["X"] < 800_000 and out.collect()[1]["X"] is None
    back = p.reproject(out, 32616, FEET).first()
    assert abs(back["X"] - 2_200_000) < 1e-2 and abs(back["Y"] - 1_300_000) < 1e-2 and abs(back["Z"] - 1000) < 1e-6
    plan = p.reproject(there, FEET, 32616)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and p.reproject(there, 25830, 25830) is there
