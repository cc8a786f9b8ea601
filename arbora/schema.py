"""The point schema, class codes and coordinate domains."""

from __future__ import annotations

from pyspark.sql import types as T

# ASPRS classes.
GROUND = (2, 9)
BARE_GROUND = 2
VEGETATION = (3, 4, 5)
NOISE = (7, 18)

ATTRIBUTES: dict[str, T.DataType] = {
    "Z": T.DoubleType(),
    "Intensity": T.IntegerType(),
    "ReturnNumber": T.ShortType(),
    "NumberOfReturns": T.ShortType(),
    "ScanDirectionFlag": T.ShortType(),
    "EdgeOfFlightLine": T.ShortType(),
    "Classification": T.ShortType(),
    "ScanAngleRank": T.ByteType(),
    "UserData": T.ShortType(),
    "PointSourceId": T.IntegerType(),
    "GpsTime": T.DoubleType(),
    "Red": T.IntegerType(),
    "Green": T.IntegerType(),
    "Blue": T.IntegerType(),
    "Synthetic": T.ShortType(),
    "KeyPoint": T.ShortType(),
    "Withheld": T.ShortType(),
    "Overlap": T.ShortType(),
}

#: Easting and northing bounds of projected systems by EPSG code; any other is wide open.
DOMAINS: dict[int, tuple[float, float, float, float]] = {
    25830: (100_000.0, 3_000_000.0, 900_000.0, 9_999_900.0),
    28992: (-7_000.0, 289_000.0, 300_000.0, 629_000.0),
    2154: (99_000.0, 6_049_000.0, 1_242_000.0, 7_111_000.0),
    27700: (-100_000.0, 0.0, 700_000.0, 1_300_000.0),
}
WORLD = (-20_000_000.0, -20_000_000.0, 20_000_000.0, 20_000_000.0)
YEARS = (2000, 2100)


def domain(epsg: int) -> tuple[float, float, float, float]:
    """min_x, min_y, max_x, max_y of a projected system."""
    return DOMAINS.get(epsg, WORLD)


def point_schema(attributes: tuple[str, ...] | None = None) -> T.StructType:
    """X, Y, Year and the chosen attributes; Z must be among them."""
    names = tuple(ATTRIBUTES) if attributes is None else tuple(attributes)
    unknown = [n for n in names if n not in ATTRIBUTES]
    if unknown or "Z" not in names:
        raise ValueError(f"unknown attributes {unknown}" if unknown else "attributes must contain Z")
    fields = [T.StructField("X", T.DoubleType(), False), T.StructField("Y", T.DoubleType(), False), T.StructField("Year", T.IntegerType(), False)]
    return T.StructType(fields + [T.StructField(n, ATTRIBUTES[n]) for n in ATTRIBUTES if n in names])
