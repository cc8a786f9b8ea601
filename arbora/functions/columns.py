"""Scalar column functions; null stands for a missing value."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extinction coefficients by leaf angle distribution.
EXTINCTION = {"spherical": 0.5, "planophile": 0.8, "erectophile": 0.35, "conifer": 0.45}
LAI_MAX = 15.0


def lai(gap: Column, k: float = 0.5, clumping: float = 1.0) -> Column:
    """Leaf area from gap fraction, clipped to [0, 15]; null where there is no gap."""
    return F.when(gap > 0, F.least(F.greatest(-F.log(gap) / (k * clumping), F.lit(0.0)), F.lit(LAI_MAX)))


def plant_area(gap: Column, k: float = 0.5) -> Column:
    """Plant area crossed from the top, clipped to [0, 15]."""
    return lai(gap, k)


def freeze_distance(density: Column) -> Column:
    """Freeze distance of a spike-free surface from the local pulse density (1/m2)."""
    d = F.least(F.greatest(density, F.lit(0.5)), F.lit(100.0))
    return 3.1 / F.log(1.75 * d + 2.1) + 1.0


def in_strips(x: Column, x_min: float, period: float, width: float, offset: float = 0.0) -> Column:
    """Whether ``x`` lies in one of the parallel strips."""
    return F.pmod(x - (x_min + offset), F.lit(period)) < width


def density_version(name: Column) -> Column:
    """(density, tag) of names such as ``pd_00p5_a``; any other name has no density and is its own tag."""
    form = r"^pd_(\d+)(p\d+)?(_.+)?$"
    part = lambda k: F.regexp_extract(name, form, k)
    density = F.concat(part(1), F.lit("."), F.coalesce(F.nullif(F.substring(part(2), 2, 20), F.lit("")), F.lit("0"))).cast("double")
    known = name.rlike(form)
    return F.struct(F.when(known, density).alias("density"), F.when(known, F.substring(part(3), 2, 1 << 30)).otherwise(name).alias("tag"))


def right_open_label(value: Column, breaks: list[float], scale: float = 1.0) -> Column:
    """The label of the right-open bin of ``value``; the last bin holds its top edge, null and outside give ""."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(""))
    for k, (lo, hi) in enumerate(zip(breaks, breaks[1:], strict=False)):
        inside = (value >= lo) & ((value <= hi) if k == len(breaks) - 2 else (value < hi))
        out = out.when(inside, F.lit(f"{lo * scale:g}-{hi * scale:g}"))
    return out.otherwise(F.lit(""))


def tilt(x: Column, y: Column, z: Column, angle: float, azimuth: float) -> tuple[Column, Column, Column]:
    """The point turned by ``angle`` degrees about the horizontal axis across ``azimuth``."""
    a, b = math.radians(angle), math.radians(azimuth)
    along = x * math.cos(b) + y * math.sin(b)
    across = -x * math.sin(b) + y * math.cos(b)
    turned, up = along * math.cos(a) - z * math.sin(a), along * math.sin(a) + z * math.cos(a)
    return turned * math.cos(b) - across * math.sin(b), turned * math.sin(b) + across * math.cos(b), up


def terrain(kind: str, x: Column, y: Column) -> Column:
    """Analytic test terrains."""
    forms = {
        "flat": lambda: F.lit(0.0) * x,
        "slope": lambda: 0.3 * x + 0.1 * y,
        "hills": lambda: 8.0 * F.sin(x / 25.0) + 6.0 * F.cos(y / 30.0),
        "ridge": lambda: 20.0 - F.abs(x - 50.0) * 0.4,
        "terraces": lambda: F.floor(x / 20.0) * 3.0,
        "cliff": lambda: F.when(x > 50.0, F.lit(15.0)).otherwise(F.lit(0.0)),
    }
    if kind not in forms:
        raise ValueError(f"terrain must be one of {sorted(forms)}")
    return forms[kind]().cast("double")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a position."""
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def season(date: Column) -> Column:
    """Leaf season from an ISO date: leaf-on from May to October."""
    month = F.month(F.to_date(F.substring(date, 1, 10)))
    return F.when(month.between(5, 10), F.lit("leaf-on")).when(month.isNotNull(), F.lit("leaf-off"))


def slope_class(degrees: Column) -> Column:
    return F.when(degrees < 10, F.lit("flat")).when(degrees < 25, F.lit("moderate")).when(degrees >= 25, F.lit("steep"))


#: Beginnings of forest formation codes by leaf type, and the share of typed forest from which one type names the whole.
LEAF_CODES = {"broadleaf": ("FF1", "FO1", "FP"), "conifer": ("FF2", "FO2"), "mixed": ("FF3", "FO3")}
LEAF_SHARE = 0.75


def leaf_code(formation: Column) -> Column:
    """Leaf type of a forest formation; null if it has none."""
    begins = {kind: functools.reduce(Column.__or__, [formation.startswith(c) for c in codes]) for kind, codes in LEAF_CODES.items()}
    return F.coalesce(*[F.when(hit, F.lit(kind)) for kind, hit in begins.items()])


def leaf_type(broadleaf: Column, conifer: Column, mixed: Column) -> Column:
    """Leaf type of a block from areas or shares: broadleaf or conifer from three quarters of the typed forest, else mixed; null without any."""
    typed = broadleaf + conifer + mixed
    pure = [F.when(part / F.nullif(typed, F.lit(0.0)) >= LEAF_SHARE, F.lit(kind)) for kind, part in (("broadleaf", broadleaf), ("conifer", conifer))]
    return F.when(typed > 0, F.coalesce(*pure, F.lit("mixed")))


FEET = {"us": 0.3048006096, "international": 0.3048}


def feet_to_metres(z: Column, kind: str = "us") -> Column:
    return z * FEET[kind]
