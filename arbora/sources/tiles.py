"""What file names and headers say about tiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_NAME = r"PNOA_(\d{4})_([A-Za-z]+)_(\d+)-(\d+)_([A-Za-z0-9]+)\.la[sz]"
TILE_METRES = 2000.0


def parse_names(files: DataFrame, path: str) -> DataFrame:
    """``files`` with year, region, x_km, y_km, product and box of national tile names; null for other names."""
    part = lambda k: F.nullif(F.regexp_extract(path, TILE_NAME, k), F.lit(""))
    out = files.withColumn("year", part(1).cast("int")).withColumn("region", part(2)).withColumn("x_km", part(3).cast("int")).withColumn("y_km", part(4).cast("int")).withColumn("product", part(5))
    out = out.withColumn("min_x", F.col("x_km") * 1000.0).withColumn("max_y", F.col("y_km") * 1000.0)
    return out.withColumn("max_x", F.col("min_x") + TILE_METRES).withColumn("min_y", F.col("max_y") - TILE_METRES)


def survey_year(files: DataFrame, path: str, header_year: str | None = None) -> DataFrame:
    """``files`` with ``year``: from the file name, else the header, else 0."""
    named = F.nullif(F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    return files.withColumn("year", F.coalesce(named, *([F.nullif(F.col(header_year).cast("int"), F.lit(0))] if header_year else []), F.lit(0)))


def epsg_of(wkt: str | None) -> int:
    """The EPSG code that a coordinate system's text names last; 0 if it names none."""
    codes = re.findall(r'(?:AUTHORITY\["EPSG","|ID\["EPSG",|EPSG:)(\d+)', wkt or "")
    return int(codes[-1]) if codes else 0
