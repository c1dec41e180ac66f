"""Geospatial operators on latitude/longitude columns in degrees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, dbl, share, small_frame
from cleanlake.operators.profile import known_counts
from cleanlake.operators.quantiles import exact_quantiles
from cleanlake.operators.selection import sample_n

EARTH_KM = 6371.0

# fixed values: name words per kind of column
GEO_WORDS = {
    "latitude": ["lat", "latitude", "y_coord", "y"], "longitude": ["lon", "lng", "longitude", "x_coord", "x"],
    "address": ["address", "addr", "location", "place"], "city": ["city", "town", "municipality"],
    "state": ["state", "province", "region"], "country": ["country", "nation"], "zipcode": ["zip", "zipcode", "postal", "postcode"],
}
# fixed values: coarse regions by centre (lat from, lat to, lon from, lon to), first match wins
REGIONS = [("North America", -48, 71, -168, -52), ("Europe", 35, 71, -12, 40), ("Africa", -35, 37, -20, 55), ("Asia", -47, 81, 26, 180)]


def detect(df: DataFrame) -> DataFrame:
    """Columns with a keyword as a whole part of the name, with their known values."""
    found = []
    for x in df.columns:
        name = "_" + re.sub(r"[^a-z0-9]+", "_", x.lower()) + "_"
        found += [(kind, x) for kind, words in GEO_WORDS.items() if any(f"_{w}_" in name for w in words)]
    known = known_counts(df, sorted({x for _, x in found}))
    return small_frame(df.sparkSession, [(kind, x, known[x]) for kind, x in found], "kind string, column string, known long")


def is_valid(lat: str, lon: str) -> Column:
    return c(lat).between(-90, 90) & c(lon).between(-180, 180)


def validate(df: DataFrame, lat: str, lon: str) -> DataFrame:
    pair = c(lat).isNotNull() & c(lon).isNotNull()
    t = df.agg(count_if(pair).alias("pairs"), count_if(is_valid(lat, lon)).alias("valid"))
    return t.select("pairs", "valid", (F.col("pairs") - F.col("valid")).alias("invalid"), share(F.col("valid"), F.col("pairs")).alias("valid_pct"))


def fix_invalid(df: DataFrame, lat: str, lon: str, how: str) -> DataFrame:
    """how: remove, null or flag (column coordinate_valid). Incomplete pairs count as invalid."""
    ok = F.coalesce(is_valid(lat, lon), F.lit(False))
    if how == "remove":
        return df.where(ok)
    if how == "null":
        return df.select(*[F.when(ok, c(x)).alias(x) if x in (lat, lon) else c(x) for x in df.columns])
    return df.withColumn("coordinate_valid", ok)


def clip(df: DataFrame, lat: str, lon: str) -> DataFrame:
    lim = {lat: 90.0, lon: 180.0}
    return df.select(*[F.when(c(x).isNotNull(), F.greatest(F.lit(-lim[x]), F.least(F.lit(lim[x]), c(x)))).alias(x) if x in lim else c(x) for x in df.columns])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def reference_point(df: DataFrame, lat: str, lon: str, how: str, order_by: list[str] | None = None) -> tuple[float, float]:
    pair = df.where(c(lat).isNotNull() & c(lon).isNotNull())
    if how == "centroid":
        return tuple(pair.agg(F.avg(c(lat)), F.avg(c(lon))).first())
    row = pair.agg(F.min_by(F.struct(c(lat).alias("a"), c(lon).alias("b")), F.struct(*[c(o) for o in order_by])).alias("r")).first()["r"]
    return row["a"], row["b"]


def distance_to(df: DataFrame, lat: str, lon: str, point: tuple[float, float], name: str = "distance_from_reference_km") -> DataFrame:
    return df.withColumn(name, haversine(F.lit(point[0]), F.lit(point[1]), c(lat), c(lon)))


def distance_stats(df: DataFrame, name: str = "distance_from_reference_km") -> DataFrame:
    med = exact_quantiles(df, [name], [0.5])[name][0]
    return df.agg(F.avg(c(name)).alias("mean"), F.lit(med).cast("double").alias("median"), F.min(c(name)).alias("min"), F.max(c(name)).alias("max"), F.stddev_pop(c(name)).alias("std"))


def bounds(df: DataFrame, lat: str, lon: str) -> DataFrame:
    t = df.agg(F.min(c(lat)).alias("lat_min"), F.max(c(lat)).alias("lat_max"), F.min(c(lon)).alias("lon_min"), F.max(c(lon)).alias("lon_max"),
               F.avg(c(lat)).alias("lat_mean"), F.avg(c(lon)).alias("lon_mean"))
    t = t.select("*", (F.col("lat_max") - F.col("lat_min")).alias("lat_range"), (F.col("lon_max") - F.col("lon_min")).alias("lon_range"))
    la, lo = (F.col("lat_min") + F.col("lat_max")) / 2, (F.col("lon_min") + F.col("lon_max")) / 2
    case = F
    for name, a, b, x, y in REGIONS:
        case = case.when(la.between(a, b) & lo.between(x, y), name)
    inside = (F.col("lat_min") >= -90) & (F.col("lat_max") <= 90) & (F.col("lon_min") >= -180) & (F.col("lon_max") <= 180)
    return t.withColumn("region", F.when(inside, case.otherwise("Mixed/Global")))


def density(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Points per cell of a g x g grid, g = clamp(sqrt(n), 3, 10); upper edges belong to the last cell."""
    pair = df.where(c(lat).isNotNull() & c(lon).isNotNull())
    r = pair.agg(F.count(F.lit(1)), F.min(c(lat)), F.max(c(lat)), F.min(c(lon)), F.max(c(lon))).first()
    n, la0, la1, lo0, lo1 = r
    if n < 2 or la0 == la1 or lo0 == lo1:
        return small_frame(df.sparkSession, [], "lat_cell long, lon_cell long, lat_center double, lon_center double, points long, densest boolean")
    g = min(10, max(3, int(n ** 0.5)))
    cell = lambda x, lo, hi: F.least(F.floor((c(x) - F.lit(lo)) * g / F.lit(hi - lo)), F.lit(g - 1)).cast("long")
    t = pair.groupBy(cell(lat, la0, la1).alias("lat_cell"), cell(lon, lo0, lo1).alias("lon_cell")).agg(F.count(F.lit(1)).alias("points"))
    center = lambda x, lo, hi: F.lit(lo) + (F.col(x) + 0.5) * F.lit((hi - lo) / g)
    # at most g*g rows from here on
    top = t.agg(F.max("points").alias("__top"))
    t = t.withColumn("k", F.lit(1)).join(F.broadcast(top.withColumn("k", F.lit(1))), "k")
    return t.select("lat_cell", "lon_cell", center("lat_cell", la0, la1).alias("lat_center"), center("lon_cell", lo0, lo1).alias("lon_center"),
                    "points", (F.col("points") == F.col("__top")).alias("densest"))


def sample_points(df: DataFrame, lat: str, lon: str, key: str, n: int, extra: list[str] | None = None, seed: int = 42) -> DataFrame:
    """n points chosen by the hash of the key (see `sample_n`), with colour and size columns."""
    pair = df.where(c(lat).isNotNull() & c(lon).isNotNull())
    return sample_n(pair, n, [key], seed).select(c(key), c(lat), c(lon), *[c(x) for x in (extra or [])])
