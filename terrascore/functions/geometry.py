"""Line length in a conformal conic projection, and WKB decoding.

The projection is the ordinary two-parallel Lambert conformal conic forward
formula with the published parameters of the French national grid. Lengths are
computed by Column expressions; only turning WKB bytes into coordinates needs
Python, as one Arrow-batched UDF.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from terrascore.functions.cleaning import ColumnOrName, _col

# GRS80 ellipsoid and the parameters of EPSG:2154.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
LAT_ORIGIN, LON_ORIGIN = 46.5, 3.0
PARALLEL_1, PARALLEL_2 = 49.0, 44.0
FALSE_EAST, FALSE_NORTH = 700000.0, 6600000.0

_FLAT = 1.0 / INVERSE_FLATTENING
_ECC = math.sqrt(2 * _FLAT - _FLAT * _FLAT)


def _conformal(phi: float) -> float:
    s = _ECC * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_ECC / 2)


def _parallel_radius(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_ECC * math.sin(phi)) ** 2)


_P1, _P2, _P0 = (math.radians(v) for v in (PARALLEL_1, PARALLEL_2, LAT_ORIGIN))
CONE = math.log(_parallel_radius(_P1) / _parallel_radius(_P2)) / math.log(_conformal(_P1) / _conformal(_P2))
SCALE = SEMI_MAJOR * _parallel_radius(_P1) / (CONE * _conformal(_P1) ** CONE)
RADIUS_ORIGIN = SCALE * _conformal(_P0) ** CONE
ECCENTRICITY = _ECC


def _projector():
    """The forward formula as ``xy(lon, lat, m)``; ``m`` is the Spark or the numpy function module.

    Its constants are local, so it can be shipped to executors by value.
    """
    eccentricity, cone, scale = ECCENTRICITY, CONE, SCALE
    origin, east, north = LON_ORIGIN, FALSE_EAST, FALSE_NORTH + RADIUS_ORIGIN
    quarter = math.pi / 4

    def xy(lon, lat, m):
        phi = m.radians(lat)
        s = m.sin(phi) * eccentricity
        t = m.tan(quarter - phi / 2) / ((1 - s) / (1 + s)) ** (eccentricity / 2)
        radius = t**cone * scale
        angle = m.radians(lon - origin) * cone
        return radius * m.sin(angle) + east, north - radius * m.cos(angle)

    return xy


def project(lon: Column, lat: Column) -> Column:
    """Longitude and latitude in degrees to a struct (x, y) in metres."""
    x, y = _projector()(lon, lat, F)
    return F.struct(x.alias("x"), y.alias("y"))


def line_length_km(points: ColumnOrName) -> Column:
    """Length of one line given as array<struct<lon, lat>>; each point is projected once."""
    projected = F.transform(_col(points), lambda p: project(p["lon"], p["lat"]))
    start = F.struct(
        F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("metres")
    )

    def add_segment(state: Column, p: Column) -> Column:
        # the first point has no predecessor, hence the null step
        step = F.hypot(p["x"] - state["x"], p["y"] - state["y"])
        return F.struct(
            p["x"].alias("x"), p["y"].alias("y"), (state["metres"] + F.coalesce(step, F.lit(0.0))).alias("metres")
        )

    return F.aggregate(projected, start, add_segment, lambda state: state["metres"] / 1000)


# WKB geometry type numbers, and the flag bits of extended WKB.
WKB_LINE, WKB_MULTI_LINE = 2, 5
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000


def wkb_type(geometry: ColumnOrName) -> Column:
    """Geometry type number of a WKB value, without dimension thousands and flag bits; null for what has no head."""
    head = F.hex(F.substring(_col(geometry), 1, 5))
    word = F.substring(head, 3, 8)
    little = F.concat(*[F.substring(word, i, 2) for i in (7, 5, 3, 1)])
    number = F.conv(F.when(F.substring(head, 1, 2) == "01", little).otherwise(word), 16, 10).cast("long")
    bare = number.bitwiseAND(F.lit(0xFFFFFFFF & ~(HAS_Z | HAS_M | HAS_SRID)))
    return F.when(F.length(head) == 10, (bare % 1000).cast("int"))


def is_line(geometry: ColumnOrName) -> Column:
    return wkb_type(geometry).isin(WKB_LINE, WKB_MULTI_LINE)


def wkb_length_km(geometry: ColumnOrName) -> Column:
    """Length in kilometres of WKB lines and multi-lines, one Arrow batch at a time.

    Python only finds the coordinates in each value; projecting and measuring is
    done by numpy over all points of a batch. Everything the UDF needs is inside
    this function, so it is shipped by value and executors need no package.
    """
    line, multi_line, xy = WKB_LINE, WKB_MULTI_LINE, _projector()
    has_z, has_m, has_srid = HAS_Z, HAS_M, HAS_SRID

    def add_parts(blob: bytes, offset: int, parts: list) -> int:
        order = "<" if blob[offset] == 1 else ">"
        (word,) = struct.unpack_from(order + "I", blob, offset + 1)
        offset += 9 if word & has_srid else 5  # a reference system number may stand before the count
        (count,) = struct.unpack_from(order + "I", blob, offset)
        offset += 4
        bare = word & ~(has_z | has_m | has_srid)
        kind, thousands = bare % 1000, bare // 1000
        extra = int(bool(word & has_z) or thousands in (1, 3)) + int(bool(word & has_m) or thousands in (2, 3))
        if kind == line:
            dims = 2 + extra
            values = np.frombuffer(blob, order + "f8", count * dims, offset)
            parts.append(values.reshape(count, dims)[:, :2])
            return offset + 8 * count * dims
        if kind != multi_line:
            raise ValueError(f"not a line geometry: type {kind}")
        for _ in range(count):
            offset = add_parts(blob, offset, parts)
        return offset

    @pandas_udf(T.DoubleType())
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for geometries in batches:
            parts: list = []
            owners: list = []
            for row, blob in enumerate(geometries):
                before = len(parts)
                if blob is not None:
                    add_parts(bytes(blob), 0, parts)
                owners.extend([row] * (len(parts) - before))
            missing = geometries.isna().to_numpy()
            total = np.zeros(len(geometries))
            if parts:
                points = np.concatenate(parts).astype("float64")
                x, y = xy(points[:, 0], points[:, 1], np)
                part_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                # a step from the end of one part to the start of the next is not a segment
                steps = np.hypot(np.diff(x), np.diff(y)) * (part_of[1:] == part_of[:-1])
                owner_of = np.asarray(owners)[part_of[1:]]
                total = np.bincount(owner_of, weights=steps, minlength=len(geometries))
            yield pd.Series(np.where(missing, np.nan, total / 1000))

    return length(_col(geometry))


def first_pair(coordinates_json: ColumnOrName) -> Column:
    """First (lon, lat) of nested GeoJSON coordinates given as JSON text."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    pattern = rf"^[\[\s]*\[\s*{number}\s*,\s*{number}"
    text = _col(coordinates_json)
    return F.struct(
        F.regexp_extract(text, pattern, 1).try_cast("double").alias("lon"),
        F.regexp_extract(text, pattern, 2).try_cast("double").alias("lat"),
    )


# Box around the mainland.
MAINLAND_BOX = (-6.0, 10.0, 41.0, 51.5)


def in_box(lon: ColumnOrName, lat: ColumnOrName, box=MAINLAND_BOX) -> Column:
    west, east, south, north = box
    return _col(lon).between(west, east) & _col(lat).between(south, north)
