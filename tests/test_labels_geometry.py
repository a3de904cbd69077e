import math
import struct

import pytest
from pyspark.sql import functions as F

from terrascore.functions import geometry as g
from terrascore.functions import labels
from terrascore.functions.bands import SIX_BANDS, band
from terrascore.sources.files import link_entities


def test_link_entities(spark, rows, texts):
    lines = texts(
        ["value"],
        ['<a href="#">Radio A (Lyon)</a> x <a href="#">Le Mag (bis) (Saint-Omer)</a>'],
        ['<a href="#">Sans ville</a><a href="/autre">Pas lui (X)</a>'],
        ["rien"],
    )
    assert rows(link_entities(lines, "value")) == [
        ("Le Mag (bis)", "Saint-Omer"), ("Radio A", "Lyon"), ("Sans ville", "Inconnue"),
    ]


def test_classification(spark, rows, texts):
    df = texts(["l", "c"], ["Existence d'un ratio", "Vitaux"], ["ratio x", "Induits"], ["Taux", "?"])
    got = rows(df, labels.indicator_kind("l"), labels.source_kind("l"), labels.objective_of("c"))
    assert got == [
        ("Action", "Enquête territoire", "Subsistance"),
        ("État", "Calcul dérivé", "Soutenabilité"),
        ("État", "Donnée publique", "Soutenabilité"),
    ]


def test_bands(spark):
    df = spark.createDataFrame([(float(v),) for v in (100, 80, 79.99, 60, 40, 20, 19.9)], "s double")
    assert [r[0] for r in df.select(band("s")).collect()] == [
        "Excellent", "Excellent", "Bon", "Bon", "Moyen", "Faible", "Critique",
    ]
    assert [r[0] for r in df.select(band("s", SIX_BANDS)).collect()] == [
        "Excellent", "Excellent", "Bon", "Modéré", "Insuffisant", "Critique", "Critique",
    ]


def projected(spark, lon, lat):
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    return tuple(df.select(g.project(F.col("lon"), F.col("lat")).alias("p")).select("p.x", "p.y").first())


def test_projection_control_points(spark):
    assert projected(spark, 3.0, 46.5) == pytest.approx((700000.0, 6600000.0), abs=1e-3)
    assert projected(spark, 2.3522, 48.8566) == pytest.approx((652469.02, 6862035.26), abs=0.05)


@pytest.mark.parametrize("parallel", [44.0, 49.0])
def test_projection_keeps_length_on_its_parallels(spark, parallel):
    step = 0.001
    a, b = projected(spark, 2.0, parallel), projected(spark, 2.0 + step, parallel)
    phi = math.radians(parallel)
    e2 = g.ECCENTRICITY**2
    arc = g.SEMI_MAJOR * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2) * math.radians(step)
    assert math.dist(a, b) == pytest.approx(arc, rel=1e-6)


def wkb_line(points, order="<"):
    head = struct.pack(order + "BII", 1 if order == "<" else 0, 2, len(points))
    return head + b"".join(struct.pack(order + "dd", *p) for p in points)


def test_wkb_lengths(spark):
    line = [(2.0, 48.0), (2.01, 48.0), (2.01, 48.02)]
    multi = struct.pack("<BII", 1, 5, 3) + wkb_line(line) + wkb_line(line, ">") + struct.pack("<BII", 1, 2, 0)
    with_height = struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 2.0, 48.0, 9.0, 2.01, 48.0, 7.0)
    point = struct.pack("<BIdd", 1, 1, 2.0, 48.0)
    data = [("line", wkb_line(line)), ("big", wkb_line(line, ">")), ("multi", multi), ("z", with_height), ("point", point)]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data], "k string, g binary")
    kinds = dict(tuple(r) for r in df.select("k", g.wkb_type("g")).collect())
    assert kinds == {"line": 2, "big": 2, "multi": 5, "z": 2, "point": 1}
    got = dict(tuple(r) for r in df.where(g.is_line("g")).select("k", g.wkb_length_km("g")).collect())
    corners = [projected(spark, *p) for p in line]
    expected = sum(math.dist(a, b) for a, b in zip(corners, corners[1:])) / 1000
    assert got["line"] == pytest.approx(expected) and got["big"] == pytest.approx(expected)
    assert got["multi"] == pytest.approx(2 * expected)
    assert got["z"] == pytest.approx(math.dist(*corners[:2]) / 1000)
    assert set(got) == {"line", "big", "multi", "z"}


def test_single_point_line_has_no_length(spark):
    df = spark.createDataFrame([([(2.0, 48.0)],)], "p array<struct<lon: double, lat: double>>")
    assert df.select(g.line_length_km("p")).first()[0] == 0.0


def test_first_pair_and_box(spark, rows, texts):
    df = texts(["c"], ["[2.5,48.1]"], ["[[[-61.5, 16.2],[1,2]]]"], ["[ [9,41.5e0], [0,0] ]"], [None], ["[]"])
    pairs = df.select(g.first_pair("c").alias("p")).select("p.lon", "p.lat")
    assert rows(pairs.where(g.in_box("lon", "lat"))) == [(2.5, 48.1), (9.0, 41.5)]
