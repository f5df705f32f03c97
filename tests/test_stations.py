import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourmark.functions import text as x
from hourmark.operators import stations
from hourmark.operators.nearest import descents, nearest
from hourmark.runtime import cut
from hourmark.sources.registry import PLACE_COLUMNS

REGISTRY = "seq int, full_name string, state string, city string, latitude double, longitude double"
SOURCE = "station_id string, station_name string, state string, city string, latitude double, longitude double"


def resolve(spark, ids, source=(), fixed=(), portal=(), registry=()):
    readings = spark.createDataFrame([(i,) for i in ids], "raw_id string")
    raw = stations.raw_stations(readings, spark.createDataFrame(list(source), SOURCE))
    listed = spark.createDataFrame(list(registry), REGISTRY).withColumn("norm", x.name_key(F.col("full_name")))
    dim = stations.resolve_stations(
        raw, spark.createDataFrame(list(fixed), PLACE_COLUMNS), spark.createDataFrame(list(portal), PLACE_COLUMNS), listed
    )
    return {r.raw_id: r for r in dim.collect()}


def test_an_exact_name_hides_name_keys(spark):
    got = resolve(
        spark,
        ["site_1"],
        source=[("site_1", "Fort, Agra - UP", None, None, 5.0, 5.0)],
        registry=[(1, "Fort, Agra - XX", "near", "near", 5.0, 5.0), (2, "Fort, Agra - UP", None, "exact", 9.0, 9.0)],
    )
    row = got["site_1"]
    # the exact row has no state and the name key is not consulted
    assert (row.city_name, row.state_name, row.latitude) == ("exact", None, 9.0)


def test_nearest_of_a_shared_key_then_listing_order(spark):
    listed = [
        (1, "Mill Lane, Port - A", "s1", "c1", 10.0, 10.0),
        (2, "Mill Lane, Port - B", "s2", "c2", 20.0, 20.0),
        (3, "Mill Lane, Port - C", "s3", "c3", 0.0, 10.0),
    ]
    got = resolve(
        spark,
        ["site_1", "site_2", "site_3_Mill Lane, Port - Z", "site_4"],
        source=[
            ("site_1", "Mill Lane, Port - Q", None, None, 19.0, 19.0),
            ("site_2", "Mill Lane, Port - R", None, None, 5.0, 10.0),
            ("site_4", "Mill Lane, Port - S", None, None, 1.0, None),
        ],
        registry=listed,
    )
    assert got["site_1"].city_name == "c2"
    assert got["site_2"].city_name == "c1"  # a tie
    assert got["site_4"].city_name == "c1"  # half a coordinate is none
    derived = got["site_3_Mill Lane, Port - Z"]
    assert (derived.station_id, derived.station_name, derived.city_name) == ("site_3", "Mill Lane, Port - A", "c1")
    assert got["site_1"].station_name == "Mill Lane, Port - Q"  # a name of its own stays


def test_columns_are_filled_one_by_one(spark):
    got = resolve(
        spark,
        ["DS1010001", "site_2"],
        source=[("DS1010001", None, "src state", "src city", 1.0, 1.0), ("site_2", "Two - A", "src state", "src city", 1.0, 1.0)],
        fixed=[("DS1010001", "Fixed", None, "fixed state", 2.0, None)],
        portal=[("DS1010001", "Portal", "portal city", "portal state", 3.0, 3.0), ("site_2", None, None, None, 4.0, 4.0)],
        registry=[(1, "Two - A", "reg state", None, 5.0, 5.0)],
    )
    one, two = got["DS1010001"], got["site_2"]
    assert (one.station_name, one.state_name, one.city_name, one.latitude, one.longitude) == (
        "Fixed", "fixed state", "portal city", 2.0, 3.0,
    )
    assert one.source == "us_embassy" and two.source == "cpcb_caaqm"
    assert (two.station_name, two.state_name, two.city_name, two.latitude) == ("Two - A", "reg state", "src city", 4.0)


def test_a_repeated_portal_row_does_not_repeat_its_station(spark):
    got = resolve(spark, ["site_1"], portal=[("site_1", "B", "c", "s", 1.0, 1.0), ("site_1", "A", "c", "s", 2.0, 2.0)])
    assert got["site_1"].station_name == "A"


def test_two_raw_ids_for_one_public_id_are_an_error(spark):
    dim = spark.createDataFrame([("site_12", "site_12"), ("site_12_Name", "site_12"), ("site_1", "site_1")], "raw_id string, station_id string")
    assert {r.raw_id for r in stations.duplicate_stations(dim).collect()} == {"site_12", "site_12_Name"}
    with pytest.raises(stations.DuplicateStations, match="site_12: 2 raw ids, site_12 .. site_12_Name"):
        stations.require_unique(dim)
    alone = dim.where("raw_id <> 'site_12_Name'")
    assert stations.require_unique(alone) is alone


def brute_force(points, candidates):
    best = {}
    for norm, lat, lon in points:
        own = [c for c in candidates if c[1] == norm]
        if not own:
            continue
        if lat is None or lon is None:
            best[norm, lat, lon] = min(c[0] for c in own)
        else:
            best[norm, lat, lon] = min(((c[2] - lat) ** 2 + (c[3] - lon) ** 2, c[0]) for c in own)[1]
    return best


@pytest.mark.parametrize("cell", [0.01, 0.5, 40.0])
def test_nearest_equals_brute_force(spark, cell):
    rng = random.Random(7)

    def place(norm):
        if norm == "grid":  # many exact ties
            return float(rng.randrange(12)), float(rng.randrange(12))
        if norm == "cluster":  # one far outlier, the rest packed
            return (80.0, 170.0) if rng.random() < 0.02 else (rng.random() * 1e-3, rng.random() * 1e-3)
        return rng.uniform(-90, 90), rng.uniform(-180, 180)

    norms = ["grid"] * 3 + ["cluster"] * 2 + ["wide"] * 2 + ["lone", "absent"]
    points = set()
    for norm in rng.choices(norms, k=250):
        lat, lon = place(norm)
        points.add((norm, None if rng.random() < 0.05 else lat + rng.choice([0, 0.5]), lon))
    candidates = []
    for seq, norm in enumerate(rng.choices(norms[:-1], k=400)):
        candidates.append((seq, norm, *place(norm)))
    got = nearest(
        spark.createDataFrame(sorted(points, key=str), "norm string, latitude double, longitude double"),
        spark.createDataFrame(candidates, "seq int, norm string, latitude double, longitude double"),
        cell,
    )
    found = {(r.norm, r.latitude, r.longitude): r.best.seq for r in got.collect()}
    assert found == brute_force(points, candidates)


def test_many_far_points_of_one_key(spark):
    """A hundred thousand points far from a hundred thousand places, all under one key: a point meets a few
    cells at every level, and finds what comparing all with all finds."""
    points = spark.range(100_000).selectExpr("'k' AS norm", "30 + 20 * rand(1) AS latitude", "30 + 20 * rand(2) AS longitude")
    places = spark.range(100_000).selectExpr("id AS seq", "'k' AS norm", "-20 + 10 * rand(3) AS latitude", "-20 + 10 * rand(4) AS longitude")
    points, places = cut(points), cut(places)
    sites = places.groupBy("norm", "latitude", "longitude").agg(F.min(F.struct("seq")).alias("site"))
    sites = sites.withColumnsRenamed({"latitude": "site_lat", "longitude": "site_lon"})
    levels = descents(points, sites, 0.5)
    widest = max(df.count() for df in (levels[3], levels[5], levels[-1]))
    assert widest <= 8 * 100_000
    got = {(r.latitude, r.longitude): r.best.seq for r in nearest(points, places).collect()}
    assert len(got) == 100_000
    at = np.array([(r.latitude, r.longitude) for r in places.orderBy("seq").collect()])
    rng = random.Random(1)
    for lat, lon in rng.sample(sorted(got), 300):
        assert got[lat, lon] == int(((at - (lat, lon)) ** 2).sum(axis=1).argmin())


def test_coordinates_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    points = [("a", 1.0, 1.0), ("a", nan, 1.0), ("a", inf, 2.0), ("a", 80.0, 170.0), ("b", 1.0, 1.0), ("b", None, None)]
    candidates = [(0, "a", nan, 0.0), (1, "a", 1.2, 1.0), (2, "a", -inf, 5.0), (3, "a", 50.0, 90.0), (4, "b", nan, nan), (5, "b", inf, 1.0)]
    got = nearest(
        spark.createDataFrame(points, "norm string, latitude double, longitude double"),
        spark.createDataFrame(candidates, "seq int, norm string, latitude double, longitude double"),
    )
    found = {(r.norm, str(r.latitude), str(r.longitude)): r.best.seq for r in got.collect()}
    assert found == {
        ("a", "1.0", "1.0"): 1, ("a", "nan", "1.0"): 0, ("a", "inf", "2.0"): 0, ("a", "80.0", "170.0"): 3, ("b", "1.0", "1.0"): 4, ("b", "None", "None"): 4,
    }


def test_copies_in_the_registry_do_not_multiply(spark):
    points = spark.range(2000).selectExpr("'k' AS norm", "id % 40 / 7D AS latitude", "id % 30 / 3D AS longitude")
    candidates = spark.range(5000).selectExpr("id AS seq", "'k' AS norm", "id % 4 * 1D AS latitude", "2D AS longitude")
    got = nearest(points, candidates)
    assert got.count() == points.distinct().count()
    assert {r.best.seq for r in got.collect()} <= {0, 1, 2, 3}
