"""Geocoding, zones and repair on small tables and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidyward.operators import geocode as GC
from tidyward.operators import repair as RP
from tidyward.operators import zones as Z
from tidyward.operators.streets import registry_table
from tidyward.schema import ADDRESS_POINTS, BUILDING_LAYER, GEOCODER_RESULTS
from tidyward.sources.readers import parse_corrections

POINTS = [(1, "הרצל", "1", 1, "מרכז", 32.150, 34.800, 1), (1, "הרצל", "5א", 5, "מרכז", 32.151, 34.801, 2),
          (1, "הרצל", "40", 40, None, 32.152, 34.802, 3), (2, "ויצמן", "3", 3, None, 32.160, 34.810, 4),
          (2, "ויצמן", "3", 3, None, 32.161, 34.811, 5)]


@pytest.fixture
def points(frame):
    return frame(POINTS, ADDRESS_POINTS)


def located(df, key="ticket"):
    return {r[key]: (r["geocode_method"], r["precision"], r["lat"]) for r in df.collect()}


def requests(frame, rows):
    return frame(rows, "ticket string, street string, house string, loc_type string, cross_street string")


def test_local_steps(frame, points):
    rows = requests(frame, [
        ("1", "הרצל", "1", "כתובת", None), ("2", "הרצל", "5", "כתובת", None),
        ("3", "הרצל", "7ב", "כתובת", None), ("4", "הרצל", "90", "כתובת", None),
        ("5", "הרצל", None, "כתובת", None), ("6", "ויצמן", "3", "כתובת", None),
        ("7", "הרצל 1 כניסה ב", None, "ציון דרך", None), ("8", "אין כזה", "1", "כתובת", None),
        ("9", None, None, "ללא רחוב", None)])
    got = located(GC.geocode(rows, GC.Sources(points=points), "r1"))
    centre = pytest.approx(32.151)
    assert got["1"] == ("local_exact", "address", 32.150)
    assert got["2"] == ("local_exact", "address", 32.151)
    assert got["3"] == ("local_nearest", "near_address", 32.151)
    assert got["4"] == ("local_street_centroid", "street", centre)
    assert got["5"] == ("local_street_centroid", "street", centre)
    assert got["6"] == ("local_exact", "address", 32.161)
    # the name's first prefix form names the street, and no house means its centroid
    assert got["7"] == ("local_street_centroid", "street", centre)
    assert got["8"] == got["9"] == ("unresolved", "none", None)


def test_cascade_order_and_labels(frame, points):
    rows = requests(frame, [
        ("1", "הרצוג", "0", "כתובת", None), ("2", "הרצוג", "4", "כתובת", None),
        ("3", "גורדון", "4", "כתובת", None), ("4", "גורדון", "90", "כתובת", None),
        ("5", "פינה", None, "ציון דרך", None), ("6", "ביאליק", "7", "כתובת", None),
        ("7", "ביאליק", "7", "כתובת", None), ("8", "רע", "7", "כתובת", None),
        ("9", "", "7", "כתובת", None), ("a", "ביאליק", "8", "כתובת", None)])
    layer = frame([("גורדון", "4", 34.81, 32.17, 1), ("גורדון", "10", 34.82, 32.18, 2)], BUILDING_LAYER)
    answers = frame([("ביאליק 7, הרצליה, ישראל", 32.15, 34.80, 30), ("ביאליק 8, הרצליה, ישראל", 31.0, 34.8, 30),
                     ("ביאליק, הרצליה, ישראל", 32.155, 34.80, 26)], GEOCODER_RESULTS)
    corrections = parse_corrections(frame([(
        '{"פינה": {"status": "resolvable", "note": "", "nominatim": null, "gis": "__INTERSECTION__גורדון__חסר"},'
        ' "רע": {"status": "unresolvable", "note": "", "nominatim": null, "gis": null}}',)], "value string"))
    src = GC.Sources(points=points, layer=layer, geocoder=answers, corrections=corrections,
                     registry=registry_table(frame([("הרצל", "9", 1)], "name string, code string, seq long")),
                     project=lambda x, y: (F.col(y), F.col(x)))
    out = GC.geocode(rows, src, "r1")
    got = located(out)
    assert got["1"] == ("street_zero_centroid", "street", 32.168058)
    assert got["2"] == ("osm_centroid", "street", 32.168058)
    assert got["3"] == ("gis_exact", "address", 32.17)
    assert got["4"] == ("gis_nearest", "near_address", 32.18)
    assert got["5"] == ("gis_intersection", "street", pytest.approx(32.175))
    assert got["6"] == ("nominatim", "address", 32.15)
    assert got["7"] == ("nominatim_cached", "address", 32.15)
    assert got["8"] == ("flagged_description", "none", None)
    assert got["9"] == ("no_street", "none", None)
    assert got["a"] == ("nominatim", "street", 32.155)
    s = GC.geocode_stats(out).first()
    assert (s["total_rows"], s["total_geocoded"], s["coverage_pct"]) == (10, 8, 80.0)


def test_located_rows_are_left_alone(frame, points):
    rows = requests(frame, [("1", "הרצל", "1", "כתובת", None)]).withColumns(
        {"lat": F.lit("1.5,"), "lon": F.lit("2.5"), "geocode_method": F.lit("manual")})
    assert located(GC.geocode(rows, GC.Sources(points=points))) == {"1": ("manual", "address", 1.5)}


def test_nearest_numbers_equal_brute_force(frame):
    rng = random.Random(5)
    have = [(k, rng.randrange(400), i) for i in range(200) for k in ["a", rng.choice("bc")]]
    asked = sorted({(rng.choice("abcd"), rng.randrange(500)) for _ in range(300)})
    numbered = frame(have, "k string, n long, seq long").withColumn("point", F.col("seq"))
    wanted = frame(asked, "k string, n long")

    def brute(k, n, cap):
        near = [(abs(m - n), s) for kk, m, s in have if kk == k and (cap is None or abs(m - n) <= cap)]
        first = {}
        for kk, m, s in have:
            if kk == k:
                first[m] = min(first.get(m, s), s)
        near = [(abs(m - n), s) for m, s in first.items() if cap is None or abs(m - n) <= cap]
        return min(near)[1] if near else None

    for cap, fn in ((20, lambda: GC.nearest_within(wanted, numbered, "k", 20)),
                    (None, lambda: GC.nearest_any(wanted, numbered, "k"))):
        got = {(r["k"], r["n"]): r["point"] for r in fn().collect()}
        want = {(k, n): brute(k, n, cap) for k, n in asked}
        assert got == {k: v for k, v in want.items() if v is not None}


def test_zones_equal_brute_force(frame):
    rng = random.Random(11)
    refs = [(i, 32 + rng.random() * .1, 34.8 + rng.random() * .1, rng.choice("מצד")) for i in range(600)]
    refs += [(600 + i, 32.05, 34.85, "מ") for i in range(200)]       # one place many times
    refs += [(900, 0.0, 0.0, "צ"), (901, float("inf"), 34.8, "ד"), (902, None, 34.8, "ד")]   # strays
    pts = [(31.9 + rng.random() * .3, 34.7 + rng.random() * .3) for _ in range(200)]
    pts += [(0.1, 0.0), (-80.0, 170.0), (32.05, 34.85), (32.0501, 34.8501)]
    references = frame(refs, "ref_id long, lat double, lon double, zone string")
    points = frame(pts + [(float("inf"), 34.8), (float("nan"), 34.8), (None, 34.8)], "lat double, lon double")
    want = {p: min(((p[0] - la) ** 2 + (p[1] - lo) ** 2, i) for i, la, lo, _ in refs[:801])[1] for p in pts}
    got = {(r["lat"], r["lon"]): r["ref_id"] for r in Z.nearest_reference(points, references).collect()}
    assert got == want
    assert Z.nearest_reference(points, references.limit(0)).count() == 0
    single = Z.nearest_reference(points, frame(refs[:1], references.schema)).collect()
    assert {r["ref_id"] for r in single} == {0} and len(single) == len(pts)


def test_infinite_coordinates_have_no_zone(frame):
    refs = frame([(1, 32.15, 34.80, "מרכז")], "ref_id long, lat double, lon double, zone string")
    rows = frame([("1", "Infinity", "34.8"), ("2", "32.1", "-inf")], "ticket string, lat string, lon string")
    for r in Z.assign_zones(rows, refs).collect():
        assert (r["zone"], r["zone_distance_m"], r["zone_true_m"]) == ("לא ידוע", None, None)


def test_enrich_flags(frame):
    refs = frame([(1, 32.15, 34.80, "מרכז"), (2, 32.19, 34.86, "מחוץ לתחום")],
                 "ref_id long, lat double, lon double, zone string")
    rows = frame([("1", "32.15", "34.8001", "שני"), ("2", "32.19,", "34.86", "שני"), ("3", None, None, "שני"),
                  ("4", "32.151", "34.80", None)], "ticket string, lat string, lon string, weekday string")
    out = {r["ticket"]: r for r in Z.enrich(rows, refs).collect()}
    assert (out["1"]["zone"], out["1"]["collection_day"], out["1"]["same_day"]) == ("מרכז", "שני", 1)
    assert (out["2"]["zone"], out["2"]["collection_day"], out["2"]["same_day"]) == ("מחוץ לתחום", None, None)
    assert (out["3"]["zone"], out["3"]["zone_distance_m"]) == ("לא ידוע", None)
    assert out["4"]["same_day"] is None
    assert out["4"]["zone_distance_m"] == pytest.approx(111.2, abs=.1)
    stats = Z.enrichment_stats(Z.enrich(rows, refs)).first()
    assert (stats["total_rows"], stats["in_city"], stats["same_day"]) == (4, 2, 1)


def test_repair(frame):
    rows = [(f"{i}", "32.16,", "34.82", "nominatim", str(h), "כתובת") for i, h in enumerate([1, 2, 3, 4, 0, 4])]
    rows += [("r", "32.17", "34.82", "nominatim", "9", "כתובת"), ("u", "32.18", "34.82", "unresolved", "9", "כתובת"),
             ("n", None, None, "gis_exact", "9", "כתובת")]
    df = RP.relabel_methods(RP.coerce_coordinates(frame(
        rows, "ticket string, lat string, lon string, geocode_method string, house string, loc_type string")))
    collapsed = RP.collapsed_points(df)
    assert [(r["rows"], r["houses"]) for r in collapsed.collect()] == [(6, 4)]
    got = {r["ticket"]: r["precision"] for r in RP.backfill_precision(df, collapsed).collect()}
    assert got == {**{str(i): "street" for i in range(6)}, "r": "address_unverified", "u": "address", "n": "none"}
