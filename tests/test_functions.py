"""Scalar functions on hand-made values."""

import math
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidyward.functions import geo as G
from tidyward.functions import text as T
from tidyward.functions.address import address_route, parse_address


def values(df, expr):
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_decode_order_and_strip(frame):
    df = frame([("a &amp;#39; b",), (" &quot;x&quot; ",), (None,)], "s string")
    assert values(df, T.decode_entities("s")) == ["a ' b", '"x"', ""]


def test_ticket(frame):
    df = frame([("  2178241-ב",), ("77.0",), ("x9",), ("12 - ג ",)], "s string")
    assert values(df, T.ticket_id("s")) == ["2178241", "77", "x9", "12"]
    assert values(df, T.ticket_suffix("s")) == ["ב", None, None, "ג"]


def test_numbers(frame):
    df = frame([("32.1,",), ("nan",), ("",), (None,), (" 5 ",), ("x",)], "s string")
    assert values(df, T.to_number("s")) == [32.1, None, None, None, 5.0, None]


def test_blank_and_junk(frame):
    df = frame([("",), (" ",), ("NaN",), ("None",), ("12-14",), ("a1",), (None,)], "s string")
    assert values(df, T.is_blank("s")) == [True, True, True, True, False, False, True]
    assert values(df, T.is_junk("s")) == [False, False, False, False, True, False, False]


def test_units(frame):
    df = frame([("5/2",), ("22 דירה 1",), ("7 קומה 2",), ("9 כניסה ב",), ("0",), (None,)], "s string")
    assert values(df, T.strip_unit("s")) == ["5", "22", "7", "9", "", ""]


def test_bare_street_reaches_a_fixpoint(frame):
    names = ["רחוב הרצוג 14", "הרצוג 14א, ", "הרצוג, 3 ; 4/2 .", "12", "רח' הרצוג"]
    df = frame([(n,) for n in names], "s string")
    out = values(df, T.bare_street("s"))
    assert out == ["הרצוג", "הרצוג", "הרצוג", "12", "הרצוג"]
    again = frame([(n,) for n in out], "s string")
    assert values(again, T.bare_street("s")) == out


def test_tokens_and_ngrams(frame):
    df = frame([("הפח של ריח רע מאוד",), ("א ב",), (None,)], "s string")
    df = df.withColumn("w", T.tokens("s"))
    assert values(df, F.col("w")) == [["הפח", "ריח", "רע"], [], []]
    assert values(df, T.ngrams("w")) == [["הפח ריח", "ריח רע"], [], []]
    assert values(df, T.ngrams("w", 3)) == [["הפח ריח רע"], [], []]


ADDRESSES = {
    "": (None, None, None, "ללא רחוב", "empty"),
    "הרצל 8": ("הרצל", None, "8", "כתובת", "std"),
    "הרצל 8-12": ("הרצל", None, "8-12", "טווח בתים", "range"),
    "הרצל 9+11": ("הרצל", None, "9+11", "טווח בתים", "range"),
    "הרצל פינת סוקולוב": ("הרצל", "סוקולוב", None, "צומת", "intersection"),
    "הרצל פ. סוקולוב": ("הרצל", "סוקולוב", None, "צומת", "intersection"),
    "הרב קוק 43א": ("הרב קוק", None, "43א", "כתובת", "apt_suffix"),
    "פורצי הדרך 49 ג'": ("פורצי הדרך", None, "49ג", "כתובת", "apt_suffix"),
    "הרצל 5 ליד בית פוסטר": ("הרצל", None, "5", "כתובת", "std"),
    "הרצל בין הנדיב לאלתרמן": ("הרצל", None, None, "ציון דרך", "landmark"),
    "הרצל 6 (גן הגאולה)": ("הרצל", None, "6", "כתובת", "std"),
    "(גן)": ("", None, None, "ציון דרך", "landmark"),
    "הרצל 7": ("הרצל", None, "7", "כתובת", "std"),
    "ליד הים": ("ליד הים", None, None, "ציון דרך", "landmark"),
}


def test_address_cascade(frame):
    df = parse_address(frame([(a,) for a in ADDRESSES], "raw string"), "raw")
    df = df.withColumn("route", address_route(F.col("loc_type"), F.col("house"), F.col("address_text")))
    got = {r["raw"]: (r["street"], r["cross_street"], r["house"], r["loc_type"], r["route"])
           for r in df.collect()}
    assert got == ADDRESSES


def test_address_notes(frame):
    df = parse_address(frame([("הרצל 6 ( גן )",), ("הרצל ליד | הגן",), ("הרצל 2-4",)], "raw string"), "raw")
    rows = [(r["addr_note"], r["loc_note"]) for r in df.collect()]
    assert rows == [("(גן)", None), (None, "ליד | הגן"), (None, "בתים: 2-4")]


def _plain_parse(text):
    """The number part of the cascade stated with the standard library."""
    text = text.strip()
    if not text:
        return None, None
    for pattern in (r"^(.+?)\s+(\d+\s*[-–]\s*\d+)\s*$", r"^(.+?)\s+(\d+)\s*$",
                    r"^(.+?)\s+(\d+\s*[א-ת]{1,2}['׳]?)\s*$", r"^(.+?)\s+(\d+\s*[+&]\s*\d+)\s*$"):
        m = re.match(pattern, text)
        if m:
            return m.group(1).strip(), re.sub(r"\s", "", m.group(2)).rstrip("'")
    return text, None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="אבגד 0123456789-+&'", max_size=14), min_size=1, max_size=40))
def test_address_numbers_match_a_plain_statement(spark, texts):
    df = parse_address(spark.createDataFrame([(x,) for x in texts], "raw string"), "raw")
    for r in df.collect():
        assert (r["street"], r["house"]) == _plain_parse(r["raw"]), r["raw"]


def test_haversine(frame):
    df = frame([(32.0, 34.8, 33.0, 34.8)], "a double, b double, c double, d double")
    assert values(df, G.haversine_m("a", "b", "c", "d"))[0] == pytest.approx(111194.9, abs=1)


def _forward(lat, lon, g=G.GRID):
    """Degrees to grid metres by the textbook series in the eccentricity."""
    a, f, k0 = g["a"], g["f"], g["k0"]
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, phi0 = math.radians(lat), math.radians(g["lat0"])
    def arc(p):
        return a * ((1 - e2/4 - 3*e2**2/64 - 5*e2**3/256) * p
                    - (3*e2/8 + 3*e2**2/32 + 45*e2**3/1024) * math.sin(2*p)
                    + (15*e2**2/256 + 45*e2**3/1024) * math.sin(4*p)
                    - 35*e2**3/3072 * math.sin(6*p))
    n = a / math.sqrt(1 - e2 * math.sin(phi)**2)
    t, c = math.tan(phi)**2, ep2 * math.cos(phi)**2
    d = math.radians(lon - g["lon0"]) * math.cos(phi)
    x = g["x0"] + k0 * n * (d + (1 - t + c) * d**3/6 + (5 - 18*t + t*t + 72*c - 58*ep2) * d**5/120)
    y = g["y0"] + k0 * (arc(phi) - arc(phi0) + n * math.tan(phi) * (
        d*d/2 + (5 - t + 9*c + 4*c*c) * d**4/24 + (61 - 58*t + t*t + 600*c - 330*ep2) * d**6/720))
    return x, y


def test_reprojection_inverts_the_projection(frame):
    points = [(32.1660, 34.8250), (32.14, 34.78), (32.2, 34.87), (31.5, 35.4)]
    df = frame([(*_forward(*p), *p) for p in points], "x double, y double, lat double, lon double")
    lat, lon = G.grid_to_degrees("x", "y")
    for r in df.select(lat.alias("a"), lon.alias("b"), "lat", "lon").collect():
        assert (r["a"], r["b"]) == pytest.approx((r["lat"], r["lon"]), abs=2e-7)
