"""Column functions over coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidyward import rules as R
from tidyward.functions.text import col

EARTH_M = 6_371_000


def in_box(lat: Column | str, lon: Column | str, box=R.BOX) -> Column:
    lat_min, lat_max, lon_min, lon_max = box
    return col(lat).between(lat_min, lat_max) & col(lon).between(lon_min, lon_max)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres between two points in degrees."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(a)) * (2 * EARTH_M)


# The projection of the address-point files.
GRID = {
    "a": 6378137.0, "f": 1 / 298.257222101,
    "x0": 219529.584, "y0": 626907.39, "k0": 1.0000067,
    "lon0": 35.20451694444445, "lat0": 31.734393611111113,
}


def grid_to_degrees(x: Column | str, y: Column | str, grid: dict = GRID) -> tuple[Column, Column]:
    """Transverse Mercator metres to (latitude, longitude), rounded to 7 places.

    Inverse series in the third flattening, to fourth order; no datum shift.
    """
    n = grid["f"] / (2 - grid["f"])
    radius = grid["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # forward terms give the meridian arc of the origin
    alpha = [n/2 - 2*n**2/3 + 5*n**3/16 + 41*n**4/180,
             13*n**2/48 - 3*n**3/5 + 557*n**4/1440,
             61*n**3/240 - 103*n**4/140,
             49561*n**4/161280]
    beta = [n/2 - 2*n**2/3 + 37*n**3/96 - n**4/360,
            n**2/48 + n**3/15 - 437*n**4/1440,
            17*n**3/480 - 37*n**4/840,
            4397*n**4/161280]
    delta = [2*n - 2*n**2/3 - 2*n**3 + 116*n**4/45,
             7*n**2/3 - 8*n**3/5 - 227*n**4/45,
             56*n**3/15 - 136*n**4/35,
             4279*n**4/630]
    phi0 = math.radians(grid["lat0"])
    e = 2 * math.sqrt(n) / (1 + n)
    chi0 = math.atan(math.sinh(math.asinh(math.tan(phi0)) - e * math.atanh(e * math.sin(phi0))))
    xi0 = chi0 + sum(a_j * math.sin(2 * (j + 1) * chi0) for j, a_j in enumerate(alpha))
    scale = grid["k0"] * radius

    xi = (col(y) - grid["y0"]) / scale + xi0
    eta = (col(x) - grid["x0"]) / scale
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_p = xi_p - F.sin(2 * j * xi) * F.cosh(2 * j * eta) * b
        eta_p = eta_p - F.cos(2 * j * xi) * F.sinh(2 * j * eta) * b
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + F.sin(2 * j * chi) * d
    lon = F.atan2(F.sinh(eta_p), F.cos(xi_p))
    return F.round(F.degrees(lat), 7), F.round(F.degrees(lon) + grid["lon0"], 7)
