"""Geodesy as column expressions: degrees, metres, WGS84. Failures are NULL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
A = 6378137.0
FLATTENING = 0.00335281068118
E2 = 0.0066943799901975848
UTM_A, UTM_F, UTM_K0, UTM_E0 = 6378.137, 1 / 298.257223563, 0.9996, 500.0
TILE, SIN_LIMIT = 512, 0.9999
FAILED = -1e20

RAD = math.pi / 180


def rad(c: Column) -> Column:
    return c * F.lit(RAD)


def deg(c: Column) -> Column:
    return c * F.lit(180 / math.pi)


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def gps(lon: Column, lat: Column, alt: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"), alt.alias("alt"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it. Keeps chains of conversions from growing as products."""
    return F.element_at(F.transform(F.array(value), f), 1)


def valid_gps(lon: Column, lat: Column) -> Column:
    return (F.abs(lon) <= 180) & (F.abs(lat) <= 90)


def gps_error(lon: Column, lat: Column) -> Column:
    """What is wrong with a corner, null if nothing is. Whole degrees, as they are typed in."""
    return F.when(~valid_gps(lon, lat), F.concat(F.lit("lon: "), lon.cast("bigint"), F.lit("; lat: "), lat.cast("bigint")))


def region_error(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """What is wrong with the corners of a region, the second one's after ``<==>`` if both are; null if nothing is."""
    a, b = gps_error(lon0, lat0), gps_error(lon1, lat1)
    return F.when(a.isNotNull() | b.isNotNull(), F.concat_ws("<==>", a, b))


def filter_region_nonempty(regions: DataFrame) -> DataFrame:
    """Regions (lon0, lat0, lon1, lat1) that may be used. Only corners out of range reject one; an extent of nothing, or below 1e-30, doesn't."""
    return regions.where(region_error(*(F.col(k) for k in ("lon0", "lat0", "lon1", "lat1"))).isNull())


def lla_to_ecef(lon: Column, lat: Column, alt: Column, radians: bool = False) -> Column:
    """Geodetic to earth-centred; NULL outside the valid range."""
    o, a = (lon, lat) if radians else (rad(lon), rad(lat))
    ok = (F.abs(a) <= math.pi / 2) & (F.abs(o) <= math.pi)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(a) * F.sin(a))
    return F.when(ok, point((n + alt) * F.cos(a) * F.cos(o), (n + alt) * F.cos(a) * F.sin(o), (n * (1 - E2) + alt) * F.sin(a)))


def ecef_to_lla(x: Column, y: Column, z: Column, radians: bool = False) -> Column:
    """Earth-centred to geodetic, by the fixed point of the height correction, in 10 rounds, which settle far below 1e-8 everywhere. NULL at the centre."""
    return let(point(x, y, z), lambda p: _ecef_to_lla(p, radians))


#: Rounds of the fixed point, each of which leaves at most a hundred and fiftieth of the error.
ROUNDS = 10


def _ecef_to_lla(c: Column, radians: bool) -> Column:
    rho = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
    flat = math.sqrt(1 - E2)
    # with the latitude's tangent t = (z + h) / rho the correction is E2 * A * t / sqrt(1 + (1 - E2) * t * t), here by the angle of flat * t, in which h stands once
    h = E2 * c["z"]
    for _ in range(ROUNDS):
        h = E2 * A / flat * F.sin(F.atan2(flat * (c["z"] + h), rho))

    def finish(e: Column) -> Column:
        zp, rho = e["zp"], e["rho"]
        r = F.sqrt(rho * rho + zp * zp)
        sp = F.try_divide(zp, r)
        lat, lon = F.atan2(zp, rho), F.atan2(c["y"], c["x"])
        out = (lon, lat) if radians else (deg(lon), deg(lat))
        return F.when(r > 0, gps(*out, r - F.lit(A) / F.sqrt(1 - E2 * sp * sp)))

    return let(F.struct((c["z"] + h).alias("zp"), rho.alias("rho")), finish)


def enu_rotation(lon: Column, lat: Column) -> Column:
    """Row-major 3x3 rotation from earth-centred to east-north-up axes."""
    o, a = rad(lon), rad(lat)
    so, co, sa, ca = F.sin(o), F.cos(o), F.sin(a), F.cos(a)
    return F.array(-so, co, F.lit(0.0), -sa * co, -sa * so, ca, ca * co, ca * so, sa)


def transpose3(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def rotate(m: Column, x: Column, y: Column, z: Column) -> Column:
    return point(*[m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] * z for i in range(3)])


def ecef_to_enu(target: Column, origin_lon: Column, origin_lat: Column, origin_alt: Column) -> Column:
    o = lla_to_ecef(origin_lon, origin_lat, origin_alt)
    return rotate(enu_rotation(origin_lon, origin_lat), target["x"] - o["x"], target["y"] - o["y"], target["z"] - o["z"])


def enu_to_ecef(enu: Column, origin_lon: Column, origin_lat: Column, origin_alt: Column) -> Column:
    o = lla_to_ecef(origin_lon, origin_lat, origin_alt)

    def back(e: Column) -> Column:
        d = rotate(transpose3(enu_rotation(origin_lon, origin_lat)), e["x"], e["y"], e["z"])
        return point(o["x"] + d["x"], o["y"] + d["y"], o["z"] + d["z"])

    return let(enu, back)


def lla_to_enu(lon: Column, lat: Column, alt: Column, origin: tuple[Column, Column, Column], strict: bool = False) -> Column:
    """Geodetic to local east-north-up around ``origin``; out of range NULL, or with ``strict`` three times -1e20."""
    out = ecef_to_enu(lla_to_ecef(lon, lat, alt), *origin)
    ok = valid_gps(lon, lat) & valid_gps(origin[0], origin[1])
    return F.when(ok, out).otherwise(point(*[F.lit(FAILED)] * 3)) if strict else F.when(ok, out)


def enu_to_lla(enu: Column, origin: tuple[Column, Column, Column]) -> Column:
    return let(enu_to_ecef(enu, *origin), lambda e: _ecef_to_lla(e, False))


def ecef_velocity_to_enu(v: Column, origin_lon: Column, origin_lat: Column) -> Column:
    return rotate(enu_rotation(origin_lon, origin_lat), v["x"], v["y"], v["z"])


def enu_velocity_to_ecef(v: Column, origin_lon: Column, origin_lat: Column) -> Column:
    return rotate(transpose3(enu_rotation(origin_lon, origin_lat)), v["x"], v["y"], v["z"])


_n = UTM_F / (2 - UTM_F)
_R = UTM_A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
# Series in the third flattening
ALPHA = (_n / 2 - 2 / 3 * _n**2 + 5 / 16 * _n**3, 13 / 48 * _n**2 - 3 / 5 * _n**3, 61 / 240 * _n**3)
BETA = (_n / 2 - 2 / 3 * _n**2 + 37 / 96 * _n**3, 1 / 48 * _n**2 + 1 / 15 * _n**3, 17 / 480 * _n**3)
DELTA = (2 * _n - 2 / 3 * _n**2 - 2 * _n**3, 7 / 3 * _n**2 - 8 / 5 * _n**3, 56 / 15 * _n**3)


def _series(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def utm_forward(lat: Column, lon: Column, zone: Column) -> Column:
    """(x, y) in metres, northern hemisphere."""
    phi, lam = rad(lat), rad(lon) - rad(zone * 6.0 - 183.0)
    k = 2 * math.sqrt(_n) / (1 + _n)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + _series([a * F.cos(2.0 * (j + 1) * xi) * F.sinh(2.0 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
    y = xi + _series([a * F.sin(2.0 * (j + 1) * xi) * F.cosh(2.0 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
    return F.struct(((UTM_E0 + UTM_K0 * _R * x) * 1000).alias("x"), (UTM_K0 * _R * y * 1000).alias("y"))


def utm_inverse(x: Column, y: Column, zone: Column) -> Column:
    """(lat, lon) in degrees."""
    xi, eta = y / 1000 / (UTM_K0 * _R), (x / 1000 - UTM_E0) / (UTM_K0 * _R)
    xi1 = xi - _series([b * F.sin(2.0 * (j + 1) * xi) * F.cosh(2.0 * (j + 1) * eta) for j, b in enumerate(BETA)])
    eta1 = eta - _series([b * F.cos(2.0 * (j + 1) * xi) * F.sinh(2.0 * (j + 1) * eta) for j, b in enumerate(BETA)])
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + _series([d * F.sin(2.0 * (j + 1) * chi) for j, d in enumerate(DELTA)])
    return F.struct(deg(phi).alias("lat"), (zone * 6.0 - 183.0 + deg(F.atan(F.sinh(eta1) / F.cos(xi1)))).alias("lon"))


def cartesian_position(lat: Column, lon: Column, alt: Column, sphere: bool = True) -> Column:
    """Cartesian position on the sphere or the ellipsoid of flattening FLATTENING."""
    a, o = rad(lat), rad(lon)
    if sphere:
        g1 = g2 = A + alt
    else:
        n = F.lit(A) / F.sqrt(1 - (2 - FLATTENING) * FLATTENING * F.sin(a) * F.sin(a))
        g1, g2 = n + alt, n * (1 - FLATTENING) ** 2 + alt
    return point(g1 * F.cos(a) * F.cos(o), g1 * F.cos(a) * F.sin(o), g2 * F.sin(a))


def cartesian_to_gps_sphere(x: Column, y: Column, z: Column) -> Column:
    """Altitude is z / sin(lat) - a, NULL on the equator."""
    lat = F.atan2(z, F.sqrt(y * y + x * x))
    return gps(deg(F.atan2(y, x)), deg(lat), F.try_divide(z, F.sin(lat)) - A)


def local_frame_matrix(x: Column, y: Column, z: Column) -> Column:
    """Row-major 4x4 that takes row vectors from the east-north-up frame at (x, y, z) to earth axes: the axes as rows, the point as the last row."""
    r = F.sqrt(x * x + y * y + z * z)
    up = [x / r, y / r, z / r]
    # east is (pole - point) x up, both horizontal terms; its z is 0
    ex, ey = -(A - z) * up[1] - y * up[2] + 0 * z, (A - z) * up[0] + x * up[2]
    n = F.sqrt(ex * ex + ey * ey)
    east = [ex / n, ey / n, F.lit(0.0)]
    north = [up[1] * east[2] - up[2] * east[1], up[2] * east[0] - up[0] * east[2], up[0] * east[1] - up[1] * east[0]]
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*east, zero, *north, zero, *up, zero, x, y, z, one)


def mercator_world(lon: Column, lat: Column) -> Column:
    s = F.greatest(F.least(F.sin(rad(lat)), F.lit(SIN_LIMIT)), F.lit(-SIN_LIMIT))
    return F.struct((TILE * (0.5 + lon / 360)).alias("x"), (TILE * (0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi))).alias("y"))


def mercator_pixel_tile(lon: Column, lat: Column, zoom: int) -> Column:
    w = mercator_world(lon, lat)
    px, py = w["x"] * 2**zoom, w["y"] * 2**zoom
    return F.struct(px.alias("pixel_x"), py.alias("pixel_y"), (px / TILE).alias("tile_x"), (py / TILE).alias("tile_y"))


def fit_zoom(ul_lon: Column, ul_lat: Column, lr_lon: Column, lr_lat: Column) -> Column:
    a, b = mercator_pixel_tile(ul_lon, ul_lat, 14), mercator_pixel_tile(lr_lon, lr_lat, 14)
    t = F.log2(F.greatest(b["pixel_x"] - a["pixel_x"], b["pixel_y"] - a["pixel_y"]) / TILE)
    return F.greatest((14 - t).cast("int"), F.lit(1))


def affine_to_map(px: Column, py: Column, w: Column) -> Column:
    return F.struct((px * w["a"] + py * w["b"] + w["c"]).alias("x"), (px * w["d"] + py * w["e"] + w["f"]).alias("y"))


def affine_from_map(x: Column, y: Column, w: Column, width: Column, height: Column) -> Column:
    """Normalised by the image size; NULL if the world file is singular."""
    det = w["a"] * w["e"] - w["d"] * w["b"]
    u = F.try_divide(w["e"] * x - w["b"] * y + w["b"] * w["f"] - w["e"] * w["c"], det) / width
    v = F.try_divide(-w["d"] * x + w["a"] * y + w["d"] * w["c"] - w["a"] * w["f"], det) / height
    return F.struct(u.alias("u"), v.alias("v"))


def raster_geotransform(ul_x: Column, ul_y: Column, lr_y: Column, pixel_w: Column, pixel_h: Column, unit: Column) -> Column:
    """Six numbers, origin moved half a pixel out; unit ``ds`` is divided by 3600."""
    h = F.when(ul_y > lr_y, -pixel_h).otherwise(pixel_h)
    scale = F.when(F.lower(unit) == "ds", 3600.0).otherwise(1.0)
    zero = F.lit(0.0)
    return F.transform(F.array(ul_x - pixel_w * 0.5, pixel_w, zero, ul_y - h * 0.5, zero, h), lambda v: v / scale)


def invert_geotransform(g: Column) -> Column:
    """NULL if the determinant is below 1e-15."""
    det = g[1] * g[5] - g[2] * g[4]
    d = F.when(F.abs(det) >= 1e-15, det)
    return F.when(
        d.isNotNull(),
        F.array((g[2] * g[3] - g[0] * g[5]) / d, g[5] / d, -g[2] / d, (g[0] * g[4] - g[1] * g[3]) / d, -g[4] / d, g[1] / d),
    )


def transform_point(x: Column, y: Column, z: Column, m: Column) -> Column:
    """Row vector times a row-major 4x4, divided by w."""
    v = [x * m[j] + y * m[4 + j] + z * m[8 + j] + m[12 + j] for j in range(4)]
    return point(*[F.try_divide(c, v[3]) for c in v[:3]])


def multiply_matrices(a: Column, b: Column) -> Column:
    return F.array(*[_series([a[4 * i + k] * b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)])


def axis_swap(x: Column, y: Column, z: Column, to_y_up: bool) -> Column:
    """z-up to y-up is (x, z, -y); back is (x, -z, y)."""
    return point(x, z, -y) if to_y_up else point(x, -z, y)


def rotation_euler(rx: Column, ry: Column, rz: Column) -> Column:
    """Row-major Rz * Ry * Rx."""
    sx, cx, sy, cy, sz, cz = F.sin(rx), F.cos(rx), F.sin(ry), F.cos(ry), F.sin(rz), F.cos(rz)
    return F.array(cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx)


def euler_angles(m: Column) -> Column:
    return F.struct(F.atan2(m[7], m[8]).alias("rx"), F.atan2(-m[6], F.sqrt(m[7] * m[7] + m[8] * m[8])).alias("ry"), F.atan2(m[3], m[0]).alias("rz"))


def uv_of(lon: Column, lat: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Position in a box, clamped to 0..1; NULL in a box without extent."""
    clamp = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    u, v = F.try_divide(lon - min_lon, max_lon - min_lon), F.try_divide(lat - min_lat, max_lat - min_lat)
    return F.struct(F.when(u.isNotNull(), clamp(u)).alias("u"), F.when(v.isNotNull(), clamp(v)).alias("v"))
