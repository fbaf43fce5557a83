"""Queries over geodesy functions and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.plans.fixtures import sql, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(name: str, text: str | None = None):
    """Register a query and its SQL twin."""

    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def r(x: Column, n: int = 3) -> Column:
    """Rounded, with no negative zero, so that engines agree on the last bits."""
    return F.round(x, n) + 0.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "gps_point")


def origin() -> tuple[Column, Column, Column]:
    return lit(-122.0), lit(37.5), lit(0.0)


PI = "3.141592653589793e0"
_D = f"{PI}/180"
ECEF = f"""ecef AS (SELECT *, n0, (n0+alt)*cos(a)*cos(o) AS x, (n0+alt)*cos(a)*sin(o) AS y, (n0*(1-{geo.E2}e0)+alt)*sin(a) AS z
  FROM (SELECT *, lon*({_D}) AS o, lat*({_D}) AS a, 6378137e0/sqrt(1-{geo.E2}e0*sin(lat*({_D}))*sin(lat*({_D}))) AS n0 FROM {{src}}))"""
_o, _a = f"(-122e0*({_D}))", f"(37.5e0*({_D}))"
_n0 = f"(6378137e0/sqrt(1-{geo.E2}e0*sin({_a})*sin({_a})))"
_ox, _oy, _oz = f"({_n0}*cos({_a})*cos({_o}))", f"({_n0}*cos({_a})*sin({_o}))", f"({_n0}*(1-{geo.E2}e0)*sin({_a}))"
ENU = f"""enu AS (SELECT *, -sin({_o})*(x-{_ox})+cos({_o})*(y-{_oy}) AS e,
  -sin({_a})*cos({_o})*(x-{_ox})-sin({_a})*sin({_o})*(y-{_oy})+cos({_a})*(z-{_oz}) AS nn,
  cos({_a})*cos({_o})*(x-{_ox})+cos({_a})*sin({_o})*(y-{_oy})+sin({_a})*(z-{_oz}) AS u FROM ecef)"""


def geo_sql(select: str, src: str = "gps_point", more: str = "") -> str:
    return sql(src, f", {ECEF.format(src=src)}, {ENU}{more} {select}")


def xyz(s: Column, *names: str) -> list[Column]:
    return [r(s[f]).alias(n) for f, n in zip(("x", "y", "z"), names or ("x", "y", "z"))]


@query("f01_filter_valid_gps", sql("gps_point_raw", "SELECT point_id, lon, lat FROM gps_point_raw WHERE abs(lon) <= 180 AND abs(lat) <= 90"))
def filter_valid_gps(spark, d):
    return view(spark, d, "gps_point_raw").where(geo.valid_gps(c("lon"), c("lat")))


@query("f01_gps_errors", sql("gps_point_raw", """SELECT point_id, CASE WHEN NOT (abs(lon) <= 180 AND abs(lat) <= 90) THEN 'lon: ' || CAST(CAST(lon AS BIGINT) AS VARCHAR) || '; lat: ' || CAST(CAST(lat AS BIGINT) AS VARCHAR) END AS error FROM gps_point_raw"""))
def gps_errors(spark, d):
    return view(spark, d, "gps_point_raw").select("point_id", geo.gps_error(c("lon"), c("lat")).alias("error"))


@query("f02_filter_region_nonempty", sql("gps_point_raw", """, regions AS (SELECT a.point_id, a.lon AS lon0, a.lat AS lat0, b.lon AS lon1, b.lat AS lat1 FROM gps_point_raw a JOIN gps_point_raw b ON b.point_id = a.point_id + 1)
SELECT point_id, lon0, lat0, lon1, lat1 FROM regions WHERE abs(lon0) <= 180 AND abs(lat0) <= 90 AND abs(lon1) <= 180 AND abs(lat1) <= 90"""))
def filter_region(spark, d):
    """Regions made of neighbouring points."""
    return geo.filter_region_nonempty(_regions(spark, d))


def _regions(spark, d):
    p = view(spark, d, "gps_point_raw")
    nxt = p.select((c("point_id") - 1).alias("point_id"), c("lon").alias("lon1"), c("lat").alias("lat1"))
    return p.select("point_id", c("lon").alias("lon0"), c("lat").alias("lat0")).join(nxt, "point_id")


_ERROR = "CASE WHEN NOT (abs(lon{k}) <= 180 AND abs(lat{k}) <= 90) THEN 'lon: ' || CAST(CAST(lon{k} AS BIGINT) AS VARCHAR) || '; lat: ' || CAST(CAST(lat{k} AS BIGINT) AS VARCHAR) END"


@query("f02_region_errors", sql("gps_point_raw", f""", regions AS (SELECT a.point_id, a.lon AS lon0, a.lat AS lat0, b.lon AS lon1, b.lat AS lat1 FROM gps_point_raw a JOIN gps_point_raw b ON b.point_id = a.point_id + 1), e AS (SELECT point_id, {_ERROR.format(k=0)} AS a, {_ERROR.format(k=1)} AS b FROM regions)
SELECT point_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || '<==>' || b ELSE coalesce(a, b) END AS error FROM e"""))
def region_errors(spark, d):
    """What is wrong with one or both corners."""
    return _regions(spark, d).select("point_id", geo.region_error(c("lon0"), c("lat0"), c("lon1"), c("lat1")).alias("error"))


@query("g01_lla_to_ecef", geo_sql("SELECT point_id, round(x,3)+0.0 AS x, round(y,3)+0.0 AS y, round(z,3)+0.0 AS z FROM ecef"))
def g01(spark, d):
    e = geo.lla_to_ecef(c("lon"), c("lat"), c("alt"))
    return points(spark, d).withColumn("e", e).select("point_id", *xyz(c("e")))


#: There and back again gives the point itself.
_SAME = sql("gps_point", "SELECT point_id, round(lon,6)+0.0 AS lon2, round(lat,6)+0.0 AS lat2, round(alt,3)+0.0 AS alt2 FROM gps_point")


@query("g02_ecef_to_lla", _SAME)
def g02(spark, d):
    p = points(spark, d).withColumn("e", geo.lla_to_ecef(c("lon"), c("lat"), c("alt"))).withColumn("g", geo.ecef_to_lla(c("e.x"), c("e.y"), c("e.z")))
    return p.select("point_id", r(c("g.lon"), 6).alias("lon2"), r(c("g.lat"), 6).alias("lat2"), r(c("g.alt")).alias("alt2"))


_XYZ = "round(e,3)+0.0 AS x, round(nn,3)+0.0 AS y, round(u,3)+0.0 AS z"


@query("g03_ecef_to_enu", geo_sql(f"SELECT point_id, {_XYZ} FROM enu"))
def g03(spark, d):
    e = geo.ecef_to_enu(geo.lla_to_ecef(c("lon"), c("lat"), c("alt")), *origin())
    return points(spark, d).withColumn("e", e).select("point_id", *xyz(c("e")))


@query("g03_enu_to_ecef", geo_sql("SELECT point_id, round(x,3)+0.0 AS x, round(y,3)+0.0 AS y, round(z,3)+0.0 AS z FROM ecef"))
def g03b(spark, d):
    e = geo.ecef_to_enu(geo.lla_to_ecef(c("lon"), c("lat"), c("alt")), *origin())
    return points(spark, d).withColumn("e", e).withColumn("b", geo.enu_to_ecef(c("e"), *origin())).select("point_id", *xyz(c("b")))


_RAW_OK = "abs(lon) <= 180 AND abs(lat) <= 90"


@query("g04_lla_to_enu", sql("gps_point_raw", f""", p AS (SELECT *, 0e0 AS alt FROM gps_point_raw), {ECEF.format(src='p')}, {ENU}
SELECT point_id, CASE WHEN {_RAW_OK} THEN round(e,3)+0.0 ELSE -1e20 END AS x, CASE WHEN {_RAW_OK} THEN round(nn,3)+0.0 ELSE -1e20 END AS y, CASE WHEN {_RAW_OK} THEN round(u,3)+0.0 ELSE -1e20 END AS z FROM enu"""))
def g04(spark, d):
    """With out-of-range rows, which give -1e20 three times."""
    p = view(spark, d, "gps_point_raw").withColumn("e", geo.lla_to_enu(c("lon"), c("lat"), lit(0.0), origin(), strict=True))
    return p.select("point_id", *[F.when(c("e")[f] == geo.FAILED, lit(geo.FAILED)).otherwise(r(c("e")[f])).alias(f) for f in "xyz"])


@query("g05_enu_to_lla", _SAME)
def g05(spark, d):
    p = points(spark, d).withColumn("e", geo.lla_to_enu(c("lon"), c("lat"), c("alt"), origin())).withColumn("g", geo.enu_to_lla(c("e"), origin()))
    return p.select("point_id", r(c("g.lon"), 6).alias("lon2"), r(c("g.lat"), 6).alias("lat2"), r(c("g.alt")).alias("alt2"))


def _rot(o: str, a: str) -> list[str]:
    return [f"(-sin({o}))", f"cos({o})", "0e0", f"(-sin({a})*cos({o}))", f"(-sin({a})*sin({o}))", f"cos({a})", f"(cos({a})*cos({o}))", f"(cos({a})*sin({o}))", f"sin({a})"]


_m = _rot(f"(lon*({_D}))", f"(lat*({_D}))")
_v = ("value", "(value*2)", "10e0")
_ROW = [" + ".join(f"{_m[3 * i + j]}*{_v[j]}" for j in range(3)) for i in range(3)]
_COL = [" + ".join(f"{_m[3 * j + i]}*{_v[j]}" for j in range(3)) for i in range(3)]
_VEL = "gps_point.*, alt AS value"


@query("g06_velocity_rotation", sql("gps_point", f"SELECT point_id, {', '.join(f'round({x},6)+0.0 AS {n}' for x, n in zip(_ROW + _COL, ('east', 'north', 'up', 'vx', 'vy', 'vz')))} FROM (SELECT {_VEL} FROM gps_point)"))
def g06(spark, d):
    v = geo.point(c("alt"), c("alt") * 2, lit(10.0))
    p = points(spark, d).withColumn("e", geo.ecef_velocity_to_enu(v, c("lon"), c("lat"))).withColumn("b", geo.enu_velocity_to_ecef(v, c("lon"), c("lat")))
    return p.select("point_id", *[r(c("e")[f], 6).alias(n) for f, n in zip("xyz", ("east", "north", "up"))], *[r(c("b")[f], 6).alias(n) for f, n in zip("xyz", ("vx", "vy", "vz"))])


@query("g07_enu_rotation", sql("gps_point", "SELECT point_id, " + ", ".join(f"round({x},9)+0.0 AS m{k}" for k, x in enumerate(_m)) + ", " + ", ".join(f"round({_m[3 * (k % 3) + k // 3]},9)+0.0 AS i{k}" for k in range(9)) + " FROM gps_point"))
def g07(spark, d):
    p = points(spark, d).withColumn("m", geo.enu_rotation(c("lon"), c("lat"))).withColumn("i", geo.transpose3(c("m")))
    return p.select("point_id", *[r(c("m")[k], 9).alias(f"m{k}") for k in range(9)], *[r(c("i")[k], 9).alias(f"i{k}") for k in range(9)])


def _num(x: float) -> str:
    return repr(x) if "e" in repr(x) else repr(x) + "e0"


_k = 2 * geo._n**0.5 / (1 + geo._n)
_S = _num(geo.UTM_K0 * geo._R)
UTM = f""", u0 AS (SELECT *, lat*({_D}) AS phi, lon*({_D}) - (-123e0)*({_D}) AS lam FROM {{src}}),
u1 AS (SELECT *, sinh(atanh(sin(phi)) - {_num(_k)}*atanh({_num(_k)}*sin(phi))) AS t FROM u0),
u2 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM u1),
utm AS (SELECT *, (500 + {_S}*(eta {' '.join(f'+ {_num(a)}*cos({2 * j + 2}*xi)*sinh({2 * j + 2}*eta)' for j, a in enumerate(geo.ALPHA))}))*1000 AS ux,
  {_S}*(xi {' '.join(f'+ {_num(a)}*sin({2 * j + 2}*xi)*cosh({2 * j + 2}*eta)' for j, a in enumerate(geo.ALPHA))})*1000 AS uy FROM u2)"""
UTM_BACK = f""", v0 AS (SELECT * EXCLUDE (xi, eta), uy/1000/{_S} AS xi, (ux/1000-500)/{_S} AS eta FROM utm),
v1 AS (SELECT *, xi {' '.join(f'- {_num(b)}*sin({2 * j + 2}*xi)*cosh({2 * j + 2}*eta)' for j, b in enumerate(geo.BETA))} AS xi1, eta {' '.join(f'- {_num(b)}*cos({2 * j + 2}*xi)*sinh({2 * j + 2}*eta)' for j, b in enumerate(geo.BETA))} AS eta1 FROM v0),
v2 AS (SELECT *, asin(sin(xi1)/cosh(eta1)) AS chi FROM v1),
back AS (SELECT *, (chi {' '.join(f'+ {_num(x)}*sin({2 * j + 2}*chi)' for j, x in enumerate(geo.DELTA))})*180/{PI} AS lat2, -123e0 + atan(sinh(eta1)/cos(xi1))*180/{PI} AS lon2 FROM v2)"""
ZONE = 10


def _with_utm(spark, d):
    return points(spark, d).withColumn("utm", geo.utm_forward(c("lat"), c("lon"), lit(float(ZONE))))


@query("g08_utm_forward", sql("gps_point", UTM.format(src="gps_point") + " SELECT point_id, round(ux,3)+0.0 AS x, round(uy,3)+0.0 AS y FROM utm"))
def g08(spark, d):
    return _with_utm(spark, d).select("point_id", r(c("utm.x")).alias("x"), r(c("utm.y")).alias("y"))


@query("g09_utm_inverse", sql("gps_point", UTM.format(src="gps_point") + UTM_BACK + " SELECT point_id, round(lat2,6)+0.0 AS lat2, round(lon2,6)+0.0 AS lon2 FROM back"))
def g09(spark, d):
    g = geo.utm_inverse(c("utm.x"), c("utm.y"), lit(float(ZONE)))
    return _with_utm(spark, d).withColumn("g", g).select("point_id", r(c("g.lat"), 6).alias("lat2"), r(c("g.lon"), 6).alias("lon2"))


@query("a09_reprojection_error", sql("gps_point", UTM.format(src="gps_point") + UTM_BACK.replace("gps_point", "utm") + UTM.format(src="(SELECT path_id, ux AS ux0, uy AS uy0, lon2 AS lon, lat2 AS lat FROM back)").replace("u0 ", "w0 ").replace("u1 ", "w1 ").replace("u2 ", "w2 ").replace("utm ", "utm2 ").replace("FROM u0)", "FROM w0)").replace("FROM u1)", "FROM w1)").replace("FROM u2)", "FROM w2)") + " SELECT path_id, round(max(abs(ux-ux0)),3)+0.0 AS err_x, round(max(abs(uy-uy0)),3)+0.0 AS err_y FROM utm2 GROUP BY path_id"))
def a09(spark, d):
    """Largest error of UTM -> GPS -> UTM per path."""
    p = _with_utm(spark, d).withColumn("g", geo.utm_inverse(c("utm.x"), c("utm.y"), lit(float(ZONE)))).withColumn("again", geo.utm_forward(c("g.lat"), c("g.lon"), lit(float(ZONE))))
    return p.groupBy("path_id").agg(r(F.max(F.abs(c("again.x") - c("utm.x")))).alias("err_x"), r(F.max(F.abs(c("again.y") - c("utm.y")))).alias("err_y"))


_fl = _num(geo.FLATTENING)
_gn = f"(6378137e0/sqrt(1-(2-{_fl})*{_fl}*sin(lat*({_D}))*sin(lat*({_D}))))"


@query("g10_cartesian_position", sql("gps_point", "SELECT point_id, " + ", ".join(f"round({e},3)+0.0 AS {n}" for e, n in [
    (f"(6378137e0+alt)*cos(lat*({_D}))*cos(lon*({_D}))", "sx"), (f"(6378137e0+alt)*cos(lat*({_D}))*sin(lon*({_D}))", "sy"), (f"(6378137e0+alt)*sin(lat*({_D}))", "sz"),
    (f"({_gn}+alt)*cos(lat*({_D}))*cos(lon*({_D}))", "ex"), (f"({_gn}+alt)*cos(lat*({_D}))*sin(lon*({_D}))", "ey"), (f"({_gn}*(1-{_fl})*(1-{_fl})+alt)*sin(lat*({_D}))", "ez")]) + " FROM gps_point"))
def g10(spark, d):
    p = points(spark, d).withColumn("s", geo.cartesian_position(c("lat"), c("lon"), c("alt"))).withColumn("e", geo.cartesian_position(c("lat"), c("lon"), c("alt"), sphere=False))
    return p.select("point_id", *xyz(c("s"), "sx", "sy", "sz"), *xyz(c("e"), "ex", "ey", "ez"))


@query("g11_cartesian_to_gps_sphere", sql("gps_point", "SELECT point_id, round(lon,6)+0.0 AS lon2, round(lat,6)+0.0 AS lat2, round(alt,3)+0.0 AS alt2 FROM gps_point"))
def g11(spark, d):
    p = points(spark, d).withColumn("s", geo.cartesian_position(c("lat"), c("lon"), c("alt"))).withColumn("g", geo.cartesian_to_gps_sphere(c("s.x"), c("s.y"), c("s.z")))
    return p.select("point_id", r(c("g.lon"), 6).alias("lon2"), r(c("g.lat"), 6).alias("lat2"), r(c("g.alt")).alias("alt2"))


@query("g12_local_frame_matrix", sql("gps_point", f""", s AS (SELECT point_id, lon*({_D}) AS o, lat*({_D}) AS a, (6378137e0+alt) AS g FROM gps_point)
SELECT point_id, round(-sin(o),6)+0.0 AS m0, round(cos(o),6)+0.0 AS m1, 0e0 AS m2, round(-sin(a)*cos(o),6)+0.0 AS m4, round(-sin(a)*sin(o),6)+0.0 AS m5, round(cos(a),6)+0.0 AS m6,
round(cos(a)*cos(o),6)+0.0 AS m8, round(cos(a)*sin(o),6)+0.0 AS m9, round(sin(a),6)+0.0 AS m10, round(g*cos(a)*cos(o),3)+0.0 AS m12, round(g*cos(a)*sin(o),3)+0.0 AS m13, round(g*sin(a),3)+0.0 AS m14 FROM s"""))
def g12(spark, d):
    """Its axes are the east, north and up directions of the sphere's point."""
    p = points(spark, d).withColumn("s", geo.cartesian_position(c("lat"), c("lon"), c("alt"))).withColumn("m", geo.local_frame_matrix(c("s.x"), c("s.y"), c("s.z")))
    return p.select("point_id", *[r(c("m")[k], 3 if k >= 12 else 6).alias(f"m{k}") for k in (0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14)])


_sin = f"greatest(least(sin(lat*({_D})), 0.9999e0), -0.9999e0)"
_wx, _wy = "(512*(0.5e0+lon/360))", f"(512*(0.5e0-ln((1+{_sin})/(1-{_sin}))/(4*{PI})))"


@query("g13_mercator", sql("gps_point", f"SELECT point_id, round({_wx},6)+0.0 AS world_x, round({_wy},6)+0.0 AS world_y, round({_wx}*16384,3)+0.0 AS pixel_x, round({_wy}*16384,3)+0.0 AS pixel_y, round({_wx}*32,6)+0.0 AS tile_x, round({_wy}*32,6)+0.0 AS tile_y FROM gps_point"))
def g13(spark, d):
    p = points(spark, d).withColumn("w", geo.mercator_world(c("lon"), c("lat"))).withColumn("t", geo.mercator_pixel_tile(c("lon"), c("lat"), 14))
    return p.select("point_id", r(c("w.x"), 6).alias("world_x"), r(c("w.y"), 6).alias("world_y"), *[r(c("t")[f], 3 if f[0] == "p" else 6).alias(f) for f in ("pixel_x", "pixel_y", "tile_x", "tile_y")])


_swy = lambda lat: f"(512*(0.5e0-ln((1+greatest(least(sin(({lat})*({_D})), 0.9999e0), -0.9999e0))/(1-greatest(least(sin(({lat})*({_D})), 0.9999e0), -0.9999e0)))/(4*{PI})))"


@query("g14_fit_zoom", sql("footprint_map", f"SELECT map_id, greatest(CAST(trunc(14 - log2(greatest(512*(size/360)*16384, ({_swy('min_lat')}-{_swy('min_lat+size')})*16384)/512)) AS INTEGER), 1) AS zoom FROM footprint_map"))
def g14(spark, d):
    return view(spark, d, "footprint_map").select("map_id", geo.fit_zoom(c("min_lon"), c("min_lat") + c("size"), c("min_lon") + c("size"), c("min_lat")).alias("zoom"))


_W = "0.5e0 AS a, 0.1e0 AS b, 1000e0 + map_id AS c, -0.2e0 AS d, -0.6e0 AS e, 2000e0 - map_id AS f"


@query("g15_affine", sql("footprint_map", f""", w AS (SELECT map_id, CAST(map_id*7 % 100 AS DOUBLE) AS px, CAST(map_id*13 % 90 AS DOUBLE) AS py, {_W} FROM footprint_map),
m AS (SELECT *, px*a+py*b+c AS x, px*d+py*e+f AS y FROM w)
SELECT map_id, round(x,6) AS x, round(y,6) AS y, round((e*x-b*y+b*f-e*c)/(a*e-d*b)/256,9)+0.0 AS u, round((-d*x+a*y+d*c-a*f)/(a*e-d*b)/128,9)+0.0 AS v FROM m"""))
def g15(spark, d):
    w = F.struct(lit(0.5).alias("a"), lit(0.1).alias("b"), (1000.0 + c("map_id")).alias("c"), lit(-0.2).alias("d"), lit(-0.6).alias("e"), (2000.0 - c("map_id")).alias("f"))
    m = view(spark, d, "footprint_map").withColumn("w", w).withColumn("m", geo.affine_to_map((c("map_id") * 7 % 100).cast("double"), (c("map_id") * 13 % 90).cast("double"), c("w")))
    m = m.withColumn("back", geo.affine_from_map(c("m.x"), c("m.y"), c("w"), lit(256.0), lit(128.0)))
    return m.select("map_id", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"), r(c("back.u"), 9).alias("u"), r(c("back.v"), 9).alias("v"))


_g0, _g3 = "(min_lon-size*0.5e0)/k", "(CASE WHEN map_id % 2 = 0 THEN min_lat + size*0.25e0 ELSE min_lat - size*0.25e0 END)/k"


@query("g16_geotransform", sql("footprint_map", f""", g AS (SELECT *, {_g0} AS g0, size/k AS g1, {_g3} AS g3, (CASE WHEN map_id % 2 = 0 THEN -size*0.5e0 ELSE size*0.5e0 END)/k AS g5 FROM (SELECT *, CASE WHEN map_id % 3 = 0 THEN 3600e0 ELSE 1e0 END AS k FROM footprint_map))
SELECT map_id, round(g0,9) AS g0, round(g1,9) AS g1, round(g3,9) AS g3, round(g5,9) AS g5, round(-g0/g1,6)+0.0 AS i0, round(1/g1,6) AS i1, round(-g3/g5,6)+0.0 AS i3, round(1/g5,6) AS i5 FROM g"""))
def g16(spark, d):
    lr_y = c("min_lat") + F.when(c("map_id") % 2 == 0, -1.0).otherwise(1.0)
    g = geo.raster_geotransform(c("min_lon"), c("min_lat"), lr_y, c("size"), c("size") * 0.5, F.when(c("map_id") % 3 == 0, "ds").otherwise("meters"))
    p = view(spark, d, "footprint_map").withColumn("g", g).withColumn("i", geo.invert_geotransform(c("g")))
    return p.select("map_id", *[F.round(c("g")[k], 9).alias(f"g{k}") for k in (0, 1, 3, 5)], *[r(c("i")[k], 6).alias(f"i{k}") for k in (0, 1, 3, 5)])


_mat = lambda k: [f"{v}e0" for v in ([2, 0, 0, 0, 0, 3, 0, 0, 0, 1, 4, 0, 5, 6, 7, 1] if k == 0 else [0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0, 1, 1, 1, 1])]
_MM = [sum(float(_mat(0)[4 * i + k][:-2]) * float(_mat(1)[4 * k + j][:-2]) for k in range(4)) for i in range(4) for j in range(4)]


@query("g17_transform_points", sql("gps_point", f"SELECT point_id, round(x*{_MM[0]}e0+y*{_MM[4]}e0+z*{_MM[8]}e0+{_MM[12]}e0,3)+0.0 AS x, round(x*{_MM[1]}e0+y*{_MM[5]}e0+z*{_MM[9]}e0+{_MM[13]}e0,3)+0.0 AS y, round(x*{_MM[2]}e0+y*{_MM[6]}e0+z*{_MM[10]}e0+{_MM[14]}e0,3)+0.0 AS z FROM (SELECT point_id, lon AS x, lat AS y, alt AS z FROM gps_point)"))
def g17(spark, d):
    a, b = (F.array(*[lit(float(v[:-2])) for v in _mat(k)]) for k in (0, 1))
    p = points(spark, d).withColumn("m", geo.multiply_matrices(a, b)).withColumn("t", geo.transform_point(c("lon"), c("lat"), c("alt"), c("m")))
    return p.select("point_id", *xyz(c("t")))


@query("g20_axis_swap", sql("gps_point", "SELECT point_id, lon AS x, alt AS y, -lat AS z, lon AS bx, lat AS by_, alt AS bz FROM gps_point"))
def g20(spark, d):
    p = points(spark, d).withColumn("a", geo.axis_swap(c("lon"), c("lat"), c("alt"), True)).withColumn("b", geo.axis_swap(c("a.x"), c("a.y"), c("a.z"), False))
    return p.select("point_id", "a.x", "a.y", "a.z", c("b.x").alias("bx"), c("b.y").alias("by_"), c("b.z").alias("bz"))


@query("g21_rotation_euler", sql("gps_point", "SELECT point_id, round(lat/100,6) AS rx, round(lon/300,6) AS ry, round(atan2(sin(alt/1000),cos(alt/1000)),6)+0.0 AS rz, round(cos(alt/1000)*cos(lon/300),6)+0.0 AS m0, round(-sin(lon/300),6)+0.0 AS m6 FROM gps_point"))
def g21(spark, d):
    p = points(spark, d).withColumn("m", geo.rotation_euler(c("lat") / 100, c("lon") / 300, c("alt") / 1000)).withColumn("e", geo.euler_angles(c("m")))
    return p.select("point_id", *[r(c("e")[f], 6).alias(f) for f in ("rx", "ry", "rz")], r(c("m")[0], 6).alias("m0"), r(c("m")[6], 6).alias("m6"))


@query("g22_uv_of", sql("gps_point", "SELECT point_id, round(greatest(least((lon+122.25e0)/0.5e0,1e0),0e0),9) AS u, round(greatest(least((lat-37.25e0)/0.5e0,1e0),0e0),9) AS v FROM gps_point"))
def g22(spark, d):
    p = points(spark, d).withColumn("t", geo.uv_of(c("lon"), c("lat"), lit(-122.25), lit(37.25), lit(-121.75), lit(37.75)))
    return p.select("point_id", F.round("t.u", 9).alias("u"), F.round("t.v", 9).alias("v"))
