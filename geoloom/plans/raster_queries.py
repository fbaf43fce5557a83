"""Queries over rasters, grids and tiles and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import boxes, raster
from geoloom.plans.box_queries import square
from geoloom.plans.fixtures import sql, view
from geoloom.plans.geodesy import ECEF, ENU, origin, r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def samples(spark, d) -> DataFrame:
    return view(spark, d, "raster_sample").select(F.col("map_id"), F.col("row").cast("bigint").alias("row"), "col", "h")


def bands(spark, d) -> DataFrame:
    """Rasters of two bands."""
    return view(spark, d, "band_sample").select("map_id", "band", F.col("row").cast("bigint").alias("row"), "col", "h")


def headers(s: DataFrame) -> DataFrame:
    h = s.groupBy(*raster.band_keys(s)).agg((F.max("row") + 1).alias("ny"), (F.max("col") + 1).alias("nx"))
    return h.select(*raster.band_keys(s), (F.lit(-122.5) + F.col("map_id") * 0.1).alias("ul_x"), F.lit(37.9).alias("ul_y"), F.lit(0.001).alias("pixel"), F.col("nx").cast("int").alias("nx"), F.col("ny").cast("int").alias("ny"))


HEAD = """, hd AS (SELECT map_id, -122.5e0 + map_id*0.1e0 AS ul_x, 37.9e0 AS ul_y, 0.001e0 AS pixel, CAST(max(col)+1 AS INTEGER) AS nx, CAST(max("row")+1 AS INTEGER) AS ny FROM raster_sample GROUP BY map_id)"""


@query("s04_raster_blocks_to_samples", sql("raster_sample", """SELECT map_id, "row", col, CASE WHEN (map_id + "row"//16 + col//16) % 7 = 0 THEN 0e0 ELSE h END AS h FROM raster_sample"""))
def s04(spark, d):
    """Every seventh tile is absent and reads as zeros."""
    s = samples(spark, d)
    tiles = raster.samples_to_blocks(s, 16).withColumn("data", F.when((F.col("map_id") + F.col("block_y") + F.col("block_x")) % 7 != 0, F.col("data")))
    return raster.raster_blocks_to_samples(tiles, headers(s), 16)


@query("a03_raster_range", sql("raster_sample", "SELECT map_id, least(min(h), 100000e0) AS lo, greatest(max(h), -100000e0) AS hi FROM raster_sample GROUP BY map_id"))
def a03(spark, d):
    return raster.raster_range(samples(spark, d), seeded=True)


@query("a04_raster_statistics", sql("raster_sample", ", k AS (SELECT map_id, floor(h/50e0) AS h FROM raster_sample), n AS (SELECT map_id, h, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT map_id, min(h) AS mode FROM (SELECT *, rank() OVER (PARTITION BY map_id ORDER BY n DESC) AS k FROM n) WHERE k = 1 GROUP BY map_id) SELECT k.map_id, min(h) AS minimum, max(h) AS maximum, round(avg(h),6)+0.0 AS mean, quantile_cont(h, 0.5) AS median, any_value(mode) AS mode, round(stddev_samp(h),6) AS stddev FROM k JOIN m ON k.map_id = m.map_id GROUP BY k.map_id"))
def a04(spark, d):
    s = raster.raster_statistics(samples(spark, d).withColumn("h", F.floor(F.col("h") / 50.0).cast("double")))
    return s.withColumn("mean", r(F.col("mean"), 6)).withColumn("stddev", F.round("stddev", 6))


@query("a05_raster_histogram", sql("raster_sample", ", c AS (SELECT map_id, CAST(least(greatest(floor((h+300)/600e0*16),0),15) AS INTEGER) AS bin, count(*) AS n FROM raster_sample GROUP BY ALL), m AS (SELECT DISTINCT map_id FROM raster_sample) SELECT m.map_id, CAST(g.i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM m CROSS JOIN generate_series(0, 15) g(i) LEFT JOIN c ON c.map_id = m.map_id AND c.bin = g.i"))
def a05(spark, d):
    return raster.raster_histogram(samples(spark, d), 16, -300.0, 300.0)


@query("a06_data_range_ok", sql("raster_sample", 'SELECT map_id, min(CASE WHEN map_id % 3 = 0 THEN 1e0 ELSE h END) AS lo, max(CASE WHEN map_id % 3 = 0 THEN 1e0 ELSE h END) AS hi FROM raster_sample GROUP BY map_id HAVING map_id % 3 <> 0 AND max(h) > min(h)'))
def a06(spark, d):
    """Every third map is flat and has no range."""
    s = samples(spark, d).withColumn("h", F.when(F.col("map_id") % 3 == 0, 1.0).otherwise(F.col("h")))
    return raster.data_range_ok(raster.raster_range(s))


@query("a03_band_range", sql("band_sample", "SELECT map_id, band, min(h) AS lo, max(h) AS hi FROM band_sample GROUP BY ALL"))
def a03b(spark, d):
    return raster.raster_range(bands(spark, d))


_K2 = ", k AS (SELECT map_id, band, floor(h/50e0) AS h FROM band_sample)"


@query("a04_band_statistics", sql("band_sample", _K2 + ", n AS (SELECT map_id, band, h, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT map_id, band, min(h) AS mode FROM (SELECT *, rank() OVER (PARTITION BY map_id, band ORDER BY n DESC) AS k FROM n) WHERE k = 1 GROUP BY ALL) SELECT k.map_id, k.band, min(h) AS minimum, max(h) AS maximum, round(avg(h),6)+0.0 AS mean, quantile_cont(h, 0.5) AS median, any_value(mode) AS mode, round(stddev_samp(h),6) AS stddev FROM k JOIN m ON k.map_id = m.map_id AND k.band = m.band GROUP BY k.map_id, k.band"))
def a04b(spark, d):
    s = raster.raster_statistics(bands(spark, d).withColumn("h", F.floor(F.col("h") / 50.0).cast("double")))
    return s.withColumn("mean", r(F.col("mean"), 6)).withColumn("stddev", F.round("stddev", 6))


@query("a05_band_histogram", sql("band_sample", ", c AS (SELECT map_id, band, CAST(least(greatest(floor((h+300)/600e0*16),0),15) AS INTEGER) AS bin, count(*) AS n FROM band_sample GROUP BY ALL), m AS (SELECT DISTINCT map_id, band FROM band_sample) SELECT m.map_id, m.band, CAST(g.i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM m CROSS JOIN generate_series(0, 15) g(i) LEFT JOIN c ON c.map_id = m.map_id AND c.band = m.band AND c.bin = g.i"))
def a05b(spark, d):
    return raster.raster_histogram(bands(spark, d), 16, -300.0, 300.0)


@query("f07_band_nodata", sql("band_sample", ', k AS (SELECT map_id, band, "row", col, floor(h/50e0) AS h FROM band_sample) SELECT map_id, band, "row", col, nullif(h, CAST(map_id % 3 + band*2 - 1 AS DOUBLE)) AS h FROM k'))
def f07b(spark, d):
    s = bands(spark, d).withColumn("h", F.floor(F.col("h") / 50.0).cast("double"))
    return raster.nodata_to_null(s, s.select("map_id", "band").distinct().withColumn("nodata", (F.col("map_id") % 3 + F.col("band") * 2 - 1).cast("double")))


@query("m13_band_overview", sql("band_sample", 'SELECT map_id, band, "row"//8 AS "row", col//8 AS col, round(avg(h),6)+0.0 AS h FROM band_sample GROUP BY ALL'))
def m13b(spark, d):
    return raster.overview_grid(bands(spark, d), 8).withColumn("h", r(F.col("h"), 6))


# the pixel types in their order, and a value of each for a row and a column
_TYPES = list(raster.PIXEL_BITS)
_PIXEL = ["({r}+{c}) % 2", "({r}+{c}) % 4", "({r}+{c}*3) % 16", "({r}*{c}) % 256", "({r}*{c}) % 256 - 128", "({r}*{c}*17) % 65536", "({r}*{c}) % 4000 - 2000", "({r}*{c}*1000003) % 4294967296", "({r}*{c}*1000003) % 2147483648 - 1073741824", "{r}*0.25e0 - {c}", "{r}/3e0 - {c}", "{r}*0.5e0 - {c}", "{r}/7e0 - {c}"]


@query("s04_pixel_types", sql("band_sample", "SELECT t.i AS pixel_type, map_id, band, \"row\", col, CAST(CASE t.i " + " ".join(f"WHEN {k} THEN {e.format(r='CAST(\"row\" AS BIGINT)', c='col')}" for k, e in enumerate(_PIXEL)) + " END AS DOUBLE) AS h, CASE WHEN t.i >= 11 THEN CAST(band - \"row\" AS DOUBLE) END AS h_im FROM band_sample, generate_series(0, 12) t(i)"))
def s04b(spark, d):
    """Tiles of all pixel types, packed and unpacked."""
    s, out = bands(spark, d), None
    head = headers(s)
    for k, (name, e) in enumerate(zip(_TYPES, _PIXEL)):
        t = s.withColumn("h", F.expr(f"cast({e.format(r='row', c='col')} as double)")).withColumn("h_im", (F.col("band") - F.col("row")).cast("double"))
        back = raster.raster_blocks_to_samples(raster.samples_to_blocks(t, 16, name), head, 16, name)
        im = F.col("h_im") if "h_im" in back.columns else F.lit(None).cast("double")
        back = back.select(F.lit(k).cast("bigint").alias("pixel_type"), "map_id", "band", "row", "col", "h", im.alias("h_im"))
        out = back if out is None else out.union(back)
    return out


# tiles of three pixel types, whose pixels come in runs; forms go by the tile's place
_RUNS = {"u8": "({r}//5 + {c}//16) % 256", "s16": "({r}//3)*37 - 300 - {c}//8", "f32": "({r}//4)*0.25e0 - {c}//16"}
_FORMS = ("raw", "runs", "narrow", "absent")


@query("s04_compressed_tiles", sql("raster_sample", "SELECT t.i AS pixel_type, map_id, \"row\", col, CASE WHEN (\"row\"//16 + col//16) % 4 = 3 THEN 0e0 ELSE CAST(CASE t.i " + " ".join(f"WHEN {k} THEN {e.format(r='CAST(\"row\" AS BIGINT)', c='col')}" for k, e in enumerate(_RUNS.values())) + " END AS DOUBLE) END AS h FROM raster_sample, generate_series(0, 2) t(i)"))
def s04c(spark, d):
    """Raw, run, narrow and absent tiles in each map."""
    s, out = samples(spark, d), None
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("block_y") + F.col("block_x")) % 4 + 1)
    for k, (name, e) in enumerate(_RUNS.items()):
        t = s.withColumn("h", F.expr("cast(" + e.format(r="row", c="col").replace("//", " div ") + " as double)"))
        tiles = raster.samples_to_blocks(t, 16, name, F.when(form == "absent", "raw").otherwise(form)).withColumn("data", F.when(form != "absent", F.col("data")))
        back = raster.raster_blocks_to_samples(tiles, headers(s), 16, name).select(F.lit(k).cast("bigint").alias("pixel_type"), "map_id", "row", "col", "h")
        out = back if out is None else out.union(back)
    return out


@query("f07_nodata_to_null", sql("raster_sample", ', k AS (SELECT map_id, "row", col, floor(h/50e0) AS h FROM raster_sample) SELECT map_id, "row", col, nullif(h, CAST(map_id % 5 AS DOUBLE)) AS h FROM k'))
def f07(spark, d):
    s = samples(spark, d).withColumn("h", F.floor(F.col("h") / 50.0).cast("double"))
    return raster.nodata_to_null(s, s.select("map_id").distinct().withColumn("nodata", (F.col("map_id") % 5).cast("double")))


_F32 = "CAST({} AS FLOAT)".format


def _bil(fx: str, fy: str) -> str:
    x, y, one = _F32(fx), _F32(fy), "CAST(1 AS FLOAT)"
    row = lambda a, b: f"({_F32(a)}*({one}-{x})+{_F32(b)}*{x})"
    return f"({row('h', 'h01')}*({one}-{y})+{row('h10', 'h11')}*{y})"


NB = """, nb AS (SELECT a.map_id, a."row", a.col, a.h, coalesce(b.h, a.h) AS h01, coalesce(c.h, a.h) AS h10, coalesce(e.h, c.h, b.h, a.h) AS h11x, CASE WHEN c.h IS NULL THEN coalesce(b.h, a.h) ELSE coalesce(e.h, c.h) END AS h11
 FROM raster_sample a LEFT JOIN raster_sample b ON b.map_id=a.map_id AND b."row"=a."row" AND b.col=a.col+1 LEFT JOIN raster_sample c ON c.map_id=a.map_id AND c."row"=a."row"+1 AND c.col=a.col LEFT JOIN raster_sample e ON e.map_id=a.map_id AND e."row"=a."row"+1 AND e.col=a.col+1)"""


@query("w08_bilinear_sample", sql("gps_point raster_sample", f"""{HEAD}{NB}, q AS (SELECT point_id, map_id, (lon-ul_x)/pixel AS x, (ul_y-lat)/pixel AS y FROM gps_point JOIN hd ON floor((lon-ul_x)/pixel) BETWEEN 0 AND nx-1 AND floor((ul_y-lat)/pixel) BETWEEN 0 AND ny-1)
SELECT point_id, q.map_id, round(CAST({_bil('(x-floor(x))', '(y-floor(y))')} AS DOUBLE), 2) AS height FROM q JOIN nb ON nb.map_id=q.map_id AND nb."row"=floor(y) AND nb.col=floor(x)"""))
def w08(spark, d):
    """Points find their map by the whole tenths of a degree between the maps' corners."""
    s = samples(spark, d)
    q = view(spark, d, "gps_point").withColumn("map_id", F.floor((F.col("lon") + 122.5) / 0.1))
    q = q.join(headers(s), "map_id").select("point_id", "map_id", ((F.col("lon") - F.col("ul_x")) / F.col("pixel")).alias("x"), ((F.col("ul_y") - F.col("lat")) / F.col("pixel")).alias("y"))
    return raster.bilinear_sample(q, s).select("point_id", "map_id", F.round(F.col("height").cast("double"), 2).alias("height"))


NB2 = """, n1 AS (SELECT *, CASE WHEN lead(col) OVER w = col + 1 THEN lead(h) OVER w END AS r FROM band_sample WINDOW w AS (PARTITION BY map_id, band, "row" ORDER BY col)),
n2 AS MATERIALIZED (SELECT *, CASE WHEN lead("row") OVER w = "row" + 1 THEN lead(h) OVER w END AS l, CASE WHEN lead("row") OVER w = "row" + 1 THEN lead(r) OVER w END AS lr FROM n1 WINDOW w AS (PARTITION BY map_id, band, col ORDER BY "row")),
nb2 AS (SELECT map_id, band, "row", col, h, coalesce(r, h) AS h01, coalesce(l, h) AS h10, CASE WHEN l IS NULL THEN coalesce(r, h) ELSE coalesce(lr, l) END AS h11 FROM n2)"""


@query("w08_band_bilinear", sql("band_sample gps_point", f"""{NB2}, q AS (SELECT point_id, band, point_id % 3 AS map_id, (lon+122.5e0)*63 AS x, (lat-37)*63 AS y FROM gps_point, generate_series(0, 1) g(band))
SELECT point_id, q.map_id, q.band, round(CAST({_bil('(x-floor(x))', '(y-floor(y))')} AS DOUBLE), 2) AS height FROM q JOIN nb2 nb ON nb.map_id=q.map_id AND nb.band=q.band AND nb."row"=floor(y) AND nb.col=floor(x)"""))
def w08b(spark, d):
    """Each point in both bands of a map."""
    q = view(spark, d, "gps_point").select("point_id", (F.col("point_id") % 3).alias("map_id"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("band"), ((F.col("lon") + 122.5) * 63).alias("x"), ((F.col("lat") - 37) * 63).alias("y"))
    return raster.bilinear_sample(q, bands(spark, d)).select("point_id", "map_id", "band", F.round(F.col("height").cast("double"), 2).alias("height"))


@query("m01_map_extent", sql("raster_sample", f"{HEAD} SELECT map_id, round(ul_x+pixel*(nx-1),9) AS lr_x, round(ul_y-pixel*(ny-1),9) AS lr_y FROM hd"))
def m01(spark, d):
    return raster.map_extent(headers(samples(spark, d))).select("map_id", F.round("lr_x", 9).alias("lr_x"), F.round("lr_y", 9).alias("lr_y"))


@query("m02_degree_grid", sql("footprint_map", f""", g AS (SELECT map_id, i, j, i/256e0 AS lon, j/256e0 AS lat, 0e0 AS alt FROM (SELECT map_id, unnest(generate_series(CAST(ceil(min_lon*256) AS BIGINT), CAST(floor((min_lon+size)*256) AS BIGINT))) AS i, min_lat, size FROM footprint_map), LATERAL (SELECT unnest(generate_series(CAST(ceil(min_lat*256) AS BIGINT), CAST(floor((min_lat+size)*256) AS BIGINT))) AS j)),
{ECEF.format(src='g')}, {ENU} SELECT map_id, i, j, round(e,3)+0.0 AS x, round(nn,3)+0.0 AS y, round(u,3)+0.0 AS z FROM enu"""))
def m02(spark, d):
    g = raster.degree_grid(square(spark, d, "footprint_map", "map_id"), 256).withColumn("e", geo.lla_to_enu(F.col("lon"), F.col("lat"), F.lit(0.0), origin()))
    return g.select("map_id", "i", "j", *[r(F.col("e")[a]).alias(a) for a in "xyz"])


def grids(spark, d) -> DataFrame:
    return view(spark, d, "footprint_map").select("map_id", (2 + F.col("map_id") % 7).cast("int").alias("nx"), (2 + F.col("map_id") % 5).cast("int").alias("ny"))


_G = ", g AS (SELECT map_id, CAST(2 + map_id % 7 AS INTEGER) AS nx, CAST(2 + map_id % 5 AS INTEGER) AS ny FROM footprint_map), c AS (SELECT map_id, nx, ny, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM g, generate_series(0, 10) a(y), generate_series(0, 10) b(x))"


@query("m03_grid_triangles", sql("footprint_map", f"{_G}, s AS (SELECT *, y*nx+x AS a FROM c WHERE x < nx-1 AND y < ny-1) SELECT map_id, nx, ny, y, x, 0 AS half, a AS v0, a+1 AS v1, a+nx+1 AS v2 FROM s UNION ALL SELECT map_id, nx, ny, y, x, 1, a, a+nx+1, a+nx FROM s"))
def m03(spark, d):
    return raster.grid_triangles(grids(spark, d))


@query("m04_grid_outline", sql("footprint_map", f"{_G} SELECT map_id, nx, ny, 'h' AS kind, y*nx+x AS v0, y*nx+x+1 AS v1 FROM c WHERE x < nx-1 AND y < ny UNION ALL SELECT map_id, nx, ny, 'v', y*nx+x, y*nx+x+nx FROM c WHERE x < nx AND y < ny-1"))
def m04(spark, d):
    return raster.grid_outline(grids(spark, d))


@query("m05_grid_quads", sql("footprint_map", f"{_G} SELECT map_id, nx, ny, y, x, y*nx+x AS v0, y*nx+x+1 AS v1, y*nx+x+nx+1 AS v2, y*nx+x+nx AS v3 FROM c WHERE x < nx-1 AND y < ny-1"))
def m05(spark, d):
    return raster.grid_quads(grids(spark, d))


_WIN = f"""{HEAD}, mb AS (SELECT map_id, ul_x, ul_y, pixel, ul_x AS x0, ul_y-pixel*(ny-1) AS y0, ul_x+pixel*(nx-1) AS x1, ul_y AS y1 FROM hd),
ov AS (SELECT map_id, texture_id, ul_x, ul_y, pixel, greatest(x0,min_lon) AS min_x, greatest(y0,min_lat) AS min_y, least(x1,min_lon+size) AS max_x, least(y1,min_lat+size) AS max_y, min_lon AS t_min_x, min_lat AS t_min_y, min_lon+size AS t_max_x, min_lat+size AS t_max_y FROM mb JOIN footprint_texture ON greatest(x0,min_lon) < least(x1,min_lon+size) AND greatest(y0,min_lat) < least(y1,min_lat+size)),
wi AS (SELECT *, (min_x-ul_x)/pixel AS i_min_x, (max_x-ul_x)/pixel AS i_max_x, (ul_y-max_y)/pixel AS i_min_y, (ul_y-min_y)/pixel AS i_max_y FROM ov),
w AS (SELECT *, CAST(ceil(i_max_x)-floor(i_min_x)+1 AS INTEGER) AS n_x, CAST(ceil(i_max_y)-floor(i_min_y)+1 AS INTEGER) AS n_y FROM wi),
bl AS (SELECT *, least(34, n_x-b_x*33) AS size_x, least(34, n_y-b_y*33) AS size_y FROM (SELECT w.*, CAST(bx AS INTEGER) AS b_x, CAST(by_ AS INTEGER) AS b_y FROM w, generate_series(0, 3) p(bx), generate_series(0, 3) q(by_) WHERE bx < ceil((n_x-1)/33e0) AND by_ < ceil((n_y-1)/33e0))),
blocks AS (SELECT * FROM bl WHERE size_x > 1 AND size_y > 1)"""


def windows(spark, d) -> DataFrame:
    ext = raster.map_extent(headers(samples(spark, d)))
    maps = ext.select("map_id", "ul_x", "ul_y", "pixel", F.col("ul_x").alias("min_x"), F.col("lr_y").alias("min_y"), F.col("lr_x").alias("max_x"), F.col("ul_y").alias("max_y"))
    t = square(spark, d, "footprint_texture", "texture_id")
    t = t.withColumns({f"t_{s}": F.col(s) for s in boxes.SIDES})
    return raster.tile_window(boxes.box_overlap_join(maps, t, 0.1))


@query("m06_tile_window", sql("raster_sample footprint_texture", f"{_WIN} SELECT map_id, texture_id, round(i_min_x,6)+0.0 AS i_min_x, round(i_max_y,6)+0.0 AS i_max_y, n_x, n_y FROM w"))
def m06(spark, d):
    return windows(spark, d).select("map_id", "texture_id", r(F.col("i_min_x"), 6).alias("i_min_x"), r(F.col("i_max_y"), 6).alias("i_max_y"), "n_x", "n_y")


@query("m07_tile_blocks", sql("raster_sample footprint_texture", f"{_WIN} SELECT map_id, texture_id, b_x, b_y, size_x, size_y FROM blocks"))
def m07(spark, d):
    return raster.tile_blocks(windows(spark, d)).select("map_id", "texture_id", "b_x", "b_y", "size_x", "size_y")


_VERT = f"""{_WIN}, vv AS (SELECT *, b_x*33+j AS gx, b_y*33+i AS gy FROM (SELECT blocks.*, CAST(jj AS INTEGER) AS j, CAST(ii AS INTEGER) AS i FROM blocks, generate_series(0, 33) p(jj), generate_series(0, 33) q(ii) WHERE jj < size_x AND ii < size_y)),
vs AS (SELECT *, CASE WHEN gx = 0 THEN i_min_x WHEN gx = n_x-1 THEN i_max_x ELSE gx+floor(i_min_x) END AS s_x, CASE WHEN gy = 0 THEN i_min_y WHEN gy = n_y-1 THEN i_max_y ELSE gy+floor(i_min_y) END AS s_y FROM vv)"""


@query("m08_block_vertices", sql("raster_sample footprint_texture", f"{_VERT}{NB} SELECT vs.map_id, texture_id, b_x, b_y, i*size_x+j AS vertex_idx, round(ul_x+pixel*s_x,7) AS lon, round(ul_y-pixel*s_y,7) AS lat, round(CAST({_bil('(s_x-floor(s_x))', '(s_y-floor(s_y))')} AS DOUBLE),2) AS h FROM vs JOIN nb ON nb.map_id=vs.map_id AND nb.\"row\"=floor(s_y) AND nb.col=floor(s_x)"))
def m08(spark, d):
    """Samples of each block with their height."""
    v = raster.block_vertices(raster.tile_blocks(windows(spark, d))).withColumnRenamed("s_x", "x").withColumnRenamed("s_y", "y")
    h = raster.bilinear_sample(v.drop("col", "row", "h"), samples(spark, d))
    return h.select("map_id", "texture_id", "b_x", "b_y", "vertex_idx", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round(F.col("height").cast("double"), 2).alias("h"))


@query("m09_block_strip", sql("raster_sample footprint_texture", f"""{_WIN}, p AS (SELECT map_id, texture_id, b_x, b_y, size_x AS bx, CAST(k AS INTEGER) AS pos, CAST(k//(2*size_x+2) AS INTEGER) AS i, CAST(k%(2*size_x+2) AS INTEGER) AS a FROM (SELECT blocks.*, unnest(generate_series(0, 2*size_x*(size_y-1)+2*(size_y-2)-1)) AS k FROM blocks))
SELECT map_id, texture_id, b_x, b_y, pos, CASE WHEN a = 2*bx THEN (i+1)*bx+bx-1 WHEN a > 2*bx THEN (i+1)*bx WHEN a%2 = 0 THEN i*bx+a//2 ELSE (i+1)*bx+a//2 END AS vertex_idx FROM p"""))
def m09(spark, d):
    return raster.block_strip(raster.tile_blocks(windows(spark, d))).select("map_id", "texture_id", "b_x", "b_y", "pos", "vertex_idx")


@query("m10_recenter", sql("gps_point", f""", {ECEF.format(src='gps_point')}, {ENU}, c AS (SELECT path_id, (min(e)+max(e))*0.5e0 AS tx, (min(nn)+max(nn))*0.5e0 AS ty, (min(u)+max(u))*0.5e0 AS tz FROM enu GROUP BY path_id)
SELECT point_id, path_id, round(e-tx,3)+0.0 AS x, round(nn-ty,3)+0.0 AS y, round(u-tz,3)+0.0 AS z, round(tx,3)+0.0 AS tx FROM enu JOIN c USING (path_id)"""))
def m10(spark, d):
    p = view(spark, d, "gps_point").withColumn("e", geo.lla_to_enu(F.col("lon"), F.col("lat"), F.col("alt"), origin())).select("point_id", "path_id", "e.*")
    return raster.recenter(p, ["path_id"]).select("point_id", "path_id", *[r(F.col(a)).alias(a) for a in "xyz"], r(F.col("tx")).alias("tx"))


@query("m11_texture_window", sql("raster_sample footprint_texture", f"""{_WIN}, p AS (SELECT *, CAST(least(floor((min_x-t_min_x)/(t_max_x-t_min_x)*256),256) AS INTEGER) AS p0_x, CAST(least(ceil((min_y-t_min_y)/(t_max_y-t_min_y)*128),128) AS INTEGER) AS p0_y, CAST(least(floor((max_x-t_min_x)/(t_max_x-t_min_x)*256),256) AS INTEGER) AS p1_x, CAST(least(ceil((max_y-t_min_y)/(t_max_y-t_min_y)*128),128) AS INTEGER) AS p1_y FROM ov)
SELECT map_id, texture_id, p0_x, p0_y, p1_x, p1_y, CAST(least(abs(p1_x-p0_x)+1, 256-least(p0_x,p1_x)) AS INTEGER) AS w_x, CAST(least(abs(p1_y-p0_y)+1, 128-least(p0_y,p1_y)) AS INTEGER) AS w_y, CAST(128-least(p0_y,p1_y)-least(abs(p1_y-p0_y)+1, 128-least(p0_y,p1_y)) AS INTEGER) AS row0, round(p0_x/256e0*(t_max_x-t_min_x)+t_min_x,9) AS g0_x FROM p"""))
def m11(spark, d):
    w = windows(spark, d).withColumns({"b0_x": F.col("min_x"), "b0_y": F.col("min_y"), "b1_x": F.col("max_x"), "b1_y": F.col("max_y")})
    return raster.texture_window(w, 256, 128).select("map_id", "texture_id", "p0_x", "p0_y", "p1_x", "p1_y", "w_x", "w_y", "row0", F.round("g0_x", 9).alias("g0_x"))


@query("m13_overview_grid", sql("raster_sample", 'SELECT map_id, "row"//4 AS "row", col//4 AS col, round(avg(h),6)+0.0 AS h FROM raster_sample GROUP BY ALL'))
def m13(spark, d):
    return raster.overview_grid(samples(spark, d), 4).withColumn("h", r(F.col("h"), 6))


@query("j16_apply_palette", sql("raster_sample", """, pal AS (SELECT CAST(n_nationkey AS DOUBLE) AS value, n_nationkey/25e0 AS red, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey/5e0 END AS green, 0.5e0 AS blue, CAST(NULL AS DOUBLE) AS opacity FROM nation)
SELECT map_id, "row", col, floor((h+300)/24e0) AS value, round(coalesce(red,1),6) AS red, coalesce(green,1) AS green, coalesce(blue,1) AS blue, coalesce(opacity,1) AS opacity FROM raster_sample LEFT JOIN pal ON floor((h+300)/24e0) = value"""))
def j16(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    pal = n.select(k.cast("double").alias("value"), (k / 25.0).alias("red"), F.when(k % 2 == 0, F.col("n_regionkey") / 5.0).alias("green"), F.lit(0.5).alias("blue"), F.lit(None).cast("double").alias("opacity"))
    s = samples(spark, d).select("map_id", "row", "col", F.floor((F.col("h") + 300) / 24.0).cast("double").alias("value"))
    return raster.apply_palette(s, pal).withColumn("red", F.round("red", 6))


@query("w09_rle_encode", sql("pixel_run_input", """, m AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM pixel_run_input WINDOW w AS (PARTITION BY block_id ORDER BY pos)), n AS (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY pos) - 1 AS run_no FROM m),
s AS (SELECT block_id, CAST(run_no AS BIGINT) AS run_no, v, count(*) AS repeat FROM n GROUP BY ALL), p AS (SELECT block_id, min(v) AS minimum, max(v)-min(v) AS span, count(*) AS pixels FROM pixel_run_input GROUP BY ALL), b AS (SELECT *, CASE WHEN span < 255 THEN 8 WHEN span < 65535 THEN 16 ELSE 32 END AS bits FROM p),
c AS (SELECT block_id, 13 + sum(bits//8 + CASE WHEN repeat < 64 THEN 1 WHEN repeat < 16384 THEN 2 WHEN repeat < 4194304 THEN 3 ELSE 4 END) AS cost FROM s JOIN b USING (block_id) GROUP BY block_id)
SELECT s.block_id, run_no, v-minimum AS value, repeat, minimum, bits, cost < pixels*2 AS smaller FROM s JOIN b USING (block_id) JOIN c USING (block_id)"""))
def w09(spark, d):
    """Pixels of 16 bits."""
    return raster.rle_encode(view(spark, d, "pixel_run_input"), raw_bits=16)


@query("w10_rle_decode", sql("pixel_run_input", "SELECT block_id, pos, v FROM pixel_run_input"))
def w10(spark, d):
    return raster.rle_decode(raster.rle_encode(view(spark, d, "pixel_run_input")))


@query("w10_rle_bytes", sql("pixel_run_input", "SELECT block_id, pos, v FROM pixel_run_input"))
def w10b(spark, d):
    """Blocks as bytes, of runs or of all values, and back."""
    return raster.unpack_runs(raster.pack_runs(raster.rle_encode(view(spark, d, "pixel_run_input"))))


def surface(spark, d) -> DataFrame:
    """Triangles of the rasters' grids with their corners."""
    s = samples(spark, d)
    return raster.grid_surface(s, headers(s))


@query("j05_drape_points", sql("gps_point raster_sample", f"""{HEAD}, g AS (SELECT map_id, "row" AS y, col AS x, ul_x+col*pixel AS px, ul_y-"row"*pixel AS py, h FROM raster_sample JOIN hd USING (map_id)),
tri AS (SELECT a.px AS x0, a.py AS y0, a.h AS z0, b.px AS x1, b.py AS y1, b.h AS z1, d.px AS x2, d.py AS y2, d.h AS z2 FROM g a JOIN g b ON b.map_id=a.map_id AND b.y=a.y AND b.x=a.x+1 JOIN g d ON d.map_id=a.map_id AND d.y=a.y+1 AND d.x=a.x+1
 UNION ALL SELECT a.px, a.py, a.h, d.px, d.py, d.h, c.px, c.py, c.h FROM g a JOIN g d ON d.map_id=a.map_id AND d.y=a.y+1 AND d.x=a.x+1 JOIN g c ON c.map_id=a.map_id AND c.y=a.y+1 AND c.x=a.x),
hit AS (SELECT point_id, ((lat-y0)*(x2-x0)-(lon-x0)*(y2-y0))/((y1-y0)*(x2-x0)-(x1-x0)*(y2-y0)) AS u, ((lon-x0)*(y1-y0)-(lat-y0)*(x1-x0))/((y1-y0)*(x2-x0)-(x1-x0)*(y2-y0)) AS v, alt, z0, z1, z2 FROM gps_point JOIN tri ON lon >= x0 - 0.0011e0 AND lon <= x0 + 0.0011e0 AND lat <= y0 + 0.0011e0 AND lat >= y0 - 0.0011e0),
best AS (SELECT point_id, max(z0+u*(z1-z0)+v*(z2-z0)-alt) AS t FROM hit WHERE u >= 0 AND u <= 1 AND v >= 0 AND u+v <= 1 GROUP BY point_id)
SELECT point_id, round(alt+coalesce(-t,0),3)+0.0 AS draped FROM gps_point LEFT JOIN (SELECT point_id, -t AS t FROM best) USING (point_id)"""))
def j05(spark, d):
    return raster.drape(view(spark, d, "gps_point"), surface(spark, d), 0.004).select("point_id", r(F.col("draped")).alias("draped"))


_TRI2 = SQL["j05_drape_points"].split("tri AS (")[1].split("hit AS (")[0].replace("SELECT a.px AS x0", "SELECT a.map_id AS mesh_id, a.px AS x0").replace("UNION ALL SELECT a.px", "UNION ALL SELECT a.map_id, a.px")


@query("j05_drape_paths", SQL["j05_drape_points"].split("tri AS (")[0] + "tri AS (" + _TRI2 + """pt AS (SELECT point_id, path_id, CASE WHEN path_id % 7 IN (0, 2) THEN -122.3e0 - path_id*1e-4 ELSE lon END AS lon, CASE WHEN path_id % 7 IN (1, 2) THEN 37.87e0 ELSE lat END AS lat, alt FROM gps_point),
pb AS (SELECT path_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM pt GROUP BY path_id), mb AS (SELECT mesh_id, min(least(x0,x1,x2)) AS x0, max(greatest(x0,x1,x2)) AS x1, min(least(y0,y1,y2)) AS y0, max(greatest(y0,y1,y2)) AS y1 FROM tri GROUP BY mesh_id),
pr AS (SELECT path_id, mesh_id FROM pb JOIN mb ON greatest(pb.x0,mb.x0) < least(pb.x1,mb.x1) AND greatest(pb.y0,mb.y0) < least(pb.y1,mb.y1)),
hit AS (SELECT point_id, path_id, mesh_id, ((lat-y0)*(x2-x0)-(lon-x0)*(y2-y0))/((y1-y0)*(x2-x0)-(x1-x0)*(y2-y0)) AS u, ((lon-x0)*(y1-y0)-(lat-y0)*(x1-x0))/((y1-y0)*(x2-x0)-(x1-x0)*(y2-y0)) AS v, alt, z0, z1, z2 FROM pt JOIN tri ON lon >= x0 - 0.0011e0 AND lon <= x0 + 0.0011e0 AND lat <= y0 + 0.0011e0 AND lat >= y0 - 0.0011e0),
best AS (SELECT point_id, max(z0+u*(z1-z0)+v*(z2-z0)-alt) AS t FROM hit JOIN pr USING (path_id, mesh_id) WHERE u >= 0 AND u <= 1 AND v >= 0 AND u+v <= 1 GROUP BY point_id)
SELECT point_id, path_id, round(alt+coalesce(t,0),3)+0.0 AS draped FROM pt LEFT JOIN best USING (point_id)""")
def j05p(spark, d):
    """Of seven paths one runs along a meridian, one along a parallel, and one stays in one place: these lie over the maps and aren't draped."""
    kind = F.col("path_id") % 7
    p = view(spark, d, "gps_point").withColumns({"lon": F.when(kind.isin(0, 2), F.lit(-122.3) - F.col("path_id") * 1e-4).otherwise(F.col("lon")), "lat": F.when(kind.isin(1, 2), F.lit(37.87)).otherwise(F.col("lat"))})
    t = surface(spark, d).withColumnRenamed("map_id", "mesh_id").withColumns({"batch_id": F.col("mesh_id") % 2, "group_id": F.col("mesh_id") % 4})
    return raster.drape_paths(p, t, ["batch_id", "group_id", "mesh_id"], 0.004).select("point_id", "path_id", r(F.col("draped")).alias("draped"))


def surface_numbers(spark, d) -> DataFrame:
    """Triangles with a number: map, then cell, then half."""
    return surface(spark, d).withColumn("triangle", (F.col("map_id") * 4096 + F.col("y") * 64 + F.col("x")) * 2 + F.col("half"))


@query("o01_topmost_hit", SQL["j05_drape_points"].split("tri AS (")[0] + """tri AS (SELECT (a.map_id*4096+a.y*64+a.x)*2 AS triangle, a.px AS x0, a.py AS y0, a.h AS z0, b.px AS x1, b.py AS y1, b.h AS z1, d.px AS x2, d.py AS y2, d.h AS z2 FROM g a JOIN g b ON b.map_id=a.map_id AND b.y=a.y AND b.x=a.x+1 JOIN g d ON d.map_id=a.map_id AND d.y=a.y+1 AND d.x=a.x+1
 UNION ALL SELECT (a.map_id*4096+a.y*64+a.x)*2+1, a.px, a.py, a.h, d.px, d.py, d.h, c.px, c.py, c.h FROM g a JOIN g d ON d.map_id=a.map_id AND d.y=a.y+1 AND d.x=a.x+1 JOIN g c ON c.map_id=a.map_id AND c.y=a.y+1 AND c.x=a.x),
hit AS (SELECT point_id, triangle, ((lat-y0)*(x2-x0)-(lon-x0)*(y2-y0))/((y1-y0)*(x2-x0)-(x1-x0)*(y2-y0)) AS u, ((lon-x0)*(y1-y0)-(lat-y0)*(x1-x0))/((y1-y0)*(x2-x0)-(x1-x0)*(y2-y0)) AS v, alt, z0, z1, z2 FROM gps_point JOIN tri ON lon >= x0 - 0.0011e0 AND lon <= x0 + 0.0011e0 AND lat <= y0 + 0.0011e0 AND lat >= y0 - 0.0011e0),
k AS (SELECT *, z0+u*(z1-z0)+v*(z2-z0)-alt AS t FROM hit WHERE u >= 0 AND u <= 1 AND v >= 0 AND u+v <= 1), o AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY t DESC, triangle) AS n FROM k)
SELECT point_id, triangle, round(t,3)+0.0 AS t FROM o WHERE n = 1""")
def o01(spark, d):
    """The highest triangle over each point."""
    hits = raster.ray_hits(view(spark, d, "gps_point"), surface_numbers(spark, d), 0.001)
    return raster.topmost_hit(hits, "triangle").select("point_id", "triangle", r(F.col("t")).alias("t"))


@query("m12_globe_vertices", sql("gps_point_raw", "SELECT CAST(CASE WHEN lat = 90 THEN 0 WHEN lat = -90 THEN 64620 ELSE 1 + (89-lat)*361 + lon+180 END AS BIGINT) AS vertex_idx, count(*) AS points FROM gps_point_raw WHERE abs(lon) <= 180 AND abs(lat) <= 90 GROUP BY ALL"))
def m12(spark, d):
    """Points counted at the vertices of the 1 degree globe, whose vertex numbers come from the globe's grid."""
    from geoloom.operators.mesh import globe_vertices

    p = view(spark, d, "gps_point_raw").where(geo.valid_gps(F.col("lon"), F.col("lat")))
    pole = F.abs("lat") == 90
    at = p.select(F.col("lat").cast("int").alias("lat"), F.when(pole, 0).otherwise(F.col("lon").cast("int")).alias("lon"))
    return at.join(globe_vertices(spark).select("lat", "lon", "vertex_idx"), ["lat", "lon"]).groupBy("vertex_idx").agg(F.count("*").alias("points"))


@query("m12_globe_triangles", sql("gps_point_raw", """, p AS (SELECT DISTINCT CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon FROM gps_point_raw WHERE lat < 89 AND lat > -89 AND lon >= -180 AND lon < 180),
v AS (SELECT lat, lon, 1 + (89-lat)*361 + lon+180 AS a FROM p)
SELECT lat, lon, k AS half, a AS v0, CASE WHEN k = 0 THEN a+361 ELSE a+362 END AS v1, CASE WHEN k = 0 THEN a+362 ELSE a+1 END AS v2, round((lon+180)/360e0, 6) AS u, round((90-lat)/180e0, 6) AS v FROM v, generate_series(0, 1) g(k)"""))
def m12t(spark, d):
    """The globe's two triangles at each point's degree, with the uv of their first corner."""
    from geoloom.operators.mesh import globe_triangles, globe_vertices

    p = view(spark, d, "gps_point_raw").where("lat < 89 and lat > -89 and lon >= -180 and lon < 180").select(F.col("lat").cast("bigint").alias("lat"), F.col("lon").cast("bigint").alias("lon")).distinct()
    v = globe_vertices(spark).select(F.col("lat").cast("bigint").alias("lat"), F.col("lon").cast("bigint").alias("lon"), F.col("vertex_idx").alias("v0"), F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))
    t = globe_triangles(spark).where("v0 > 0 and v0 < 64620")
    half = (F.col("v2") == F.col("v0") + 1).cast("bigint")
    return p.join(v, ["lat", "lon"]).join(t, "v0").select("lat", "lon", half.alias("half"), "v0", "v1", "v2", "u", "v")
