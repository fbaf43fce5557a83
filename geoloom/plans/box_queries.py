"""Queries over boxes and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import boxes
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


GPS = {"lon": "lon", "lat": "lat", "alt": "alt"}
CELL = 0.1


def square(spark: SparkSession, d: str, name: str, key: str, *more) -> DataFrame:
    v = view(spark, d, name)
    return v.select(key, *more, F.col("min_lon").alias("min_x"), F.col("min_lat").alias("min_y"), (F.col("min_lon") + F.col("size")).alias("max_x"), (F.col("min_lat") + F.col("size")).alias("max_y"))


_box = lambda axes: ", ".join(f"{f}({c}) AS {f}_{a}" for a, c in axes.items() for f in ("min", "max"))


@query("a01_bbox", sql("gps_point", f"SELECT path_id, {_box(GPS)} FROM gps_point GROUP BY path_id"))
def a01(spark, d):
    return boxes.bbox(view(spark, d, "gps_point"), ["path_id"], GPS)


@query("flagship_path_boxes", sql("gps_point", f""", {ECEF.format(src='gps_point')}, {ENU}
SELECT path_id % 7 AS batch_id, path_id % 49 AS group_id, path_id, round(min(e),3)+0.0 AS min_x, round(max(e),3)+0.0 AS max_x, round(min(nn),3)+0.0 AS min_y, round(max(nn),3)+0.0 AS max_y, round(min(u),3)+0.0 AS min_z, round(max(u),3)+0.0 AS max_z,
  CAST(grouping(path_id % 7, path_id % 49, path_id) AS INTEGER) AS level FROM enu GROUP BY ROLLUP (path_id % 7, path_id % 49, path_id)"""))
def flagship(spark, d):
    """GPS points, checked, in the local frame, to boxes of paths, groups, batches and all."""
    p = view(spark, d, "gps_point").where(geo.valid_gps(F.col("lon"), F.col("lat"))).withColumn("e", geo.lla_to_enu(F.col("lon"), F.col("lat"), F.col("alt"), origin()))
    p = p.select((F.col("path_id") % 7).alias("batch_id"), (F.col("path_id") % 49).alias("group_id"), "path_id", F.col("e.x").alias("x"), F.col("e.y").alias("y"), F.col("e.z").alias("z"))
    out = boxes.bbox_rollup(p, ["batch_id", "group_id", "path_id"], {a: a for a in "xyz"})
    return out.select("batch_id", "group_id", "path_id", *[r(F.col(f"{f}_{a}")).alias(f"{f}_{a}") for a in "xyz" for f in ("min", "max")], "level")


@query("a02_bbox_rollup", sql("gps_point", f"SELECT path_id % 7 AS batch_id, path_id % 49 AS group_id, path_id, {_box(GPS)}, CAST(grouping(path_id % 7, path_id % 49, path_id) AS INTEGER) AS level FROM gps_point GROUP BY ROLLUP (path_id % 7, path_id % 49, path_id)"))
def a02(spark, d):
    p = view(spark, d, "gps_point").withColumn("batch_id", F.col("path_id") % 7).withColumn("group_id", F.col("path_id") % 49)
    return boxes.bbox_rollup(p, ["batch_id", "group_id", "path_id"], GPS)


@query("u01_union_batches", sql("gps_point footprint_map", f", u AS (SELECT 'paths' AS batch, lon, lat, alt FROM gps_point UNION ALL SELECT 'maps', min_lon, min_lat, size FROM footprint_map) SELECT batch, {_box(GPS)}, CAST(grouping(batch) AS INTEGER) AS level FROM u GROUP BY ROLLUP (batch)"))
def u01(spark, d):
    """A new batch is appended to the world and the boxes merge."""
    a = view(spark, d, "gps_point").select(F.lit("paths").alias("batch"), "lon", "lat", "alt")
    b = view(spark, d, "footprint_map").select(F.lit("maps").alias("batch"), F.col("min_lon").alias("lon"), F.col("min_lat").alias("lat"), F.col("size").alias("alt"))
    return boxes.union_batches(a, b, "batch", GPS)[1]


_PATH3 = "SELECT path_id, min(lon) AS min_x, max(lon) AS max_x, min(lat) AS min_y, max(lat) AS max_y, min(alt) AS min_z, max(alt) AS max_z FROM gps_point GROUP BY path_id"


def path_boxes(spark, d):
    return boxes.bbox(view(spark, d, "gps_point"), ["path_id"], {"x": "lon", "y": "lat", "z": "alt"})


@query("g18_box_measures", sql("gps_point", f""", b AS ({_PATH3})
SELECT path_id, round((min_x+max_x)*0.5e0,6) AS centre_x, round((min_y+max_y)*0.5e0,6) AS centre_y, round((min_z+max_z)*0.5e0,6) AS centre_z, round(sqrt((max_x-min_x)*(max_x-min_x)+(max_y-min_y)*(max_y-min_y)+(max_z-min_z)*(max_z-min_z)),6) AS diagonal,
 round(0.5e0*sqrt((max_x-min_x)*(max_x-min_x)+(max_y-min_y)*(max_y-min_y)+(max_z-min_z)*(max_z-min_z)),6) AS radius, CASE WHEN max_x-min_x >= greatest(max_y-min_y,max_z-min_z) THEN 0 WHEN max_y-min_y >= max_z-min_z THEN 1 ELSE 2 END AS longest, round((max_x-min_x)*(max_y-min_y)*(max_z-min_z),6) AS content FROM b"""))
def g18(spark, d):
    m = boxes.box_measures(3)
    return path_boxes(spark, d).select("path_id", *[(v if k == "longest" else F.round(v, 6)).alias(k) for k, v in m.items()])


@query("g19_box_algebra", sql("gps_point", f""", b AS ({_PATH3}), p AS (SELECT a.path_id, a.min_x AS ax0, a.max_x AS ax1, a.min_y AS ay0, a.max_y AS ay1, c.min_x AS bx0, c.max_x AS bx1, c.min_y AS by0, c.max_y AS by1 FROM b a JOIN b c ON c.path_id = a.path_id + 1)
SELECT path_id, CASE WHEN greatest(ax0,bx0) < least(ax1,bx1) AND greatest(ay0,by0) < least(ay1,by1) THEN greatest(ax0,bx0) END AS cut_x, CASE WHEN greatest(ax0,bx0) < least(ax1,bx1) AND greatest(ay0,by0) < least(ay1,by1) THEN least(ay1,by1) END AS cut_y, least(ax0,bx0) AS all_x, greatest(ay1,by1) AS all_y, (ax0=bx0 AND ax1=bx1 AND ay0=by0 AND ay1=by1) AS same FROM p"""))
def g19(spark, d):
    """Intersection (null if empty), union and equality of neighbouring paths' boxes."""
    p = path_boxes(spark, d)
    a = p.select("path_id", *[F.col(s).alias(s + "_a") for s in boxes.SIDES])
    b = p.select((F.col("path_id") - 1).alias("path_id"), *[F.col(s).alias(s + "_b") for s in boxes.SIDES])
    cut = boxes.intersection("_a", "_b")
    same = F.lit(True)
    for s in boxes.SIDES:
        same = same & (F.col(s + "_a") == F.col(s + "_b"))
    return a.join(b, "path_id").select("path_id", F.when(cut["overlaps"], cut["min_x"]).alias("cut_x"), F.when(cut["overlaps"], cut["max_y"]).alias("cut_y"), F.least("min_x_a", "min_x_b").alias("all_x"), F.greatest("max_y_a", "max_y_b").alias("all_y"), same.alias("same"))


_MT = """, m AS (SELECT map_id, min_lon AS x0, min_lat AS y0, min_lon+size AS x1, min_lat+size AS y1 FROM footprint_map),
t AS (SELECT texture_id, min_lon AS x0, min_lat AS y0, min_lon+size AS x1, min_lat+size AS y1 FROM footprint_texture)"""
_OVER = "greatest(m.x0,t.x0) < least(m.x1,t.x1) AND greatest(m.y0,t.y0) < least(m.y1,t.y1)"


@query("j01_box_overlap_join", sql("footprint_map footprint_texture", f"{_MT} SELECT map_id, texture_id, greatest(m.x0,t.x0) AS min_x, greatest(m.y0,t.y0) AS min_y, least(m.x1,t.x1) AS max_x, least(m.y1,t.y1) AS max_y FROM m JOIN t ON {_OVER}"))
def j01(spark, d):
    return boxes.box_overlap_join(square(spark, d, "footprint_map", "map_id"), square(spark, d, "footprint_texture", "texture_id"), CELL)


@query("j02_patch_overlap_index", sql("footprint_map footprint_texture", f"""{_MT}, tm AS (SELECT texture_id, list_sort(list(map_id)) AS maps FROM t JOIN m ON {_OVER} GROUP BY texture_id),
tt AS (SELECT m.texture_id, list_sort(list(t.texture_id)) AS textures FROM t m JOIN t ON {_OVER} GROUP BY m.texture_id)
SELECT t.texture_id AS patch_id, array_to_string(maps, ',') AS maps, array_to_string(textures, ',') AS textures FROM t LEFT JOIN tm USING (texture_id) LEFT JOIN tt USING (texture_id)"""))
def j02(spark, d):
    maps, textures = square(spark, d, "footprint_map", "map_id"), square(spark, d, "footprint_texture", "texture_id")
    return boxes.patch_overlap_index(textures.withColumnRenamed("texture_id", "patch_id"), "patch_id", {"maps": (maps, "map_id"), "textures": (textures, "texture_id")}, CELL, ",")


@query("j03_scissor_maps", sql("footprint_map footprint_texture", f"{_MT} SELECT map_id, greatest(x0,-122.2e0) AS min_x, greatest(y0,37.2e0) AS min_y, least(x1,-121.7e0) AS max_x, least(y1,37.8e0) AS max_y FROM m WHERE greatest(x0,-122.2e0) < least(x1,-121.7e0) AND greatest(y0,37.2e0) < least(y1,37.8e0)"))
def j03(spark, d):
    return boxes.scissor(square(spark, d, "footprint_map", "map_id"), (-122.2, 37.2, -121.7, 37.8))


@query("j04_prune_candidates", sql("gps_point footprint_map footprint_texture", f"""{_MT}, m2 AS (SELECT ts AS batch_id, 0 AS z FROM (SELECT 0 AS ts)), p AS (SELECT path_id, CAST(floor(point_id/5) AS BIGINT) AS seg, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM gps_point GROUP BY ALL),
m3 AS (SELECT path_id*100000+seg AS path_id, x0, y0, x1, y1 FROM p) SELECT m.path_id, t.texture_id % 5 AS batch_id, t.texture_id % 25 AS group_id, t.texture_id AS mesh_id FROM m3 m JOIN t ON {_OVER}"""))
def j04(spark, d):
    p = view(spark, d, "gps_point").withColumn("path_id", F.col("path_id") * 100000 + F.floor(F.col("point_id") / 5))
    paths = boxes.bbox(p, ["path_id"], {"x": "lon", "y": "lat"})
    t = square(spark, d, "footprint_texture", "texture_id")
    meshes = t.select((F.col("texture_id") % 5).alias("batch_id"), (F.col("texture_id") % 25).alias("group_id"), F.col("texture_id").alias("mesh_id"), *boxes.SIDES)
    return boxes.prune_candidates(paths, meshes, ["batch_id", "group_id", "mesh_id"], CELL)


_DUP = """SELECT a.mesh_id, b.mesh_id AS earlier_id FROM mesh_box a JOIN mesh_box b ON a.n_vertex = b.n_vertex AND a.n_index = b.n_index AND a.file_no > b.file_no
 AND abs(a.x0-b.x0) < 1 AND abs(a.y0-b.y0) < 1
 AND CAST((least(a.x0,b.x0)+1-greatest(a.x0,b.x0))*(least(a.y0,b.y0)+1-greatest(a.y0,b.y0)) AS FLOAT) > CAST(0.8 AS FLOAT)"""


@query("j07_near_duplicate_pairs", sql("mesh_box", _DUP))
def j07(spark, d):
    return boxes.near_duplicate_pairs(view(spark, d, "mesh_box"))


@query("j08_dedup_meshes")
def j08(spark, d):
    m = view(spark, d, "mesh_box")
    return boxes.dedup_meshes(m, boxes.near_duplicate_pairs(m)).select("mesh_id", "file_no")


_M8 = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 0.001, 0.5, 122.0, -37.5, 0, 1.0]
_w = lambda z: f"(({z})*0.5e0+1)"
_cx = [f"(({x})+122)/nullif({_w(z)},0)" for x in ("min_x", "max_x") for z in ("min_z", "max_z")]
_cy = [f"(({y})-37.5e0)/nullif({_w(z)},0)" for y in ("min_y", "max_y") for z in ("min_z", "max_z")]
_cz = [f"({z})*0.001e0/nullif({_w(z)},0)" for z in ("min_z", "max_z")]
_lo = lambda e: "least(" + ", ".join(f"coalesce({x},0)" for x in e) + ")"
_hi = lambda e: "greatest(" + ", ".join(f"coalesce({x},0)" for x in e) + ")"


@query("f08_visible_boxes", sql("gps_point", f""", b AS ({_PATH3}), p AS (SELECT path_id, {_lo(_cx)} AS lo_x, {_hi(_cx)} AS hi_x, {_lo(_cy)} AS lo_y, {_hi(_cy)} AS hi_y, {_lo(_cz)} AS lo_z, {_hi(_cz)} AS hi_z FROM b)
SELECT path_id, round(lo_x,6)+0.0 AS lo_x, round(hi_y,6)+0.0 AS hi_y FROM p WHERE lo_x < 1 AND hi_x > -1 AND lo_y < 1 AND hi_y > -1 AND lo_z < 1 AND hi_z > 0"""))
def f08(spark, d):
    return boxes.visible(path_boxes(spark, d), _M8).select("path_id", r(F.col("lo_x"), 6).alias("lo_x"), r(F.col("hi_y"), 6).alias("hi_y"))
