"""Meshes: strips, compaction, numbering, globe, placement, export."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators.links import spread_join
from geoloom.storage import job, materialize, numbered, result

TRIANGLES, STRIP = 4, 5
#: Rows of one batch or group that a task meets.
AT_ONCE = 500_000


def globe_vertices(spark: SparkSession) -> DataFrame:
    """The 1 degree globe: a north pole, 179 rings of 361 vertices, a south pole; lat, lon, position on the ellipsoid and uv."""
    n = 2 + 179 * 361
    k = F.col("id") - 1
    pole = (F.col("id") == 0) | (F.col("id") == n - 1)
    lat = F.when(F.col("id") == 0, 90).when(F.col("id") == n - 1, -90).otherwise(89 - F.floor(k / 361)).cast("int")
    lon = F.when(pole, 0).otherwise(k % 361 - 180).cast("int")
    g = spark.range(n).select(F.col("id").alias("vertex_idx"), lat.alias("lat"), lon.alias("lon"))
    p = geo.cartesian_position(F.col("lat").cast("double"), F.col("lon").cast("double"), F.lit(0.0), sphere=False)
    return g.withColumn("p", p).select("vertex_idx", "lat", "lon", "p.*", ((F.col("lon") + 180) / 360).alias("u"), ((90 - F.col("lat")) / 180).alias("v"))


def globe_triangles(spark: SparkSession) -> DataFrame:
    """128,880 triangles: a fan at each pole, two triangles a cell between the rings."""
    last = 1 + 179 * 361
    caps = spark.range(360).select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("v0"), (F.col("id") + 1).alias("v1"), (F.col("id") + 2).alias("v2")), F.struct(F.lit(last).cast("bigint").alias("v0"), (F.lit(1 + 178 * 361) + F.col("id") + 1).alias("v1"), (F.lit(1 + 178 * 361) + F.col("id")).alias("v2")))).alias("t"))
    a = 1 + F.floor(F.col("id") / 360) * 361 + F.col("id") % 360
    body = spark.range(178 * 360).select(F.explode(F.array(F.struct(a.alias("v0"), (a + 361).alias("v1"), (a + 362).alias("v2")), F.struct(a.alias("v0"), (a + 362).alias("v1"), (a + 1).alias("v2")))).alias("t"))
    return caps.union(body).select("t.*")


def strip_to_triangles(strips: DataFrame, keys: list[str]) -> DataFrame:
    """Triangles of strips (pos, vertex_idx): each run of three, odd ones with the first two swapped; degenerate ones are left out but still turn the winding."""
    w = W.partitionBy(*keys).orderBy("pos")
    t = strips.select(*keys, F.lag("vertex_idx", 2).over(w).alias("_a"), F.lag("vertex_idx", 1).over(w).alias("_b"), F.col("vertex_idx").alias("_c"), (F.row_number().over(w) - 3).alias("_k")).where("_k >= 0")
    t = t.where("_a <> _b and _b <> _c and _a <> _c")
    odd = F.col("_k") % 2 == 1
    return t.select(*keys, F.col("_k").cast("bigint").alias("triangle"), F.when(odd, F.col("_b")).otherwise(F.col("_a")).alias("v0"), F.when(odd, F.col("_a")).otherwise(F.col("_b")).alias("v1"), F.col("_c").alias("v2"))


def dealt(df: DataFrame, rows: int | None = None) -> int:
    """Tasks that meet about AT_ONCE of the rows each, at least one a core. ``rows``, if known, spares counting."""
    rows = df.count() if rows is None else rows
    return max(-(-rows // AT_ONCE), df.sparkSession.sparkContext.defaultParallelism)


def compact_vertices(index: DataFrame, n_vertex: DataFrame, keys: list[str], triangles: bool = True, rows: int | None = None) -> DataFrame:
    """Renumber the referenced vertices in range by first use: pos, vertex_idx, new_idx.

    A triangle with an index out of range goes as a whole; strips lose the index only.
    No index (null) is out of range. Rows are few bytes in a shuffle and many in a sort,
    so each step deals them by their number (``rows``, if known), not by the bytes.
    """
    n = dealt(index, rows)
    inside = (F.col("vertex_idx") >= 0) & (F.col("vertex_idx") < F.col("n_vertex"))
    i = index.join(n_vertex.repartition(n, *keys), keys).select(*keys, "pos", "vertex_idx", F.coalesce(inside, F.lit(False)).alias("ok"))
    if triangles:
        i = i.withColumn("_triangle", F.floor(F.col("pos") / 3)).repartition(n, *keys, "_triangle")
        i = i.withColumn("ok", F.min("ok").over(W.partitionBy(*keys, "_triangle")))
    # the join asks for keys that aren't null: said here, both of its sides read one shuffle
    i = i.where("ok and vertex_idx is not null").select(*keys, "pos", "vertex_idx").repartition(n, *keys, "vertex_idx")
    first = i.groupBy(*keys, "vertex_idx").agg(F.min("pos").alias("first")).repartition(n, *keys)
    number = first.select(*keys, "vertex_idx", (F.row_number().over(W.partitionBy(*keys).orderBy("first")) - 1).cast("bigint").alias("new_idx"))
    return i.join(number, [*keys, "vertex_idx"]).select(*keys, "pos", "vertex_idx", "new_idx")


def mesh_numbers(meshes: DataFrame, stem: Column) -> DataFrame:
    """Group number in the batch, mesh number in the group, and the export names.

    All meshes are numbered in one order, by ranges; a mesh's number in its group is
    what it is beyond the group's first, and a group's in its batch likewise. So no
    task holds a whole batch or group. Meshes of one group with one identifier may take
    either number. Null keys are keys like others, ordered first.
    """
    with job(meshes.sparkSession):
        # keys as structs, which are equal where both are null
        n = meshes.withColumns({"_batch": F.struct("batch_id"), "_group": F.struct("batch_id", "group_id"), "_at": F.struct("batch_id", "group_id", "mesh_id")})
        n = materialize(numbered(n, "_at").withColumnRenamed("number", "_number").drop("_at"), "numbered")
        groups = materialize(n.groupBy("_batch", "_group").agg(F.min("_number").alias("_first"), F.count("*").alias("n")), "groups")
        ordered = materialize(numbered(groups, "_group"), "ordered")
        batches = ordered.groupBy("_batch").agg(F.min("number").alias("_start"), F.count("*").alias("n"))
        placed = spread_join(ordered.drop("n"), batches.drop("n"), ["_batch"], "_group", AT_ONCE, counts=batches.select("_batch", "n"))
        placed = placed.select("_group", "_first", (F.col("number") - F.col("_start")).alias("g"))
        out = spread_join(n, placed, ["_group"], "mesh_id", AT_ONCE, counts=groups.select("_group", "n"))
        out = out.withColumn("m", F.col("_number") - F.col("_first")).select(*meshes.columns, "g", "m")
        out = out.withColumn("mesh_name", F.concat(stem, F.lit("_meshNode_"), "g", F.lit("_"), "m")).withColumn("material_name", F.concat(F.lit("material_"), "g", F.lit("_"), "m"))
        return result(out, "mesh-numbers")


def with_triangles(meshes: DataFrame, draws: DataFrame) -> DataFrame:
    """Meshes that have a triangle draw call."""
    return meshes.join(draws.where(F.col("primitive") == TRIANGLES).select("mesh_id"), "mesh_id", "left_semi")


def used_textures(textures: DataFrame, meshes: DataFrame, unused: bool = False) -> DataFrame:
    """Textures that a mesh of their group uses, or those that none does."""
    return textures.join(meshes.select("group_id", "texture_id"), ["group_id", "texture_id"], "left_anti" if unused else "left_semi")


def bind_textures(meshes: DataFrame, textures: DataFrame) -> DataFrame:
    """Texture of each mesh by its index in the group's list; an index out of range has none."""
    number = textures.withColumn("texture_idx", F.row_number().over(W.partitionBy("group_id").orderBy("texture_id")) - 1)
    return meshes.join(number, ["group_id", "texture_idx"], "left")


def export_item_count(meshes: DataFrame) -> DataFrame:
    """Groups, and textures of capture groups, per batch."""
    per = meshes.groupBy("batch_id").agg(F.countDistinct("group_id").alias("groups"), F.countDistinct(F.when(F.col("is_capture"), F.struct("group_id", "texture_id"))).alias("textures"))
    return per.withColumn("items", F.col("groups") + F.col("textures"))


def export_names(meshes: DataFrame, stem: Column) -> DataFrame:
    """Node, mesh, material and texture names of meshes (batch_id, group_id, mesh_id, texture_idx), numbered within their batch and group."""
    n = mesh_numbers(meshes, stem)
    texture = F.when(F.col("texture_idx").isNotNull(), F.concat(F.lit("texture_"), "g", F.lit("_"), F.col("texture_idx").cast("string")))
    return n.withColumn("node_name", F.col("mesh_name")).withColumn("texture_name", texture)


def write_mesh_tables(vertices: DataFrame, triangles: DataFrame, meshes: DataFrame, path: str, stem: Column) -> None:
    """The export set of the meshes that are no splines: tables ``vertices`` (absolute, with uv), ``triangles`` and ``meshes`` (names), partitioned by batch and group."""
    keys = ["batch_id", "group_id", "mesh_id"]
    m = export_names(meshes, stem).where("not is_spline")
    moved = vertices.join(m.select(*keys, "tx", "ty", "tz"), keys).withColumns({a: F.col(a) + F.col(f"t{a}") for a in "xyz"})
    tables = {"vertices": moved.select(*keys, "vertex_idx", "x", "y", "z", "u", "v"), "triangles": triangles.join(m.select(*keys), keys), "meshes": m.drop("tx", "ty", "tz", "is_spline", "g", "m")}
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("batch_id", "group_id").parquet(f"{path}/{name}")


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1; null vectors stay."""
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(size > 0, size, 1.0)


def turn(axis: np.ndarray, angle: float) -> np.ndarray:
    """Rotation about a unit axis, for row vectors."""
    x, y, z = axis
    k = np.array([[0, z, -y], [-z, 0, x], [y, -x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def rigid_transform(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Row-vector 4x4 that takes three source points to three targets: move to the centroid, turn the normal, turn in the plane, scale, move.

    Scale is the ratio of the mean distances from the centroids. A normal is the sum
    of the unit normals of successive points, weighted by the angle between their
    directions (taken as at most a right one). Turns come from sines, so they reach a
    right angle; the one in the plane is the mean of the three points'. Fewer points,
    or points in one place, give the identity; parallel normals aren't turned.
    """
    if len(src) < 3 or len(dst) < 3:
        return np.eye(4)
    src, dst = src[:3], dst[:3]
    cs, cd = src.mean(axis=0), dst.mean(axis=0)
    a, b = src - cs, dst - cd
    spread = np.linalg.norm(a, axis=1).mean()
    if spread == 0:
        return np.eye(4)
    scale = np.linalg.norm(b, axis=1).mean() / spread

    def normal(v: np.ndarray) -> np.ndarray:
        u, w = unit(v), unit(np.roll(v, -1, axis=0))
        weight = np.arccos(np.clip(np.abs((u * w).sum(axis=1)), 0, 1))
        return unit((unit(np.cross(u, w)) * weight[:, None]).sum(axis=0))

    na, nb = normal(a), normal(b)
    axis = np.cross(na, nb)
    sine = np.linalg.norm(axis)
    level = turn(axis / sine, np.arcsin(min(sine, 1.0))) if sine > 1e-12 else np.eye(3)
    p, q = unit(np.cross(nb, unit(a @ level))), unit(np.cross(nb, unit(b)))
    cross = np.cross(p, q)
    angles = np.arcsin(np.clip(np.linalg.norm(cross, axis=1), 0, 1)) * np.where(cross @ nb < 0, -1, 1)
    out = np.eye(4)
    out[:3, :3] = level @ turn(nb, angles.mean()) * scale
    out[3, :3] = cd - cs @ out[:3, :3]
    return out


def fit_rigid(pairs: DataFrame) -> DataFrame:
    """A similarity transform per dump from its first three point pairs (k, sx, sy, sz, tx, ty, tz); fewer give the identity. Groups hold a few rows each."""
    first = pairs.withColumn("_k", F.row_number().over(W.partitionBy("dump_id").orderBy("k"))).where("_k <= 3").drop("_k")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        m = rigid_transform(g[["sx", "sy", "sz"]].to_numpy(), g[["tx", "ty", "tz"]].to_numpy())
        return pd.DataFrame({"dump_id": [g["dump_id"].iloc[0]], "matrix": [m.reshape(-1).tolist()]})

    return first.groupBy("dump_id").applyInPandas(fit, "dump_id bigint, matrix array<double>")


def georeference(vertices: DataFrame, transforms: DataFrame, origin: tuple[Column, Column, Column]) -> DataFrame:
    """Vertices (dump_id, x, y, z) through their dump's matrix to sphere GPS and to the local frame: lon, lat, alt, east, north, up."""
    v = vertices.join(transforms, "dump_id").withColumn("w", geo.transform_point(F.col("x"), F.col("y"), F.col("z"), F.col("matrix")))
    v = v.withColumn("g", geo.cartesian_to_gps_sphere(F.col("w.x"), F.col("w.y"), F.col("w.z")))
    v = v.withColumn("e", geo.lla_to_enu(F.col("g.lon"), F.col("g.lat"), F.col("g.alt"), origin))
    return v.select(*vertices.columns, "g.lon", "g.lat", "g.alt", F.col("e.x").alias("east"), F.col("e.y").alias("north"), F.col("e.z").alias("up"))


def place_meshes(vertices: DataFrame, transforms: DataFrame, origin: tuple[Column, Column, Column]) -> tuple[DataFrame, DataFrame]:
    """Meshes (dump_id, mesh_id, vertex_idx, x, y, z) in the local frame, and their boxes.

    Vertices of dumps with a transform are georeferenced, moved to their mesh's box
    centre, which is kept as tx, ty, tz, and have lon, lat and alt; the others stay as
    they are and have none. Boxes are in the local frame, and in lon, lat and alt.
    """
    placed = georeference(vertices, transforms, origin).select("dump_id", "mesh_id", "vertex_idx", F.col("east").alias("x"), F.col("north").alias("y"), F.col("up").alias("z"), "lon", "lat", "alt")
    loose = vertices.join(transforms, "dump_id", "left_anti").select("dump_id", "mesh_id", "vertex_idx", "x", "y", "z", *[F.lit(None).cast("double").alias(c) for c in ("lon", "lat", "alt")])
    all_ = placed.union(loose)
    axes = [*"xyz", "lon", "lat", "alt"]
    box = all_.groupBy("dump_id", "mesh_id").agg(*[f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))])
    centre = {f"t{a}": F.when(F.col("min_lon").isNull(), 0.0).otherwise((F.col(f"min_{a}") + F.col(f"max_{a}")) * 0.5) for a in "xyz"}
    moved = all_.join(box.withColumns(centre).select("dump_id", "mesh_id", *centre), ["dump_id", "mesh_id"]).withColumns({a: F.col(a) - F.col(f"t{a}") for a in "xyz"})
    return moved, box
