"""Closed forms, round trips, brute force and boundary cases."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, text
from geoloom.operators import boxes, capture, lookup, mesh, raster
from geoloom.sources import files

SQUARE = "min_x double, min_y double, max_x double, max_y double"


def test_utm_known_point(spark):
    """Zone 10, central meridian: x is the false easting."""
    r = spark.range(1).select(geo.utm_forward(F.lit(45.0), F.lit(-123.0), F.lit(10.0)).alias("u")).first()["u"]
    assert r["x"] == pytest.approx(500000, abs=1e-3) and r["y"] == pytest.approx(4982950.4, abs=1)


def test_ecef_poles_equator_and_range(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 90.0, 0.0), (200.0, 0.0, 0.0)], "lon double, lat double, alt double")
    rows = [r["e"] for r in df.select(geo.lla_to_ecef(F.col("lon"), F.col("lat"), F.col("alt")).alias("e")).collect()]
    assert rows[0]["x"] == geo.A and rows[1]["z"] == pytest.approx(6356752.314, abs=1e-3) and rows[2] is None
    flat = spark.range(1).select(geo.cartesian_to_gps_sphere(F.lit(geo.A), F.lit(0.0), F.lit(0.0)).alias("g")).first()["g"]
    assert flat["alt"] is None


def test_geotransform_singular(spark):
    g = spark.range(1).select(geo.invert_geotransform(F.array(*[F.lit(0.0)] * 6)).alias("g")).first()["g"]
    assert g is None


def test_touching_and_flat_boxes_do_not_overlap(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 5.0, 9.0)], "a int, " + SQUARE)
    b = spark.createDataFrame([(1, 1.0, 0.0, 2.0, 1.0), (2, 0.5, 0.5, 3.0, 3.0), (3, 4.0, 4.0, 6.0, 10.0)], "b int, " + SQUARE)
    assert [(r["a"], r["b"]) for r in boxes.box_overlap_join(a, b, 0.4).collect()] == [(1, 2)]


def test_box_join_has_no_nested_loop(spark, sf):
    from geoloom.plans import box_queries, raster_queries

    for q in (box_queries.j01, box_queries.j07, raster_queries.j05):
        plan = q(spark, sf)._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_box_join_against_nested_loop(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(k, *(float(v) for v in (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(np.c_[rng.uniform(-3, 3, (n, 2)), rng.choice([0.0, 0.1, 0.7, 2.0], (n, 2))])]
    a, b = make(60), make(60)
    want = {(p[0], q[0]) for p in a for q in b if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])}
    got = [(r["a"], r["b"]) for r in boxes.box_overlap_join(spark.createDataFrame(a, "a int, " + SQUARE), spark.createDataFrame(b, "b int, " + SQUARE), 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def greedy(meshes, pairs):
    kept = set()
    earlier = {}
    for m, e in pairs:
        earlier.setdefault(m, []).append(e)
    for m, _ in sorted(meshes, key=lambda x: (x[1], x[0])):
        if not any(e in kept for e in earlier.get(m, ())):
            kept.add(m)
    return kept


def test_dedup_chain_keeps_both_ends(spark):
    m = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "mesh_id bigint, file_no int")
    p = spark.createDataFrame([(2, 1), (3, 2)], "mesh_id bigint, earlier_id bigint")
    assert {r["mesh_id"] for r in boxes.dedup_meshes(m, p).collect()} == {1, 3}


def test_dedup_against_greedy(spark, sf):
    from geoloom.plans.fixtures import view

    m = view(spark, sf, "mesh_box")
    pairs = boxes.near_duplicate_pairs(m)
    want = greedy([(r["mesh_id"], r["file_no"]) for r in m.collect()], [tuple(r) for r in pairs.collect()])
    assert {r["mesh_id"] for r in boxes.dedup_meshes(m, pairs).collect()} == want


def test_drape_edges_and_flat_triangles(spark):
    tri = [(0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0), (0.0, 0.0, 5.0, 1.0, 1.0, 5.0, 2.0, 2.0, 5.0)]
    t = spark.createDataFrame(tri, ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.0), (2, 0.5, 0.0, 0.0), (3, 0.6, 0.6, 7.0), (4, 0.0, 0.0, 3.0)], "point_id int, lon double, lat double, alt double")
    got = {r["point_id"]: r["draped"] for r in raster.drape(p, t, 0.3).collect()}
    assert got == pytest.approx({1: 1.0, 2: 1.0, 3: 7.0, 4: 1.0})


def test_grid_counts_and_strip_length(spark):
    g = spark.createDataFrame([(1, 5, 4), (2, 1, 9)], "g int, nx int, ny int")
    assert raster.grid_triangles(g).groupBy("g").count().collect()[0]["count"] == 2 * 4 * 3
    b = spark.createDataFrame([(1, 5, 4), (2, 2, 2)], "b int, size_x int, size_y int")
    got = {r["b"]: r["count"] for r in raster.block_strip(b).groupBy("b").count().collect()}
    assert got == {1: 2 * 5 * 3 + 2 * 2, 2: 4}


def test_strip_of_a_block_covers_its_cells(spark):
    b = spark.createDataFrame([(1, 5, 4)], "b int, size_x int, size_y int")
    t = mesh.strip_to_triangles(raster.block_strip(b).select("b", "pos", "vertex_idx"), ["b"]).collect()
    assert len({frozenset((r["v0"], r["v1"], r["v2"])) for r in t}) == len(t) == 2 * 4 * 3
    side = lambda r: np.sign((r["v1"] % 5 - r["v0"] % 5) * (r["v2"] // 5 - r["v0"] // 5) - (r["v2"] % 5 - r["v0"] % 5) * (r["v1"] // 5 - r["v0"] // 5))
    assert len({side(r) for r in t}) == 1


def test_globe(spark):
    assert mesh.globe_vertices(spark).count() == 64621
    t = mesh.globe_triangles(spark)
    assert t.count() == 128880 and t.agg(F.max(F.greatest("v0", "v1", "v2"))).first()[0] == 64620


def test_histogram_and_range_edges(spark):
    s = spark.createDataFrame([(1, 0, 0, -5.0), (1, 0, 1, 0.0), (1, 1, 0, 10.0), (1, 1, 1, 99.0)], "map_id bigint, row bigint, col bigint, h double")
    assert [r["n"] for r in raster.raster_histogram(s, 2, 0.0, 10.0).orderBy("bin").collect()] == [2, 2]
    flat = raster.raster_range(s.where("h = 0"))
    assert raster.data_range_ok(flat).count() == 0


def test_truncated_last_block_and_absent_tile(spark):
    s = spark.createDataFrame([(1, y, x, float(10 * y + x)) for y in range(5) for x in range(3)], "map_id bigint, row bigint, col bigint, h double")
    head = spark.createDataFrame([(1, 3, 5)], "map_id bigint, nx int, ny int")
    tiles = raster.samples_to_blocks(s, 4)
    back = raster.raster_blocks_to_samples(tiles, head, 4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect()))
    none = raster.raster_blocks_to_samples(tiles.withColumn("data", F.lit(None).cast("binary")), head, 4)
    assert {r["h"] for r in none.collect()} == {0.0} and none.count() == 15


def test_run_length_round_trip_with_wide_values(spark):
    rows = [(1, k, v) for k, v in enumerate([7] * 70 + [300, 300, 7, -2])] + [(2, 0, 5)]
    p = spark.createDataFrame(rows, "block_id bigint, pos bigint, v bigint")
    runs = raster.rle_encode(p)
    assert {r["bits"] for r in runs.where("block_id = 1").collect()} == {16}
    assert sorted(map(tuple, raster.rle_decode(runs).collect())) == sorted(rows)


def test_two_colour_block_survives_coding(spark):
    p = spark.createDataFrame([(1, k, 255 if k % 3 else 0, 255 if k % 3 else 0, 255 if k % 3 else 0) for k in range(16)], "block_id bigint, pixel int, r bigint, g bigint, b bigint")
    d = {r["pixel"]: r["r"] for r in text.dxt1_decode(text.dxt1_encode(p)).collect()}
    assert all((d[k] > 127) == bool(k % 3) for k in range(16))


def test_state_before_anything_is_set(spark):
    r = spark.createDataFrame([(1, 1, "draw", 0), (1, 2, "enable", 5), (1, 3, "bind_texture", 9), (1, 4, "draw", 0), (1, 5, "enable", 4), (1, 6, "bind_texture", 8), (1, 7, "draw", 0)], "dump_id int, seq int, tag string, arg int")
    got = [(x["seq"], x["slot"], x["texture"]) for x in capture.draw_state_asof(r).orderBy("seq").collect()]
    assert got == [(1, 0, -1), (4, 1, -1), (7, 0, 8)]


def test_rigid_fit_degenerate_and_exact(spark):
    assert (mesh.rigid_transform(np.eye(3)[:2], np.eye(3)[:2]) == np.eye(4)).all()
    src = np.array([[0.0, 0, 0], [1, 0, 0], [0, 2, 0]])
    a = 0.7
    turn = np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, np.cos(1.1), np.sin(1.1)], [0, -np.sin(1.1), np.cos(1.1)]])
    dst = src @ turn * 2.5 + [4, 5, 6]
    m = mesh.rigid_transform(src, dst)
    assert np.c_[src, np.ones(3)] @ m == pytest.approx(np.c_[dst, np.ones(3)])
    same = mesh.rigid_transform(src, src + [1, 1, 1])
    assert np.c_[src, np.ones(3)] @ same == pytest.approx(np.c_[src + 1, np.ones(3)])


def test_kml_folders_hide_loose_placemarks(spark):
    line = "<Placemark><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString></Placemark>"
    ring = "<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>\n0,0 1,0,2\n</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    t = spark.createDataFrame([("a", f"<Document>{line}<Folder>{ring}</Folder></Document>"), ("b", f"<Document>{line}<!--{ring}--></Document>"), ("c", None), ("d", "")], "file string, text string")
    got = sorted((r["file"], r["kind"], r["point_idx"], r["lon"], r["alt"]) for r in files.parse_kml(t).collect())
    assert got == [("a", "Polygon", 0, 0.0, 0.0), ("a", "Polygon", 1, 1.0, 2.0), ("b", "LineString", 0, 1.0, 3.0), ("b", "LineString", 1, 4.0, 6.0)]


def test_kml_nested_folders_documents_and_prefixes(spark):
    line = lambda x: f"<Placemark><LineString><coordinates>{x},1,2</coordinates></LineString></Placemark>"
    hole = "<k:Polygon><k:innerBoundaryIs><k:LinearRing><k:coordinates>9,9,9</k:coordinates></k:LinearRing></k:innerBoundaryIs><k:outerBoundaryIs><k:LinearRing><k:coordinates>7,7,7</k:coordinates></k:LinearRing></k:outerBoundaryIs></k:Polygon>"
    texts = {
        "nested": f"<Document>{line(1)}<Folder><name>a</name><Folder>{line(2)}</Folder>{line(3)}</Folder>{line(4)}</Document>",
        "two": f"<kml><Document>{line(1)}</Document><Document><Folder>{line(2)}</Folder>{line(3)}</Document></kml>",
        "prefix": f"<k:Document><k:Folder>{hole}</k:Folder></k:Document>",
        "empty": f"<Document><Folder/>{line(5)}</Document>",
    }
    got = {(r["file"], r["path_id"], r["lon"]) for r in files.parse_kml(spark.createDataFrame(list(texts.items()), "file string, text string")).collect()}
    assert got == {("nested", 0, 2.0), ("nested", 1, 3.0), ("two", 0, 1.0), ("two", 1, 2.0), ("prefix", 0, 7.0)}


def test_rigid_fit_step_by_step():
    """Inexact triangles, turned by quaternions instead of matrices."""
    rng = np.random.default_rng(5)

    def rotate(v, axis, angle):
        w, u = np.cos(angle / 2), np.sin(angle / 2) * axis
        return v + 2 * np.cross(u, np.cross(u, v) + w * v)

    for _ in range(50):
        src, dst = rng.normal(size=(3, 3)), rng.normal(size=(3, 3)) * 3 + 5
        a, b = src - src.mean(axis=0), dst - dst.mean(axis=0)
        sums = []
        for v in (a, b):
            u = [x / np.linalg.norm(x) for x in v]
            n = sum(np.cross(u[k], u[k - 2]) / np.linalg.norm(np.cross(u[k], u[k - 2])) * np.arccos(abs(u[k] @ u[k - 2])) for k in range(3))
            sums.append(n / np.linalg.norm(n))
        c = np.cross(*sums)
        s = np.linalg.norm(c)
        level = lambda v: rotate(v, c / s, np.arcsin(s))  # noqa: B023, E731
        angles = []
        for x, y in zip(a, b):
            p, q = np.cross(sums[1], level(x)), np.cross(sums[1], y)
            z = np.cross(p / np.linalg.norm(p), q / np.linalg.norm(q))
            angles.append(np.arcsin(np.linalg.norm(z)) * np.sign(z @ sums[1]))
        scale = np.mean([np.linalg.norm(x) for x in b]) / np.mean([np.linalg.norm(x) for x in a])
        want = [rotate(level(x), sums[1], np.mean(angles)) * scale + dst.mean(axis=0) for x in a]
        assert (np.c_[src, np.ones(3)] @ mesh.rigid_transform(src, dst))[:, :3] == pytest.approx(np.array(want))
    assert np.isfinite(mesh.rigid_transform(np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]), np.array([[2.0, 0, 0], [3, 0, 0], [2, 1, 0]]))).all()


def test_duplicates_of_many_sizes_against_nested_loop(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        size = float(rng.choice([0.01, 0.3, 1.0, 1.05, 7.0, 300.0]))
        rows.append((k, k % 7, 3, 3, *(float(v) for v in rng.integers(-2, 3, 3) * size * 0.06 + rng.choice([-1.0, 0.0, 5.0]) * size), size))
    m = spark.createDataFrame(rows, "mesh_id bigint, file_no int, n_vertex int, n_index int, x0 double, y0 double, z0 double, size double")
    f, want = np.float32, set()
    for p in rows:
        for q in rows:
            cut = [min(p[i] + p[7], q[i] + q[7]) - max(p[i], q[i]) for i in (4, 5, 6)]
            if p[1] > q[1] and min(cut) > 0:
                both = f(cut[0] * cut[1] * cut[2])
                if both / f(p[7] ** 3) > f(0.8) and both / f(q[7] ** 3) > f(0.8):
                    want.add((p[0], q[0]))
    got = [tuple(r) for r in boxes.near_duplicate_pairs(m).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_boxes_of_many_sizes_meet_in_few_cells(spark):
    rng = np.random.default_rng(9)
    make = lambda n: [(k, float(x), float(y), float(x + s), float(y + s * 0.7)) for k, (x, y, s) in enumerate(zip(*rng.uniform(-50, 50, (2, n)), rng.choice([0.01, 0.5, 3.0, 40.0, 9000.0], n)))]
    a, b = make(80), make(80)
    want = {(p[0], q[0]) for p in a for q in b if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])}
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, " + SQUARE)
    got = [(r["a"], r["b"]) for r in boxes.box_overlap_join(frame(a, "a"), frame(b, "b"), 0.1).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_metadata_is_cut_at_whole_characters(spark):
    rows = [(1, "a", "é" * 300), (1, "b", "x" * 600), (1, "c", "x" + "漢" * 200), (1, "d", "short")]
    m = lookup.metadata_map(spark.createDataFrame(rows, "map_id int, name string, value string").withColumns({"type": F.lit("string"), "rows": F.lit(1)})).first()["metadata"]
    assert m == {"a": "é" * 250, "b": "x" * 500, "c": "x" + "漢" * 166, "d": "short"}


def test_run_bytes_of_all_widths_and_long_runs(spark):
    rng = np.random.default_rng(2)
    rows = [(b, k, int(v)) for b, values in enumerate([[5] * 70_000 + [9], [7] * 100 + [300] * 20_000, rng.integers(0, 2**20, 50), [-3], rng.integers(0, 200, 400), [1] * 63 + [2] * 64]) for k, v in enumerate(values)]
    p = spark.createDataFrame(rows, "block_id bigint, pos bigint, v bigint")
    assert sorted(map(tuple, raster.unpack_runs(raster.pack_runs(raster.rle_encode(p))).collect())) == rows
    narrow = struct.pack("<iiiB", 10, -1, 13, 2) + bytes([0b11100100, 0b1])
    assert raster.decode_block(narrow, 5).tolist() == [10, 11, 12, 13, 11]
    assert raster.decode_block(struct.pack("<iiiB", 0, 1, 14, 0) + bytes([9]), 4).tolist() == [0] * 4


def test_capture_files(spark, tmp_path):
    rec = lambda tag, body: struct.pack("<II", len(body), tag) + body
    good = struct.pack("<II", files.MAGIC, 1) + rec(0x10000005, b"ab") + rec(0x20000000, struct.pack("<I", 7) + b"xyz") + rec(0x40000000, b"") + rec(0xF0000000, b"") + rec(0x10000001, b"late")
    (tmp_path / "good").write_bytes(good)
    (tmp_path / "cut").write_bytes(good[:18] + b"\xff\xff")
    (tmp_path / "other").write_bytes(b"hello world")
    got = sorted((r["file"].rsplit("/", 1)[1], r["seq"], r["kind"], r["link_index"], bytes(r["payload"])) for r in files.read_capture(spark, str(tmp_path)).collect())
    assert got == [("cut", 0, "command", None, b"ab"), ("good", 0, "command", None, b"ab"), ("good", 1, "data", 7, b"xyz"), ("good", 2, "skipped", None, b"")]


def test_lookup_without_match(spark):
    df = spark.createDataFrame([("A ",), ("12 x",), (None,)], "key string")
    t = spark.createDataFrame([("a ", "low", 2), ("A ", "high", 1), ("12", "twelve", 3)], "k string, v string, line_no int")
    got = {c: [r["v"] for r in lookup.lookup_first(df, "key", t, "k", "v", c).orderBy(F.col("key").asc_nulls_last()).collect()] for c in ("exact", "nocase", "integer")}
    assert got == {"exact": ["", "high", ""], "nocase": ["", "high", ""], "integer": ["twelve", "high", "high"]}


# overlap in levels


def test_one_huge_box_meets_each_box_of_the_other_side_once(spark):
    """Small boxes visit the huge one's level, but not each other there."""
    n = 3000
    small = lambda name, shift: spark.range(n).select(F.col("id").alias(name), (F.col("id") % 60 + shift).alias("min_x"), (F.floor(F.col("id") / 60) + shift).alias("min_y")).withColumns({"max_x": F.col("min_x") + 0.5, "max_y": F.col("min_y") + 0.5})
    a, b = small("a", 0.1), small("b", 0.3)
    huge = spark.createDataFrame([(n, -1.0, -1.0, 200.0, 200.0)], "a bigint, " + SQUARE)
    with_huge = a.union(huge)
    alone = boxes.candidates(a, b, 0.5).count()
    met = boxes.candidates(with_huge, b, 0.5).count()
    assert met <= alone + 4 * n  # and not n * n
    assert boxes.box_overlap_join(with_huge, b, 0.5).count() == boxes.box_overlap_join(a, b, 0.5).count() + n
    both = b.union(huge.withColumnRenamed("a", "b"))
    assert boxes.candidates(with_huge, both, 0.5).count() <= alone + 8 * n + 16
    assert boxes.box_overlap_join(with_huge, both, 0.5).count() == boxes.box_overlap_join(a, b, 0.5).count() + 2 * n + 1


def test_overlap_of_all_levels_against_nested_loop(spark):
    rng = np.random.default_rng(8)

    def make(n):
        size = 2.0 ** rng.uniform(-6, 9, n)
        at = rng.uniform(-40, 40, (n, 2))
        return [(k, float(x), float(y), float(x + s), float(y + s * w)) for k, ((x, y), s, w) in enumerate(zip(at, size, rng.uniform(0.1, 1, n)))]

    a, b = make(150), make(150)
    want = {(p[0], q[0]): (max(p[1], q[1]), max(p[2], q[2]), min(p[3], q[3]), min(p[4], q[4])) for p in a for q in b if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])}
    got = boxes.box_overlap_join(spark.createDataFrame(a, "a int, " + SQUARE), spark.createDataFrame(b, "b int, " + SQUARE), 0.05).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): (r["min_x"], r["min_y"], r["max_x"], r["max_y"]) for r in got} == want


# greedy dedup


def jobs_of(spark, f):
    """How many jobs ``f`` runs."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{id(f)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_dedup_of_long_chains_takes_as_many_jobs_as_of_short_ones(spark):
    chain = lambda n: (spark.range(n).select(F.col("id").alias("mesh_id"), F.col("id").alias("file_no")), spark.range(1, n).select(F.col("id").alias("mesh_id"), (F.col("id") - 1).alias("earlier_id")))
    m, p = chain(2000)
    assert {r["mesh_id"] for r in boxes.dedup_meshes(m, p).collect()} == set(range(0, 2000, 2))
    both = lambda n: tuple(x.union(y) for x, y in zip(chain(n), (f.select(*[(F.col(c) + 10_000).alias(c) for c in f.columns]) for f in chain(n))))
    long, short = (jobs_of(spark, lambda: boxes.dedup_meshes(*both(n), together=n)) for n in (2000, 40))  # two components
    assert long <= short + 40  # rounds of the components; rounds by depth would be a thousand times four


@pytest.mark.parametrize("together", [boxes.TOGETHER, 12, 0])
def test_dedup_of_components_of_any_size(spark, together):
    """Those of more pairs than ``together`` are decided in rounds; both ways together equal the loop."""
    rng = np.random.default_rng(6)
    meshes = [(k, int(rng.integers(25))) for k in range(300)]
    pairs = [(a[0], b[0]) for a in meshes for b in meshes if a[1] > b[1] and a[0] // 15 == b[0] // 15 and rng.random() < (0.03 if a[0] < 150 else 0.3)]
    pairs += pairs[:3]
    got = boxes.dedup_meshes(spark.createDataFrame(meshes, "mesh_id bigint, file_no int"), spark.createDataFrame(pairs, "mesh_id bigint, earlier_id bigint"), together)
    assert {r["mesh_id"] for r in got.collect()} == greedy(meshes, pairs)


def test_dedup_without_pairs(spark):
    m = spark.createDataFrame([(1, 1), (2, 1)], "mesh_id bigint, file_no int")
    assert boxes.dedup_meshes(m, spark.createDataFrame([], "mesh_id bigint, earlier_id bigint")).count() == 2


def test_components_with_a_hub_met_in_pieces(spark, monkeypatch):
    from geoloom.operators import links

    monkeypatch.setattr(links, "HUB", 50)
    pairs = spark.range(1, 1000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b")).union(spark.range(2000, 2100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).repartition(7)
    got = {r["node"]: r["component"] for r in links.components(pairs).collect()}
    assert got == {k: 0 for k in range(1000)} | {k: 2000 for k in range(2000, 2101)}


# state in chunks


def replayed(records, slots=4):
    """State at the draws of one dump, record by record."""
    s = {"matrix": -1, "slot": 0, "texture": -1, "array_buffer": -1, "element_buffer": -1} | {f"{n}_{k}": (0 if n == "enabled" else -1) for k in capture.ATTRIBUTES for n in ("enabled", "pointer", "buffer")}
    out = []
    for _, seq, tag, arg, index in records:
        if tag == "matrix":
            s["matrix"] = arg
        elif tag == "enable":
            s["slot"] = arg % slots
        elif tag in ("array_buffer", "element_buffer"):
            s[tag] = arg or -1
        elif tag in ("bind_texture", "disable_texture") and s["slot"] == 0:
            s["texture"] = arg if tag == "bind_texture" else -1
        elif tag in ("enable_attribute", "disable_attribute") and index in capture.ATTRIBUTES:
            s[f"enabled_{index}"] = int(tag == "enable_attribute")
        elif tag == "attribute_pointer" and index in capture.ATTRIBUTES:
            s[f"pointer_{index}"], s[f"buffer_{index}"] = arg, s["array_buffer"]
        elif tag == "draw":
            out.append({"seq": seq} | s)
    return out


@pytest.mark.parametrize("chunk", [1, 2, 7, 50, 100_000])
def test_state_in_chunks_equals_a_replay(spark, chunk):
    rng = np.random.default_rng(9)
    tags = ["matrix", "enable", "array_buffer", "element_buffer", "bind_texture", "disable_texture", "enable_attribute", "disable_attribute", "attribute_pointer", "draw", "draw", "other"]
    rows = {d: [(d, int(seq), tags[int(rng.integers(len(tags)))], int(rng.integers(0, 9)), int(rng.integers(0, 4))) for seq in np.sort(rng.choice(900, 300, False))] for d in (1, 2)}
    df = spark.createDataFrame([r for d in rows for r in rows[d]], "dump_id bigint, seq bigint, tag string, arg bigint, index bigint").repartition(4)
    got = [r.asDict() for r in capture.draw_state_asof(df, chunk=chunk).orderBy("dump_id", "seq").collect()]
    assert got == [{"dump_id": d} | s for d in (1, 2) for s in replayed(rows[d])]


def test_no_window_of_the_state_is_over_a_whole_dump(spark, sf):
    """But for those over a row a chunk."""
    from geoloom.plans.fixtures import view

    plan = capture.draw_state_asof(view(spark, sf, "state_record"))._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert over and all("_chunk" in line for line in over)
    assert any("_chunk" in line.split("], [")[-2] for line in over)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_numbers_gaps_and_end_in_chunks(spark, chunk):
    rows = [(d, k, ["draw", "clear", "other"][(k * 7 + d) % 3], k + (k > 5) + 2 * (k == 9), k == 11) for d in (1, 2) for k in range(0, 40, 2 if d == 2 else 1)]
    df = spark.createDataFrame(rows, "dump_id int, seq bigint, tag string, stamp bigint, stencil boolean").repartition(3)
    hits = [[r for r in rows if r[0] == d and r[2] != "other"] for d in (1, 2)]
    assert sorted((r["dump_id"], r["seq"], r["dispatch"]) for r in capture.dispatch_number(df, chunk).collect()) == [(r[0], r[1], n) for h in hits for n, r in enumerate(h)]
    gaps = [(b[0], b[1], a[3] + 1) for d in (1, 2) for a, b in zip([r for r in rows if r[0] == d], [r for r in rows if r[0] == d][1:]) if b[3] != a[3] + 1]
    assert sorted((r["dump_id"], r["seq"], r["expected"]) for r in capture.data_sequence_gaps(df, "stamp", chunk).collect()) == gaps
    stop = {1: min((r[1] for r in rows if r[0] == 1 and r[2] == "clear" and r[4]), default=10**9), 2: 10**9}
    assert {(r["dump_id"], r["seq"]) for r in capture.cut_after_end(df, F.col("seq") % 4 == 0).collect()} == {(r[0], r[1]) for r in rows if r[2] == "draw" and (r[1] < stop[r[0]] or r[1] % 4 == 0)}


def test_codes_of_all_domains(spark):
    from geoloom.functions import codes

    assert [len(set(codes.codes_of(d))) for d in codes.DOMAINS] == [len(codes.codes_of(d)) for d in codes.DOMAINS]
    df = spark.createDataFrame([(1, 0x1903, 0x88E0, None), (2, 0x88E0, 0x1903, 0x0104), (3, None, 0x88E9, 0x2200)], "seq int, f bigint, u bigint, op bigint")
    got = capture.validate_codes(df, {"f": "format", "u": "buffer_usage", "op": "texture_env_op"}, codes.domain_table(spark), ["seq"])
    assert sorted(map(tuple, got.collect())) == [(2, "f", "format", 0x88E0), (2, "u", "buffer_usage", 0x1903), (3, "op", "texture_env_op", 0x2200)]


# captures in ranges


def capture_bytes(rng, n):
    out = struct.pack("<II", files.MAGIC, 1)
    for _ in range(n):
        body = rng.bytes(int(rng.integers(0, 300)))
        out += struct.pack("<II", len(body), (int(rng.integers(1, 6)) << 28) + int(rng.integers(0, 999))) + body
    return out


def test_a_long_capture_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(11)
    whole = capture_bytes(rng, 400)
    (tmp_path / "a.dump").write_bytes(whole + struct.pack("<II", 0, files.END) + b"rest")
    (tmp_path / "b.dump").write_bytes(whole[:-50])  # cut off
    (tmp_path / "c.dump").write_bytes(capture_bytes(rng, 3))
    (tmp_path / "d.dump").write_bytes(b"no capture" * 2000)
    (tmp_path / "e.dump").write_bytes(b"")
    once, parted = (files.read_capture(spark, f"{tmp_path}/*.dump", split) for split in (files.SPLIT, 3000))
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))
    assert rows(once) == rows(parted) and once.count() > 700
    tasks = parted.where("file like '%a.dump'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 5


def test_index_of_a_capture_over_two_gigabytes(spark, tmp_path):
    """A file with holes: headers are found without reading the payloads."""
    sizes, path = [900_000_000, 5, 900_000_000, 700_000_000, 0], tmp_path / "long.dump"
    with open(path, "wb") as f:
        f.write(struct.pack("<II", files.MAGIC, 1))
        for size in sizes:
            f.write(struct.pack("<II", size, 2 << 28))
            f.seek(size, 1)
        f.write(struct.pack("<II", 0, files.END))
    listed = spark.read.format("binaryFile").load(str(path)).select("path", "length")
    got = [tuple(r)[1:] for r in files.index_captures(listed, 1_000_000_000).orderBy("begin").collect()]
    ends = np.cumsum([8, *[8 + s for s in sizes]]).tolist()
    assert got == [(ends[0], ends[3], 0), (ends[3], ends[5], 3)]


# runs and tiles


def test_smaller_compares_real_lengths(spark):
    rng = np.random.default_rng(12)
    for bits, top in ((8, 250), (16, 60_000), (32, 2**31)):
        blocks = [np.full(5, 1), np.full(13, 7), np.repeat(rng.integers(0, top, 6), rng.integers(1, 9, 6)), rng.integers(0, top, 40), np.full(70, 3), np.repeat([1, top - 1], 20_000), np.arange(20) % top, np.repeat(rng.integers(0, min(top, 90), 200), 2)]
        rows = [(b, p, int(v)) for b, x in enumerate(blocks) for p, v in enumerate(x)]
        runs = raster.rle_encode(spark.createDataFrame(rows, "block_id bigint, pos bigint, v bigint"), bits).collect()
        for b, x in enumerate(blocks):
            own = sorted((r["run_no"], r["value"], r["repeat"], r["minimum"], r["bits"], r["smaller"]) for r in runs if r["block_id"] == b)
            data = raster.encode_block(own[0][3], own[0][4], np.array([r[1] for r in own]), np.array([r[2] for r in own]))
            assert {r[5] for r in own} == {len(data) < len(x) * bits // 8}
            assert raster.decode_block(data, len(x)).tolist() == [v - (v >= 2**31) * 2**32 for v in x.tolist()]


@pytest.mark.parametrize("pixel_type", ["u8", "s8", "u16", "s16", "u32", "s32", "f32"])
def test_tiles_of_all_forms(pixel_type):
    rng = np.random.default_rng(13)
    low, high = (-3.5, 3.5) if pixel_type == "f32" else (np.iinfo(raster.LAYOUT[pixel_type]).min, np.iinfo(raster.LAYOUT[pixel_type]).max)
    for x in (np.repeat(rng.uniform(low, high, 4), 16), rng.uniform(low, high, 64), np.zeros(64), np.repeat([low, high], 32)):
        x = np.floor(x) if pixel_type != "f32" else x.astype("<f4").astype(float)
        for form in ("raw", "runs", "narrow"):
            data, compressed = raster.encode_tile(x, pixel_type, form)
            back = raster.decode_block(data, 64, pixel_type) if compressed else raster.decode_pixels(data, pixel_type)
            assert back.astype(float).tolist() == x.tolist()
    assert raster.encode_tile(np.zeros(64), pixel_type, "runs")[1] and not raster.encode_tile(np.arange(64) % 7, pixel_type, "runs")[1] or pixel_type.endswith("32")


def test_compressed_flags_and_short_blocks(spark):
    head = spark.createDataFrame([(1, 8, 8)], "map_id bigint, nx int, ny int")
    run = raster.encode_block(2, 8, np.array([0, 5]), np.array([3, 2]))  # fewer pixels than the tile has
    rows = [(1, 0, 0, run, True), (1, 0, 1, raster.encode_pixels(np.arange(16), "u8"), None), (1, 1, 0, None, True), (1, 1, 1, raster.encode_block(0, 8, np.array([9]), np.array([99])), True)]
    blocks = spark.createDataFrame(rows, "map_id bigint, block_y int, block_x int, data binary, compressed boolean")
    got = {(r["row"], r["col"]): r["h"] for r in raster.raster_blocks_to_samples(blocks, head, 4, "u8").collect()}
    assert [got[0, c] for c in range(8)] == [2.0, 2.0, 2.0, 7.0, 0.0, 1.0, 2.0, 3.0]
    assert got[1, 0] == 7.0 and got[1, 1] == got[5, 0] == 0.0 and got[7, 7] == 9.0


def test_median_of_distinct_heights(spark):
    rng = np.random.default_rng(14)
    maps = {1: rng.normal(size=901), 2: rng.normal(size=900), 3: np.array([5.0]), 4: np.array([1.0, 1.0, 9.0, 9.0]), 5: np.repeat([2.0, 3.0], [7, 2])}
    rows = [(m, 0, k, float(h)) for m, x in maps.items() for k, h in enumerate(x)] + [(3, 1, 0, None), (6, 0, 0, None)]
    got = {r["map_id"]: r for r in raster.raster_statistics(spark.createDataFrame(rows, "map_id bigint, row bigint, col bigint, h double").repartition(5)).collect()}
    for m, x in maps.items():
        assert got[m]["median"] == pytest.approx(np.median(x)) and got[m]["maximum"] == x.max()
    assert got[4]["mode"] == 1.0 and got[6]["median"] is None


@pytest.mark.parametrize("tile", [1, 4, 32])
def test_bilinear_over_tiles_and_gaps(spark, tile):
    rng = np.random.default_rng(15)
    h = {(m, y, x): float(rng.integers(-50, 50)) for m in (1, 2) for y in range(11) for x in range(9) if rng.random() < 0.85}
    s = spark.createDataFrame([(*k, v) for k, v in h.items()] + [(1, 20, 20, None)], "map_id bigint, row bigint, col bigint, h double")
    q = [(k, int(rng.integers(1, 3)), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-1, 11, (400, 2)))] + [(900, 1, 8.0, 10.0), (901, 1, 20.0, 20.0)]
    got = {r["k"]: r["height"] for r in raster.bilinear_sample(spark.createDataFrame(q, "k int, map_id bigint, x double, y double"), s, tile).collect()}
    want = {}
    for k, m, x, y in q:
        c, r = int(np.floor(x)), int(np.floor(y))
        if (m, r, c) in h:
            a = h[m, r, c]
            b, low = h.get((m, r, c + 1)), h.get((m, r + 1, c))
            lr = h.get((m, r + 1, c + 1))
            b2 = a if b is None else b
            low2, lr2 = (a, b2) if low is None else (low, low if lr is None else lr)
            fx, fy = np.float32(x - c), np.float32(y - r)
            one = np.float32(1)
            want[k] = float((np.float32(a) * (one - fx) + np.float32(b2) * fx) * (one - fy) + (np.float32(low2) * (one - fx) + np.float32(lr2) * fx) * fy)
    assert got == pytest.approx(want, abs=1e-4)


def test_queries_of_heights_are_shuffled_once(spark, sf):
    from geoloom.plans import raster_queries

    plan = raster_queries.w08(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("heights") and sum("Join" in line for line in plan.splitlines()) == 2  # with the headers, and with the tiles


def test_flat_paths_are_not_draped(spark):
    t = [(1, 1, 1, 0.0, 0.0, 5.0, 10.0, 0.0, 5.0, 0.0, 10.0, 5.0), (1, 1, 2, 20.0, 20.0, 9.0, 21.0, 20.0, 9.0, 20.0, 21.0, 9.0)]
    tri = spark.createDataFrame(t, "batch_id int, group_id int, mesh_id int, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    p = [(1, 1, 1.0, 1.0, 0.0), (1, 2, 2.0, 2.0, 0.0), (2, 1, 3.0, 1.0, 1.0), (2, 2, 3.0, 2.0, 1.0), (3, 1, 1.0, 4.0, 2.0), (3, 2, 2.0, 4.0, 2.0), (4, 1, 1.0, 1.0, 3.0), (5, 1, 30.0, 30.0, 4.0), (5, 2, 31.0, 31.0, 4.0), (6, 1, 9.0, 9.0, 0.0), (6, 2, 20.2, 20.2, 0.0)]
    got = raster.drape_paths(spark.createDataFrame(p, "path_id int, point_id int, lon double, lat double, alt double"), tri, ["batch_id", "group_id", "mesh_id"], 0.5)
    assert {(r["path_id"], r["point_id"]): r["draped"] for r in got.collect()} == {(1, 1): 5.0, (1, 2): 5.0, (2, 1): 1.0, (2, 2): 1.0, (3, 1): 2.0, (3, 2): 2.0, (4, 1): 3.0, (5, 1): 4.0, (5, 2): 4.0, (6, 1): 0.0, (6, 2): 9.0}


def test_numbers_of_one_batch_and_group(spark, monkeypatch):
    """All meshes in one batch; the join with the group's first number is in pieces."""
    monkeypatch.setattr(mesh, "AT_ONCE", 100)
    df = spark.range(1000).select(F.lit(1).alias("batch_id"), (F.col("id") % 3 * 10 - F.col("id") % 3).alias("group_id"), (1000 - F.col("id")).alias("mesh_id")).union(spark.createDataFrame([(2, 5, 1), (None, None, 1), (None, None, 2), (2, None, 1)], "batch_id int, group_id bigint, mesh_id bigint")).repartition(5)
    rows = mesh.mesh_numbers(df, F.lit("s")).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["batch_id"], r["group_id"]), []).append(r)
    assert len(rows) == 1004 and {k: {r["g"] for r in v} for k, v in groups.items()} == {(1, 0): {0}, (1, 9): {1}, (1, 18): {2}, (2, 5): {1}, (2, None): {0}, (None, None): {0}}
    for own in groups.values():
        assert [r["m"] for r in sorted(own, key=lambda r: r["mesh_id"])] == list(range(len(own)))
    assert rows[0]["mesh_name"] == f"s_meshNode_{rows[0]['g']}_{rows[0]['m']}"
