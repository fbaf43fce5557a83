"""Joins that would hand exploded tables to every task, and work that would grow with pairs."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from geoloom.functions import text
from geoloom.operators import boxes, capture, lookup, mesh, raster
from geoloom.plans import capture_queries


def plan(df):
    """The plan as it is before it runs."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rays_dont_broadcast_triangles(spark):
    """Both sides are small here, so the planner would, as it would with any that are exploded."""
    t = spark.createDataFrame([(1, *[0.0] * 9)], "triangle int, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point_id int, lon double, lat double, alt double")
    assert "SortMergeJoin" in plan(raster.ray_hits(p, t, 0.3)) and "BroadcastHashJoin" not in plan(raster.ray_hits(p, t, 0.3))


def test_surface_with_holes(spark):
    """A triangle needs its three pixels; a null height is there, a pixel left out isn't."""
    s = spark.createDataFrame([(0, 0, c, float(c)) for c in range(3)] + [(0, 1, 0, 10.0), (0, 1, 1, None)], "map_id bigint, row bigint, col bigint, h double")
    head = spark.createDataFrame([(0, 100.0, 50.0, 0.5, 3, 2)], "map_id bigint, ul_x double, ul_y double, pixel double, nx int, ny int")
    got = sorted((r["y"], r["x"], r["half"], r["x0"], r["y0"], r["z0"], r["x1"], r["y1"], r["z1"], r["x2"], r["y2"], r["z2"]) for r in raster.grid_surface(s, head).collect())
    assert got == [(0, 0, 0, 100.0, 50.0, 0.0, 100.5, 50.0, 1.0, 100.5, 49.5, None), (0, 0, 1, 100.0, 50.0, 0.0, 100.5, 49.5, None, 100.0, 49.5, 10.0)]


def test_rays_at_the_edges_of_the_boxes(spark):
    """Points on the corners of the triangles' common box hit; those beyond it, and triangles away from all points, don't matter."""
    tri = [(1, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0), (2, 50.0, 50.0, 2.0, 51.0, 50.0, 2.0, 50.0, 51.0, 2.0)]
    t = spark.createDataFrame(tri, "triangle int, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, -9.0, 0.0, 0.0)], "point_id int, lon double, lat double, alt double")
    assert {(r["point_id"], r["triangle"]) for r in raster.ray_hits(p, t, 0.3).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert raster.ray_hits(p.where(F.col("point_id") == 4), t, 0.3).count() == 0
    assert raster.ray_hits(p.where("false"), t, 0.3).count() == 0
    assert raster.ray_hits(p, t.where("false"), 0.3).count() == 0


def test_blocks_are_encoded_without_a_join(spark):
    """Also with pixels that aren't there or lack a channel, and the block of no number."""
    rows = [(1, k, 16 * k, 255 - k, k * k % 256) for k in range(14)] + [(1, 14, None, 3, 4), (None, 0, 1, 2, 3)]
    px = spark.createDataFrame(rows, "block_id bigint, pixel int, r bigint, g bigint, b bigint")
    out = text.dxt1_encode(px)
    assert "Join" not in plan(out)
    (got,) = out.collect()
    idx, high, low = 0, [], []
    for values in zip(*[row[2:] for row in rows[:15]]):
        some = [v for v in values if v is not None]
        inset = (max(some) - min(some)) // 16
        high.append(max(some) - inset)
        low.append(min(some) + inset)
    a = [v & 0xF8 | v >> 5 if i != 1 else v & 0xFC | v >> 6 for i, v in enumerate(high)]
    b = [v & 0xF8 | v >> 5 if i != 1 else v & 0xFC | v >> 6 for i, v in enumerate(low)]
    tables = [a, b, [(2 * x + y) // 3 for x, y in zip(a, b)], [(x + 2 * y) // 3 for x, y in zip(a, b)]]
    c0, c1 = (e[0] >> 3 << 11 | e[1] >> 2 << 5 | e[2] >> 3 for e in (high, low))
    for _, k, *rgb in rows[:14]:
        d = [sum(abs(x - y) for x, y in zip(rgb, t)) for t in tables]
        code = 2 * ((d[2] < d[0] and d[2] < d[1]) or (d[3] < d[0] and d[3] < d[1])) + (d[3] < d[0] and d[3] < d[2])
        idx |= code << 2 * k
    assert (got["block_id"], got["c0"], got["c1"], got["idx"]) == (1, c0, c1, idx)


def test_names_of_unknown_tags_are_listed_once(spark, monkeypatch):
    """Tags of one number of words share a list: no row a tag and function is made, also where many tags share it."""
    monkeypatch.setattr(capture, "TAGS_AT_ONCE", 3)
    fn = spark.createDataFrame([(100 + k, f"f{k:02}", 0, 2, k % 2) for k in range(20)] + [(1, "known", 0, 2, 0), (900, "pointers", 1, 2, 0)], "function_tag bigint, name string, pointers int, params int, returns int")
    calls = spark.createDataFrame([(d, t, 2 + t % 3) for d in range(4) for t in range(6)] * 2 + [(0, 102, 9)], "dump_id bigint, tag bigint, words int")
    names = {2: "f00," + ",".join(f"f{k:02}" for k in range(4, 20, 2)), 3: ",".join(f"f{k:02}" for k in range(1, 20, 2))}
    out = capture.unknown_tag_candidates(calls, fn, ",")
    assert sorted((r["dump_id"], r["tag"], r["words"], r["names"]) for r in out.collect()) == [(d, t, 2 + t % 3, names[2 + t % 3]) for d in range(4) for t in (0, 3, 4)]
    assert "collect_list" not in plan(out)


def test_long_lists_of_names_are_copied_a_row_at_a_time(spark, monkeypatch):
    """A join that broadcasts tags to the names, or an explode beside them, would hold a long row's copies all at once."""
    fn = spark.createDataFrame([(100 + k, f"f{k:02}", 0, k % 3, 0) for k in range(20)], "function_tag bigint, name string, pointers int, params int, returns int")
    calls = spark.createDataFrame([(d, t, t % 4) for d in range(5) for t in range(9)], "dump_id bigint, tag bigint, words int")
    names = {w: ",".join(f"f{k:02}" for k in range(w, 20, 3)) for w in range(3)}
    for rows in (20_000, 2):  # tags of a number of words in one piece, and in many
        monkeypatch.setattr(capture, "TAGS_AT_ONCE", rows)
        out = capture.unknown_tag_candidates(calls, fn, ",")
        assert sorted((r["dump_id"], r["tag"], r["words"], r["names"]) for r in out.collect()) == [(d, t, t % 4, names[t % 4]) for d in range(5) for t in range(9) if t % 4 < 3]
        lines = plan(out).splitlines()
        assert not [x for x in lines if "Generate" in x and "names" in x]
        last = next(x for x in lines if "Join" in x)
        assert "SortMergeJoin" in last


def test_selection_joins_each_pixel_once(spark, sf, tmp_path):
    """A hundred times the points, on the same pixels, bring no more hits to the quads; the actions still count each."""
    q = spark.createDataFrame([(1, True), (2, False), (3, True)], "quad_id bigint, initial boolean")
    corners = spark.createDataFrame([(k, *map(float, (10 * k, 0, 10 * k + 8, 0, 10 * k + 8, 8, 10 * k, 8))) for k in (1, 2, 3)], "quad_id bigint, " + ", ".join(f"{a}{k} double" for k in range(4) for a in "xy"))
    p = spark.createDataFrame([(12, 3, "click")] * 101 + [(22, 3, "set"), (22, 3, "click"), (22, 3, "click"), (33, 3, "remove")], "px int, py int, action string")
    folded = lookup.points_in_quads(lookup.fold_actions(p, ["px", "py"]), corners, 4.0)
    assert folded.count() == 3
    got = {r["quad_id"]: r["selected"] for r in lookup.patch_selection(q, folded).collect()}
    assert got == {1: False, 2: True, 3: False} == {r["quad_id"]: r["selected"] for r in lookup.patch_selection(q, lookup.points_in_quads(p, corners, 4.0)).collect()}


def test_exploded_cells_arent_broadcast(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "k int, min_x double, min_y double, max_x double, max_y double")
    corners = spark.createDataFrame([(1, *[0.0] * 8)], "quad_id bigint, " + ", ".join(f"{a}{k} double" for k in range(4) for a in "xy"))
    for joined in (boxes.candidates(b.withColumnRenamed("k", "a"), b, 0.1), lookup.points_in_quads(spark.createDataFrame([(1, 1)], "px int, py int"), corners, 4.0)):
        assert "SortMergeJoin" in plan(joined) and "BroadcastHashJoin" not in plan(joined)


def test_small_boxes_meet_in_small_cells(spark):
    """Boxes far below the cell that is asked for, all of them in one such cell, don't all meet."""
    k = F.col("id")
    b = spark.range(400).select(k.alias("k"), (k % 20 / 20).alias("min_x"), (F.floor(k / 20) / 20).alias("min_y"))
    b = b.withColumns({"max_x": F.col("min_x") + 0.06, "max_y": F.col("min_y") + 0.06})
    a = b.withColumnRenamed("k", "a")
    assert boxes.candidates(a, b, 1.0).count() < 160_000 / 4
    assert boxes.box_overlap_join(a, b, 1.0).count() == 58 * 58


def test_large_boxes_meet_small_ones_near_them(spark):
    """Narrow boxes as long as all the small ones' square meet a few more small ones than they overlap, and no cell holds most of them."""
    k = F.col("id")
    small = spark.range(2500).select(k.alias("b"), (k % 50 * 1.0).alias("min_x"), (F.floor(k / 50) * 1.0).alias("min_y"))
    small = small.withColumns({"max_x": F.col("min_x") + 0.9, "max_y": F.col("min_y") + 0.9})
    large = spark.range(20).select(k.alias("a"), (k * 0.3 + 0.95).alias("min_x"), F.lit(0.95).alias("min_y"), (k * 0.3 + 2.5).alias("max_x"), F.lit(49.5).alias("max_y"))
    pairs = boxes.box_overlap_join(large, small, 1.0).count()
    met = boxes.candidates(large, small, 1.0)
    assert pairs == sum(49 * sum(max(x, 0.95 + 0.3 * a) < min(x + 0.9, 2.5 + 0.3 * a) for x in range(50)) for a in range(20))
    assert pairs < met.count() < 8 * pairs
    assert max(r["count"] for r in met.groupBy("_at", "cell_x", "cell_y").count().collect()) < met.count() / 4


def test_pairs_of_meshes_arent_joined_again(spark):
    """Upper levels are cut first; nothing is joined with the pairs that come out last."""
    m = spark.createDataFrame([(b, g, 10 * g + k, 10.0 * g + k, 0.0, 10.0 * g + k + 1.5, 1.0) for b in (0, 1) for g in (2 * b, 2 * b + 1) for k in range(3)], "batch_id int, group_id int, mesh_id int, min_x double, min_y double, max_x double, max_y double")
    p = spark.createDataFrame([(1, 0.5, 0.5, 1.2, 2.0), (2, 5.0, 0.1, 9.0, 0.9), (3, 31.0, 0.2, 32.0, 0.3), (4, 90.0, 0.0, 95.0, 1.0), (5, 11.2, 1.0, 12.0, 2.0)], "path_id int, min_x double, min_y double, max_x double, max_y double")
    out = boxes.prune_candidates(p, m, ["batch_id", "group_id", "mesh_id"], 1.0)
    last = next(line for line in plan(out).splitlines() if "Join" in line)
    assert "Inner" in last
    assert sorted((r["path_id"], r["mesh_id"]) for r in out.collect()) == [(1, 0), (1, 1), (3, 30), (3, 31)]


def test_draping_computes_triangles_once_for_the_rays(spark, monkeypatch):
    """The rays ask for the triangles' box and levels, and for the triangles: those left are read from a step's table."""
    seen = []
    rays = raster.ray_hits
    monkeypatch.setattr(raster, "ray_hits", lambda p, t, cell: seen.append(t.inputFiles()) or rays(p, t, cell))
    t = spark.createDataFrame([(0, 0, 0, *map(float, (0, 0, 5, 4, 0, 5, 0, 4, 5)))], "batch_id int, group_id int, mesh_id int, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    p = spark.createDataFrame([(1, 1, 0.5, 0.5, 1.0), (1, 2, 1.0, 1.5, 1.0)], "path_id int, point_id int, lon double, lat double, alt double")
    out = raster.drape_paths(p, t, ["batch_id", "group_id", "mesh_id"], 0.5)
    assert sorted((r["point_id"], r["draped"]) for r in out.collect()) == [(1, 5.0), (2, 5.0)]
    assert seen and all("/triangles-" in f for f in seen[0]) and seen[0]


def test_near_duplicates_of_all_sizes_and_places(spark):
    """Against all pairs; copies for cells aren't broadcast, and a pair comes once."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 400
    size = np.exp2(rng.choice([-1.0, -0.52, -0.5, -0.48, 0.0, 1.0, 3.5], n)) * rng.uniform(0.97, 1.03, n)
    low = np.round(rng.uniform(-2, 2, (n, 3))) * 4 + rng.choice([-0.37, 0.0, 0.13, 0.5], (n, 1)) + rng.uniform(-0.05, 0.05, (n, 3)) * size[:, None]
    rows = [(k, int(k % 7), 3, 6, *map(float, low[k]), float(size[k])) for k in range(n)]
    m = spark.createDataFrame(rows, "mesh_id bigint, file_no int, n_vertex int, n_index int, x0 double, y0 double, z0 double, size double")
    for share in (0.5, 0.8):
        cut = np.minimum((low + size[:, None])[:, None], (low + size[:, None])[None]) - np.maximum(low[:, None], low[None])
        both = np.where((cut > 0).all(axis=2), cut.prod(axis=2), 0)
        want = sorted((a, b) for a, b in zip(*np.nonzero((both > share * size[:, None] ** 3) & (both > share * size[None] ** 3))) if a % 7 > b % 7)
        out = boxes.near_duplicate_pairs(m, share)
        assert "BroadcastHashJoin" not in plan(out)
        assert sorted((r["mesh_id"], r["earlier_id"]) for r in out.collect()) == want and len(want) > 20


def test_compaction_deals_rows_by_their_number(spark, sf, monkeypatch):
    """However few bytes a shuffle packs them to, each step's tasks meet about as many rows; against a plain loop, with indices out of range and none."""
    import numpy as np

    monkeypatch.setattr(mesh, "AT_ONCE", 100)
    tasks = lambda df: {int(k) for k in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan(df))}
    rng = np.random.default_rng(5)
    lists = {m: [None if v == 11 else int(v) - 1 for v in rng.integers(0, 12, n)] for m, n in enumerate([*rng.integers(1, 60, 60), 900])}
    size = {m: 9 + m % 2 for m in lists if m != 7}
    index = spark.createDataFrame([(m, p, v) for m, vs in lists.items() for p, v in enumerate(vs)], "mesh_id bigint, pos bigint, vertex_idx bigint")
    n_vertex = spark.createDataFrame(list(size.items()), "mesh_id bigint, n_vertex bigint")
    rows = sum(map(len, lists.values()))
    for triangles in (True, False):
        want = []
        for m in size:
            ok = [v is not None and 0 <= v < size[m] for v in lists[m]]
            if triangles:
                ok = [all(ok[p - p % 3 : p - p % 3 + 3]) for p in range(len(ok))]
            new = {}
            want += [(m, p, v, new.setdefault(v, len(new))) for p, v in enumerate(lists[m]) if ok[p]]
        for known in (None, rows):
            out = mesh.compact_vertices(index, n_vertex, ["mesh_id"], triangles, known)
            assert tasks(out) == {-(-rows // 100)}
            assert sorted(map(tuple, out.collect())) == want and len(want) > 300
    li = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert tasks(capture_queries.indices(spark, sf)) == {-(-li // 100)}


def listed(patches, others):
    """The lists by a nested loop over rows (key, box)."""
    over = lambda p, q: max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])
    full = lambda r: None not in r
    return sorted((p[0], *[sorted(q[0] for q in rows if full(q) and full(p) and over(p, q)) or None for rows in others]) for p in patches)


def test_lists_of_overlaps_are_made_without_a_shuffle_of_pairs(spark, monkeypatch):
    """One shuffle, of boxes; against a nested loop, with boxes on tiles' edges, without inside, null, and alike."""
    import numpy as np

    rng = np.random.default_rng(4)

    def make(n, least, most, first):
        at, size = np.round(rng.uniform(-2, 2, (n, 2)) * 8) / 8, np.round(rng.uniform(least, most, n) * 16) / 16
        return [(first + k, *map(float, (x, y, x + s, y + s))) for k, ((x, y), s) in enumerate(zip(at, size))]

    p, a, b = make(300, 0.1, 0.4, 10), make(200, 0.05, 0.9, 9), make(5, 3, 4, -3)
    p += [(990, None, 0.0, 1.0, 1.0), (991, 0.0, 0.0, 0.0, 1.0), (992, 77.0, 77.0, 77.25, 77.25)]
    a += [(None, 0.0, 0.0, 0.5, 0.5), (880, 0.0, 0.0, None, 1.0), (881, 0.25, 0.25, 0.25, 0.5)]
    schema = "k bigint, min_x double, min_y double, max_x double, max_y double"
    patches, others = spark.createDataFrame(p, schema), {"a": (spark.createDataFrame(a, schema), "k"), "b": (spark.createDataFrame(b, schema), "k")}
    want = listed(p, [a, b])
    assert sum(len(r[1] or ()) for r in want) > 1000 and any(r[1] is None for r in want)
    monkeypatch.setattr(boxes, "COPIES", 400)  # the large ones of b lie in many tiles
    for at_once, least, keys in ((4_000_000, 256, 1_000_000), (50, 1, 7), (1000, 3, 1)):
        for name, value in (("AT_ONCE", at_once), ("COMPARED", least), ("LISTED", keys)):
            monkeypatch.setattr(boxes, name, value)
        out = boxes.patch_overlap_index(patches, "k", others, 0.1)
        assert "Join" not in plan(out) and "Aggregate" not in plan(out) and plan(out).count("Exchange") == 1
        assert sorted(map(tuple, out.collect())) == want
    text = boxes.patch_overlap_index(patches, "k", others, 0.1, ";")
    assert sorted(map(tuple, text.collect())) == [(k, *[x and ";".join(map(str, x)) for x in lists]) for k, *lists in want]
    assert boxes.patch_overlap_index(patches.where("false"), "k", others, 0.1).count() == 0
    none = boxes.patch_overlap_index(patches, "k", {"a": (patches.where("false"), "k")}, 0.1)
    assert sorted(map(tuple, none.collect())) == [(r[0], None) for r in want]


def test_lists_of_overlaps_of_boxes_of_all_sizes(spark):
    """Where copies in tiles would be too many, or a patch comes twice, pairs are grouped; the lists are the same."""
    p = [(k, float(k), 0.0, k + 0.5, 0.5) for k in range(40)]
    huge = [(90, -1.0, -1.0, 1e6, 1e6)]
    schema = "k bigint, min_x double, min_y double, max_x double, max_y double"
    for rows, others in ((p, p + huge), (p + huge, p), (p, [(91, -1.0, -1.0, float("inf"), 1e3)]), (p + p[:1], p)):
        if others[0][3] == float("inf"):
            assert boxes._tile_width(spark.createDataFrame(rows, schema), "k", {"a": (spark.createDataFrame(others, schema), "k")}, 0.1) == (None, 0)
            continue
        out = boxes.patch_overlap_index(spark.createDataFrame(rows, schema), "k", {"a": (spark.createDataFrame(others, schema), "k")}, 0.1, ",")
        want = listed(rows, [others]) if len(set(rows)) == len(rows) else [(r[0], r[1] * (1 + (r[0] == 0))) for r in listed(rows, [others])]
        assert sorted(map(tuple, out.collect())) == [(k, ",".join(map(str, x))) for k, x in want]
