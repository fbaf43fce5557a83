"""Many small files, long captures of many records, and batches of many tiles and buffers."""

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.operators import raster
from geoloom.sources import files


def test_texts_lie_flat_in_one_folder(spark, tmp_path):
    """A folder a file, and moves by the driver, cost more than the files."""
    rows = [("a/b", "1"), ("c", "2\n3"), ("d", None), ("7", "")]
    files.write_texts(spark.createDataFrame(rows, "file string, text string"), f"file://{tmp_path}/out", ".txt")
    found = {n: open(f"{tmp_path}/out/{n}").read() for n in os.listdir(f"{tmp_path}/out")}
    assert found == {"a%2Fb.txt": "1\n", "c.txt": "2\n3\n", "7.txt": "\n"}
    assert files.read_texts(spark, f"{tmp_path}/out").count() == 3


def test_paths_lie_flat_in_one_folder(spark, tmp_path):
    p = spark.createDataFrame([(f, f, "LineString", k, float(f), float(k), 0.0) for f in (1, 2) for k in range(3)], "file int, path_id int, kind string, point_idx int, lon double, lat double, alt double")
    files.write_kml(p, f"file://{tmp_path}/kml")
    assert sorted(os.listdir(f"{tmp_path}/kml")) == ["1.kml", "2.kml"]
    got = sorted((r["file"][-5:], r["point_idx"], r["lon"], r["lat"]) for r in files.read_kml_paths(spark, f"{tmp_path}/kml").collect())
    assert got == [(f"{f}.kml", k, float(f), float(k)) for f in (1, 2) for k in range(3)]


def test_short_ranges_share_tasks(spark):
    """A task a range was what took the time; long ranges still have tasks of their own."""
    cores = spark.sparkContext.defaultParallelism
    assert files.tasks_for(spark, 60_000, 60_000 * 4096) == 30
    assert files.tasks_for(spark, 3, 100) == 3 and files.tasks_for(spark, 1000, 1000) == cores
    assert files.tasks_for(spark, 50, 50 * files.SPLIT) == 50 and files.tasks_for(spark, 0, 0) == 1


def test_captures_are_put_together_at_once(spark, capsys):
    records = [("x", k, 1 << 28, bytes([k % 256]) * k) for k in range(300)]
    packed = files.pack_capture(spark.createDataFrame(records, "path string, seq bigint, tag bigint, payload binary"))
    packed.explain()
    assert "aggregate(" not in capsys.readouterr().out
    (row,) = packed.collect()
    body = b"".join(struct.pack("<II", len(d), t) + d for _, _, t, d in records)
    assert bytes(row["content"]) == struct.pack("<II", files.MAGIC, 1) + body + struct.pack("<II", 0, files.END)


def test_buffers_of_all_lengths_in_one_batch(spark):
    """Strides above and below a vertex's size, colours that are cut off, buffers without a vertex and null ones."""
    rng = np.random.default_rng(1)
    bodies = [None if k % 11 == 0 else rng.integers(0, 256, k, dtype=np.uint8).tobytes() for k in range(70)]
    df = spark.createDataFrame([("f", k, 0, b) for k, b in enumerate(bodies)], "file string, seq bigint, block_no bigint, data binary")
    for stride, offset, n in ((8, 0, 1), (5, 3, 2), (20, 4, 3)):
        want = []
        for k, b in enumerate(bodies):
            for v in range(70):
                at = offset + stride * v
                if b is None or at + 4 * n > len(b):
                    break
                floats = np.frombuffer(b, "<f4", n, at).astype(float)
                want.append((k, v, floats.tobytes(), int.from_bytes(b[at + 4 * n : at + 4 * n + 4], "little")))
        got = [(r["seq"], r["vertex_idx"], np.array(r["values"]).tobytes(), r["color"]) for r in files.unpack_vertices(df, stride, offset, n).collect()]
        same = lambda rows: sorted((k, v, [repr(x) for x in np.frombuffer(f)], c) for k, v, f, c in rows)
        assert same(got) == same(want)


def test_vertices_go_out_in_spans():
    spans = list(files.slices(np.array([3, 0, 4, 0, 0, 9, 1]), 5))
    assert spans[0][0] == 0 and [x for x, _ in spans[1:]] == sorted(x for x, _ in spans[1:])
    assert sum(int(np.array([3, 0, 4, 0, 0, 9, 1])[x:y].sum()) for x, y in spans) == 17
    assert not list(files.slices(np.zeros(3, int)))


def test_tiles_of_a_batch_are_packed_in_parts(spark):
    batch = pa.RecordBatch.from_pydict({"k": np.arange(10_000)})
    parts = list(raster.tiles_at_once([batch], 256))
    assert max(p.num_rows for p in parts) * 256 <= raster.PIXELS_AT_ONCE and pa.Table.from_batches(parts)["k"].to_pylist() == list(range(10_000))
    # more tiles than one part holds, with a hole
    s = spark.range(300 * 256).where("id % 7 <> 3").select(F.lit(1).cast("bigint").alias("map_id"), F.floor(F.col("id") / 256).alias("row"), (F.col("id") % 256).alias("col"), F.col("id").cast("double").alias("h"))
    tiles = raster.samples_to_blocks(s, 16).collect()
    assert len(tiles) == 19 * 16
    for t in tiles:
        r, c = np.mgrid[0:16, 0:16] + np.array([t["block_y"], t["block_x"]])[:, None, None] * 16
        i = r * 256 + c
        assert np.array_equal(np.frombuffer(t["data"]).reshape(16, 16), np.where((i % 7 != 3) & (r < 300), i, 0))
