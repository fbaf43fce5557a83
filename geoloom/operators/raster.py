"""Raster samples, statistics, grids and tiles.

Samples are rows (map_id, row, col, h), with a ``band`` after the map where maps
have several, each of which is then worked on by itself; headers rows (map_id, ul_x,
ul_y, pixel, nx, ny), y decreasing with the row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.operators.boxes import bbox, prune_candidates
from geoloom.operators.links import shuffled
from geoloom.storage import job, materialize, result, running_sums

STEPS = 33  # of a height block


# Bits of the pixel types, and how those of whole bytes lie in memory.
PIXEL_BITS = {"u1": 1, "u2": 2, "u4": 4, "u8": 8, "s8": 8, "u16": 16, "s16": 16, "u32": 32, "s32": 32, "f32": 32, "f64": 64, "c64": 64, "c128": 128}
LAYOUT = {"u8": "<u1", "s8": "<i1", "u16": "<u2", "s16": "<i2", "u32": "<u4", "s32": "<i4", "f32": "<f4", "f64": "<f8", "c64": "<c8", "c128": "<c16"}


def band_keys(*frames: DataFrame) -> list[str]:
    """What tells rasters apart in all of the frames: the map, and the band if there are bands."""
    return ["map_id", *(["band"] if all("band" in f.columns for f in frames) else [])]


def encode_pixels(values: np.ndarray, pixel_type: str) -> bytes:
    """Pixels in memory order; several in a byte begin with its low bits."""
    bits = PIXEL_BITS[pixel_type]
    if bits >= 8:
        return values.astype(LAYOUT[pixel_type]).tobytes()
    x = values.astype(np.uint8).reshape(-1, 8 // bits) << (bits * np.arange(8 // bits, dtype=np.uint8))
    return np.bitwise_or.reduce(x, axis=1).astype(np.uint8).tobytes()


def decode_pixels(data: bytes, pixel_type: str) -> np.ndarray:
    bits = PIXEL_BITS[pixel_type]
    if bits >= 8:
        return np.frombuffer(data, LAYOUT[pixel_type])
    x = np.frombuffer(data, np.uint8)[:, None] >> (bits * np.arange(8 // bits, dtype=np.uint8))
    return (x & (2**bits - 1)).reshape(-1)


#: Pixels of tiles that a task packs at a time, however many tiles come together.
PIXELS_AT_ONCE = 1 << 16


def tiles_at_once(batches: Iterator[pa.RecordBatch], pixels: int) -> Iterator[pa.RecordBatch]:
    """Batches of tiles of ``pixels`` pixels, cut to about PIXELS_AT_ONCE: what a task holds beside a batch doesn't grow with its rows."""
    step = max(1, PIXELS_AT_ONCE // pixels)
    for b in batches:
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def samples_to_blocks(samples: DataFrame, size: int, pixel_type: str = "f64", packing: Column | None = None) -> DataFrame:
    """Square tiles of pixels in little-endian order, rows after rows, padded with zeros past the map's edge. The imaginary part of complex ones is ``h_im``. ``size`` squared is a multiple of 8.

    ``packing``, of block_y and block_x, names each tile's form: raw, runs (where they
    make it smaller, else raw) or narrow (all values in the width of their range); the
    column ``compressed`` then tells what a tile is. Pixels of 8, 16 and 32 bits can be
    packed.
    """
    keys = band_keys(samples)
    where = [F.floor(F.col(c) / size).cast("int").alias(n) for c, n in (("row", "block_y"), ("col", "block_x"))]
    cell = ((F.col("row") % size) * size + F.col("col") % size).cast("int")
    parts = ["h", *(["h_im"] if pixel_type[0] == "c" else [])]
    names = [*keys, "block_y", "block_x"]
    packed = packing is not None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tiles_at_once(batches, size * size):
            cells = b["cells"].combine_chunks() if isinstance(b["cells"], pa.ChunkedArray) else b["cells"]
            flat = cells.flatten()
            tile = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            x = np.zeros((len(cells), size * size), complex if len(parts) == 2 else float)
            value = flat.field("h").to_numpy(zero_copy_only=False)
            x[tile, flat.field("cell").to_numpy()] = value + 1j * flat.field("h_im").to_numpy(zero_copy_only=False) if len(parts) == 2 else value
            forms = b["packing"].to_pylist() if packed else ["raw"] * len(x)
            tiles = [encode_tile(row, pixel_type, form) for row, form in zip(x, forms)]
            more = [pa.array([c for _, c in tiles], pa.bool_())] if packed else []
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array([t for t, _ in tiles], pa.binary()), *more], names=[*names, "data", *(["compressed"] if packed else [])])

    tiles = samples.groupBy(*keys, *where).agg(F.collect_list(F.struct(cell.alias("cell"), *parts)).alias("cells"))
    if packed:
        tiles = tiles.withColumn("packing", packing)
    return tiles.mapInArrow(pack, ", ".join(f"{k} bigint" for k in keys) + ", block_y int, block_x int, data binary" + (", compressed boolean" if packed else ""))


def raster_blocks_to_samples(blocks: DataFrame, headers: DataFrame, size: int, pixel_type: str = "f64") -> DataFrame:
    """A row per pixel inside the map; tiles without data are zeros. Complex pixels give ``h_im``, too.

    Where blocks have a column ``compressed``, a tile with it set is one of runs, or of
    values in a narrow width; a null flag is unset. Both kinds may be in one map.
    """
    keys = band_keys(blocks)
    complex_ = pixel_type[0] == "c"
    flagged = "compressed" in blocks.columns
    names = [*keys, "row", "col", "h", *(["h_im"] if complex_ else [])]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(size * size)
        for b in batches:
            flags = b["compressed"].to_pylist() if flagged else [False] * b.num_rows
            for data, flag, y, x, *own in zip(b["data"], flags, b["block_y"].to_pylist(), b["block_x"].to_pylist(), *(b[c].to_pylist() for c in keys)):
                h = np.zeros(size * size)
                if data.is_valid and flag:
                    found = decode_block(data.as_py(), size * size, pixel_type)
                    h = np.pad(found, (0, size * size - len(found)))
                elif data.is_valid:
                    h = decode_pixels(data.as_buffer(), pixel_type)[: size * size]
                values = [h.real.astype(float), h.imag.astype(float)] if complex_ else [h.astype(float)]
                columns = [*(np.full(size * size, v) for v in own), y * size + at // size, x * size + at % size, *values]
                yield pa.RecordBatch.from_pydict(dict(zip(names, columns)))

    flat = blocks.mapInArrow(unpack, ", ".join(f"{n} {'double' if n[0] == 'h' else 'bigint'}" for n in names))
    own = band_keys(blocks, headers)
    inside = flat.join(headers.select(*own, "nx", "ny"), own).where("row < ny and col < nx")
    return inside.select(*names)


def raster_range(samples: DataFrame, seeded: bool = False) -> DataFrame:
    """Least and greatest height per map and band; ``seeded`` starts from 100000 and -100000."""
    lo, hi = F.min("h"), F.max("h")
    if seeded:
        lo, hi = F.least(lo, F.lit(100000.0)), F.greatest(hi, F.lit(-100000.0))
    return samples.groupBy(*band_keys(samples)).agg(lo.alias("lo"), hi.alias("hi"))


def raster_statistics(samples: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, median, mode (the least of several) and standard deviation per map and band.

    Median and mode come from counts of the distinct heights. These are put into one
    order by ranges with the running sum of their counts, so the two heights in the
    middle of each map are found by position, and no buffer holds a map's heights.
    """
    keys = band_keys(samples)
    with job(samples.sparkSession):
        plain = samples.groupBy(*keys).agg(F.min("h").alias("minimum"), F.max("h").alias("maximum"), F.avg("h").alias("mean"), F.stddev_samp("h").alias("stddev"))
        heights = materialize(samples.where("h is not null").groupBy(*keys, "h").agg(F.count("*").alias("n")), "heights")
        mode = heights.groupBy(*keys).agg(F.max_by("h", F.struct(F.col("n"), -F.col("h"))).alias("mode"))
        ordered = running_sums(heights, [F.col(k) for k in (*keys, "h")], {"before": F.col("n")})
        totals = ordered.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("before").alias("start"))
        place = F.col("before") - F.col("start")
        middle = [F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)]
        held = [(place <= m) & (m < place + F.col("n")) for m in middle]
        halves = ordered.join(totals, keys).where(held[0] | held[1]).groupBy(*keys).agg(F.min(F.when(held[0], F.col("h"))).alias("low"), F.min(F.when(held[1], F.col("h"))).alias("high"))
        median = halves.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median"))
        out = plain.join(mode, keys, "left").join(median, keys, "left")
        return result(out.select(*keys, "minimum", "maximum", "mean", "median", "mode", "stddev"), "statistics")


def raster_histogram(samples: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts of linear bins between the limits per map and band, values at or past them in the outer bins; empty bins count 0."""
    keys = band_keys(samples)
    b = F.least(F.greatest(F.floor((F.col("h") - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = samples.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    frame = samples.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def data_range_ok(ranges: DataFrame) -> DataFrame:
    return ranges.where("hi > lo")


def nodata_to_null(samples: DataFrame, nodata: DataFrame) -> DataFrame:
    """Heights equal to their map's (and band's) no-data value become null."""
    joined = samples.join(nodata, band_keys(samples, nodata), "left")
    return joined.select(*band_keys(samples), "row", "col", F.nullif("h", "nodata").alias("h"))


def bilinear(fx: Column, fy: Column) -> Column:
    """Between h, h01, h10, h11, along x and then y, in 32-bit floats."""
    f32 = lambda c: c.cast("float")
    one, x, y = F.lit(1.0).cast("float"), f32(fx), f32(fy)
    top = f32(f32(f32(F.col("h")) * (one - x)) + f32(f32(F.col("h01")) * x))
    low = f32(f32(f32(F.col("h10")) * (one - x)) + f32(f32(F.col("h11")) * x))
    return f32(f32(top * (one - y)) + f32(low * y))


#: Rows and columns of the tiles that queries meet.
TILE = 32


def halo_tiles(samples: DataFrame, tile: int = TILE) -> DataFrame:
    """Square tiles of heights as arrays, row after row, with a further row below and column to the right, which are the neighbours' first ones. Pixels that aren't there are null."""
    keys = band_keys(samples)
    along = lambda c: F.when((F.col(c) % tile == 0) & (F.col(c) > 0), F.array(F.floor(F.col(c) / tile), F.floor(F.col(c) / tile) - 1)).otherwise(F.array(F.floor(F.col(c) / tile)))
    placed = samples.where("h is not null").withColumn("tile_y", F.explode(along("row"))).withColumn("tile_x", F.explode(along("col")))
    side = tile + 1
    cell = ((F.col("row") - F.col("tile_y") * tile) * side + F.col("col") - F.col("tile_x") * tile).cast("int")
    names = [*keys, "tile_y", "tile_x"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b["cells"].combine_chunks() if isinstance(b["cells"], pa.ChunkedArray) else b["cells"]
            flat = cells.flatten()
            at = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy())) * side * side + flat.field("cell").to_numpy()
            heights, absent = np.zeros(len(cells) * side * side), np.ones(len(cells) * side * side, bool)
            heights[at], absent[at] = flat.field("h").to_numpy(zero_copy_only=False), False
            arrays = pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * side * side, pa.array(heights, mask=absent))
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), arrays], [*names, "heights"])

    tiles = placed.groupBy(*names).agg(F.collect_list(F.struct(cell.alias("cell"), F.col("h").cast("double").alias("h"))).alias("cells"))
    return tiles.mapInArrow(fill, ", ".join(f"{n} bigint" for n in names) + ", heights array<double>")


def bilinear_sample(queries: DataFrame, samples: DataFrame, tile: int = TILE) -> DataFrame:
    """Heights at fractional (map_id, x, y); points outside their map, or on a pixel without a height, have none.

    One equi-join: a query meets the tile that holds its pixel and, with the tile's
    halo, the right, lower and lower right neighbours, too. Queries are shuffled once.
    Where a neighbour is missing, at the edge or in a gap, the nearer pixel is used
    again.
    """
    keys = band_keys(queries, samples)
    q = queries.withColumn("col", F.floor("x")).withColumn("row", F.floor("y"))
    q = q.withColumns({"tile_y": F.floor(F.col("row") / tile), "tile_x": F.floor(F.col("col") / tile)})
    out = q.join(halo_tiles(samples, tile), [*keys, "tile_y", "tile_x"])
    at = ((F.col("row") - F.col("tile_y") * tile) * (tile + 1) + F.col("col") - F.col("tile_x") * tile).cast("int")
    pixel = {n: F.get("heights", at + down * (tile + 1) + right) for n, down, right in (("h", 0, 0), ("h01", 0, 1), ("h10", 1, 0), ("h11", 1, 1))}
    out = out.withColumns(pixel).where("h is not null").drop("heights", "tile_y", "tile_x")
    out = out.withColumn("h11", F.when(F.col("h10").isNull(), F.col("h01")).otherwise(F.coalesce("h11", "h10")))
    out = out.withColumns({c: F.coalesce(c, F.col("h")) for c in ("h01", "h10", "h11")})
    return out.withColumn("height", bilinear(F.col("x") - F.col("col"), F.col("y") - F.col("row")))


def map_extent(headers: DataFrame) -> DataFrame:
    return headers.withColumn("lr_x", F.col("ul_x") + F.col("pixel") * (F.col("nx") - 1)).withColumn("lr_y", F.col("ul_y") - F.col("pixel") * (F.col("ny") - 1))


def degree_grid(boxes: DataFrame, per_degree: int = 256) -> DataFrame:
    """All points k / per_degree inside each box (min_x..max_y), as lon and lat."""
    axis = lambda a: F.sequence(F.ceil(F.col(f"min_{a}") * per_degree), F.floor(F.col(f"max_{a}") * per_degree))
    some = boxes.where(" and ".join(f"ceil(min_{a} * {per_degree}) <= floor(max_{a} * {per_degree})" for a in "xy"))
    g = some.withColumn("i", F.explode(axis("x"))).withColumn("j", F.explode(axis("y")))
    return g.withColumn("lon", F.col("i") / per_degree).withColumn("lat", F.col("j") / per_degree)


def _grid(df: DataFrame, nx: Column, ny: Column) -> DataFrame:
    """Explode to y, x for 0 <= y < ny, 0 <= x < nx; nothing if either is below 1."""
    d = df.withColumn("_nx", nx).withColumn("_ny", ny).where("_nx > 0 and _ny > 0")
    d = d.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    return d.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))).drop("_nx", "_ny")


def grid_triangles(grids: DataFrame) -> DataFrame:
    """Two triangles a cell of grids with nx, ny: (a, b, d) and (a, d, c)."""
    g = _grid(grids, F.col("nx") - 1, F.col("ny") - 1).withColumn("a", F.col("y") * F.col("nx") + F.col("x"))
    b, c, d = F.col("a") + 1, F.col("a") + F.col("nx"), F.col("a") + F.col("nx") + 1
    tri = lambda k, *v: F.struct(F.lit(k).alias("half"), *[e.alias(f"v{i}") for i, e in enumerate(v)])
    return g.withColumn("t", F.explode(F.array(tri(0, F.col("a"), b, d), tri(1, F.col("a"), d, c)))).select(*grids.columns, "y", "x", "t.*")


def grid_surface(samples: DataFrame, headers: DataFrame) -> DataFrame:
    """Triangles (a, b, d) and (a, d, c), ``half`` 0 and 1, of the cells (y, x) of rasters, with corners x0, y0, z0 .. x2, y2, z2; those with a pixel that isn't there are left out.

    A pixel is handed to the four cells that it is a corner of, so the cells come from
    one grouping, and pixels aren't joined with their neighbours.
    """
    keys = band_keys(samples, headers)
    corner = [F.struct(F.lit(k).alias("corner"), (F.col("row") - k // 2).alias("y"), (F.col("col") - k % 2).alias("x")) for k in range(4)]  # a, b, c, d
    placed = samples.select(*keys, "h", F.explode(F.array(*corner)).alias("p")).select(*keys, "h", "p.*")
    cells = placed.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("corner") == k, F.col("h"))).alias(f"h{k}") for k in range(4)], F.bit_or(F.expr("shiftleft(1, corner)")).alias("there"))
    halves = F.array(*[F.when(F.col("there").bitwiseAND(m) == m, F.lit(k)) for k, m in enumerate((0b1011, 0b1101))])
    t = cells.withColumn("half", F.explode(F.array_compact(halves))).join(headers.select(*keys, "ul_x", "ul_y", "pixel"), keys)
    first = F.col("half") == 0
    x, y = lambda right: F.col("ul_x") + (F.col("x") + right) * F.col("pixel"), lambda down: F.col("ul_y") - (F.col("y") + down) * F.col("pixel")
    at = {
        "x0": x(0), "y0": y(0), "z0": F.col("h0"),
        "x1": x(1), "y1": F.when(first, y(0)).otherwise(y(1)), "z1": F.when(first, F.col("h1")).otherwise(F.col("h3")),
        "x2": F.when(first, x(1)).otherwise(x(0)), "y2": y(1), "z2": F.when(first, F.col("h3")).otherwise(F.col("h2")),
    }
    return t.select(*keys, "y", "x", "half", *[c.alias(n) for n, c in at.items()])


def grid_quads(grids: DataFrame) -> DataFrame:
    """(a, b, d, c) a cell."""
    g = _grid(grids, F.col("nx") - 1, F.col("ny") - 1).withColumn("a", F.col("y") * F.col("nx") + F.col("x"))
    return g.select(*grids.columns, "y", "x", F.col("a").alias("v0"), (F.col("a") + 1).alias("v1"), (F.col("a") + F.col("nx") + 1).alias("v2"), (F.col("a") + F.col("nx")).alias("v3"))


def grid_outline(grids: DataFrame) -> DataFrame:
    """Horizontal and vertical unit edges."""
    at = F.col("y") * F.col("nx") + F.col("x")
    across = _grid(grids, F.col("nx") - 1, F.col("ny")).select(*grids.columns, F.lit("h").alias("kind"), at.alias("v0"), (at + 1).alias("v1"))
    down = _grid(grids, F.col("nx"), F.col("ny") - 1).select(*grids.columns, F.lit("v").alias("kind"), at.alias("v0"), (at + F.col("nx")).alias("v1"))
    return across.union(down)


def tile_window(pairs: DataFrame) -> DataFrame:
    """Overlap boxes (min_x..max_y) of a map and a texture, with the map's header, to fractional index ranges and numbers of samples."""
    i = {"i_min_x": (F.col("min_x") - F.col("ul_x")) / F.col("pixel"), "i_max_x": (F.col("max_x") - F.col("ul_x")) / F.col("pixel"), "i_min_y": (F.col("ul_y") - F.col("max_y")) / F.col("pixel"), "i_max_y": (F.col("ul_y") - F.col("min_y")) / F.col("pixel")}
    w = pairs.withColumns(i)
    return w.withColumns({f"n_{a}": (F.ceil(f"i_max_{a}") - F.floor(f"i_min_{a}") + 1).cast("int") for a in "xy"})


def tile_blocks(windows: DataFrame) -> DataFrame:
    """Blocks of STEPS steps, up to STEPS + 1 samples, so that neighbours share an edge; blocks under 2 x 2 are left out."""
    n = {a: F.ceil((F.col(f"n_{a}") - 1) / STEPS).cast("int") for a in "xy"}
    b = _grid(windows.withColumnsRenamed({}), n["x"], n["y"]).withColumnsRenamed({"x": "b_x", "y": "b_y"})
    b = b.withColumns({f"size_{a}": F.least(F.lit(STEPS + 1), F.col(f"n_{a}") - F.col(f"b_{a}") * STEPS) for a in "xy"})
    return b.where("size_x > 1 and size_y > 1")


def block_vertices(blocks: DataFrame) -> DataFrame:
    """A row per sample of a block: sample numbers, fractional raster position, lon and lat. The first and last samples of a window sit on its box."""
    v = _grid(blocks, F.col("size_x"), F.col("size_y")).withColumnsRenamed({"x": "j", "y": "i"})
    number = {"x": F.col("b_x") * STEPS + F.col("j"), "y": F.col("b_y") * STEPS + F.col("i")}
    at = {f"s_{a}": F.when(number[a] == 0, F.col(f"i_min_{a}")).when(number[a] == F.col(f"n_{a}") - 1, F.col(f"i_max_{a}")).otherwise(number[a] + F.floor(f"i_min_{a}")) for a in "xy"}
    v = v.withColumns(at)
    return v.withColumn("vertex_idx", F.col("i") * F.col("size_x") + F.col("j")).withColumn("lon", F.col("ul_x") + F.col("pixel") * F.col("s_x")).withColumn("lat", F.col("ul_y") - F.col("pixel") * F.col("s_y"))


def block_strip(blocks: DataFrame) -> DataFrame:
    """One triangle strip a block: pos and vertex_idx. Rows of 2 * size_x, joined by the last lower vertex and the next row's first lower one."""
    bx, by = F.col("size_x"), F.col("size_y")
    s = blocks.withColumn("pos", F.explode(F.sequence(F.lit(0), 2 * bx * (by - 1) + 2 * (by - 2) - 1)))
    i, at = F.floor(F.col("pos") / (2 * bx + 2)).cast("int"), (F.col("pos") % (2 * bx + 2)).cast("int")
    j = F.floor(at / 2).cast("int")
    inside = F.when(at % 2 == 0, i * bx + j).otherwise((i + 1) * bx + j)
    return s.withColumn("vertex_idx", F.when(at < 2 * bx, inside).when(at == 2 * bx, (i + 1) * bx + bx - 1).otherwise((i + 1) * bx))


def recenter(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract each mesh's box centre and keep it as tx, ty, tz."""
    centre = vertices.groupBy(*keys).agg(*[((F.min(a) + F.max(a)) * 0.5).alias(f"t{a}") for a in "xyz"])
    return vertices.join(centre, keys).withColumns({a: F.col(a) - F.col(f"t{a}") for a in "xyz"})


def texture_window(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel window of a box (b0_x.. b1_y) in its texture's box (t_min_x.. t_max_y): floor x, ceil y, at most the size, rows flipped, and the snapped box."""
    span = {a: F.col(f"t_max_{a}") - F.col(f"t_min_{a}") for a in "xy"}
    size = {"x": width, "y": height}
    px = {}
    for k in (0, 1):
        for a, f in (("x", F.floor), ("y", F.ceil)):
            px[f"p{k}_{a}"] = F.least(f((F.col(f"b{k}_{a}") - F.col(f"t_min_{a}")) / span[a] * size[a]), F.lit(size[a])).cast("int")
    w = blocks.withColumns(px)
    w = w.withColumns({f"g{k}_{a}": F.col(f"p{k}_{a}") / size[a] * span[a] + F.col(f"t_min_{a}") for k in (0, 1) for a in "xy"})
    w = w.withColumns({f"w_{a}": F.least(F.abs(F.col(f"p1_{a}") - F.col(f"p0_{a}")) + 1, size[a] - F.least(f"p0_{a}", f"p1_{a}")).cast("int") for a in "xy"})
    return w.withColumn("row0", (height - F.least("p0_y", "p1_y") - F.col("w_y")).cast("int"))


def overview_grid(samples: DataFrame, level: int) -> DataFrame:
    """Means of level x level cells per map and band."""
    return samples.groupBy(*band_keys(samples), F.floor(F.col("row") / level).alias("row"), F.floor(F.col("col") / level).alias("col")).agg(F.avg("h").alias("h"))


def apply_palette(samples: DataFrame, palette: DataFrame) -> DataFrame:
    """Colours of the pixel values; columns that the palette lacks are 1."""
    return samples.join(palette, "value", "left").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("red", "green", "blue", "opacity")})


#: Bytes before the counts of a compressed block, and repeats from which their count takes one byte more.
HEADER, LONGER = 13, (2**6, 2**14, 2**22)


def rle_encode(pixels: DataFrame, raw_bits: int = 32) -> DataFrame:
    """Runs of equal values per block (run_no, value - minimum, repeat) with the minimum, the bit width, and whether runs make the block smaller.

    A run costs its value's bytes and a count of 1 to 4 bytes. The block is smaller if
    its header, counts and values take fewer bytes than its pixels of ``raw_bits``.
    """
    w = W.partitionBy("block_id").orderBy("pos")
    marked = pixels.withColumn("new", F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1))
    runs = marked.withColumn("run_no", F.sum("new").over(w) - 1).groupBy("block_id", "run_no", "v").agg(F.count("*").alias("repeat"))
    per = pixels.groupBy("block_id").agg(F.min("v").alias("minimum"), (F.max("v") - F.min("v")).alias("span"), F.count("*").alias("pixels"))
    per = per.withColumn("bits", F.when(F.col("span") < 0xFF, 8).when(F.col("span") < 0xFFFF, 16).otherwise(32))
    count_bytes = F.lit(1)
    for k in LONGER:
        count_bytes = count_bytes + (F.col("repeat") >= k).cast("int")
    out = runs.join(per, "block_id")
    cost = F.sum(F.expr("bits div 8") + count_bytes).over(W.partitionBy("block_id")) + HEADER
    return out.select("block_id", "run_no", (F.col("v") - F.col("minimum")).alias("value"), "repeat", "minimum", "bits", (cost < F.col("pixels") * (raw_bits // 8)).alias("smaller"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """Pixels (block_id, pos, v) of runs."""
    start = F.coalesce(F.sum("repeat").over(W.partitionBy("block_id").orderBy("run_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = runs.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("repeat") - 1)))
    return e.select("block_id", (F.col("start") + F.col("k")).alias("pos"), (F.col("value") + F.col("minimum")).alias("v"))


def encode_counts(repeats: np.ndarray) -> bytes:
    """Repeats of 1 to 4 bytes, high byte first, whose first two bits say how many more there are."""
    return b"".join((n | (k - 1) << (8 * k - 2)).to_bytes(k, "big") for n in repeats.tolist() for k in (1 + sum(n >= x for x in LONGER),))


def encode_block(low: int, bits: int, values: np.ndarray, repeats: np.ndarray | None) -> bytes:
    """Minimum, number of runs and where the values begin, 4 bytes each, the bit width, then the repeats and the values less the minimum, high byte first. Without repeats, -1 for the runs and all values."""
    counts = b"" if repeats is None else encode_counts(repeats)
    head = struct.pack("<IiIB", low & 0xFFFFFFFF, -1 if repeats is None else len(values), HEADER + len(counts), bits)
    return head + counts + values.astype(f">u{bits // 8}").tobytes()


def encode_tile(pixels: np.ndarray, pixel_type: str, form: str) -> tuple[bytes, bool]:
    """A tile's bytes in the form asked for, and whether they are compressed. Values are taken as the unsigned numbers of their bits."""
    raw = encode_pixels(pixels, pixel_type)
    if form == "raw":
        return raw, False
    x = np.frombuffer(raw, f"<u{PIXEL_BITS[pixel_type] // 8}").astype(np.int64)
    low, span = int(x.min()), int(x.max() - x.min())
    bits = 8 if span < 0xFF else 16 if span < 0xFFFF else 32
    if form == "narrow":
        return encode_block(low, bits, x - low, None), True
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    block = encode_block(low, bits, x[first] - low, np.diff(np.append(first, len(x))))
    return (block, True) if len(block) < len(raw) else (raw, False)


def pack_runs(runs: DataFrame) -> DataFrame:
    """Runs of ``rle_encode`` as one block of bytes each: (block_id, pixels, data). Blocks that runs don't make smaller hold all values in their width."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sizes = [], []
            for rows in b["runs"].to_pylist():
                bits, low = rows[0]["bits"], rows[0]["minimum"]
                values, repeats = np.array([r["value"] for r in rows]), np.array([r["repeat"] for r in rows])
                sizes.append(int(repeats.sum()))
                out.append(encode_block(low, bits, values, repeats) if rows[0]["smaller"] else encode_block(low, bits, np.repeat(values, repeats), None))
            yield pa.RecordBatch.from_arrays([b["block_id"].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["block_id", "pixels", "data"])

    rows = runs.groupBy(F.col("block_id").cast("bigint").alias("block_id")).agg(F.array_sort(F.collect_list(F.struct("run_no", "value", "repeat", "minimum", "bits", "smaller"))).alias("runs"))
    return rows.mapInArrow(pack, "block_id bigint, pixels bigint, data binary")


def _values(data: bytes, bits: int, n: int) -> np.ndarray:
    """n values of 0 to 32 bits, several in a byte from its low bits, several bytes high byte first."""
    if not bits:
        return np.zeros(n, np.int64)
    if bits < 8:
        return decode_pixels(data[: -(-n * bits // 8)], f"u{bits}")[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n).astype(np.int64)


def decode_block(data: bytes, pixels: int, pixel_type: str = "s32") -> np.ndarray:
    """Pixels of a compressed block; runs that go past its size are cut. Sums with the minimum are taken as the bits of the pixel type, also of floats."""
    low, n, begin, bits = struct.unpack_from("<IiIB", data)
    if n == -1:
        found = _values(data[HEADER:], bits, pixels)
    else:
        repeats, at = np.zeros(n, np.int64), HEADER
        for k in range(n):
            more = data[at] >> 6
            repeats[k] = int.from_bytes(data[at : at + 1 + more], "big") & (1 << (6 + 8 * more)) - 1
            at += 1 + more
        found = np.repeat(_values(data[begin:], bits, n), repeats)[:pixels]
    found = (found + low) & 0xFFFFFFFF
    width = PIXEL_BITS[pixel_type]
    return found if width < 8 else found.astype(f"<u{width // 8}").view(LAYOUT[pixel_type])


def unpack_runs(blocks: DataFrame) -> DataFrame:
    """Pixels (block_id, pos, v) of blocks of bytes (block_id, pixels, data)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pixels, data in zip(b["block_id"].to_pylist(), b["pixels"].to_pylist(), b["data"].to_pylist()):
                v = decode_block(data, pixels).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"block_id": np.full(len(v), block), "pos": np.arange(len(v)), "v": v})

    return blocks.select("block_id", "pixels", "data").mapInArrow(unpack, "block_id bigint, pos bigint, v bigint")


def ray_hits(points: DataFrame, triangles: DataFrame, cell: float, levels: int = 12) -> DataFrame:
    """Hits (point columns, triangle columns, t) of the vertical rays through the points (lon, lat, alt).

    Triangles have corners x0, y0, z0 .. x2, y2, z2. Each lies on the level whose
    cells, ``cell`` times a power of two, are as large as its box, and so in four
    cells at most; points look into one cell a level that occurs. Triangles larger
    than the last level's cells take more cells there. Bounds are inclusive,
    flat-on-edge triangles (|a| < 1e-30) never hit. Points outside the triangles' box,
    and triangles outside the points', are left out first.
    """
    low = {a: F.least(*[f"{a}{k}" for k in range(3)]) for a in "xy"}
    high = {a: F.greatest(*[f"{a}{k}" for k in range(3)]) for a in "xy"}
    size = F.greatest(*[high[a] - low[a] for a in "xy"])
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.ceil(F.log2(F.greatest(size, F.lit(cell)) / cell)))).cast("int")
    tri = triangles.withColumn("_level", level)
    width = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    span = lambda a: F.explode(F.sequence(F.floor(low[a] / width), F.floor(high[a] / width)))
    place = {"x": F.col("lon"), "y": F.col("lat")}
    about = lambda lows, highs: [f(c[a]).alias(f"{n}_{a}") for a in "xy" for n, f, c in (("min", F.min, lows), ("max", F.max, highs))]
    of_points = points.agg(F.struct(*about(place, place))).scalar()
    of_triangles = tri.agg(F.struct(F.collect_set("_level").alias("levels"), *about(low, high))).scalar()
    for a in "xy":
        tri = tri.where((high[a] >= of_points[f"min_{a}"]) & (low[a] <= of_points[f"max_{a}"]))
    tri = tri.withColumn("_cell_x", span("x")).withColumn("_cell_y", span("y"))
    some = points
    for a in "xy":
        some = some.where(place[a].between(of_triangles[f"min_{a}"], of_triangles[f"max_{a}"]))
    pts = some.withColumn("_level", F.explode(of_triangles["levels"])).withColumns({"_cell_x": F.floor(F.col("lon") / width), "_cell_y": F.floor(F.col("lat") / width)})
    e1, e2 = ([F.col(f"{a}{k}") - F.col(f"{a}0") for a in "xyz"] for k in (1, 2))
    a = e1[1] * e2[0] - e1[0] * e2[1]
    s = [F.col("lon") - F.col("x0"), F.col("lat") - F.col("y0"), F.col("alt") - F.col("z0")]
    f = 1 / F.when(F.abs(a) >= 1e-30, a)
    u = f * (s[1] * e2[0] - s[0] * e2[1])
    q = [s[1] * e1[2] - s[2] * e1[1], s[2] * e1[0] - s[0] * e1[2], s[0] * e1[1] - s[1] * e1[0]]
    v = f * q[2]
    t = f * (e2[0] * q[0] + e2[1] * q[1] + e2[2] * q[2])
    hit = pts.join(shuffled(tri), ["_level", "_cell_x", "_cell_y"]).where((u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1))
    return hit.withColumn("t", t).drop("_level", "_cell_x", "_cell_y")


def topmost_hit(hits: DataFrame, triangle: str, point: str = "point_id") -> DataFrame:
    """The greatest t of each point, and its triangle (of equal ones the least)."""
    return hits.groupBy(point).agg(F.max("t").alias("t"), F.max_by(triangle, F.struct(F.col("t"), -F.col(triangle))).alias(triangle))


def drape(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """Add the highest hit of the vertical ray through each point to its altitude; points without a hit keep theirs. The greatest t per point is folded before it is joined back."""
    best = ray_hits(points, triangles, cell).groupBy("point_id").agg(F.max("t").alias("t"))
    return points.join(best, "point_id", "left").withColumn("draped", F.col("alt") + F.coalesce("t", F.lit(0.0)))


def drape_paths(points: DataFrame, triangles: DataFrame, levels: list[str], cell: float) -> DataFrame:
    """``drape`` of the points of paths (path_id), each on the meshes whose boxes overlap its own at every level.

    Triangles have the keys of ``levels``, from the batch to the mesh. Overlap is
    strict: a path along a meridian or a parallel, or of one point, has a box without
    an inside, and keeps its altitudes. Points and triangles that are in no pair are
    left out before the rays are cast, the rest of the pairs decides on the hits. Boxes,
    pairs and the triangles left are written, as they are asked for several times.
    """
    corners = [f"{a}{k}" for a in "xy" for k in range(3)]
    with job(points.sparkSession):
        paths = materialize(bbox(points, ["path_id"], {"x": "lon", "y": "lat"}), "paths")
        boxes = triangles.groupBy(*levels).agg(*[f(g(*[c for c in corners if c[0] == a])).alias(f"{n}_{a}") for n, f, g in (("min", F.min, F.least), ("max", F.max, F.greatest)) for a in "xy"])
        pairs = materialize(prune_candidates(paths, materialize(boxes, "meshes"), levels, cell), "pairs")
        some_points = points.join(pairs.select("path_id").distinct(), "path_id", "left_semi")
        some_triangles = triangles.join(pairs.select(*levels).distinct(), levels, "left_semi").select(*levels, *[f"{a}{k}" for a in "xyz" for k in range(3)])
        hits = ray_hits(some_points.select("path_id", "point_id", "lon", "lat", "alt"), materialize(some_triangles, "triangles"), cell)
        best = hits.groupBy("path_id", "point_id", *levels).agg(F.max("t").alias("t")).join(shuffled(pairs), ["path_id", *levels], "left_semi").groupBy("path_id", "point_id").agg(F.max("t").alias("t"))
        return result(points.join(best, ["path_id", "point_id"], "left").withColumn("draped", F.col("alt") + F.coalesce("t", F.lit(0.0))), "draped")
