"""Names, codes, paths and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
PRIMITIVES = ["points", "lines", "lineloop", "linestrip", "triangles", "trianglestrip", "trianglefan", "quads", "quadstrip", "polygon"]
#: Bytes of a data element by its graphics type; others have 4.
ELEMENT_SIZES = {
    0x1400: 1, 0x1401: 1, 0x8032: 1, 0x8362: 1,
    0x1402: 2, 0x1403: 2, 0x1407: 2, 0x8363: 2, 0x8364: 2, 0x8033: 2, 0x8365: 2, 0x8034: 2, 0x8366: 2,
    0x1408: 3,
    0x1404: 4, 0x1405: 4, 0x1406: 4, 0x1409: 4, 0x8035: 4, 0x8367: 4, 0x8036: 4, 0x8368: 4,
    0x140A: 8,
}
PIXEL_TYPES = [("u1", 1), ("u2", 2), ("u4", 4), ("u8", 8), ("s8", 8), ("u16", 16), ("s16", 16), ("u32", 32), ("s32", 32), ("f32", 32), ("f64", 64), ("c64", 64), ("c128", 128)]


def split_path(path: Column) -> dict[str, Column]:
    """Root up to the last / or \\, stem, and extension after the last dot."""
    return {"root": F.regexp_extract(path, r"(?s)^(.*[/\\])?", 0), "stem": F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1), "extension": F.regexp_extract(path, r"\.([^./\\]*)$", 1)}


def six_digits(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros."""
    size = F.abs(x)
    out = F.round(x, 8)
    for least, places in ((0.01, 7), (0.1, 6), (1, 5), (10, 4), (100, 3)):
        out = F.when(size >= least, F.round(x, places)).otherwise(out)
    return F.regexp_replace(out.cast("string"), r"\.0$", "")


def tile_request_key(lon: Column, lat: Column, zoom: Column) -> Column:
    return F.concat(F.lit("lon@"), six_digits(lon), F.lit("_lat@"), six_digits(lat), F.lit("_zoom@"), zoom.cast("string"))


#: Pixels of a requested tile, and the margin above and below it, which the request adds to its height.
TILE_PIXELS, TILE_MARGIN = 512, 22


def tile_request(lon: Column, lat: Column, zoom: Column, width: int = TILE_PIXELS, height: int = TILE_PIXELS) -> dict[str, Column]:
    """Key, centre and size of the request for a tile; the height has the margin on both sides."""
    size = F.lit(f"{width}x{height + 2 * TILE_MARGIN}")
    return {"key": tile_request_key(lon, lat, zoom), "center": F.concat(six_digits(lat), F.lit(","), six_digits(lon)), "size": size}


def primitive_name(code: Column) -> Column:
    return F.when((code >= 0) & (code < len(PRIMITIVES)), F.element_at(F.array(*map(F.lit, PRIMITIVES)), code.cast("int") + 1))


def element_size(code: Column) -> Column:
    out = F.lit(4)
    for k, v in ELEMENT_SIZES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def effective_stride(stride: Column, n: Column, code: Column) -> Column:
    return F.when(stride != 0, stride).otherwise(n * element_size(code))


def pixel_type(code: Column) -> dict[str, Column]:
    inside = (code >= 0) & (code < len(PIXEL_TYPES))
    at = code.cast("int") + 1
    return {"pixel_type": F.when(inside, F.element_at(F.array(*[F.lit(n) for n, _ in PIXEL_TYPES]), at)), "bits": F.when(inside, F.element_at(F.array(*[F.lit(b) for _, b in PIXEL_TYPES]), at))}


def texture_export_kind(fmt: Column) -> Column:
    return F.when(fmt.isin("rgb", "rgba", "dxt1"), "jpg").when(fmt.isin("dxt3", "dxt5"), "dds").otherwise("error")


def _rgb(c: Column) -> list[Column]:
    """Channels of a 5:6:5 colour in the high bits of a byte."""
    return [F.shiftleft(F.shiftright(c, s).bitwiseAND(m), up).cast("bigint") for s, m, up in ((11, 31, 3), (5, 63, 2), (0, 31, 3))]


def dxt1_decode(blocks: DataFrame) -> DataFrame:
    """16 pixels a block (c0, c1, idx): pixel, r, g, b, a. c0 <= c1 has three colours and a clear one."""
    a, b = _rgb(F.col("c0")), _rgb(F.col("c1"))
    four = F.col("c0") > F.col("c1")
    third = [F.when(four, F.expr(f"(2 * a{k} + b{k}) div 3")).otherwise(F.expr(f"(a{k} + b{k}) div 2")) for k in range(3)]
    fourth = [F.when(four, F.expr(f"(a{k} + 2 * b{k}) div 3")).otherwise(F.lit(0)) for k in range(3)]
    d = blocks.withColumns({f"a{k}": a[k] for k in range(3)} | {f"b{k}": b[k] for k in range(3)} | {"four": four})
    d = d.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("code", F.expr("shiftright(idx, 2 * pixel) & 3"))
    pick = lambda k: F.when(F.col("code") == 0, F.col(f"a{k}")).when(F.col("code") == 1, F.col(f"b{k}")).when(F.col("code") == 2, third[k]).otherwise(fourth[k])
    alpha = F.when((F.col("code") == 3) & ~F.col("four"), 0).otherwise(255)
    return d.select("block_id", "pixel", *[pick(k).alias(c) for k, c in enumerate("rgb")], alpha.alias("a"))


def dxt1_encode(pixels: DataFrame) -> DataFrame:
    """Blocks of 16 pixels (pixel, r, g, b) to c0, c1, idx.

    The ends are the corners of the colour box, inset by a sixteenth, in 5:6:5 with
    the high bits repeated below. A pixel takes one of the two colours between them
    if it is nearer than both ends (sum of absolute differences), else an end.
    Pixels of 8 bits a channel are folded to a row a block, which is shuffled once and
    unfolded in its place, so none is joined with its block's ends. A block may lack pixels, and a pixel that lacks a channel has no code.
    """
    inset = lambda c: F.expr(f"(max({c}) - min({c})) div 16")
    colour = F.expr("(r << 16) | (g << 8) | b").cast("int")
    ends = pixels.where("block_id is not null").groupBy("block_id").agg(*[(F.max(c) - inset(c)).alias(f"hi_{c}") for c in "rgb"], *[(F.min(c) + inset(c)).alias(f"lo_{c}") for c in "rgb"], *[F.max(F.when(F.col("pixel") == k, colour)).alias(f"p{k}") for k in range(16)])
    pack = lambda p: F.expr(f"(({p}_r div 8) << 11) | (({p}_g div 4) << 5) | ({p}_b div 8)")
    repeat = lambda c, low: F.col(c).bitwiseAND(0xFF - low).bitwiseOR(F.shiftright(c, 6 if low == 3 else 5)).cast("bigint")
    colours = ends.withColumns({"c0": pack("hi"), "c1": pack("lo")} | {f"{n}{k}": repeat(f"{e}_{c}", 3 if c == "g" else 7) for n, e in (("a", "hi"), ("b", "lo")) for k, c in enumerate("rgb")})
    tables = [[F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)], [F.expr(f"(2 * a{k} + b{k}) div 3") for k in range(3)], [F.expr(f"(a{k} + 2 * b{k}) div 3") for k in range(3)]]
    each = F.posexplode(F.array(*[f"p{k}" for k in range(16)])).alias("pixel", "packed")
    j = colours.select("block_id", "c0", "c1", *[f"{e}{k}" for e in "ab" for k in range(3)], each)
    j = j.withColumns({c: F.shiftright("packed", s).bitwiseAND(0xFF) for c, s in (("r", 16), ("g", 8), ("b", 0))})
    j = j.withColumns({f"d{n}": sum((F.abs(F.col(c) - t[k]) for k, c in enumerate("rgb")), F.lit(0)) for n, t in enumerate(tables)})
    between = F.expr("(d2 < d0 and d2 < d1) or (d3 < d0 and d3 < d1)")
    far = F.expr("d3 < d0 and d3 < d2")
    return j.withColumn("bits", between.cast("bigint") * 2 + far.cast("bigint")).groupBy("block_id", "c0", "c1").agg(F.sum(F.expr("shiftleft(bits, cast(2 * pixel as int))")).alias("idx"))


def flip_and_swap(pixels: DataFrame, height: str = "height", swap: bool = True) -> DataFrame:
    """Rows upside down; red and blue exchanged on demand."""
    out = pixels.withColumn("y", F.col(height) - 1 - F.col("y"))
    return out.withColumns({"r": F.col("b"), "b": F.col("r")}) if swap else out


def texture_summary(levels: DataFrame, header: int = 128) -> DataFrame:
    """Levels, file size and base size of textures; of repeated (texture, level) the last write counts."""
    last = levels.groupBy("texture_id", "level").agg(F.max_by(F.struct("width", "height", "size"), "write_no").alias("w"))
    base = lambda c: F.max(F.when(F.col("level") == 0, F.col(f"w.{c}")))
    return last.groupBy("texture_id").agg((F.max("level") + 1).cast("bigint").alias("levels"), (F.sum("w.size") + header).alias("bytes"), base("width").alias("width"), base("height").alias("height"), base("size").alias("linear_size"))
