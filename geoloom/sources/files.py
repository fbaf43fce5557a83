"""Sources and sinks of path, footprint, world and capture files. Explicit schemas, one row a file until its content is flat."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.storage import materialize, numbered

MAGIC, END = 0xAABBCCDD, 0xF0000000
#: Altitude modes by number; 0 is left out, 2 and 4 are plain tags, the others carry the extension's prefix.
ALTITUDE_MODES = {1: "clampToGround", 2: "clampToSeaFloor", 3: "relativeToGround", 4: "relativeToSeaFloor", 5: "Absolute"}


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def write_texts(texts: DataFrame, directory: str, ending: str) -> None:
    """Texts (file, text) to a new ``directory``, which all tasks see, a file each by its name and ``ending``.

    Tasks write the files where they stay: no folder a file, nothing is moved or counted
    by the driver, and a task that is run again writes the same file again.
    """
    contents = texts.select(F.concat(F.coalesce(F.col("file").cast("string"), F.lit("")), F.lit(ending)).alias("path"), F.concat("text", F.lit("\n")).cast("binary").alias("content"))
    write_captures(contents.where("content is not null"), directory).write.format("noop").mode("overwrite").save()


#: What of a KML text decides on its paths: folders and documents, opened and closed, and the shapes; tags may have a prefix.
_KML_TOKEN = r"(?s)<(?:\w+:)?(?:Folder|Document)\b[^>]*>|</(?:\w+:)?(?:Folder|Document)\s*>|<(?:\w+:)?(?:LineString|Polygon)\b.*?</(?:\w+:)?(?:LineString|Polygon)\s*>"


def parse_kml(texts: DataFrame) -> DataFrame:
    """Points of every LineString and Polygon (outer ring): file, path_id, kind, point_idx, lon, lat, alt.

    If a Document has a Folder, only its placemarks inside folders, nested ones
    included, count. Comments and null texts hold nothing.
    """
    plain = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    t = texts.select("file", F.posexplode(F.regexp_extract_all(plain, F.lit(_KML_TOKEN), F.lit(0))).alias("k", "token"))
    name, shut, whole = F.regexp_extract("token", r"^</?(?:\w+:)?(\w+)", 1), F.col("token").startswith("</"), F.col("token").endswith("/>")
    step = F.when(shut, -1).when(whole, 0).otherwise(1)
    order = W.partitionBy("file").orderBy("k")
    t = t.withColumns({"name": name, "folders": F.sum(F.when(name == "Folder", step).otherwise(0)).over(order), "document": F.sum(((name == "Document") & ~shut).cast("int")).over(order)})
    t = t.withColumn("has_folder", F.max(F.col("name") == "Folder").over(W.partitionBy("file", "document")))
    t = t.where(F.col("name").isin("LineString", "Polygon") & (~F.col("has_folder") | (F.col("folders") > 0)))
    points = r"<(?:\w+:)?coordinates[^>]*>(.*?)</(?:\w+:)?coordinates"
    outer, first = F.regexp_extract("token", r"(?s)<(?:\w+:)?outerBoundaryIs\b.*?" + points, 1), F.regexp_extract("token", "(?s)" + points, 1)
    c = F.trim(F.regexp_replace(F.when(outer != "", outer).otherwise(first), r"\s+", " "))
    d = t.select("file", (F.row_number().over(order) - 1).cast("bigint").alias("path_id"), F.col("name").alias("kind"), c.alias("c")).where("c <> ''")
    d = d.select("file", "path_id", "kind", F.posexplode(F.split("c", " ")).alias("point_idx", "triple"))
    part = F.split("triple", ",")
    number = lambda k: F.coalesce(F.try_element_at(part, F.lit(k)).try_cast("double"), F.lit(0.0))
    return d.select("file", "path_id", "kind", F.col("point_idx").cast("bigint").alias("point_idx"), number(1).alias("lon"), number(2).alias("lat"), number(3).alias("alt"))


def read_kml_paths(spark: SparkSession, glob: str, convert: str = "none") -> DataFrame:
    """Paths of KML files; ``convert`` none, sphere or ellipsoid adds cartesian x, y, z."""
    p = parse_kml(read_texts(spark, glob))
    if convert == "none":
        return p
    return p.withColumn("_p", geo.cartesian_position(F.col("lat"), F.col("lon"), F.col("alt"), sphere=convert == "sphere")).select(*p.columns, "_p.*")


def kml_texts(paths: DataFrame, mode: int = 0, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """One KML text per file of paths (path_id, kind, point_idx, lon, lat, alt), points in order."""
    tag = "" if mode == 0 else f"<altitudeMode>{ALTITUDE_MODES[mode]}</altitudeMode>" if mode in (2, 4) else f"<gx:altitudeMode>{ALTITUDE_MODES[mode]}</gx:altitudeMode>"
    triple = F.concat_ws(",", *[F.col(c).cast("string") for c in ("lon", "lat", "alt")])
    lines = paths.groupBy(*keys, "path_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point_idx", triple.alias("t")))), lambda s: s["t"]), " ").alias("c"))
    ring = F.concat(F.lit(f"<Polygon><tessellate>1</tessellate>{tag}<outerBoundaryIs><LinearRing><coordinates>"), "c", F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    line = F.concat(F.lit(f"<LineString><tessellate>1</tessellate>{tag}<coordinates>"), "c", F.lit("</coordinates></LineString>"))
    mark = F.concat(F.lit("<Placemark><name>path_"), F.col("path_id").cast("string"), F.lit("</name><styleUrl>#line</styleUrl>"), F.when(F.col("kind") == "Polygon", ring).otherwise(line), F.lit("</Placemark>"))
    marks = lines.withColumn("mark", mark).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_id", "mark"))), lambda s: s["mark"]), "\n").alias("marks"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document><Style id="line"><LineStyle><width>2</width></LineStyle></Style>\n'
    return marks.select(*keys, F.concat(F.lit(head), "marks", F.lit("\n</Document></kml>")).alias("text"))


def write_kml(paths: DataFrame, directory: str, mode: int = 0, key: str = "file") -> None:
    """One file per value of ``key``, named by it."""
    write_texts(kml_texts(paths, mode, (key,)).select(F.col(key).alias("file"), "text"), directory, ".kml")


def curve_records(paths: DataFrame) -> DataFrame:
    """One degree-1 curve per path: spans n - 1, knots 0 .. n - 1 in lines of 20, control points in centimetres, numbers from 101."""
    ordered = paths.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("point_idx", "x", "y", "z"))).alias("p"))
    n = F.size("p")
    knots = F.sequence(F.lit(0), n - 1)
    lines = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 20).cast("int")), lambda k: F.array_join(F.slice(knots, k * 20 + 1, F.lit(20)).cast("array<string>"), " "))
    points = F.array_join(F.transform("p", lambda s: F.format_string("%.3f %.3f %.3f", s["x"] * 100, s["y"] * 100, s["z"] * 100)), "\n")
    number = numbered(paths.groupBy("path_id").count().where("count > 1").select("path_id"), "path_id").select("path_id", (F.col("number") + 101).cast("int").alias("curve"))
    return ordered.where(n > 1).join(number, "path_id").select("path_id", "curve", (n - 1).alias("spans"), F.array_join(lines, "\n").alias("knots"), points.alias("points"))


def write_curves(paths: DataFrame, directory: str) -> None:
    c = curve_records(paths)
    c.select(F.concat(F.lit("curve "), "curve", F.lit(" 1 "), "spans", F.lit("\n"), "knots", F.lit("\n"), "points").alias("value")).write.text(directory)


def parse_footprints(texts: DataFrame) -> DataFrame:
    """west, east, north, south and UTM zone of metadata texts, by long tags inside bounding or by short ones; the box holds both corners."""
    bounds = F.regexp_extract("text", r"(?s)<bounding>(.*?)</bounding>", 1)

    def number(long: str, short: str) -> Column:
        a, b = F.regexp_extract(bounds, rf"<{long}>\s*([^<\s]+)", 1), F.regexp_extract("text", rf"<{short}>\s*([^<\s]+)", 1)
        return F.when(a != "", a).otherwise(b).try_cast("double")

    d = texts.select("file", number("westbc", "west").alias("w"), number("eastbc", "east").alias("e"), number("northbc", "north").alias("n"), number("southbc", "south").alias("s"), F.regexp_extract("text", r"<utmzone>\s*([0-9]+)", 1).try_cast("int").alias("zone"))
    return d.select("file", F.least("w", "e").alias("west"), F.greatest("w", "e").alias("east"), F.greatest("n", "s").alias("north"), F.least("n", "s").alias("south"), "zone")


def read_footprints(spark: SparkSession, glob: str) -> DataFrame:
    return parse_footprints(read_texts(spark, glob))


def parse_world_files(texts: DataFrame) -> DataFrame:
    """Six numbers in file order a, d, b, e, c, f."""
    v = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return texts.select("file", *[F.try_element_at(v, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate("adbecf")]).select("file", *"abcdef")


def read_world_files(spark: SparkSession, glob: str) -> DataFrame:
    return parse_world_files(read_texts(spark, glob))


CAPTURE = "file string, seq bigint, tag bigint, kind string, link_index bigint, payload binary"


#: Files longer than this are read in ranges of about as many bytes; bytes of payloads handed over at once.
SPLIT, AT_ONCE = 128 << 20, 32 << 20
#: Bytes read ahead while the headers of a long file are walked.
AHEAD = 1 << 16
#: Tasks that the ranges are dealt to at most.
MOST_TASKS = 20_000
#: Files or ranges that a task takes one after the other, if all of them are short.
FILES_A_TASK = 2_000


def tasks_for(spark: SparkSession, n: int, size: int) -> int:
    """Tasks for ``n`` files or ranges of ``size`` bytes in all: by bytes and number, so that short ones share a task; a task for each core at least, if there are as many."""
    return max(1, min(n, MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-size // SPLIT), -(-n // FILES_A_TASK))))


def headers(read: Callable[[int, int], bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(offset, size, tag) of each whole record of a capture of ``length`` bytes up to the end tag; ``read`` gives bytes from an offset."""
    ahead = read(0, AHEAD)
    if len(ahead) < 8 or struct.unpack_from("<I", ahead)[0] != MAGIC:
        return
    base, at = 0, 8
    while at + 8 <= length:
        if at + 8 > base + len(ahead):
            base, ahead = at, read(at, AHEAD)
        size, tag = struct.unpack_from("<II", ahead, at - base)
        if tag == END or at + 8 + size > length:
            return
        yield at, size, tag
        at += 8 + size


def capture_rows(path: str, records: Iterator[tuple[int, int, int]], data: bytes, base: int, first: int) -> Iterator[pd.DataFrame]:
    """Records whose bytes are in ``data``, which begins at the offset ``base``; numbers from ``first``."""
    rows, held = [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "seq", "tag", "kind", "link_index", "payload"]).astype({"link_index": "Int64"})

    for no, (at, size, tag) in enumerate(records, first):
        body = data[at + 8 - base : at + 8 + size - base]
        kind = {1: "command", 2: "data", 3: "picture"}.get(tag >> 28, "skipped")
        link = struct.unpack_from("<I", body)[0] if kind == "data" and size >= 4 else None
        rows.append((path, no, tag, kind, link, bytes(body[4:] if link is not None else body)))
        held += size + 64
        if held > AT_ONCE:
            yield frame()
            rows, held = [], 0
    if rows:
        yield frame()


def parse_capture(files: DataFrame) -> DataFrame:
    """Records of capture files (path, content): magic, version, then (byte count, tag, payload) up to the end tag.

    Data records begin with their link index. Other files and cut-off tails give no
    further records.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if content is not None:
                    yield from capture_rows(path, headers(lambda at, n: content[at : at + n], len(content)), content, 0, 0)  # noqa: B023

    return files.select("path", "content").mapInPandas(scan, CAPTURE)


def store_of(address: str):
    """The store that an address names, and the name within it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(f"file://{address[5:]}" if address.startswith("file:/") and not address.startswith("file://") else address)


def opened(path: str):
    """A file to be read at any place, from the store that its address names."""
    store, name = store_of(path)
    return store.open_input_file(name)


def reader(f) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


def index_captures(listed: DataFrame, split: int = SPLIT) -> DataFrame:
    """Byte ranges (path, begin, end, first) of whole records of the files (path, length), about ``split`` bytes long each, and the number of the first record. A task walks the headers of a file and skips the payloads."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                ranges, begin, first, end, count = [], None, 0, 0, 0
                with opened(path) as f:
                    for at, size, _ in headers(reader(f), length):
                        if begin is not None and at - begin >= split:
                            ranges.append((path, begin, end, first))
                            begin = None
                        if begin is None:
                            begin, first = at, count
                        end, count = at + 8 + size, count + 1
                if begin is not None:
                    ranges.append((path, begin, end, first))
                yield pd.DataFrame(ranges, columns=["path", "begin", "end", "first"])

    return listed.select("path", "length").mapInPandas(walk, "path string, begin bigint, end bigint, first bigint")


def parse_ranges(ranges: DataFrame) -> DataFrame:
    """Records of the ranges of ``index_captures``; a task holds one range at a time."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, begin, end, first in zip(batch["path"], batch["begin"], batch["end"], batch["first"]):
                with opened(path) as f:
                    data = reader(f)(begin, end - begin)
                at, records = begin, []
                while at < end:
                    size, tag = struct.unpack_from("<II", data, at - begin)
                    records.append((at, size, tag))
                    at += 8 + size
                yield from capture_rows(path, iter(records), data, begin, first)

    return ranges.mapInPandas(scan, CAPTURE)


def read_capture(spark: SparkSession, glob: str, split: int = SPLIT) -> DataFrame:
    """Records of capture files of any length.

    Files of up to ``split`` bytes are read whole, by Spark's reader. Of longer ones a
    task first finds where records begin, and ranges of whole records are then read by
    tasks of their own, through the store that the file's address names. Such a range
    is as long as ``split`` and its last record.
    """
    found = spark.read.format("binaryFile").load(glob)
    short = parse_capture(found.where(F.col("length") <= split))
    long = found.where(F.col("length") > split).select("path", "length")
    files, size = long.agg(F.count("*"), F.sum("length")).first()  # a listing; contents aren't read
    if not files:
        return short
    ranges = materialize(index_captures(long.repartition(tasks_for(spark, files, size)), split), "ranges")
    n, size = ranges.agg(F.count("*"), F.sum(F.col("end") - F.col("begin"))).first()
    return short.union(parse_ranges(ranges.repartition(tasks_for(spark, n, size or 0))))


def pack_capture(records: DataFrame) -> DataFrame:
    """The files of records (path, seq, tag, payload), as (path, content)."""
    size, tag = (lambda c: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), k, 2) for k in (7, 5, 3, 1)])) for _ in "ab")
    record = F.concat(size(F.length("payload").cast("bigint")), tag(F.col("tag")), F.col("payload"))
    body = records.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", record.alias("r")))).alias("rs"))
    head = F.unhex(F.lit("DDCCBBAA01000000"))
    # put together at once: adding records one by one would copy a file once a record
    joined = F.unhex(F.array_join(F.transform("rs", lambda x: F.hex(x["r"])), ""))
    return body.select("path", F.concat(head, joined, F.unhex(F.lit("00000000000000F0"))).alias("content"))


def write_captures(captures: DataFrame, directory: str) -> DataFrame:
    """Files (path, content) to ``directory``, which all tasks see, one each; returns the addresses. A task that is run again writes the same file again."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(directory)
        for batch in batches:
            names = [f"{root}/{quote(path, safe='')}" for path in batch["path"]]
            for name, content in zip(names, batch["content"]):
                with store.open_output_stream(name) as f:
                    f.write(content)
            yield pd.DataFrame({"path": names})

    store, root = store_of(directory)
    store.create_dir(root, recursive=True)
    return captures.select("path", "content").mapInPandas(write, "path string")


def explode_vertex_stream_blocks(data: DataFrame) -> DataFrame:
    """Sub-blocks (reference tag, size, bytes) of vertex-stream records: file, seq, block_no, ref_tag, data."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, seq, body in zip(batch["file"], batch["seq"], batch["payload"]):
                at = no = 0
                while at + 16 <= len(body):
                    tag, size = struct.unpack_from("<qQ", body, at)
                    if at + 16 + size > len(body):
                        break
                    rows.append((file, seq, no, tag, bytes(body[at + 16 : at + 16 + size])))
                    at, no = at + 16 + size, no + 1
            yield pd.DataFrame(rows, columns=["file", "seq", "block_no", "ref_tag", "data"])

    return data.select("file", "seq", "payload").mapInPandas(scan, "file string, seq bigint, block_no bigint, ref_tag bigint, data binary")


def unpack_vertices(blocks: DataFrame, stride: int, offset: int, n: int) -> DataFrame:
    """Vertices of buffers: keys, vertex_idx, n floats from ``offset``, and the four bytes after them as a colour (those past the end are 0)."""
    names = ["file", "seq", "block_no", "vertex_idx", "values", "color"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([x or 0 for x in pc.binary_length(b["data"]).to_pylist()], np.int64)
            begins = np.cumsum(sizes) - sizes
            raw = np.frombuffer(b"".join(x or b"" for x in b["data"].to_pylist()), np.uint8)
            counts = np.where(sizes >= offset + 4 * n, (sizes - offset - 4 * n) // stride + 1, 0)
            firsts = np.cumsum(counts) - counts
            for x, y in slices(counts):
                block = np.repeat(np.arange(x, y), counts[x:y])
                idx = np.arange(len(block)) + firsts[x] - firsts[block]
                at = begins[block] + offset + stride * idx
                floats = raw[at[:, None] + np.arange(4 * n)].view("<f4").astype(float).reshape(-1)
                colour = np.zeros(len(block), np.int64)
                for k in range(4):
                    there = at + 4 * n + k < begins[block] + sizes[block]
                    colour[there] |= raw[at[there] + 4 * n + k].astype(np.int64) << (8 * k)
                values = pa.ListArray.from_arrays(np.arange(len(block) + 1, dtype=np.int32) * n, pa.array(floats))
                keys = [b[c].take(pa.array(block)) for c in names[:3]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(idx.astype(np.int64)), values, pa.array(colour)], names=names)

    return blocks.select("file", "seq", "block_no", "data").mapInArrow(scan, "file string, seq bigint, block_no bigint, vertex_idx bigint, values array<double>, color bigint")


def slices(counts: np.ndarray, rows: int = 100_000) -> Iterator[tuple[int, int]]:
    """Spans of blocks of about ``rows`` rows each, a block at least; those without rows may be left out."""
    total = np.cumsum(counts)
    x = 0
    while x < len(counts):
        y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + rows, "right")))
        if total[y - 1] > (total[x - 1] if x else 0):
            yield x, y
        x = y


def paths_to_lines(points: DataFrame) -> DataFrame:
    """Lines keep all points."""
    return points.where("kind = 'LineString'")


def ordered_points(points: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a path with its points in file order, as structs of point_idx and ``columns``."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("point_idx", *columns))).alias("points"))


def polygons_to_loops(points: DataFrame) -> DataFrame:
    """Polygon loops without the closing point."""
    keys = [c for c in ("file", "path_id") if c in points.columns]
    n = F.count("*").over(W.partitionBy(*keys))
    k = F.row_number().over(W.partitionBy(*keys).orderBy("point_idx"))
    return points.where("kind = 'Polygon'").withColumn("_k", k).withColumn("_n", n).where("_k < _n").drop("_k", "_n")
