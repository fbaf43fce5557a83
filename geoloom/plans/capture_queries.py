"""Queries over captures, meshes, textures, lookups, selection and files, and their SQL twins."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import codes, geo, text
from geoloom.operators import capture, lookup, mesh
from geoloom.plans.fixtures import sql, view
from geoloom.plans.geodesy import ECEF, ENU, origin, r
from geoloom.sources import files
from geoloom.storage import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text_: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text_:
            SQL[name] = text_
        return f

    return put


def rec(spark, d) -> DataFrame:
    return view(spark, d, "capture_record")


_W = "OVER (PARTITION BY dump_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_last = lambda e, none: f"coalesce(last_value({e} IGNORE NULLS) {_W}, {none})"
_when = lambda tag, value, k=None: f"CASE WHEN tag='{tag}'{'' if k is None else f' AND index={k}'} THEN {value} END"
_STATE = {
    "matrix": _last(_when("matrix", "arg"), -1), "slot": _last(_when("enable", "arg % 4"), 0),
    "array_buffer": _last(_when("array_buffer", "CASE WHEN arg <> 0 THEN arg ELSE -1 END"), -1), "element_buffer": _last(_when("element_buffer", "CASE WHEN arg <> 0 THEN arg ELSE -1 END"), -1),
    **{f"enabled_{k}": _last(f"coalesce({_when('enable_attribute', 1, k)}, {_when('disable_attribute', 0, k)})", 0) for k in (0, 2, 3)},
    **{f"pointer_{k}": _last(_when("attribute_pointer", "arg", k), -1) for k in (0, 2, 3)},
}
_STATE2 = {"texture": _last("CASE WHEN slot = 0 THEN CASE tag WHEN 'bind_texture' THEN arg WHEN 'disable_texture' THEN -1 END END", -1), **{f"buffer_{k}": _last(_when("attribute_pointer", "array_buffer", k), -1) for k in (0, 2, 3)}}
_cols = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())


@query("w01_draw_state_asof", sql("state_record", f", s AS (SELECT *, {_cols(_STATE)} FROM state_record), t AS (SELECT *, {_cols(_STATE2)} FROM s) SELECT dump_id, seq, {', '.join([*_STATE, *_STATE2])} FROM t WHERE tag='draw'"))
def w01(spark, d):
    return capture.draw_state_asof(view(spark, d, "state_record"))


@query("w02_dispatch_number", sql("capture_record", "SELECT dump_id, seq, tag, row_number() OVER (PARTITION BY dump_id ORDER BY seq) - 1 AS dispatch FROM capture_record WHERE tag IN ('draw','clear')"))
def w02(spark, d):
    return capture.dispatch_number(rec(spark, d)).select("dump_id", "seq", "tag", "dispatch")


@query("w01_one_dump", sql("state_record", f", s AS (SELECT 0 AS dump_id, seq, tag, arg, index FROM state_record), t AS (SELECT *, {_cols(_STATE)} FROM s), u AS (SELECT *, {_cols(_STATE2)} FROM t) SELECT seq, {', '.join([*_STATE, *_STATE2])} FROM u WHERE tag='draw'"))
def w01o(spark, d):
    """All records as one dump, in chunks of 100."""
    return capture.draw_state_asof(view(spark, d, "state_record").withColumn("dump_id", F.lit(0)), chunk=100).drop("dump_id")


@query("w03_data_sequence_gaps", sql("capture_record", ", k AS (SELECT dump_id, seq, seq + seq // 97 + CASE WHEN seq % 211 = 5 THEN 3 ELSE 0 END AS stamp FROM capture_record), l AS (SELECT dump_id, seq, stamp, lag(stamp) OVER (PARTITION BY dump_id ORDER BY seq) + 1 AS expected FROM k) SELECT * FROM l WHERE stamp <> expected"))
def w03(spark, d):
    """Stamps that jump at every 97th record, and stray at others; chunks of 64."""
    c = rec(spark, d).withColumn("stamp", F.expr("seq + seq div 97 + CASE WHEN seq % 211 = 5 THEN 3 ELSE 0 END"))
    return capture.data_sequence_gaps(c, "stamp", chunk=64).select("dump_id", "seq", "stamp", "expected")


_TRI = [["1e0 + arg % 7", "CAST(arg % 3 AS DOUBLE)", "CAST(arg % 5 AS DOUBLE)", "0e0"], ["0e0", "2e0 + arg % 4", "CAST(arg % 2 AS DOUBLE)", "0e0"], ["0e0", "0e0", "1e0 + arg % 6", "0e0"], ["CAST(arg % 100 AS DOUBLE)", "CAST(arg % 90 AS DOUBLE)", "CAST(arg % 80 AS DOUBLE)", "1e0"]]
_m = lambda i, j: f"m[{4 * i + j + 1}]"


def _solve() -> str:
    """SQL of M * inverse(F) for the matrices of _TRI."""
    steps = []
    for i in range(4):
        last = f"(k.{_m(i, 3)})"
        move = lambda j: f"(k.{_m(i, j)} - {last}*f.{_m(3, j)})"  # noqa: B023, E731
        a = f"({move(0)}/f.{_m(0, 0)})"
        b = f"(({move(1)}-{a}*f.{_m(0, 1)})/f.{_m(1, 1)})"
        c = f"(({move(2)}-{a}*f.{_m(0, 2)}-{b}*f.{_m(1, 2)})/f.{_m(2, 2)})"
        steps += [f"round({x},6)+0.0 AS m{4 * i + j}" for j, x in enumerate((a, b, c, last))]
    return ", ".join(steps)


@query("w04_first_inverse_matrix", sql("capture_record", f", k AS (SELECT dump_id, seq, [{', '.join(x for row in _TRI for x in row)}] AS m FROM capture_record WHERE tag='draw'), f AS (SELECT dump_id, arg_min(m, seq) AS m FROM k GROUP BY dump_id) SELECT k.dump_id, seq, {_solve()} FROM k JOIN f ON f.dump_id = k.dump_id"))
def w04(spark, d):
    """Matrices with scales, shears and translations of their own."""
    draws = rec(spark, d).where("tag = 'draw'").withColumn("m", F.array(*[F.expr(x) for row in _TRI for x in row]))
    return capture.relative_matrices(draws).select("dump_id", "seq", *[r(F.col("relative")[k], 6).alias(f"m{k}") for k in range(16)])


@query("w05_texture_slots_by_first_use", sql("capture_record", ", f AS (SELECT dump_id, arg % 20 AS texture, min(seq) AS first FROM capture_record WHERE tag='bind_texture' GROUP BY ALL) SELECT dump_id, texture, row_number() OVER (PARTITION BY dump_id ORDER BY first) - 1 AS index FROM f"))
def w05(spark, d):
    binds = rec(spark, d).where("tag = 'bind_texture'").withColumn("texture", F.col("arg") % 20)
    return capture.texture_slots_by_first_use(binds, "texture")


@query("f05_cut_after_end_of_capture", sql("capture_record", ", e AS (SELECT dump_id, min(seq) AS stop FROM capture_record WHERE tag='clear' AND stencil GROUP BY dump_id) SELECT c.dump_id, seq, arg FROM capture_record c LEFT JOIN e USING (dump_id) WHERE tag='draw' AND (stop IS NULL OR seq < stop OR arg % 2 = 1)"))
def f05(spark, d):
    return capture.cut_after_end(rec(spark, d), F.col("arg") % 2 == 1).select("dump_id", "seq", "arg")


_CODE = "CASE tag WHEN 'matrix' THEN 1 WHEN 'bind_texture' THEN 2 WHEN 'enable' THEN 3 WHEN 'draw' THEN 4 ELSE 15 END"


@query("f09_records_of_class", sql("capture_record", f"SELECT dump_id, seq, CASE {_CODE} WHEN 1 THEN 'command' WHEN 2 THEN 'data' WHEN 3 THEN 'picture' WHEN 15 THEN 'end' ELSE 'skipped' END AS kind, arg AS function FROM capture_record"))
def f09(spark, d):
    c = rec(spark, d).withColumn("code", F.shiftleft(F.expr(_CODE).cast("bigint"), 28) + F.col("arg"))
    return capture.records_of_class(c).select("dump_id", "seq", "kind", "function")


_b = lambda k: f"(arg // {1 << k}) % 2 = 1"


@query("f03_filter_drawable_draws", sql("capture_record", f"SELECT dump_id, seq FROM capture_record WHERE tag='draw' AND (({_b(0)} AND {_b(1)} AND {_b(2)} AND {_b(3)} AND {_b(4)} AND {_b(5)}) OR ({_b(6)} AND {_b(0)} AND ({_b(1)} OR arg % 3 > 0)))"))
def f03(spark, d):
    bit = [F.shiftright("arg", k).bitwiseAND(1) == 1 for k in range(7)]
    ok = capture.drawable(*bit[:6], bit[6], F.col("arg") % 3)
    return rec(spark, d).where("tag = 'draw'").where(ok).select("dump_id", "seq")


# columns of codes, one a domain: every third record has a code of the domain, by its number in order, the others any
_CODED = list(codes.DOMAINS)
_some = lambda k, d: f"CASE WHEN (seq + {k}) % 3 = 0 THEN list_extract([{', '.join(map(str, codes.codes_of(d)))}], CAST(arg % {len(codes.codes_of(d))} AS BIGINT) + 1) WHEN arg % 11 = {k} THEN NULL ELSE {min(codes.codes_of(d))} + (arg * 7) % 40000 END"
_allowed = " UNION ALL ".join(f"SELECT '{d}' AS domain, unnest([{', '.join(map(str, codes.codes_of(d)))}]) AS code" for d in _CODED)


@query("f06_validate_codes", sql("capture_record", f", dom AS ({_allowed}), c AS ({' UNION ALL '.join(f"SELECT seq, 'c{k}' AS \"column\", '{d}' AS domain, {_some(k, d)} AS code FROM capture_record" for k, d in enumerate(_CODED))}) SELECT seq, \"column\", domain, code FROM c WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.domain = c.domain AND dom.code = c.code)"))
def f06(spark, d):
    """Violations of all seven domains."""
    coded = rec(spark, d)
    for k, name in enumerate(_CODED):
        own = codes.codes_of(name)
        good = F.element_at(F.array(*map(F.lit, own)), (F.col("arg") % len(own) + 1).cast("int")).cast("bigint")
        coded = coded.withColumn(f"c{k}", F.when((F.col("seq") + k) % 3 == 0, good).when(F.col("arg") % 11 == k, F.lit(None)).otherwise(min(own) + (F.col("arg") * 7) % 40000))
    return capture.validate_codes(coded, {f"c{k}": name for k, name in enumerate(_CODED)}, codes.domain_table(spark), ["seq"])


_DATA = ", dat AS (SELECT dump_id, 100 + row_number() OVER (PARTITION BY dump_id ORDER BY seq) AS link_index, arg AS data FROM capture_record WHERE tag='enable')"


def data_blocks(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    return rec(spark, d).where("tag = 'enable'").select("dump_id", (100 + F.row_number().over(W.partitionBy("dump_id").orderBy("seq"))).cast("bigint").alias("link_index"), F.col("arg").alias("data"))


@query("j09_resolve_data_refs", sql("capture_record", f"{_DATA}, f AS (SELECT dump_id, min(link_index) AS first FROM dat GROUP BY dump_id), q AS (SELECT c.dump_id, seq, CASE WHEN arg % 50 = 0 THEN first ELSE 100 + arg % 200 END AS link_index FROM capture_record c LEFT JOIN f USING (dump_id) WHERE tag='draw') SELECT q.dump_id, seq, q.link_index, data FROM q LEFT JOIN dat USING (dump_id, link_index)"))
def j09(spark, d):
    draws = rec(spark, d).where("tag = 'draw'").select("dump_id", "seq", F.when(F.col("arg") % 50 == 0, 0).otherwise(100 + F.col("arg") % 200).alias("address"))
    return capture.resolve_data_refs(draws, data_blocks(spark, d)).select("dump_id", "seq", "link_index", "data")


@query("j10_resolve_vertex_streams", sql("capture_record", ", b AS (SELECT dump_id, arg % 100 AS low, min(seq) AS block_no FROM capture_record WHERE tag='matrix' GROUP BY ALL) SELECT c.dump_id, seq, block_no FROM capture_record c LEFT JOIN b ON b.dump_id=c.dump_id AND low = arg % 120 AND arg % 120 <> 0 WHERE tag='draw'"))
def j10(spark, d):
    blocks = rec(spark, d).where("tag = 'matrix'").select("dump_id", (F.col("arg") % 100 + F.lit(1 << 33)).alias("ref_tag"), F.col("seq").alias("block_no"))
    draws = rec(spark, d).where("tag = 'draw'").select("dump_id", "seq", (F.col("arg") % 120).alias("stream_tag"))
    return capture.resolve_vertex_streams(draws, blocks).select("dump_id", "seq", "block_no")


@query("j11_resolve_buffers", sql("capture_record", ", u AS (SELECT dump_id, arg % 30 AS buffer, arg_max(arg, seq) AS upload FROM capture_record WHERE tag='enable' GROUP BY ALL) SELECT c.dump_id, seq, arg % 40 AS buffer, upload FROM capture_record c LEFT JOIN u ON u.dump_id=c.dump_id AND u.buffer = arg % 40 WHERE tag='draw'"))
def j11(spark, d):
    up = rec(spark, d).where("tag = 'enable'").select("dump_id", "seq", (F.col("arg") % 30).alias("buffer"), F.col("arg").alias("upload"))
    draws = rec(spark, d).where("tag = 'draw'").select("dump_id", "seq", (F.col("arg") % 40).alias("buffer"))
    return capture.resolve_buffers(draws, up).select("dump_id", "seq", "buffer", "upload")


@query("j14_unknown_tag_candidates", sql("capture_record", """, fn AS (SELECT p_partkey AS function_tag, p_name || '#' || p_partkey AS name, p_size % 4 AS pointers, p_partkey % 7 AS params, p_size % 2 AS returns FROM part WHERE p_size > 20), q AS (SELECT DISTINCT dump_id, arg % 3000 AS tag, arg % 9 AS words FROM capture_record)
SELECT dump_id, tag, words, array_to_string(list_sort(list(name)), ',') AS names FROM q JOIN fn ON pointers = 0 AND params + returns = words WHERE tag NOT IN (SELECT function_tag FROM fn) AND function_tag NOT IN (SELECT tag FROM q) GROUP BY dump_id, tag, words"""))
def j14(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").where("p_size > 20")
    fn = p.select(F.col("p_partkey").alias("function_tag"), F.concat("p_name", F.lit("#"), "p_partkey").alias("name"), (F.col("p_size") % 4).alias("pointers"), (F.col("p_partkey") % 7).alias("params"), (F.col("p_size") % 2).alias("returns"))
    q = rec(spark, d).select("dump_id", (F.col("arg") % 3000).alias("tag"), (F.col("arg") % 9).alias("words"))
    return capture.unknown_tag_candidates(q, fn, ",")


@query("t03_primitive_name", sql("capture_record", "SELECT seq, (['points','lines','lineloop','linestrip','triangles','trianglestrip','trianglefan','quads','quadstrip','polygon'])[arg % 12 + 1] AS primitive FROM capture_record"))
def t03(spark, d):
    return rec(spark, d).select("seq", text.primitive_name(F.col("arg") % 12).alias("primitive"))


@query("t04_element_size", sql("capture_record", ", e AS (SELECT seq, arg, CASE WHEN arg % 14 < 2 THEN 1 WHEN arg % 14 IN (2, 3, 7) THEN 2 WHEN arg % 14 = 8 THEN 3 WHEN arg % 14 = 10 THEN 8 ELSE 4 END AS s FROM capture_record) SELECT seq, CAST(s AS INTEGER) AS element_size, CAST(CASE WHEN arg % 5 <> 0 THEN arg % 5 ELSE 3 * s END AS BIGINT) AS stride FROM e"))
def t04(spark, d):
    code = 5120 + F.col("arg") % 14
    return rec(spark, d).select("seq", text.element_size(code).alias("element_size"), text.effective_stride(F.col("arg") % 5, F.lit(3), code).cast("bigint").alias("stride"))


@query("t01_split_path", sql("gps_point", """SELECT point_id, 'data/' || path_id || '\\' AS root, 'tile.' || point_id AS stem, 'kml' AS extension FROM gps_point"""))
def t01(spark, d):
    path = F.concat(F.lit("data/"), "path_id", F.lit("\\tile."), "point_id", F.lit(".kml"))
    return view(spark, d, "gps_point").select("point_id", *[c.alias(n) for n, c in text.split_path(path).items()])


@query("t02_tile_request_key", sql("gps_point", "SELECT point_id, 'lon@' || printf('%g', lon) || '_lat@' || printf('%g', lat) || '_zoom@' || (1 + point_id % 14) AS key, printf('%g', lat) || ',' || printf('%g', lon) AS center, '512x556' AS size FROM gps_point"))
def t02(spark, d):
    request = text.tile_request(F.col("lon"), F.col("lat"), 1 + F.col("point_id") % 14)
    return view(spark, d, "gps_point").select("point_id", *[c.alias(n) for n, c in request.items()])


@query("t07_pixel_type", sql("capture_record", "SELECT seq, (['u1','u2','u4','u8','s8','u16','s16','u32','s32','f32','f64','c64','c128'])[arg % 15 + 1] AS pixel_type, ([1,2,4,8,8,16,16,32,32,32,64,64,128])[arg % 15 + 1] AS bits FROM capture_record"))
def t07(spark, d):
    return rec(spark, d).select("seq", *[c.alias(n) for n, c in text.pixel_type(F.col("arg") % 15).items()])


@query("t11_texture_export_kind", sql("texture_level", "SELECT write_no, CASE WHEN write_no % 6 < 3 THEN 'jpg' WHEN write_no % 6 < 5 THEN 'dds' ELSE 'error' END AS kind FROM texture_level"))
def t11(spark, d):
    fmt = F.element_at(F.array(*map(F.lit, ("rgb", "rgba", "dxt1", "dxt3", "dxt5", "other"))), (F.col("write_no") % 6 + 1).cast("int"))
    return view(spark, d, "texture_level").select("write_no", text.texture_export_kind(fmt).alias("kind"))


_ch = lambda c: [f"({c} >> 11 & 31)*8", f"({c} >> 5 & 63)*4", f"({c} & 31)*8"]
_DXT = ", e AS (SELECT *, " + ", ".join(f"{x} AS {n}{k}" for c, n in (("c0", "a"), ("c1", "b")) for k, x in enumerate(_ch(c))) + " FROM dxt1_block), p AS (SELECT e.*, i AS pixel, idx >> (2*i) & 3 AS code FROM e, generate_series(0, 15) g(i))"


@query("t08_dxt1_decode", sql("dxt1_block", f"{_DXT} SELECT block_id, CAST(pixel AS INTEGER) AS pixel, " + ", ".join(f"CASE code WHEN 0 THEN a{k} WHEN 1 THEN b{k} WHEN 2 THEN CASE WHEN c0 > c1 THEN (2*a{k}+b{k})//3 ELSE (a{k}+b{k})//2 END ELSE CASE WHEN c0 > c1 THEN (a{k}+2*b{k})//3 ELSE 0 END END AS {c}" for k, c in enumerate("rgb")) + ", CASE WHEN code = 3 AND c0 <= c1 THEN 0 ELSE 255 END AS a FROM p"))
def t08(spark, d):
    return text.dxt1_decode(view(spark, d, "dxt1_block"))


_PIX = ", px AS (SELECT o_orderkey AS block_id, i AS pixel, (o_orderkey*31 + i*17) % 256 AS r, (o_custkey*13 + i*29) % 256 AS g, (o_orderkey*7 + i*i) % 256 AS b FROM orders, generate_series(0, 15) s(i))"


def pixels(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_custkey").cast("bigint").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pixel"))
    i = F.col("pixel").cast("bigint")
    return o.select(F.col("k").alias("block_id"), "pixel", ((F.col("k") * 31 + i * 17) % 256).alias("r"), ((F.col("c") * 13 + i * 29) % 256).alias("g"), ((F.col("k") * 7 + i * i) % 256).alias("b"))


_ends = ", ".join(f"max({c})-(max({c})-min({c}))//16 AS hi_{c}, min({c})+(max({c})-min({c}))//16 AS lo_{c}" for c in "rgb")
_tab = lambda n, k: {0: f"a{k}", 1: f"b{k}", 2: f"(2*a{k}+b{k})//3", 3: f"(a{k}+2*b{k})//3"}[n]
_dist = lambda n: " + ".join(f"abs({c}-{_tab(n, k)})" for k, c in enumerate("rgb"))


@query("t09_dxt1_encode", "WITH" + _PIX[1:] + f", e0 AS (SELECT block_id, {_ends} FROM px GROUP BY block_id), e1 AS (SELECT *, ((hi_r//8) << 11) | ((hi_g//4) << 5) | (hi_b//8) AS c0, ((lo_r//8) << 11) | ((lo_g//4) << 5) | (lo_b//8) AS c1 FROM e0), e AS (SELECT *, " + ", ".join(f"({e}_{c} // {1 << low})*{1 << low} + ({e}_{c} // {1 << (8 - low)})  AS {n}{k}" for e, n in (("hi", "a"), ("lo", "b")) for k, (c, low) in enumerate((("r", 3), ("g", 2), ("b", 3)))) + f" FROM e1), q AS (SELECT px.*, c0, c1, {', '.join(f'{_dist(n)} AS d{n}' for n in range(4))} FROM px JOIN e USING (block_id)), m AS (SELECT *, CASE WHEN (d2 < d0 AND d2 < d1) OR (d3 < d0 AND d3 < d1) THEN 2 ELSE 0 END + CASE WHEN d3 < d0 AND d3 < d2 THEN 1 ELSE 0 END AS code FROM q) SELECT block_id, c0, c1, CAST(sum(CAST(code AS BIGINT) << (2*pixel)) AS BIGINT) AS idx FROM m GROUP BY ALL")
def t09(spark, d):
    return text.dxt1_encode(pixels(spark, d))


@query("t10_flip_and_swap", "WITH" + _PIX[1:] + " SELECT block_id, pixel % 4 AS x, 3 - pixel // 4 AS y, b AS r, g, r AS b FROM px")
def t10(spark, d):
    p = pixels(spark, d).select("block_id", F.expr("cast(pixel % 4 as bigint)").alias("x"), F.expr("pixel div 4").alias("y"), "r", "g", "b", F.lit(4).alias("height"))
    return text.flip_and_swap(p).drop("height")


@query("a07_texture_summary", sql("texture_level", ", l AS (SELECT *, row_number() OVER (PARTITION BY texture_id, level ORDER BY write_no DESC) AS k FROM texture_level) SELECT texture_id, CAST(max(level)+1 AS BIGINT) AS levels, CAST(sum(size)+128 AS BIGINT) AS bytes, max(CASE WHEN level=0 THEN width END) AS width, max(CASE WHEN level=0 THEN height END) AS height, max(CASE WHEN level=0 THEN size END) AS linear_size FROM l WHERE k=1 GROUP BY texture_id"))
def a07(spark, d):
    return text.texture_summary(view(spark, d, "texture_level"))


# meshes: orders are meshes, line items their indices

_IDX = ", ix AS (SELECT l_orderkey AS mesh_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_suppkey % 9 AS vertex_idx FROM lineitem)"


def lineitem(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def indices(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    li = lineitem(spark, d).select(F.col("l_orderkey").alias("mesh_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pos = F.row_number().over(W.partitionBy("mesh_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return li.repartition(mesh.dealt(li), "mesh_id").select("mesh_id", pos.cast("bigint").alias("pos"), (F.col("l_suppkey") % 9).cast("bigint").alias("vertex_idx"))


@query("w07_strip_to_triangles", "WITH" + _IDX[1:] + ", t AS (SELECT mesh_id, lag(vertex_idx, 2) OVER w AS a, lag(vertex_idx, 1) OVER w AS b, vertex_idx AS c, pos - 2 AS k FROM ix WINDOW w AS (PARTITION BY mesh_id ORDER BY pos)) SELECT mesh_id, k AS triangle, CASE WHEN k % 2 = 1 THEN b ELSE a END AS v0, CASE WHEN k % 2 = 1 THEN a ELSE b END AS v1, c AS v2 FROM t WHERE k >= 0 AND a <> b AND b <> c AND a <> c")
def w07(spark, d):
    return mesh.strip_to_triangles(indices(spark, d), ["mesh_id"])


def _compact(triangles: bool) -> str:
    ok = "min(CASE WHEN vertex_idx < 8 THEN 1 ELSE 0 END) OVER (PARTITION BY mesh_id, pos // 3)" if triangles else "CASE WHEN vertex_idx < 8 THEN 1 ELSE 0 END"
    return "WITH" + _IDX[1:] + f", k AS (SELECT * FROM (SELECT *, {ok} AS ok FROM ix) WHERE ok = 1), f AS (SELECT mesh_id, vertex_idx, min(pos) AS first FROM k GROUP BY ALL), n AS (SELECT mesh_id, vertex_idx, row_number() OVER (PARTITION BY mesh_id ORDER BY first) - 1 AS new_idx FROM f) SELECT mesh_id, pos, vertex_idx, new_idx FROM k JOIN n USING (mesh_id, vertex_idx)"


def _n_vertex(i: DataFrame) -> DataFrame:
    return i.select("mesh_id").distinct().withColumn("n_vertex", F.lit(8))


@query("w06_compact_vertices", _compact(True))
def w06(spark, d):
    i = indices(spark, d)
    return mesh.compact_vertices(i, _n_vertex(i), ["mesh_id"], rows=lineitem(spark, d).count())


@query("w06_compact_strip", _compact(False))
def w06s(spark, d):
    i = indices(spark, d)
    return mesh.compact_vertices(i, _n_vertex(i), ["mesh_id"], triangles=False, rows=lineitem(spark, d).count())


_MESH = ", ms AS (SELECT o_custkey % 3 AS batch_id, o_custkey % 30 AS group_id, o_orderkey AS mesh_id, o_custkey % 50 AS texture_id, o_custkey % 12 AS texture_idx, o_custkey % 3 = 0 AS is_capture FROM orders)"


def meshes(spark, d) -> DataFrame:
    c = F.col("o_custkey")
    return spark.read.parquet(f"{d}/orders.parquet").select((c % 3).alias("batch_id"), (c % 30).alias("group_id"), F.col("o_orderkey").alias("mesh_id"), (c % 50).alias("texture_id"), (c % 12).alias("texture_idx"), (c % 3 == 0).alias("is_capture"))


@query("w11_mesh_numbers", "WITH" + _MESH[1:] + ", n AS (SELECT *, dense_rank() OVER (PARTITION BY batch_id ORDER BY group_id) - 1 AS g, row_number() OVER (PARTITION BY batch_id, group_id ORDER BY mesh_id) - 1 AS m FROM ms) SELECT mesh_id, g, m, 'area_meshNode_' || g || '_' || m AS mesh_name, 'material_' || g || '_' || m AS material_name FROM n")
def w11(spark, d):
    return mesh.mesh_numbers(meshes(spark, d), F.lit("area")).select("mesh_id", "g", "m", "mesh_name", "material_name")


@query("f04_drop_non_triangle_meshes", "WITH" + _MESH[1:] + " SELECT mesh_id FROM ms WHERE mesh_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 = 4)")
def f04(spark, d):
    draws = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("mesh_id"), (F.col("l_suppkey") % 10).alias("primitive"))
    return mesh.with_triangles(meshes(spark, d), draws).select("mesh_id")


_TEX = ", tx AS (SELECT DISTINCT p_partkey % 30 AS group_id, p_size AS texture_id FROM part)"


def group_textures(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 30).alias("group_id"), F.col("p_size").alias("texture_id")).distinct()


@query("j12_used_textures", "WITH" + _MESH[1:] + _TEX + " SELECT group_id, texture_id FROM tx WHERE (group_id, texture_id) IN (SELECT (group_id, texture_id) FROM ms)")
def j12(spark, d):
    return mesh.used_textures(group_textures(spark, d), meshes(spark, d))


@query("j12_unused_textures", "WITH" + _MESH[1:] + _TEX + " SELECT group_id, texture_id FROM tx WHERE (group_id, texture_id) NOT IN (SELECT (group_id, texture_id) FROM ms)")
def j12b(spark, d):
    return mesh.used_textures(group_textures(spark, d), meshes(spark, d), unused=True)


@query("j13_bind_textures", "WITH" + _MESH[1:] + _TEX + ", n AS (SELECT group_id, texture_id, row_number() OVER (PARTITION BY group_id ORDER BY texture_id) - 1 AS texture_idx FROM tx WHERE texture_id < 10) SELECT mesh_id, ms.texture_idx, n.texture_id FROM ms LEFT JOIN n ON n.group_id = ms.group_id AND n.texture_idx = ms.texture_idx")
def j13(spark, d):
    return mesh.bind_textures(meshes(spark, d).drop("texture_id"), group_textures(spark, d).where("texture_id < 10")).select("mesh_id", "texture_idx", "texture_id")


@query("a08_export_item_count", "WITH" + _MESH[1:] + ", p AS (SELECT batch_id, count(DISTINCT group_id) AS groups, count(DISTINCT CASE WHEN is_capture THEN group_id*1000+texture_id END) AS textures FROM ms GROUP BY batch_id) SELECT *, groups + textures AS items FROM p")
def a08(spark, d):
    return mesh.export_item_count(meshes(spark, d))


#: Export sets that are written, by application and tables.
_exports: dict[tuple[str, str], str] = {}


def _exported(spark, d) -> str:
    """Paths of GPS points as meshes, every fifth a spline, written to a folder, once a session."""
    from pyspark.sql import Window as W

    key = spark.sparkContext.applicationId, d
    if key in _exports:
        return _exports[key]

    keys = [(F.col("path_id") % 3).alias("batch_id"), (F.col("path_id") % 6).alias("group_id"), F.col("path_id").alias("mesh_id")]
    idx = (F.row_number().over(W.partitionBy("path_id").orderBy("point_id")) - 1).cast("bigint")
    p = view(spark, d, "gps_point").withColumn("vertex_idx", idx)
    uv = geo.uv_of(F.col("lon"), F.col("lat"), F.lit(-122.5), F.lit(37.0), F.lit(-121.5), F.lit(38.0))
    v = p.withColumn("t", uv).select(*keys, "vertex_idx", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("alt").alias("z"), "t.u", "t.v")
    n = F.max("vertex_idx").over(W.partitionBy("path_id"))
    t = p.withColumn("n", n).where("vertex_idx <= n - 2").select(*keys, F.col("vertex_idx").alias("v0"), (F.col("vertex_idx") + 1).alias("v1"), (F.col("vertex_idx") + 2).alias("v2"))
    m = p.select("path_id").distinct().select(*keys, (F.col("path_id") % 7).cast("double").alias("tx"), F.lit(-1.0).alias("ty"), F.lit(0.0).alias("tz"), (F.col("path_id") % 5 == 0).alias("is_spline"), F.when(F.col("path_id") % 4 > 0, F.col("path_id") % 4).alias("texture_idx"))
    where = scratch(spark, "meshes")
    mesh.write_mesh_tables(v, t, m, where, F.lit("area"))
    _exports[key] = where
    return where


_VIDX = ", vx AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY point_id) - 1 AS k, count(*) OVER (PARTITION BY path_id) AS n FROM gps_point)"


@query("s09_write_mesh_tables", sql("gps_point", f"{_VIDX} SELECT path_id AS mesh_id, k AS vertex_idx, round(lon + path_id % 7, 9) AS x, round(lat - 1, 9) AS y, round(alt, 9) AS z, round(least(greatest(lon+122.5e0, 0), 1), 9)+0.0 AS u, round(least(greatest(lat-37, 0), 1), 9)+0.0 AS v FROM vx WHERE path_id % 5 <> 0"))
def s09(spark, d):
    """Written, and read back."""
    return spark.read.parquet(f"{_exported(spark, d)}/vertices").select("mesh_id", "vertex_idx", *[F.round(a, 9).alias(a) for a in "xyz"], *[r(F.col(a), 9).alias(a) for a in "uv"])


@query("s09_mesh_triangles", sql("gps_point", f"{_VIDX} SELECT path_id AS mesh_id, k AS v0, k+1 AS v1, k+2 AS v2 FROM vx WHERE path_id % 5 <> 0 AND k < n - 2"))
def s09t(spark, d):
    return spark.read.parquet(f"{_exported(spark, d)}/triangles").select("mesh_id", "v0", "v1", "v2")


@query("s09_mesh_names", sql("gps_point", ", p AS (SELECT DISTINCT path_id FROM gps_point), n AS (SELECT path_id, dense_rank() OVER (PARTITION BY path_id % 3 ORDER BY path_id % 6) - 1 AS g, row_number() OVER (PARTITION BY path_id % 3, path_id % 6 ORDER BY path_id) - 1 AS m FROM p) SELECT path_id AS mesh_id, 'area_meshNode_' || g || '_' || m AS node_name, 'area_meshNode_' || g || '_' || m AS mesh_name, 'material_' || g || '_' || m AS material_name, CASE WHEN path_id % 4 > 0 THEN 'texture_' || g || '_' || path_id % 4 END AS texture_name FROM n WHERE path_id % 5 <> 0"))
def s09n(spark, d):
    return spark.read.parquet(f"{_exported(spark, d)}/meshes").select("mesh_id", "node_name", "mesh_name", "material_name", "texture_name")


# paths and files


def path_points(spark, d) -> DataFrame:
    """Paths of GPS points: even ones are lines, odd ones closed polygons."""
    from pyspark.sql import Window as W

    w = W.partitionBy("path_id").orderBy("point_id")
    p = view(spark, d, "gps_point").select("path_id", "point_id", (F.row_number().over(w) - 1).cast("bigint").alias("point_idx"), "lon", "lat", "alt")
    return p.withColumn("kind", F.when(F.col("path_id") % 2 == 0, "LineString").otherwise("Polygon")).withColumn("file", F.col("path_id").cast("string"))


_PATHS = ", pp AS (SELECT path_id, CAST(path_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY path_id ORDER BY point_id) - 1 AS point_idx, lon, lat, alt, CASE WHEN path_id % 2 = 0 THEN 'LineString' ELSE 'Polygon' END AS kind FROM gps_point)"


@query("s01_read_kml_paths", sql("gps_point", f"{_PATHS} SELECT file, kind, point_idx, lon, lat, alt FROM pp"))
def s01(spark, d):
    """Paths written as KML files, and read back."""
    where = scratch(spark, "kml")
    files.write_kml(path_points(spark, d), where, mode=3)
    p = files.read_kml_paths(spark, where)
    return p.select(F.regexp_extract("file", r"([^/]*)\.kml$", 1).alias("file"), "kind", "point_idx", "lon", "lat", "alt")


@query("s07_write_kml", sql("gps_point", f"""{_PATHS}, c AS (SELECT file, path_id, kind, string_agg(printf('%d,%d,%d', CAST(floor(lon*1000) AS BIGINT), CAST(floor(lat*1000) AS BIGINT), CAST(floor(alt) AS BIGINT)), ' ' ORDER BY point_idx) AS c FROM pp GROUP BY ALL)
SELECT file, '<Placemark><name>path_' || path_id || '</name><styleUrl>#line</styleUrl>' || CASE kind WHEN 'Polygon' THEN '<Polygon><tessellate>1</tessellate><altitudeMode>clampToSeaFloor</altitudeMode><outerBoundaryIs><LinearRing><coordinates>' || c || '</coordinates></LinearRing></outerBoundaryIs></Polygon>' ELSE '<LineString><tessellate>1</tessellate><altitudeMode>clampToSeaFloor</altitudeMode><coordinates>' || c || '</coordinates></LineString>' END || '</Placemark>' AS mark FROM c"""))
def s07(spark, d):
    """Whole placemarks, of whole numbers, which both engines print alike."""
    p = path_points(spark, d).withColumns({"lon": F.floor(F.col("lon") * 1000), "lat": F.floor(F.col("lat") * 1000), "alt": F.floor("alt")})
    return files.kml_texts(p, mode=2).select("file", F.regexp_extract("text", "(?s)(<Placemark>.*</Placemark>)", 1).alias("mark"))


@query("s08_write_curves", sql("gps_point", f"{_PATHS}, o AS (SELECT path_id, count(*) AS n, string_agg(printf('%.3f %.3f %.3f', lon*100, lat*100, alt*100), chr(10) ORDER BY point_idx) AS points FROM pp GROUP BY path_id) SELECT path_id, CAST(100 + row_number() OVER (ORDER BY path_id) AS INTEGER) AS curve, CAST(n-1 AS INTEGER) AS spans, (SELECT string_agg(CASE WHEN k > 0 AND k % 20 = 0 THEN chr(10) WHEN k > 0 THEN ' ' ELSE '' END || k, '' ORDER BY k) FROM generate_series(0, n-1) g(k)) AS knots, points FROM o WHERE n > 1"))
def s08(spark, d):
    p = path_points(spark, d).withColumnsRenamed({"lon": "x", "lat": "y", "alt": "z"})
    return files.curve_records(p).select("path_id", "curve", "spans", "knots", "points")


@query("m14_polygons_to_loops", sql("gps_point", f"{_PATHS} SELECT path_id, point_idx FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM pp) WHERE kind = 'LineString' OR point_idx < n - 1"))
def m14(spark, d):
    p = path_points(spark, d)
    return files.paths_to_lines(p).select("path_id", "point_idx").union(files.polygons_to_loops(p).select("path_id", "point_idx"))


@query("s02_read_footprints", sql("footprint_map", "SELECT CAST(map_id AS VARCHAR) AS file, min_lon AS west, min_lon + size AS east, min_lat + size AS north, min_lat AS south, CAST(10 + map_id % 3 AS INTEGER) AS zone FROM footprint_map"))
def s02(spark, d):
    m = view(spark, d, "footprint_map")
    long = F.format_string("<bounding><westbc>%s</westbc><eastbc>%s</eastbc><northbc>%s</northbc><southbc>%s</southbc></bounding>", "min_lon", F.col("min_lon") + F.col("size"), F.col("min_lat") + F.col("size"), "min_lat")
    short = F.format_string("<west>%s</west><east>%s</east><north>%s</north><south>%s</south>", F.col("min_lon") + F.col("size"), "min_lon", "min_lat", F.col("min_lat") + F.col("size"))
    t = m.select(F.col("map_id").cast("string").alias("file"), F.concat(F.when(F.col("map_id") % 2 == 0, long).otherwise(short), F.lit("<utmzone>"), 10 + F.col("map_id") % 3, F.lit("</utmzone>")).alias("text"))
    where = scratch(spark, "footprints")
    files.write_texts(t, where, ".xml")
    return files.read_footprints(spark, where).withColumn("file", F.regexp_extract("file", r"([^/]*)\.xml$", 1))


@query("s03_read_world_files", sql("footprint_map", "SELECT CAST(map_id AS VARCHAR) AS file, size AS a, 0.25e0 AS b, min_lon AS c, -0.5e0 AS d, -size AS e, min_lat AS f FROM footprint_map"))
def s03(spark, d):
    t = view(spark, d, "footprint_map").select(F.col("map_id").cast("string").alias("file"), F.concat_ws("\n", "size", F.lit(-0.5), F.lit(0.25), -F.col("size"), "min_lon", "min_lat").alias("text"))
    where = scratch(spark, "world")
    files.write_texts(t, where, ".tfw")
    return files.read_world_files(spark, where).withColumn("file", F.regexp_extract("file", r"([^/]*)\.tfw$", 1))


_TAGN = "CASE tag WHEN 'matrix' THEN 268435456 WHEN 'bind_texture' THEN 268435457 WHEN 'enable' THEN 536870912 WHEN 'draw' THEN 268435458 ELSE 805306368 END"


def capture_files(spark, d) -> DataFrame:
    """Data records hold a link index and two sub-blocks of 16 bytes: a float (a number of eighths), a colour, and both again, one more each."""
    le = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), k, 2) for k in range(2 * n - 1, 0, -2)]))
    four = lambda k: F.element_at(F.array(*[F.unhex(F.lit(struct.pack("<f", n / 8).hex())) for n in range(64)]), (F.pmod(F.col("arg") + k, F.lit(64)) + 1).cast("int"))
    vertex = lambda k: F.concat(four(k), le(F.col("seq") * 2 + k, 4))
    sub = F.concat(le(F.col("arg"), 8), le(F.lit(16).cast("bigint"), 8), vertex(0), vertex(1))
    payload = F.when(F.col("tag") == "enable", F.concat(le(F.col("seq"), 4), sub, sub)).otherwise(le(F.col("arg"), 8))
    p = rec(spark, d).select(F.col("dump_id").cast("string").alias("path"), "seq", F.expr(_TAGN).cast("bigint").alias("tag"), payload.alias("payload"))
    return files.pack_capture(p)


_le = lambda c, n: "||".join(f"printf('%02X', ({c} >> {8 * k}) & 255)" for k in range(n))
_four = lambda k: "list_extract([" + ",".join(f"'{struct.pack('<f', n / 8).hex().upper()}'" for n in range(64)) + f"], CAST((arg+{k}) % 64 + 1 AS BIGINT))"
_vert = "||".join(f"{_four(k)}||{_le(f'(seq*2+{k})', 4)}" for k in (0, 1))
_sub = f"{_le('arg', 8)}||'1000000000000000'||{_vert}"


@query("s05_read_capture", sql("capture_record", f"SELECT CAST(dump_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY dump_id ORDER BY seq) - 1 AS seq, CAST({_TAGN} AS BIGINT) AS tag, CASE WHEN tag = 'enable' THEN 'data' WHEN tag = 'clear' THEN 'picture' ELSE 'command' END AS kind, CASE WHEN tag = 'enable' THEN seq END AS link_index, CASE WHEN tag = 'enable' THEN {_sub}||{_sub} ELSE {_le('arg', 8)} END AS payload FROM capture_record"))
def s05(spark, d):
    return files.parse_capture(capture_files(spark, d)).withColumn("payload", F.hex("payload"))


@query("s05_capture_ranges", SQL["s05_read_capture"])
def s05r(spark, d):
    """Written as files, each read back in ranges of about 4 KB."""
    where = scratch(spark, "captures")
    files.write_captures(capture_files(spark, d), where).count()
    name = F.regexp_extract("file", "([^/]*)$", 1)
    return files.read_capture(spark, where, split=4096).withColumn("file", name).withColumn("payload", F.hex("payload"))


@query("s06_explode_vertex_stream_blocks", sql("capture_record", f", n AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY seq) - 1 AS no FROM capture_record) SELECT CAST(dump_id AS VARCHAR) AS file, no AS seq, b AS block_no, arg AS ref_tag, {_vert} AS data FROM n, generate_series(0, 1) g(b) WHERE tag = 'enable'"))
def s06(spark, d):
    data = files.parse_capture(capture_files(spark, d)).where("kind = 'data'")
    return files.explode_vertex_stream_blocks(data).withColumn("data", F.hex("data"))


@query("t05_unpack_vertices", sql("capture_record", ", n AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY seq) - 1 AS no FROM capture_record) SELECT CAST(dump_id AS VARCHAR) AS file, no AS seq, b AS block_no, v AS vertex_idx, ((arg + v) % 64)/8e0 AS z, (c.seq*2 + v) % 4294967296 AS color FROM (SELECT dump_id, no, arg, tag, seq FROM n) c, generate_series(0, 1) g(b), generate_series(0, 1) h(v) WHERE tag = 'enable'"))
def t05(spark, d):
    """A float and a colour a vertex."""
    data = files.parse_capture(capture_files(spark, d)).where("kind = 'data'")
    v = files.unpack_vertices(files.explode_vertex_stream_blocks(data), 8, 0, 1)
    return v.select("file", "seq", "block_no", "vertex_idx", F.col("values")[0].alias("z"), "color")


@query("j17_polyline_source_target", sql("capture_record gps_point", f"{_PATHS}, f AS (SELECT 'area_' || path_id AS stem, min(path_id) AS first FROM pp WHERE kind = 'Polygon' GROUP BY ALL) SELECT DISTINCT dump_id, first AS polygon FROM capture_record LEFT JOIN f ON stem = 'area_' || dump_id"))
def j17(spark, d):
    """A dump and the KML file of the same stem; the file's first polygon is the target."""
    dumps = rec(spark, d).select("dump_id").distinct().withColumn("file", F.concat(F.lit("dumps/area_"), "dump_id", F.lit(".dump")))
    polygons = path_points(spark, d).where("kind = 'Polygon'").withColumn("file", F.concat(F.lit("kml/area_"), "path_id", F.lit(".kml")))
    return capture.polyline_source_target(dumps, polygons)


#: Targets of the rigid fit: the sources scaled, turned about z by a sine and a cosine, moved, and bent, so that no similarity takes all of them there.
_TARGET = {"tx": "3e0*(0.8e0*sx - 0.6e0*sy) + 10 + k*0.5e0", "ty": "3e0*(0.6e0*sx + 0.8e0*sy) - 20 - (dump_id % 3)*k*0.2e0", "tz": "3e0*sz + 5 + (dump_id % 4)*k*0.3e0"}


def _rigid_pairs(spark, d) -> DataFrame:
    p = path_points(spark, d).select(F.col("path_id").alias("dump_id"), F.col("point_idx").alias("k"), (F.col("lon") * 10).alias("sx"), (F.col("lat") * 10).alias("sy"), (F.col("alt") / 100).alias("sz"))
    return p.withColumns({n: F.expr(e) for n, e in _TARGET.items()})


def _rigid_sql() -> str:
    """The fit of three pairs, a stage of columns after the other."""
    stages = []

    def stage(columns: dict[str, str]) -> None:
        stages.append(f"r{len(stages) + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM r{len(stages)})")

    v = lambda n: [f"{n}{a}" for a in "xyz"]
    named = lambda n, e: dict(zip(v(n), e))
    dot = lambda a, b: "(" + " + ".join(f"{x}*{y}" for x, y in zip(a, b)) + ")"
    cross = lambda a, b: [f"({a[1]}*{b[2]} - {a[2]}*{b[1]})", f"({a[2]}*{b[0]} - {a[0]}*{b[2]})", f"({a[0]}*{b[1]} - {a[1]}*{b[0]})"]
    unit = lambda a: [f"({x} / coalesce(nullif(sqrt({dot(a, a)}), 0), 1))" for x in a]
    turn = lambda n, c, s: [f"({c}*{int(i == j)} + (1 - {c})*{n[i]}*{n[j]} + {s}*{k})" for i in range(3) for j, k in enumerate((["0", n[2], f"(-{n[1]})"], [f"(-{n[2]})", "0", n[0]], [n[1], f"(-{n[0]})", "0"])[i])]
    times = lambda a, m: [dot(a, m[j::3]) for j in range(3)]
    for side in "st":
        stage(named(f"c{side}", [f"({side}0{a} + {side}1{a} + {side}2{a})/3e0" for a in "xyz"]))
        for k in range(3):
            stage(named(f"{side}a{k}", [f"{side}{k}{a} - c{side}{a}" for a in "xyz"]))
        for k in range(3):
            stage(named(f"{side}u{k}", unit(v(f"{side}a{k}"))))
        for k in range(3):
            stage(named(f"{side}n{k}", unit(cross(v(f"{side}u{k}"), v(f"{side}u{(k + 1) % 3}")))))
            stage({f"{side}w{k}": f"acos(least(abs({dot(v(f'{side}u{k}'), v(f'{side}u{(k + 1) % 3}'))}), 1))"})
        stage(named(f"{side}m", [" + ".join(f"{side}n{k}{a}*{side}w{k}" for k in range(3)) for a in "xyz"]))
        stage(named(f"{side}z", unit(v(f"{side}m"))))
        stage({f"{side}r": "(" + " + ".join(f"sqrt({dot(v(f'{side}a{k}'), v(f'{side}a{k}'))})" for k in range(3)) + ")/3e0"})
    stage(named("ax", cross(v("sz"), v("tz"))))
    stage({"sine": f"least(sqrt({dot(v('ax'), v('ax'))}), 1)"})
    stage(named("au", unit(v("ax"))))
    stage({f"l{n}": e for n, e in enumerate(turn(v("au"), "sqrt(1 - sine*sine)", "sine"))})
    level = [f"l{n}" for n in range(9)]
    for k in range(3):
        stage(named(f"e{k}", unit(times(v(f"sa{k}"), level))))
        stage(named(f"p{k}", unit(cross(v("tz"), v(f"e{k}")))))
        stage(named(f"q{k}", unit(cross(v("tz"), v(f"tu{k}")))))
        stage(named(f"x{k}", cross(v(f"p{k}"), v(f"q{k}"))))
        stage({f"g{k}": f"asin(least(sqrt({dot(v(f'x{k}'), v(f'x{k}'))}), 1)) * CASE WHEN {dot(v(f'x{k}'), v('tz'))} < 0 THEN -1 ELSE 1 END"})
    stage({"g": "(g0 + g1 + g2)/3e0", "scale": "tr/sr"})
    stage({f"f{n}": e for n, e in enumerate(turn(v("tz"), "cos(g)", "sin(g)"))})
    stage({f"o{3 * i + j}": f"{dot(level[3 * i : 3 * i + 3], [f'f{j}', f'f{3 + j}', f'f{6 + j}'])}*scale" for i in range(3) for j in range(3)})
    stage({f"m{12 + j}": f"ct{a} - {dot(v('cs'), [f'o{j}', f'o{3 + j}', f'o{6 + j}'])}" for j, a in enumerate("xyz")})
    first = ", ".join(f"max(CASE WHEN k = {k} THEN {side}{a} END) AS {side}{k}{a}" for side in "st" for k in range(3) for a in "xyz")
    out = {0: "o0", 1: "o1", 4: "o3", 6: "o5", 10: "o8", 12: "m12", 13: "m13", 14: "m14"}
    plain = {0: 1, 10: 1}
    columns = ", ".join(f"CASE WHEN n < 3 THEN {plain.get(k, 0)}e0 ELSE round({e}, 3)+0.0 END AS m{k}" for k, e in out.items())
    return f""", pr AS (SELECT path_id AS dump_id, row_number() OVER (PARTITION BY path_id ORDER BY point_id) - 1 AS k, lon*10 AS sx, lat*10 AS sy, alt/100 AS sz FROM gps_point), pt AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _TARGET.items())} FROM pr),
r0 AS (SELECT dump_id, count(*) AS n, {first} FROM pt GROUP BY dump_id), {', '.join(stages)} SELECT dump_id, {columns} FROM r{len(stages)}"""


@query("m15_fit_rigid", sql("gps_point", _rigid_sql()))
def m15(spark, d):
    """Triangles that aren't similar."""
    f = mesh.fit_rigid(_rigid_pairs(spark, d))
    return f.select("dump_id", *[r(F.col("matrix")[k], 3).alias(f"m{k}") for k in (0, 1, 4, 6, 10, 12, 13, 14)])


def _turned(spark, d) -> tuple[DataFrame, DataFrame]:
    """Points on the ellipsoid, and for each dump a matrix that turns them about the earth's axis by none to three quarters."""
    p = view(spark, d, "gps_point").withColumn("c", geo.cartesian_position(F.col("lat"), F.col("lon"), F.col("alt")))
    v = p.select(F.col("path_id").alias("dump_id"), (F.col("point_id") % 3).alias("mesh_id"), "point_id", "c.*")
    k = (F.col("path_id") % 4).cast("int")
    cos, sin = (F.element_at(F.array(*map(F.lit, x)), k + 1) for x in ((1.0, 0.0, -1.0, 0.0), (0.0, 1.0, 0.0, -1.0)))
    o, i = F.lit(0.0), F.lit(1.0)
    t = p.select("path_id").distinct().select(F.col("path_id").alias("dump_id"), F.array(cos, sin, o, o, -sin, cos, o, o, o, o, i, o, o, o, o, i).alias("matrix"))
    return v, t


@query("m16_georeference_meshes", sql("gps_point", "SELECT point_id, round(lon + 90*(path_id % 4),6)+0.0 AS lon2, round(lat,6)+0.0 AS lat2, round(alt,3)+0.0 AS alt2 FROM gps_point"))
def m16(spark, d):
    """A quarter's turn takes a point a quarter around the earth."""
    v, t = _turned(spark, d)
    g = mesh.georeference(v.select("point_id", "dump_id", "x", "y", "z"), t, (F.lit(-122.0), F.lit(37.5), F.lit(0.0)))
    return g.select("point_id", r(F.col("lon"), 6).alias("lon2"), r(F.col("lat"), 6).alias("lat2"), r(F.col("alt")).alias("alt2"))


def _placed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Paths as meshes of dumps; every third dump has no target."""
    v, t = _turned(spark, d)
    return mesh.place_meshes(v.withColumnRenamed("point_id", "vertex_idx"), t.where("dump_id % 3 > 0"), origin())


_PLACE = f""", turned AS (SELECT point_id, path_id, lon + 90*(path_id % 4) AS lon, lat, alt FROM gps_point), {ECEF.format(src='turned')}, {ENU}, q AS (SELECT *, path_id AS dump_id, point_id % 3 AS mesh_id FROM enu WHERE path_id % 3 > 0)"""


@query("m16_placed_vertices", sql("gps_point", f"""{_PLACE}, c AS (SELECT dump_id, mesh_id, (min(e)+max(e))*0.5e0 AS tx, (min(nn)+max(nn))*0.5e0 AS ty, (min(u)+max(u))*0.5e0 AS tz FROM q GROUP BY ALL)
SELECT dump_id, mesh_id, point_id AS vertex_idx, round(e-tx,2)+0.0 AS x, round(nn-ty,2)+0.0 AS y, round(u-tz,2)+0.0 AS z FROM q JOIN c USING (dump_id, mesh_id)
UNION ALL SELECT path_id, point_id % 3, point_id, NULL, NULL, NULL FROM gps_point WHERE path_id % 3 = 0"""))
def m16v(spark, d):
    """Placed vertices about their mesh's centre; those without a target have no place."""
    v = _placed(spark, d)[0]
    return v.select("dump_id", "mesh_id", "vertex_idx", *[F.when(F.col("lon").isNotNull(), r(F.col(a), 2)).alias(a) for a in "xyz"])


@query("m16_placed_boxes", sql("gps_point", f"""{_PLACE} SELECT dump_id, mesh_id, round(min(e),2)+0.0 AS min_x, round(max(nn),2)+0.0 AS max_y, round(max(u),2)+0.0 AS max_z FROM q GROUP BY ALL"""))
def m16x(spark, d):
    return _placed(spark, d)[1].where("min_lon is not null").select("dump_id", "mesh_id", *[r(F.col(c), 2).alias(c) for c in ("min_x", "max_y", "max_z")])


# order


@query("o02_first_polygon", sql("gps_point", f"{_PATHS} SELECT path_id % 10 AS file, min(path_id) AS path_id FROM pp WHERE kind = 'Polygon' GROUP BY 1"))
def o02a(spark, d):
    """The first polygon of each file of several paths."""
    p = path_points(spark, d).where("kind = 'Polygon'").withColumn("file", F.col("path_id") % 10)
    return capture.first_of(p, ["file"], "path_id", "path_id")


@query("o02_last_triangle_draw", "SELECT l_orderkey AS mesh_id, max(l_linenumber) AS draw_no FROM lineitem WHERE l_suppkey % 10 = 4 GROUP BY l_orderkey")
def o02b(spark, d):
    draws = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("mesh_id"), F.col("l_linenumber").alias("draw_no"), (F.col("l_suppkey") % 10).alias("primitive"))
    return capture.last_triangle_draw(draws, ["mesh_id"], "draw_no")


@query("o03_ordered_points", sql("gps_point", "SELECT path_id, array_to_string(list(point_id ORDER BY point_id), ' ') AS points FROM gps_point GROUP BY path_id"))
def o03(spark, d):
    p = files.ordered_points(path_points(spark, d), ["path_id"], ["point_id"])
    return p.select("path_id", F.array_join(F.transform("points", lambda s: s["point_id"].cast("string")), " ").alias("points"))


# lookup, metadata, selection


def _lookup(name: str, criteria: str, key_sql: str, table_sql: str, key, table_key):
    @query(name, f"WITH t AS (SELECT {table_sql} AS k, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY 1) SELECT o_orderkey, coalesce(t.p_type, '') AS p_type FROM orders LEFT JOIN t ON t.k = {key_sql}")
    def run(spark, d):
        o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", key().alias("key"))
        t = spark.read.parquet(f"{d}/part.parquet").select(table_key().alias("table_key"), "p_type", F.col("p_partkey").alias("line_no"))
        return lookup.lookup_first(o, "key", t, "table_key", "p_type", criteria).select("o_orderkey", "p_type")


_lookup("j15_lookup_exact", "exact", "CAST(o_custkey % 70 AS VARCHAR)", "CAST(p_size AS VARCHAR)", lambda: (F.col("o_custkey") % 70).cast("string"), lambda: F.col("p_size").cast("string"))
_lookup("j15_lookup_nocase", "nocase", "lower('Size ' || o_custkey % 70)", "lower('SIZE ' || p_size)", lambda: F.concat(F.lit("Size "), F.col("o_custkey") % 70), lambda: F.concat(F.lit("SIZE "), "p_size"))
_lookup("j15_lookup_integer", "integer", "CASE WHEN o_custkey % 70 < 60 THEN o_custkey % 70 ELSE 0 END", "p_size", lambda: F.when(F.col("o_custkey") % 70 < 60, F.concat(F.lit(" "), F.col("o_custkey") % 70, F.lit("px"))).otherwise("none"), lambda: F.concat("p_size", F.lit(" mm")))


@query("a12_metadata_map", "WITH e AS (SELECT DISTINCT p_size AS map_id, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS value FROM part), u AS (SELECT map_id, name, min(value) AS value FROM e GROUP BY ALL) SELECT map_id, string_agg(name || '=' || value, ';' ORDER BY name) AS metadata FROM u WHERE name NOT LIKE '%1' GROUP BY map_id")
def a12(spark, d):
    """Names that end in 1 are hidden by a leading #."""
    p = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_size").alias("map_id"), "p_brand").agg(F.min(F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("y")).alias("value"))
    e = p.select("map_id", F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("#"), "p_brand")).otherwise(F.col("p_brand")).alias("name"), "value", F.lit("string").alias("type"), F.lit(1).alias("rows"))
    m = lookup.metadata_map(e)
    return m.select("map_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda s: F.concat(s["key"], F.lit("="), s["value"])), ";").alias("metadata"))


@query("a13_metadata_route", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'l' WHEN 2 THEN 'e' ELSE 'free' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_size + 0.5e0 WHEN p_partkey % 4 = 1 THEN CAST(p_size AS DOUBLE) END AS number FROM part")
def a13(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("STATISTICS_MEAN", "STATISTICS_HISTONUMBINS", "LAYER_TYPE", "author"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    value = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_size", F.lit(".5"))).otherwise(F.col("p_size").cast("string"))
    return lookup.metadata_route(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", key.alias("key"), value.alias("value"))).select("p_partkey", "kind", "number")


_Q = """, qd AS (SELECT map_id AS quad_id, (min_lon+122.5e0)*1000 AS x0, (min_lat-37)*1000 AS y0, (min_lon+122.5e0+size)*1000 AS x1, (min_lat-37)*1000+3 AS y1, (min_lon+122.5e0+size)*1000+5 AS x2, (min_lat-37+size)*1000 AS y2, (min_lon+122.5e0)*1000-2 AS x3, (min_lat-37+size)*1000-1 AS y3 FROM footprint_map),
pt AS (SELECT point_id, path_id, floor((lon+122.5e0)*1000) AS px, floor((lat-37)*1000) AS py FROM gps_point),
h AS (SELECT point_id, path_id, quad_id, (x1-x0)*(py+0.5e0-y0)-(y1-y0)*(px+0.5e0-x0) AS k0, (x2-x1)*(py+0.5e0-y1)-(y2-y1)*(px+0.5e0-x1) AS k1, (x3-x2)*(py+0.5e0-y2)-(y3-y2)*(px+0.5e0-x2) AS k2, (x0-x3)*(py+0.5e0-y3)-(y0-y3)*(px+0.5e0-x3) AS k3 FROM pt, qd),
hits AS (SELECT point_id, path_id, quad_id FROM h WHERE least(k0,k1,k2,k3) > 0 OR greatest(k0,k1,k2,k3) < 0)"""
_SEL = _Q + """, a AS (SELECT quad_id, bool_or(path_id % 40 = 0) AS s, bool_or(path_id % 40 = 1) AS rm, sum(CASE WHEN path_id % 40 > 1 THEN 1 ELSE 0 END) AS c FROM hits GROUP BY quad_id),
sel AS (SELECT qd.quad_id, ((quad_id % 2 = 0 OR coalesce(s, false)) AND NOT coalesce(rm, false)) <> (coalesce(c, 0) % 2 = 1) AS selected FROM qd LEFT JOIN a USING (quad_id))"""


def _quads(spark, d) -> DataFrame:
    x, y, s = (F.col("min_lon") + 122.5), (F.col("min_lat") - 37), F.col("size")
    c = {"x0": x * 1000, "y0": y * 1000, "x1": (x + s) * 1000, "y1": y * 1000 + 3, "x2": (x + s) * 1000 + 5, "y2": (y + s) * 1000, "x3": x * 1000 - 2, "y3": (y + s) * 1000 - 1}
    return view(spark, d, "footprint_map").select(F.col("map_id").alias("quad_id"), *[v.alias(k) for k, v in c.items()])


def _pixels(spark, d) -> DataFrame:
    return view(spark, d, "gps_point").select("point_id", "path_id", F.floor((F.col("lon") + 122.5) * 1000).alias("px"), F.floor((F.col("lat") - 37) * 1000).alias("py"))


def _selection(spark, d) -> DataFrame:
    """Points of one pixel hit the same quads, so their actions are folded first."""
    m = F.col("path_id") % 40
    p = _pixels(spark, d).withColumn("action", F.when(m == 0, "set").when(m == 1, "remove").otherwise("click"))
    h = lookup.points_in_quads(lookup.fold_actions(p, ["px", "py"]), _quads(spark, d), 50.0)
    return lookup.patch_selection(_quads(spark, d).select("quad_id", (F.col("quad_id") % 2 == 0).alias("initial")), h)


@query("j06_points_in_quads", sql("gps_point footprint_map", f"{_Q} SELECT point_id, quad_id FROM hits"))
def j06(spark, d):
    return lookup.points_in_quads(_pixels(spark, d), _quads(spark, d), 50.0).select("point_id", "quad_id")


@query("a10_patch_selection", sql("gps_point footprint_map", f"{_SEL} SELECT quad_id, selected FROM sel"))
def a10(spark, d):
    return _selection(spark, d)


@query("a11_selected_triangles", sql("gps_point footprint_map", f"{_SEL} SELECT quad_id, CAST(k AS INTEGER) AS half, quad_id*2+k AS triangle FROM sel, generate_series(0, 1) g(k) WHERE selected"))
def a11(spark, d):
    return lookup.selected_triangles(_selection(spark, d))


