"""Recorded command streams: state in force, numbering, resolution of references.

Windows are over chunks of a dump, in order of the sequence number, and over a row per
chunk; payload bytes stay out of them and are joined afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.operators.links import spread_join
from geoloom.storage import materialize

UNSET = -1
#: Sequence numbers that share a chunk of a dump.
CHUNK = 65_536


def within() -> W:
    """The rows of a chunk in order."""
    return W.partitionBy("dump_id", "_chunk").orderBy("seq")


def up_to() -> W:
    """A chunk's rows up to one."""
    return within().rowsBetween(W.unboundedPreceding, W.currentRow)


def earlier() -> W:
    """The chunks of a dump before one."""
    return W.partitionBy("dump_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)


def chunked(records: DataFrame, chunk: int) -> DataFrame:
    """Records with the chunk of their dump, which holds ``chunk`` of them at most."""
    return records.withColumn("_chunk", F.floor(F.col("seq") / chunk))


#: Attribute slots of meshes: position, colour, texture coordinates.
ATTRIBUTES = (0, 2, 3)


def draw_state_asof(records: DataFrame, slots: int = 4, chunk: int = CHUNK) -> DataFrame:
    """State at each draw: matrix, active slot, texture in slot 0, bound array and element buffer, and per attribute its flag and pointer.

    Records have a tag, an argument, and an index (of the attribute). A texture goes
    to the slot that is active at that moment, and a pointer keeps the array buffer
    that is bound at that moment (``buffer_<k>``), so slot and buffer are carried to
    those records first and their results to the draws. Binding nothing, disabling
    and what isn't set yet are UNSET, which a later record can't look through.

    Each chunk of a dump finds its own last states; null is what it hasn't set. A row a
    chunk, the states at its end are put together in order of the chunks, and what is
    in force at a chunk's begin fills its nulls. A texture before the chunk's first
    slot waits for the slot in force at the begin, and so does a pointer for its buffer.
    """
    index = F.col("index") if "index" in records.columns else F.lit(0)
    last = lambda c, over: F.last(c, ignorenulls=True).over(over)
    of = lambda tag, value: F.when(F.col("tag") == tag, value)
    at = lambda k, tag, value: F.when((F.col("tag") == tag) & (index == k), value)
    some = F.when(F.col("arg") != 0, F.col("arg")).otherwise(UNSET)
    plain = {
        "matrix": (of("matrix", F.col("arg")), UNSET),
        "slot": (of("enable", F.col("arg") % slots), 0),
        "array_buffer": (of("array_buffer", some), UNSET),
        "element_buffer": (of("element_buffer", some), UNSET),
        **{f"enabled_{k}": (F.coalesce(at(k, "enable_attribute", F.lit(1)), at(k, "disable_attribute", F.lit(0))), 0) for k in ATTRIBUTES},
        **{f"pointer_{k}": (at(k, "attribute_pointer", F.col("arg")), UNSET) for k in ATTRIBUTES},
    }
    c = chunked(records, chunk).withColumns({n: last(v, up_to()) for n, (v, _) in plain.items()})
    texture = F.coalesce(of("bind_texture", F.col("arg")), of("disable_texture", F.lit(UNSET)))
    c = c.withColumns({
        "_known": last(F.when(F.col("slot") == 0, texture), up_to()),
        "_open": last(F.when(F.col("slot").isNull(), texture), up_to()),
        **{f"_held_{k}": last(at(k, "attribute_pointer", F.struct(F.col("array_buffer").alias("b"))), up_to()) for k in ATTRIBUTES},
    })
    own = [*plain, "_known", "_open", *[f"_held_{k}" for k in ATTRIBUTES]]
    ends = c.groupBy("dump_id", "_chunk").agg(F.max_by(F.struct(*own), "seq").alias("e")).select("dump_id", "_chunk", "e.*")
    starts = ends.withColumns({f"in_{n}": F.coalesce(last(F.col(n), earlier()), F.lit(none)) for n, (_, none) in plain.items()})
    late = {"texture": F.coalesce("_known", F.when(F.col("in_slot") == 0, F.col("_open"))), **{f"buffer_{k}": F.when(F.col(f"_held_{k}").isNotNull(), F.coalesce(F.col(f"_held_{k}.b"), F.col("in_array_buffer"))) for k in ATTRIBUTES}}
    starts = starts.withColumns(late).withColumns({f"in_{n}": F.coalesce(last(F.col(n), earlier()), F.lit(UNSET)) for n in late})
    starts = starts.select("dump_id", "_chunk", *[f"in_{n}" for n in (*plain, *late)])
    draws = c.where(F.col("tag") == "draw").select("dump_id", "_chunk", "seq", *own).join(starts, ["dump_id", "_chunk"])
    draws = draws.withColumns({n: F.coalesce(v, F.col(f"in_{n}")) for n, v in late.items()}).withColumns({n: F.coalesce(n, f"in_{n}") for n in plain})
    per = [f"{name}_{k}" for k in ATTRIBUTES for name in ("enabled", "pointer", "buffer")]
    return draws.select("dump_id", "seq", "matrix", "slot", "texture", "array_buffer", "element_buffer", *per)


def dispatch_number(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Running number, from 0, of draws and clears: within the chunk, after those of the chunks before."""
    hits = chunked(records.where(F.col("tag").isin("draw", "clear")), chunk)
    before = hits.groupBy("dump_id", "_chunk").agg(F.count("*").alias("_n")).select("dump_id", "_chunk", F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_before"))
    numbered = hits.withColumn("dispatch", F.count("*").over(up_to()) - 1).join(before, ["dump_id", "_chunk"])
    return numbered.withColumn("dispatch", F.col("dispatch") + F.col("_before")).drop("_chunk", "_before")


def data_sequence_gaps(records: DataFrame, stamp: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Records whose stamp isn't the one before, in order of seq, plus one. A chunk's first record follows the last one of the chunks before."""
    c = chunked(records, chunk)
    ends = c.groupBy("dump_id", "_chunk").agg(F.max_by(stamp, "seq").alias("_last"))
    starts = ends.select("dump_id", "_chunk", F.last("_last").over(earlier()).alias("_in"))
    before = F.lag(stamp).over(within())
    first = F.row_number().over(within()) == 1
    c = c.withColumns({"_lag": before, "_first": first}).join(starts, ["dump_id", "_chunk"])
    out = c.withColumn("expected", F.when(F.col("_first"), F.col("_in")).otherwise(F.col("_lag")) + 1).drop("_chunk", "_lag", "_first", "_in")
    return out.where(F.col(stamp) != F.col("expected"))


def matrix_inverse(m: pd.Series) -> pd.Series:
    """Inverses of row-major 4x4 matrices, a batch at a time; null where singular."""
    out = pd.Series([None] * len(m), index=m.index, dtype=object)
    some = np.flatnonzero(m.notna())
    if len(some):
        a = np.stack(m.iloc[some].to_list()).astype(float).reshape(-1, 4, 4)
        regular = np.abs(np.linalg.det(a)) > 1e-300
        for k, x in zip(some[regular], np.linalg.inv(a[regular]).reshape(-1, 16)):
            out.iloc[k] = x
    return out


def relative_matrices(draws: DataFrame, matrix: str = "m") -> DataFrame:
    """Each draw's matrix times the inverse of the one at its dump's first draw."""
    from geoloom.functions import geo

    inverse = F.pandas_udf(matrix_inverse, "array<double>")
    first = draws.groupBy("dump_id").agg(F.min_by(matrix, "seq").alias("first")).withColumn("inverse", inverse("first"))
    return draws.join(first, "dump_id").withColumn("relative", geo.multiply_matrices(F.col(matrix), F.col("inverse")))


def first_of(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value of each key's first row."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_triangle_draw(draws: DataFrame, keys: list[str], order: str, triangles: int = 4) -> DataFrame:
    """The last draw of triangles of each key; none if it has none."""
    return draws.where(F.col("primitive") == triangles).groupBy(*keys).agg(F.max(order).alias(order))


def polyline_source_target(dumps: DataFrame, polygons: DataFrame) -> DataFrame:
    """Dumps (dump_id, file) with the first polygon (by path_id) of the path file (file) of the same stem; none if there is no such file."""
    stem = lambda c: F.regexp_extract(c, r"([^/\\]*)\.[^.]*$", 1)
    first = polygons.groupBy(stem(F.col("file")).alias("stem")).agg(F.min("path_id").alias("polygon"))
    return dumps.withColumn("stem", stem(F.col("file"))).join(first, "stem", "left").select("dump_id", "polygon")


def texture_slots_by_first_use(binds: DataFrame, texture: str) -> DataFrame:
    """List index of each texture of a dump in order of its first bind."""
    first = binds.groupBy("dump_id", texture).agg(F.min("seq").alias("first"))
    return first.select("dump_id", texture, (F.row_number().over(W.partitionBy("dump_id").orderBy("first")) - 1).cast("bigint").alias("index"))


def cut_after_end(records: DataFrame, strip: Column) -> DataFrame:
    """Draws of each dump; after its first clear with the stencil bit strips only. One row a dump tells where that is."""
    stop = records.where((F.col("tag") == "clear") & F.col("stencil")).groupBy("dump_id").agg(F.min("seq").alias("_stop"))
    draws = records.where(F.col("tag") == "draw").join(stop, "dump_id", "left")
    return draws.where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop")) | strip).drop("_stop")


def records_of_class(records: DataFrame, tag: str = "code") -> DataFrame:
    """Class of 32-bit record tags: the top nibble, 1 command, 2 data, 3 picture, others skipped, 15 the end."""
    nibble = F.shiftright(tag, 28).bitwiseAND(15)
    kind = F.when(nibble == 1, "command").when(nibble == 2, "data").when(nibble == 3, "picture").when(nibble == 15, "end").otherwise("skipped")
    return records.withColumn("kind", kind).withColumn("function", F.col(tag).bitwiseAND((1 << 28) - 1))


def drawable(position: Column, position_buffer: Column, uv: Column, uv_buffer: Column, indexed: Column, element_buffer: Column, strip: Column, offset: Column) -> Column:
    """Whether a draw makes a mesh."""
    return (position & position_buffer & uv & uv_buffer & indexed & element_buffer) | (strip & position & (position_buffer | (offset > 0)))


def validate_codes(df: DataFrame, columns: dict[str, str], domains: DataFrame, keys: list[str]) -> DataFrame:
    """Violations (keys, column, domain, code) of code columns, each with its domain, against the table of domains (domain, code). Null codes are none.

    One anti-join for all columns. The domains are fixed lists and small.
    """
    checks = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("domain"), F.col(c).cast("bigint").alias("code")) for c, d in columns.items()])
    each = df.select(*keys, F.explode(checks).alias("_check")).select(*keys, "_check.*").where("code is not null")
    return each.join(domains.select("domain", F.col("code").cast("bigint")).distinct(), ["domain", "code"], "left_anti").select(*keys, "column", "domain", "code")


def resolve_data_refs(records: DataFrame, data: DataFrame) -> DataFrame:
    """A record's address to its data block; address 0 is the dump's first block."""
    first = data.groupBy("dump_id").agg(F.min("link_index").alias("first"))
    r = records.join(first, "dump_id", "left").withColumn("link_index", F.when(F.col("address") == 0, F.col("first")).otherwise(F.col("address"))).drop("first")
    return r.join(data, ["dump_id", "link_index"], "left")


def resolve_vertex_streams(draws: DataFrame, blocks: DataFrame) -> DataFrame:
    """A stream tag to the first sub-block with the same low 32 bits; tag 0 has none."""
    low = F.col("ref_tag").bitwiseAND(0xFFFFFFFF)
    first = blocks.groupBy("dump_id", low.alias("_low")).agg(F.min("block_no").alias("block_no"))
    d = draws.withColumn("_low", F.when(F.col("stream_tag") != 0, F.col("stream_tag").bitwiseAND(0xFFFFFFFF)))
    return d.join(first, ["dump_id", "_low"], "left").drop("_low")


def resolve_buffers(draws: DataFrame, uploads: DataFrame) -> DataFrame:
    """A buffer object to its last upload in the whole dump."""
    last = uploads.groupBy("dump_id", "buffer").agg(F.max_by("upload", "seq").alias("upload"))
    return draws.join(last, ["dump_id", "buffer"], "left")


#: Unknown tags of one number of words that a task meets.
TAGS_AT_ONCE = 20_000


def unknown_tag_candidates(records: DataFrame, functions: DataFrame, separator: str | None = None) -> DataFrame:
    """For commands of an unknown tag the unused functions without pointers whose parameters and return value fill the command's words. With a ``separator``, their names as one text.

    Names are listed once for each number of words, whatever the number of tags; tags
    and functions never meet one by one.
    """
    unused = functions.where("pointers = 0").join(records.select(F.col("tag").alias("function_tag")).distinct(), "function_tag", "left_anti")
    names = F.array_sort(F.collect_list("name"))
    lists = unused.groupBy((F.col("params") + F.col("returns")).alias("words")).agg((names if separator is None else F.array_join(names, separator)).alias("names"))
    lists = materialize(lists, "names")
    unknown = records.select("dump_id", "tag", "words").distinct().join(functions.select(F.col("function_tag").alias("tag")), "tag", "left_anti")
    return spread_join(materialize(unknown, "unknown"), lists, ["words"], "dump_id", TAGS_AT_ONCE, long=True).select("dump_id", "tag", "words", "names")
