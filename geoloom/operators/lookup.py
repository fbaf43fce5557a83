"""Table lookups, metadata and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.links import shuffled

# Statistics fields that metadata may hold, with their types
KNOWN = {"STATISTICS_MINIMUM": "d", "STATISTICS_MAXIMUM": "d", "STATISTICS_MEAN": "d", "STATISTICS_MEDIAN": "d", "STATISTICS_MODE": "d", "STATISTICS_STDDEV": "d", "STATISTICS_HISTONUMBINS": "l", "STATISTICS_HISTOMIN": "d", "STATISTICS_HISTOMAX": "d", "LAYER_TYPE": "e"}
LONGEST = 500


def leading_int(c: Column) -> Column:
    """The integer a text begins with, 0 if there is none."""
    digits = F.nullif(F.regexp_extract(c, r"^\s*([+-]?[0-9]{1,18})", 1), F.lit(""))
    return F.coalesce(digits.cast("bigint"), F.lit(0).cast("bigint"))


def lookup_first(df: DataFrame, key: str, table: DataFrame, table_key: str, field: str, criteria: str = "exact") -> DataFrame:
    """First row (by line_no) of the table whose key matches exactly, without regard to case, or as leading integers; no match gives an empty text."""
    norm = {"exact": lambda c: c, "nocase": F.lower, "integer": leading_int}[criteria]
    first = table.groupBy(norm(F.col(table_key)).alias("_key")).agg(F.min_by(field, "line_no").alias("_value"))
    out = df.withColumn("_key", norm(F.col(key))).join(first, "_key", "left")
    return out.withColumn(field, F.coalesce("_value", F.lit(""))).drop("_key", "_value")


def metadata_map(columns: DataFrame) -> DataFrame:
    """Key to value per map, of text columns with one row whose name doesn't begin with #; values cut to LONGEST bytes."""
    some = columns.where("type = 'string' and rows = 1 and not startswith(name, '#')")
    cut = F.when(F.octet_length("value") <= LONGEST, F.col("value")).otherwise(F.try_validate_utf8(F.substring(F.col("value").cast("binary"), 1, LONGEST).cast("string")))
    for k in (1, 2, 3):  # a character that the cut would split is left out
        cut = F.coalesce(cut, F.try_validate_utf8(F.substring(F.col("value").cast("binary"), 1, LONGEST - k).cast("string")))
    return some.groupBy("map_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", cut.alias("value"))))).alias("metadata"))


def metadata_route(entries: DataFrame) -> DataFrame:
    """Entries (key, value) to known statistics fields, cast by type, or free metadata."""
    kind = F.lit(None).cast("string")
    for k, v in KNOWN.items():
        kind = F.when(F.col("key") == k, v).otherwise(kind)
    out = entries.withColumn("kind", F.coalesce(kind, F.lit("free")))
    return out.withColumn("number", F.when(F.col("kind") == "d", F.expr("try_cast(value as double)")).when(F.col("kind") == "l", F.expr("try_cast(value as bigint)").cast("double")))


def points_in_quads(points: DataFrame, quads: DataFrame, cell: float, top: int = 60) -> DataFrame:
    """(point, quad) for points (px, py), taken at the pixel's centre, inside convex quads (x0, y0 .. x3, y3): the four cross products share one strict sign.

    A quad lies in the cells, 25 at most, of the level whose cells are a quarter of
    ``cell`` times a power of two that is as large as it is, so a point meets few quads
    that it isn't near to; points look into one cell a level that occurs.
    """
    low = {a: F.least(*[f"{a}{k}" for k in range(4)]) for a in "xy"}
    high = {a: F.greatest(*[f"{a}{k}" for k in range(4)]) for a in "xy"}
    size = F.greatest(*[high[a] - low[a] for a in "xy"])
    level = F.greatest(F.lit(0), F.least(F.lit(top), F.ceil(F.log2(F.greatest(size, F.lit(cell)) / cell)))).cast("int")
    q = quads.withColumn("_level", level)
    width = F.lit(cell / 4) * F.pow(F.lit(2.0), F.col("_level"))
    span = lambda a: F.explode(F.sequence(F.floor(low[a] / width), F.floor(high[a] / width)))
    used = q.agg(F.collect_set("_level")).scalar()
    q = q.withColumn("cell_x", span("x")).withColumn("cell_y", span("y"))
    x, y = F.col("px") + 0.5, F.col("py") + 0.5
    p = points.withColumn("_level", F.explode(used)).withColumn("cell_x", F.floor(x / width)).withColumn("cell_y", F.floor(y / width))
    cross = [(F.col(f"x{(k + 1) % 4}") - F.col(f"x{k}")) * (y - F.col(f"y{k}")) - (F.col(f"y{(k + 1) % 4}") - F.col(f"y{k}")) * (x - F.col(f"x{k}")) for k in range(4)]
    inside = (F.least(*cross) > 0) | (F.greatest(*cross) < 0)
    return p.join(shuffled(q), ["_level", "cell_x", "cell_y"]).where(inside).drop("_level", "cell_x", "cell_y", *[f"{a}{k}" for a in "xy" for k in range(4)])


def fold_actions(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Per key whether there is a set and a remove action, and the number of clicks (set, removed, clicks). Folded ones can be folded again."""
    folded = "clicks" in hits.columns
    set_, removed, clicks = (F.col(c) for c in ("set", "removed", "clicks")) if folded else (F.col("action") == "set", F.col("action") == "remove", (F.col("action") == "click").cast("bigint"))
    return hits.groupBy(*keys).agg(F.bool_or(set_).alias("set"), F.bool_or(removed).alias("removed"), F.sum(clicks).alias("clicks"))


def patch_selection(quads: DataFrame, hits: DataFrame) -> DataFrame:
    """Selected or not per quad: ((initial or any set hit) and no remove hit), turned over if the click hits are odd. Hits have an action, or are those of pixels whose actions are folded."""
    h = fold_actions(hits, ["quad_id"])
    no = F.lit(False)
    out = quads.join(h, "quad_id", "left")
    base = (F.col("initial") | F.coalesce("set", no)) & ~F.coalesce("removed", no)
    return out.select("quad_id", (base != (F.coalesce("clicks", F.lit(0)) % 2 == 1)).alias("selected"))


def selected_triangles(selection: DataFrame) -> DataFrame:
    """Two triangles a selected quad."""
    return selection.where("selected").select("quad_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn("triangle", F.col("quad_id") * 2 + F.col("half"))
