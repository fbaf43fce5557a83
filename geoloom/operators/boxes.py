"""Boxes: bounds, roll-ups and overlap joins. Overlap is strict: touching boxes and boxes without extent overlap nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.operators.links import components, shuffled
from geoloom.storage import job, materialize, result

SIDES = ("min_x", "min_y", "max_x", "max_y")


def bbox(points: DataFrame, keys: list[str], axes: dict[str, str]) -> DataFrame:
    """Smallest box of the points per key: min_<axis> and max_<axis>; keys without points have none."""
    return points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{axis}") for axis, c in axes.items() for n, f in (("min", F.min), ("max", F.max))])


def bbox_rollup(points: DataFrame, levels: list[str], axes: dict[str, str]) -> DataFrame:
    """Boxes of each level, and of all. Points are first folded to the lowest level's boxes, so the roll-up handles few rows."""
    low = bbox(points, levels, axes)
    parts = [f(f"{n}_{axis}").alias(f"{n}_{axis}") for axis in axes for n, f in (("min", F.min), ("max", F.max))]
    return low.rollup(*levels).agg(*parts, F.grouping_id().cast("int").alias("level"))


def union_batches(world: DataFrame, batch: DataFrame, level: str, axes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The world with a new batch appended, and the merged boxes of each batch and of all."""
    both = world.unionByName(batch)
    return both, bbox_rollup(both, [level], axes)


def box_measures(d: int = 2) -> dict[str, Column]:
    """Centroid, diagonal, radius, longest axis and area or volume of the columns min_<axis>, max_<axis>."""
    axes = "xyz"[:d]
    size = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]
    diagonal = F.sqrt(sum((s * s for s in size[1:]), size[0] * size[0]))
    content = size[0]
    for s in size[1:]:
        content = content * s
    longest = F.array_position(F.array(*size), F.greatest(*size)).cast("int") - 1
    return {f"centre_{a}": (F.col(f"max_{a}") + F.col(f"min_{a}")) * 0.5 for a in axes} | {"diagonal": diagonal, "radius": diagonal * 0.5, "longest": longest, "content": content}


def intersection(a: str, b: str) -> dict[str, Column]:
    """Intersection of boxes with column suffixes a and b, and whether it has an inside."""
    out = {s: (F.greatest if s.startswith("min") else F.least)(F.col(s + a), F.col(s + b)) for s in SIDES}
    return out | {"overlaps": (out["min_x"] < out["max_x"]) & (out["min_y"] < out["max_y"])}


#: Lowest and highest level of cells; each is twice as wide as the one before, those of level 0 as wide as asked for.
LEAST, TOP = -4, 60
#: Levels that a large box goes down to meet small ones: into 81 cells at most, 64 times smaller than its own.
DEEP = 3


def _meets(larger: Column, smaller: Column) -> Column:
    """Level of the cells where a box of one level meets smaller ones of another. Boxes of the top level may be far larger than its cells and stay there."""
    return F.when(larger == TOP, larger).otherwise(F.greatest(smaller, larger - DEEP))


def _levels(boxes: DataFrame, cell: float) -> DataFrame:
    """Boxes with an inside, and the level whose cells are as large as they are."""
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    level = F.greatest(F.lit(LEAST), F.least(F.lit(TOP), F.ceil(F.log2(size / cell)))).cast("int")
    return boxes.where("min_x < max_x and min_y < max_y").withColumn("_level", level)


def _cells(boxes: DataFrame, cell: float, level: Column) -> DataFrame:
    """A row for each cell of the level that a box touches, and whether it is the box's first one along each axis (first_x, first_y)."""
    width = F.lit(cell) * F.pow(F.lit(2.0), level)
    at = lambda side: F.floor(F.col(side) / width)
    for a in "xy":
        boxes = boxes.withColumn(f"cell_{a}", F.explode(F.sequence(at(f"min_{a}"), at(f"max_{a}")))).withColumn(f"first_{a}", F.col(f"cell_{a}") == at(f"min_{a}"))
    return boxes


def _roles(boxes: DataFrame, others: DataFrame, cell: float, larger: int, smaller: int) -> DataFrame:
    """A row for each cell that a box touches where it meets smaller ones of ``others``, in the meeting ``larger``, and where it meets larger ones, in the meeting ``smaller``. Boxes of one level meet in meeting 0. ``_of`` is the level of the larger box."""
    boxes = boxes.withColumn("_levels", others.agg(F.collect_set("_level")).scalar())
    own = F.col("_level")
    below = F.filter("_levels", lambda at: at <= own if larger == 0 else at < own)
    above = F.filter("_levels", lambda at: at >= own if smaller == 0 else at > own)
    low = F.array_distinct(F.transform(below, lambda at: _meets(own, at)))
    roles = F.concat(F.transform(low, lambda at: F.struct(at.alias("at"), own.alias("of"), F.lit(larger).alias("meeting"))), F.transform(above, lambda at: F.struct(_meets(at, own).alias("at"), at.alias("of"), F.lit(smaller).alias("meeting"))))
    placed = boxes.withColumn("_role", F.explode(roles)).select("*", F.col("_role.at").alias("_at"), F.col("_role.of").alias("_of"), F.col("_role.meeting").alias("_meeting"))
    return _cells(placed, cell, F.col("_at")).drop(*SIDES, "_level", "_levels", "_role")


def candidates(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Rows of both sides that meet in a cell; sides' columns end in _a and _b.

    Boxes of ``a`` meet those of ``b`` that are no larger (meeting 0), and those of ``b``
    meet smaller ones of ``a`` (meeting 1), in cells of the smaller one's level, but at
    most DEEP levels below the larger's. So a large box is compared with what lies near
    it, a cell holds a part of what a crowd of large boxes overlaps, and a huge box
    costs a few rows and one or so for each box of the other side. Levels of the larger
    box don't mix, so a pair meets at one level.
    """
    left = _levels(a, cell).withColumnsRenamed({s: s + "_a" for s in SIDES}).withColumns({s: F.col(s + "_a") for s in SIDES})
    right = _levels(b, cell).withColumnsRenamed({s: s + "_b" for s in SIDES}).withColumns({s: F.col(s + "_b") for s in SIDES})
    first = lambda side: {f"first_{a}": f"first_{a}{side}" for a in "xy"}
    homes = _roles(left, right, cell, 0, 1).withColumnsRenamed(first("_a"))
    return homes.join(shuffled(_roles(right, left, cell, 1, 0).withColumnsRenamed(first("_b"))), ["_at", "_of", "_meeting", "cell_x", "cell_y"])


def box_overlap_join(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """All pairs of boxes that overlap, with their intersection as min_x..max_y; the other box columns are dropped.

    Boxes of each side have levels by their size, from cells of a sixteenth of ``cell``
    on. A pair meets by an equi-join on cells of which the smaller box touches four at
    most and the larger one 81, so a few huge boxes don't multiply into small cells. A
    pair that meets in several cells is kept in the one that holds the smallest corner
    of its intersection, which is the first of one box at least, so no distinct is needed. Only
    levels that occur on the other side are looked into; each side's levels are found
    by a pass over its box columns. Both sides are plain shuffles on the cell, so that
    Spark splits a crowded one. Columns but the box must differ between the sides.
    """
    cut = intersection("_a", "_b")
    corner = (F.col("first_x_a") | F.col("first_x_b")) & (F.col("first_y_a") | F.col("first_y_b"))
    met = candidates(a, b, cell).where(corner & cut["overlaps"])
    return met.withColumns({s: cut[s] for s in SIDES}).drop("_at", "_of", "_meeting", "cell_x", "cell_y", *[s + e for s in (*SIDES, "first_x", "first_y") for e in ("_a", "_b")])


#: Copies of a box in tiles, on average; the greatest size of a patch, in average sizes; cells of a tile's side, in whose order patches are compared, and how many of them at least together; rows of tiles that a task takes; comparisons and listed keys at a time.
COPIES, SPREAD, FINE, COMPARED, TILED, AT_ONCE, LISTED = 16, 16, 16, 256, 100_000, 4_000_000, 1_000_000


def patch_overlap_index(patches: DataFrame, patch: str, others: dict[str, tuple[DataFrame, str]], cell: float, separator: str | None = None) -> DataFrame:
    """Per patch the ordered lists of overlapping boxes of each kind; null if there is none. With a ``separator``, each list as one text.

    A patch lies in one tile, twice as wide as the largest patch, and other boxes in all
    tiles whose patches they may reach. So the patch's lists are whole where they are
    made, and neither pairs nor lists are shuffled. Where this takes too many copies
    (boxes of all sizes), or a patch comes twice, pairs are joined and grouped instead.
    """
    width, rows = _tile_width(patches, patch, others, cell)
    if width is not None:
        return _lists_by_tile(patches, patch, others, width, rows, separator)
    out = patches.select(patch)
    for name, (boxes, key) in others.items():
        pairs = box_overlap_join(patches.select(F.col(patch).alias("_patch"), *SIDES), boxes.select(F.col(key).alias("_key"), *SIDES), cell)
        listed = F.array_sort(F.collect_list("_key"))
        lists = pairs.groupBy(F.col("_patch").alias(patch)).agg((listed if separator is None else F.array_join(listed.cast("array<string>"), separator)).alias(name))
        out = out.join(lists, patch, "left")
    return out


def _tile_width(patches: DataFrame, patch: str, others: dict[str, tuple[DataFrame, str]], cell: float) -> tuple[float | None, int]:
    """Width of the tiles and the rows that lie in them, or no width if pairs have to be grouped."""
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    far = F.greatest(*[F.abs(s) for s in SIDES])
    measure = lambda df: df.where("min_x < max_x and min_y < max_y").agg(F.count("*").alias("n"), F.max(size).alias("most"), F.avg(size).alias("mean"), F.avg(size * size).alias("square"), F.max(far).alias("far")).first()
    own = measure(patches)
    width = 2 * own["most"] if own["n"] else cell
    if own["n"] and not (0 < own["most"] <= SPREAD * own["mean"]):
        return None, 0
    rows = own["n"]
    for m in [own, *(measure(boxes) for boxes, _ in others.values())]:
        if not m["n"]:
            continue
        around = 1.5 * width
        copies = (m["square"] + 2 * m["mean"] * around + around**2) / width**2
        if not (copies <= COPIES and m["far"] / width < 2**50):  # nor with infinite sides or none
            return None, 0
        rows += int(copies * m["n"])
    twice = patches.where(F.col(patch).isNotNull()).groupBy(patch).agg(F.count("*").alias("n")).where("n > 1")
    return (width, rows) if twice.isEmpty() else (None, 0)


def _lists_by_tile(patches: DataFrame, patch: str, others: dict[str, tuple[DataFrame, str]], width: float, rows: int, separator: str | None) -> DataFrame:
    tile = lambda c: F.floor(c / width)
    inside = F.coalesce(F.expr(f"min_x < max_x and min_y < max_y and `{patch}` is not null"), F.lit(False))
    fine = [F.floor(F.col(f"min_{a}") / (width / FINE)) for a in "yx"]
    placed = patches.where(inside).select(*[tile(F.col(f"min_{a}")).alias(f"tile_{a}") for a in "xy"], F.lit(len(others)).alias("kind"), *[f.alias(f"fine_{a}") for a, f in zip("yx", fine)], *SIDES, F.col(patch).alias("patch"))
    reach = width / 2 * (1 + 1e-9)  # the largest patch
    types = {patch: patches.schema[patch].dataType}
    for k, (name, (boxes, key)) in enumerate(others.items()):
        at = boxes.where(f"min_x < max_x and min_y < max_y and `{key}` is not null")
        for a in "xy":
            at = at.withColumn(f"tile_{a}", F.explode(F.sequence(tile(F.col(f"min_{a}") - reach), tile(F.col(f"max_{a}")))))
        text = [] if separator is None else [F.col(key).cast("string").alias(f"text_{k}")]
        placed = placed.unionByName(at.select("tile_x", "tile_y", F.lit(k).alias("kind"), *SIDES, F.col(key).alias(f"key_{k}"), *text), allowMissingColumns=True)
        types[name] = T.ArrayType(boxes.schema[key].dataType) if separator is None else T.StringType()
    tasks = max(-(-rows // TILED), patches.sparkSession.sparkContext.defaultParallelism)
    order = ["tile_x", "tile_y", "kind", "fine_y", "fine_x", *[f"key_{k}" for k in range(len(others))]]
    schema = T.StructType([T.StructField(c, t) for c, t in types.items()])
    lists = placed.repartition(tasks, "tile_x", "tile_y").sortWithinPartitions(*order).mapInArrow(_lister(list(others), patch, separator), schema)
    return lists.unionByName(patches.where(~inside).select(patch), allowMissingColumns=True)


def _runs(batch: pa.RecordBatch, columns: list[str], least: int = 1) -> Iterator[tuple[int, int]]:
    """Begin and end of the rows that are alike in the columns; runs of less than ``least`` rows go on."""
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        x = batch[c].fill_null(0).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    cuts = [0]
    for k in (*np.flatnonzero(new).tolist(), batch.num_rows):
        if k - cuts[-1] >= least or k == batch.num_rows:
            cuts.append(k)
    return zip(cuts[:-1], cuts[1:])


def _lister(names: list[str], patch: str, separator: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows in the order of tiles, in which other boxes come before patches, to the patches with their lists."""
    column = "key" if separator is None else "text"

    def sides(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
        return [np.concatenate([b[s].to_numpy() for b in batches]) if batches else np.empty(0) for s in SIDES]

    def met(boxes: list[np.ndarray], own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Number of boxes that overlap each patch, and those boxes in turn, for some patches at a time."""
        x0, y0, x1, y1 = boxes
        near = np.flatnonzero((x0 < own[2].max()) & (x1 > own[0].min()) & (y0 < own[3].max()) & (y1 > own[1].min()))
        x0, y0, x1, y1 = (c[near] for c in boxes)
        step = max(1, AT_ONCE // max(1, len(near)))
        for i in range(0, len(own[0]), step):
            a0, b0, a1, b1 = (c[i : i + step, None] for c in own)
            hit = x0 < a1
            hit &= x1 > a0
            hit &= y0 < b1
            hit &= y1 > b0
            counts = np.count_nonzero(hit, axis=1)
            flat = np.flatnonzero(hit) - np.repeat(np.arange(len(hit)) * len(near), counts)
            yield counts, near[flat]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, found, boxes, keys = None, [[] for _ in names], [], []
        for batch in batches:
            for i, j in _runs(batch, ["tile_x", "tile_y", "kind"]):
                part = batch.slice(i, j - i)
                kind, here = part["kind"][0].as_py(), (part["tile_x"][0].as_py(), part["tile_y"][0].as_py())
                if here != tile:
                    tile, found, boxes = here, [[] for _ in names], []
                if kind < len(names):
                    found[kind].append(part)
                    continue
                if not boxes:
                    boxes = [sides(x) for x in found]
                    keys = [pa.concat_arrays([b[f"{column}_{k}"] for b in x]) if x else part[f"{column}_{k}"].slice(0, 0) for k, x in enumerate(found)]
                    found = [[] for _ in names]
                for a, z in _runs(part, ["fine_y", "fine_x"], COMPARED):
                    some = part.slice(a, z - a)
                    yield from lists(some, sides([some]), boxes, keys)

    def lists(some: pa.RecordBatch, own: list[np.ndarray], boxes: list[list[np.ndarray]], keys: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        at = 0
        todo = [met(b, own) for b in boxes]
        left = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(names)
        while at < some.num_rows:
            for k in range(len(names)):  # kinds come in pieces of their own
                if not len(left[k][0]):
                    left[k] = next(todo[k])
            n = min(len(c) for c, _ in left)
            for c, _ in left:  # no more than LISTED keys of a kind, or one patch
                n = max(1, min(n, int(np.searchsorted(np.cumsum(c), LISTED, "right"))))
            columns = []
            for k, (c, which) in enumerate(left):
                end = int(c[:n].sum())
                offsets = np.concatenate([[0], np.cumsum(c[:n])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), keys[k].take(pa.array(which[:end])), mask=pa.array(c[:n] == 0))
                columns.append(values if separator is None else pc.binary_join(values, separator))
                left[k] = (c[n:], which[end:])
            yield pa.RecordBatch.from_arrays([some["patch"].slice(at, n), *columns], names=[patch, *names])
            at += n

    return run


def scissor(boxes: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Clip to one region, unless its radius is at most 0.0001; boxes outside are dropped."""
    x0, y0, x1, y1 = region
    if ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 / 2 <= 0.0001:
        return boxes
    low = {"min_x": F.greatest("min_x", F.lit(x0)), "min_y": F.greatest("min_y", F.lit(y0)), "max_x": F.least("max_x", F.lit(x1)), "max_y": F.least("max_y", F.lit(y1))}
    return boxes.where((F.greatest("min_x", F.lit(x0)) < F.least("max_x", F.lit(x1))) & (F.greatest("min_y", F.lit(y0)) < F.least("max_y", F.lit(y1)))).withColumns(low)


def prune_candidates(paths: DataFrame, meshes: DataFrame, levels: list[str], cell: float) -> DataFrame:
    """(path_id, mesh_id) whose boxes overlap at every level: batch, group, mesh.

    The boxes of upper levels hold those below them, so what overlaps a mesh overlaps its
    group and batch, too. Upper levels are small and only cut what goes on: paths that
    overlap none of their boxes, and meshes of boxes that no path overlaps, are left out
    before the next. The pairs of meshes themselves aren't shuffled.
    """
    paths = materialize(paths.where("min_x < max_x and min_y < max_y"), "paths")  # others overlap nothing
    for k in range(1, len(levels) + 1):
        keys = levels[:k]
        boxes = meshes.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
        pairs = box_overlap_join(paths, boxes, cell).select("path_id", *keys)
        if k < len(levels):
            found = materialize(pairs, "upper-pairs")
            paths = paths.join(found.select("path_id").distinct(), "path_id", "left_semi")
            meshes = meshes.join(found.select(*keys).distinct(), keys, "left_semi")
    return pairs


def visible(boxes: DataFrame, matrix: list[float], scale: float = 1.0) -> DataFrame:
    """Boxes that meet the unit clip volume after projection of their 8 corners (row vectors, w = 0 gives 0)."""
    out = {}
    corners = [[F.col(f"{'max' if k >> i & 1 else 'min'}_{a}") * scale for i, a in enumerate("xyz")] for k in range(8)]
    projected = []
    for x, y, z in corners:
        v = [x * matrix[j] + y * matrix[4 + j] + z * matrix[8 + j] + matrix[12 + j] for j in range(4)]
        projected.append([F.coalesce(F.try_divide(e, v[3]), F.lit(0.0)) for e in v[:3]])
    for j, a in enumerate("xyz"):
        out[f"lo_{a}"], out[f"hi_{a}"] = F.least(*[p[j] for p in projected]), F.greatest(*[p[j] for p in projected])
    inside = (F.col("lo_x") < 1) & (F.col("hi_x") > -1) & (F.col("lo_y") < 1) & (F.col("hi_y") > -1) & (F.col("lo_z") < 1) & (F.col("hi_z") > 0)
    return boxes.withColumns(out).where(inside)


#: What sizes and offsets may be off by rounding, as a share of the size.
SLACK = 0.01
#: Where cells begin, in cells: whole coordinates don't lie on their edges.
SHIFT = 0.37


def near_duplicate_pairs(meshes: DataFrame, share: float = 0.8) -> DataFrame:
    """(mesh_id, earlier_id) of different files with equal vertex and index counts whose boxes overlap by more than ``share`` (at least a half) of both volumes, in 32-bit floats. Each pair comes once.

    Along every axis such boxes overlap by more than ``share`` of the larger size, so
    their corners differ by less than the rest of it, and the smaller size is more than
    the third root of ``share`` of the larger. They meet at the level of the larger box,
    whose cells are at least as wide. A mesh stands at its own level, and at the next
    only if a larger one that it may match can be there; the earlier mesh in its
    corner's cell, the later one in the cells that its match's corner may be in, eight
    at most, and mostly one.
    """
    f32 = lambda c: c.cast("float")
    level = lambda size: F.ceil(F.log2(size) + 0.5).cast("int")
    base = meshes.where("size > 0").withColumn("level", level(F.col("size")))
    above = level(F.col("size") / ((1 - SLACK) * share ** (1 / 3)))
    base = base.withColumn("at_level", F.explode(F.array_distinct(F.array(F.col("level"), above))))
    width = F.pow(F.lit(2.0), F.col("at_level") - 0.5)
    cell = lambda c: F.floor(c / width + SHIFT)
    keys = ["n_vertex", "n_index", "at_level"]
    mine = base.select(*keys, "mesh_id", "file_no", "level", "x0", "y0", "z0", "size")
    for a in "xyz":
        reach = (1 - share + SLACK) * F.col("size") + F.abs(f"{a}0") * 1e-15
        mine = mine.withColumn(f"at_{a}", F.explode(F.sequence(cell(F.col(f"{a}0") - reach), cell(F.col(f"{a}0") + reach))))
    other = base.select(*keys, *[cell(F.col(f"{a}0")).alias(f"at_{a}") for a in "xyz"], F.col("mesh_id").alias("earlier_id"), F.col("file_no").alias("earlier_file"), F.col("level").alias("earlier_level"), *[F.col(f"{a}0").alias(f"o{a}0") for a in "xyz"], F.col("size").alias("other_size"))
    cut = [F.least(F.col(f"{a}0") + F.col("size"), F.col(f"o{a}0") + F.col("other_size")) - F.greatest(f"{a}0", f"o{a}0") for a in "xyz"]
    both = f32(cut[0] * cut[1] * cut[2])
    volume = lambda size: f32(F.col(size) * F.col(size) * F.col(size))
    met = mine.join(shuffled(other), [*keys, "at_x", "at_y", "at_z"]).where((F.greatest("level", "earlier_level") == F.col("at_level")) & (F.col("file_no") > F.col("earlier_file")) & (cut[0] > 0) & (cut[1] > 0) & (cut[2] > 0))
    return met.where((f32(both / volume("size")) > F.lit(share).cast("float")) & (f32(both / volume("other_size")) > F.lit(share).cast("float"))).select("mesh_id", "earlier_id")


#: Pairs of a component that one task decides on; larger ones are decided in rounds.
TOGETHER = 1_000_000


def dedup_meshes(meshes: DataFrame, pairs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Meshes that match no kept mesh of an earlier file, decided in file order.

    Up to ``together`` pairs are decided by one task in one pass. More fall into connected
    components, which don't know of each other. Each of up to ``together`` pairs is
    decided by one task in one pass, whatever the length of its chains, so the number of jobs is that of the components' rounds. Larger ones
    are decided in rounds over the pair table: a mesh without a kept or undecided
    earlier match is kept, one with a kept earlier match is dropped; each round is
    written, and decides at least the earliest undecided file.
    """
    with job(meshes.sparkSession):
        return result(meshes.join(_dropped_meshes(pairs, together), "mesh_id", "left_anti"), "deduped")


PAIR = pa.schema([("mesh_id", pa.int64()), ("earlier_id", pa.int64())])


def greedy(group: pa.Table) -> pa.Table:
    """The meshes of a component that are dropped. A mesh is decided once its earlier matches are."""
    later, waiting = {}, {}
    for mesh, earlier in zip(group["mesh_id"].to_pylist(), group["earlier_id"].to_pylist()):
        later.setdefault(earlier, []).append(mesh)
        waiting[mesh] = waiting.get(mesh, 0) + 1
        waiting.setdefault(earlier, 0)
    dropped = set()
    ready = [m for m, n in waiting.items() if not n]
    while ready:
        mesh = ready.pop()
        for other in later.get(mesh, ()):
            if mesh not in dropped:
                dropped.add(other)
            waiting[other] -= 1
            if not waiting[other]:
                ready.append(other)
    return pa.table({"mesh_id": pa.array(sorted(dropped), pa.int64())})


def _dropped_meshes(pairs: DataFrame, together: int) -> DataFrame:
    # a pair that comes twice changes nothing, and pairs are too many to be shuffled for it
    pairs = materialize(pairs.select(F.col("mesh_id").cast("bigint"), F.col("earlier_id").cast("bigint")), "pairs")
    if pairs.count() <= together:  # as few as one component may have: all in one pass
        return pairs.coalesce(1).mapInArrow(lambda batches: greedy(pa.Table.from_batches(batches, schema=PAIR)).to_batches(), "mesh_id bigint")
    groups = components(pairs.select(F.col("earlier_id").alias("a"), F.col("mesh_id").alias("b")))
    placed = materialize(pairs.join(groups.withColumnRenamed("node", "mesh_id"), "mesh_id"), "placed")
    large = materialize(placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > together).select("component"), "large")
    dropped = placed.join(large, "component", "left_anti").groupBy("component").applyInArrow(greedy, "mesh_id bigint")
    if large.isEmpty():
        return dropped
    return dropped.union(_dropped_in_rounds(placed.join(large, "component", "left_semi").select("mesh_id", "earlier_id")))


def _dropped_in_rounds(pairs: DataFrame) -> DataFrame:
    open_pairs = materialize(pairs, "pairs")
    earlier = open_pairs.select(F.col("earlier_id").alias("mesh_id")).distinct()
    kept = materialize(earlier.join(open_pairs.select("mesh_id").distinct(), "mesh_id", "left_anti"), "kept")
    all_dropped = None
    while not open_pairs.isEmpty():
        # a match with a kept mesh drops
        dropped = materialize(open_pairs.join(kept.select(F.col("mesh_id").alias("earlier_id")), "earlier_id", "left_semi").select("mesh_id").distinct(), "dropped")
        left = materialize(open_pairs.join(dropped, "mesh_id", "left_anti"), "left")
        open_pairs = materialize(left.join(dropped.select(F.col("mesh_id").alias("earlier_id")), "earlier_id", "left_anti"), "pairs")
        kept = materialize(left.select("mesh_id").distinct().join(open_pairs.select("mesh_id").distinct(), "mesh_id", "left_anti"), "kept")
        all_dropped = dropped if all_dropped is None else all_dropped.union(dropped)
    return all_dropped
