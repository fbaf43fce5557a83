"""Near-dedup of embeddings by an inverted multi-index.

Each half of the vectors has a codebook of its own, fitted by k-means on a bounded
sample; a pair of centroids is a cell of the product grid. Every vector is filed in one
cell. A search takes the cells in the order of a lower bound of their distance: a
vector that is nearest to centroid i of a half is beyond the plane midway between i
and the searcher's own centroid, and the squared distances from the planes of both
halves add up. Cells beyond the distance that the threshold allows can't hold a
partner, so a search that goes that far misses nothing. How far it has to go for the
target recall is measured: on the sample against all vectors by brute force, and on
made-up partners just at the threshold, which differ in all components, in one half
or in few. The largest of these radii is used.

Equal vectors are one class from the start. Searchers and filed vectors of a cell meet
block by block, whole matrices at a time, and each pair is verified by its cosine. A
block gives the number of links of each searcher and links of each vector to the
smallest one that it reaches within the block: no list of pairs leaves it.
Components come of union-find over those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.graph import components, spread_join
from geoloom.storage import arrow_rows, job, materialize, result

COSINE = 0.98
#: Share of the links that searches are to reach, and the sampled vectors: for the codebooks, and as searchers for the radius.
RECALL, SAMPLE, SEARCHERS = 0.999, 20_000, 512
#: Vectors a cell aimed at, over all labels, and the largest codebook. Fewer vectors a cell mean more cells a search, each of which is sent a copy of the searcher.
FILED, CENTROIDS = 512, 1024
#: Vectors of a block.
BLOCK = 1024
#: Steps of the measured radius; sampled links below which only the made-up partners count.
STEPS, ENOUGH = 256, 100


def matrix(column: pa.Array, width: int, single: bool) -> np.ndarray:
    """Vectors held as bytes, all of one width, as a matrix."""
    kind = np.dtype("<f4" if single else "<f8")
    if not len(column):
        return np.empty((0, width))
    data = np.frombuffer(column.buffers()[2], kind)
    return data[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def tamed(x: np.ndarray) -> np.ndarray:
    """Each vector by a power of two so that its squares neither overflow nor vanish; cosines stay as they are."""
    largest = np.abs(x).max(axis=1)
    exponent = np.frexp(largest)[1]
    return np.ldexp(x, -exponent[:, None])


def packed(width: int, single: bool):
    """Rows as identifier, label, length and bytes, padded to a common width; those that can't be linked have none."""
    kind = np.dtype("<f4" if single else "<f8")
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for v, label, key in zip(batch["vector"], batch["label"], batch["id"]):
                values = v.values if v.is_valid else None
                x = values.to_numpy(zero_copy_only=False).astype(kind) if values is not None and len(values) and not values.null_count else None
                fine = x is not None and label.is_valid and key.is_valid and np.isfinite(x).all() and x.any()
                sizes.append(len(x) if fine else None)
                out.append((np.pad(x, (0, width - len(x))) + kind.type(0)).tobytes() if fine else None)  # + 0: no negative zero
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    return run


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of the rows of ``x``; an empty one is put on the row that is worst off."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)
        nearest = d.argmin(axis=1)
        worst = np.argsort(-d[np.arange(len(x)), nearest])
        sums, counts = np.zeros_like(centroids), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, x)
        for j, i in enumerate(np.flatnonzero(counts == 0)):
            sums[i], counts[i] = x[worst[j]], 1
        centroids = sums / counts[:, None]
    return centroids


class Grid:
    """Codebooks of both halves."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = max(1, sample.shape[1] // 2)
        self.books = [k_means(part, k) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.apart = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 1e-300)) for c in self.books]

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the nearest centroid, and per centroid the squared distance from the plane midway between both."""
        out = []
        for part, c, apart in zip((x[:, : self.half], x[:, self.half :]), self.books, self.apart):
            d = (part * part).sum(axis=1)[:, None] - 2 * part @ c.T + (c * c).sum(axis=1)
            own = d.argmin(axis=1)
            gap = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * apart[own])
            gap[np.arange(len(x)), own] = 0  # also where two centroids are the same
            out.append((own, gap * gap))
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        (i, _), (j, _) = self.bounds(x)
        return i * CENTROIDS + j

    def visits(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that a search visits, by row and nearest first.

        The centroids of each half stand in the order of their bounds. Of a row's r-th
        centroid of the first half, the traversal takes those of the second half in turn
        until the sum is beyond the radius.
        """
        (_, a), (_, b) = self.bounds(x)
        order_a, order_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        row, first = np.nonzero(a <= radius)
        rows, cells, sums = [], [], []
        for at in range(b.shape[1]):
            total = a[row, first] + b[row, at]
            stay = total <= radius
            row, first = row[stay], first[stay]
            if not len(row):
                break
            rows.append(row)
            sums.append(total[stay])
            cells.append(order_a[row, first] * CENTROIDS + order_b[row, at])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.lexsort((np.concatenate(sums), row))
        return row[order], cell[order]

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bound at which a search for each row of ``x`` comes to the cell of the same row of ``y``."""
        out = np.zeros(len(x))
        for (_, gaps), (own, _) in zip(self.bounds(x), self.bounds(y)):
            out += gaps[np.arange(len(x)), own]
        return out


def made_up(x: np.ndarray, cosine: float, seed: int = 1) -> Iterator[np.ndarray]:
    """Partners just at the threshold: different in all components, in either half, in three."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    few = np.zeros((n, d))
    np.put_along_axis(few, rng.random((n, d)).argsort(axis=1)[:, : min(3, d)], 1, 1)
    left = np.zeros((n, d))
    left[:, : max(1, d // 2)] = 1
    for where in (np.ones((n, d)), left, 1 - left, few):
        way = rng.normal(size=(n, d)) * where
        way -= (way * x).sum(axis=1)[:, None] * x
        length = np.sqrt((way * way).sum(axis=1))
        fine = length > 1e-9
        way[fine] /= length[fine][:, None]
        yield cosine * x + np.sqrt(1 - cosine * cosine) * way


def sampled_links(grid: Grid, searchers: np.ndarray, of: list[tuple[str, int]], cosine: float, width: int, single: bool):
    """How many links of the searchers lie at which step of the radius."""
    farthest = 2 - 2 * cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.zeros(STEPS + 1, np.int64)
        labels: dict[tuple[str, int], list[int]] = {}
        for k, key in enumerate(of):
            labels.setdefault(key, []).append(k)
        for batch in batches:
            x = unit(tamed(matrix(batch["vector"], width, single)))
            keys = list(zip(batch["label"].to_pylist(), batch["size"].to_pylist()))
            for key in set(keys) & labels.keys():
                mine = np.array([k == key for k in keys])
                y, q = x[mine], searchers[labels[key]]
                cosines = q @ y.T
                s, r = np.nonzero((cosines >= cosine) & (cosines < 1 - 1e-12))
                at = grid.between(q[s], y[r]) / farthest * STEPS
                steps += np.bincount(np.minimum(np.ceil(at), STEPS).astype(np.int64), minlength=STEPS + 1)
        held = np.flatnonzero(steps)
        yield pa.RecordBatch.from_pydict({"step": held, "n": steps[held]})

    return run


def radius(grid: Grid, classes: DataFrame, sample: list, cosine: float, recall: float, width: int, single: bool) -> float:
    """The smallest radius, in steps, that reaches the recall on sampled links and on made-up partners; never beyond the one at which nothing is missed."""
    farthest = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    x = unit(tamed(np.frombuffer(b"".join(r["vector"] for r in sample[:SEARCHERS]), "<f4" if single else "<f8").reshape(-1, width).astype(float)))
    if recall >= 1:
        return farthest
    found = max(float(np.quantile(grid.between(x, y), recall)) for y in made_up(x, cosine))
    of = [(r["label"], r["size"]) for r in sample[:SEARCHERS]]
    counts = classes.select("label", "size", "vector").mapInArrow(sampled_links(grid, x, of, cosine, width, single), "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect()
    steps = np.zeros(STEPS + 1)
    for r in counts:
        steps[r["step"]] = r["n"]
    if steps.sum() >= ENOUGH:
        found = max(found, int(np.searchsorted(np.cumsum(steps), recall * steps.sum())) / STEPS * (2 - 2 * cosine))
    return min(found, farthest)


def filing(grid: Grid, width: int, single: bool, within: float | None):
    """Rows with their cell, or, given a radius, once a cell that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(tamed(matrix(batch["vector"], width, single)))
            if not len(x):
                continue
            row, cell = (np.arange(len(x)), grid.cells(x)) if within is None else grid.visits(x, within)
            for k in range(0, len(row), 20_000):
                some = batch.take(pa.array(row[k : k + 20_000]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell[k : k + 20_000].astype(np.int64))], [*some.schema.names, "cell"])

    return run


def meeting(cosine: float, width: int, single: bool):
    """Blocks of searchers against blocks of filed vectors: links of each searcher, and of every vector the smallest number reached within the two blocks."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, vectors, counts = [], [], []
                for side in ("searchers", "filed"):
                    rows = batch[side][k].values
                    ids.append(rows.field("node").to_numpy())
                    counts.append(rows.field("n").to_numpy())
                    vectors.append(tamed(np.frombuffer(b"".join(rows.field("vector").to_pylist()), kind).reshape(-1, width).astype(float)))
                norms = [np.sqrt((v * v).sum(axis=1)) for v in vectors]
                near = vectors[0] @ vectors[1].T / (norms[0][:, None] * norms[1]) >= cosine
                near &= ids[0][:, None] != ids[1]
                links = near @ counts[1]
                if not links.any():
                    continue
                top = np.int64(2**63 - 1)
                own, other = ids[0].copy(), ids[1].copy()
                while True:
                    new = np.minimum(own, np.where(near, other, top).min(axis=1))
                    reached = np.minimum(other, np.where(near, new[:, None], top).min(axis=0))
                    if (new == own).all() and (reached == other).all():
                        break
                    own, other = new, reached
                moved = other != ids[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[0], ids[1][moved]])), pa.array(np.concatenate([links, np.zeros(moved.sum(), np.int64)])), pa.array(np.concatenate([own, other[moved]]))], schema=schema)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", filed: int = FILED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Linked are vectors of the same label and length whose cosine is ``cosine`` at least.
    ``recall`` 1 searches as far as a partner can be; below that, searches end at a
    measured radius. No pair below the threshold is linked. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do rows
    without label or identifier. Equal vectors link with each other; a row that repeats
    another counts as a further vector. An empty table gives an empty result; further
    columns are ignored.
    """
    with arrow_rows(vectors.sparkSession, 4096), job(vectors.sparkSession):
        rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
        return result(_near_vectors(rows, cosine, recall, filed), "near-vectors")


def index(vectors: DataFrame, cosine: float, recall: float, filed: int):
    """Rows and their classes as tables, and how searches go: the grid, the radius, and how vectors are held."""
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(width, 1)
    single = vectors.schema["vector"].dataType.elementType.simpleString() == "float"
    rows = materialize(vectors.mapInArrow(packed(width, single), "id bigint, label string, size int, vector binary").withColumn("print", F.sha2("vector", 256)), "vectors")
    able = rows.where("vector is not null")
    classes = materialize(able.groupBy("label", "size", "print").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()), "classes")
    sample = classes.orderBy(F.xxhash64("id"), "label", "print").limit(SAMPLE).select("label", "size", "vector").collect()
    if not sample:
        return rows, classes, None, 0.0, width, single
    x = unit(tamed(np.frombuffer(b"".join(r["vector"] for r in sample), "<f4" if single else "<f8").reshape(-1, width).astype(float)))
    grid = Grid(x, int(np.clip(np.sqrt(classes.count() / filed), 1, CENTROIDS)))
    return rows, classes, grid, radius(grid, classes, sample, cosine, recall, width, single), width, single


def _near_vectors(vectors: DataFrame, cosine: float, recall: float, filed: int) -> DataFrame:
    rows, classes, grid, within, width, single = index(vectors, cosine, recall, filed)
    alone = rows.where("vector is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if grid is None:
        return alone
    key, held = ["label", "size", "cell"], "label string, size int, node bigint, n bigint, vector binary, cell bigint"
    plain = classes.select("label", "size", "node", "n", "vector")
    residents = materialize(plain.mapInArrow(filing(grid, width, single, None), held), "filed")
    visits = materialize(plain.mapInArrow(filing(grid, width, single, within), held), "visits")
    by_cell = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
    sizes = materialize(by_cell(residents, "n_filed").join(by_cell(visits, "n_visits"), key), "cells")
    parts = {side: F.ceil(F.col(f"n_{n}") / BLOCK) for side, n in (("x", "visits"), ("y", "filed"))}
    sizes = sizes.select(*key, "n_filed", "n_visits", *[c.alias(f"parts_{s}") for s, c in parts.items()])
    block = {}
    for side, df, n, name in (("x", visits, "n_visits", "searchers"), ("y", residents, "n_filed", "filed")):
        placed = spread_join(df, sizes.select(*key, "parts_x", "parts_y"), key, "node", BLOCK, counts=sizes.select(*key, F.col(n).alias("n")))
        placed = placed.withColumn(f"part_{side}", F.pmod(F.xxhash64("node", F.lit(5)), F.col(f"parts_{side}")))
        block[side] = placed.groupBy(*key, f"part_{side}", "parts_x", "parts_y").agg(F.collect_list(F.struct("node", "n", "vector")).alias(name))
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"parts_{side}") - 1)).alias(f"part_{side}")
    x = block["x"].select(*key, "part_x", every("y"), "searchers")
    y = block["y"].select(*key, "part_y", every("x"), "filed")
    with arrow_rows(vectors.sparkSession, 16):
        met = x.join(y, [*key, "part_x", "part_y"]).select("searchers", "filed").mapInArrow(meeting(cosine, width, single), "node bigint, links bigint, least bigint")
        met = materialize(met, "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(met.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")))
    group = ["label", "size", "print"]
    named = classes.select(*group, "node", "id", "n").join(links, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "named")
    smallest = named.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("members"))
    named = spread_join(named, smallest.select("component", "least"), ["component"], "node", BLOCK, counts=smallest.select("component", F.col("members").alias("n")))
    named = named.select(*group, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least")
    linked = spread_join(rows.where("vector is not null").select("id", *group), named, group, "id", BLOCK, counts=classes.select(*group, "n"))
    return linked.select(F.col("id").alias("vec_id"), "n_links", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept")).union(alone)


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
