"""Near-dedup of vectors against all pairs."""

import math

import numpy as np
import pytest

pytest.importorskip("geoloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from geoloom.llm import vector_dedup as vd  # noqa: E402
from geoloom.storage import job  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(key, v, label):
    return key is not None and label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, cosine=0.98):
    """Links among all rows, a row at a time; components by the smallest identifier reached."""
    good = [k for k, r in enumerate(rows) if usable(*r)]
    x = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    x = {k: v / np.abs(v).max() for k, v in x.items()}
    links = {k: set() for k in good}
    for p, a in enumerate(good):
        for b in good[:p]:
            if rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / (np.sqrt(x[a] @ x[a]) * np.sqrt(x[b] @ x[b])) >= cosine:
                links[a].add(b)
                links[b].add(a)
    out, seen = [None] * len(rows), set()
    for k, (key, *_) in enumerate(rows):
        if k not in links:
            out[k] = (key, 0, key, True)
        elif k not in seen:
            group, todo = {k}, [k]
            while todo:
                for other in links[todo.pop()] - group:
                    group.add(other)
                    todo.append(other)
            seen |= group
            least = min(rows[j][0] for j in group)
            for j in group:
                out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return sorted(out, key=repr)


def families(seed=0, n=700, d=16):
    """Groups around common centres at all distances about the threshold, chains, copies and lone vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k % 7 == 0 or not rows:
            v = rng.normal(size=d)
        else:
            base = np.array(rows[int(rng.integers(len(rows)))][1])
            way = rng.normal(size=d) * (np.ones(d) if k % 3 else np.arange(d) < 2)
            v = base if k % 11 == 0 else base + way * np.linalg.norm(base) * rng.uniform(0.0, 0.5) / np.linalg.norm(way)
        rows.append((k, np.array(v, np.float32).tolist(), int(k % 13 > 3)))
    return rows


def got(df, **more):
    return sorted((tuple(r) for r in vd.near_vectors(df, **more).collect()), key=repr)


@pytest.mark.parametrize("block", [vd.BLOCK, 16])
def test_searches_to_the_farthest_miss_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(vd, "BLOCK", block)
    rows = families()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), recall=1.0, filed=8) == plain(rows)


def test_recall_of_the_measured_radius(spark):
    rows = families(1, 900)
    ours = {r[0]: r[1] for r in got(spark.createDataFrame(rows, SCHEMA).repartition(3), filed=8)}
    theirs = {r[0]: r[1] for r in plain(rows)}
    assert all(ours[k] <= n for k, n in theirs.items())  # none below the threshold
    assert sum(ours.values()) >= 0.97 * sum(theirs.values())


def test_query_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in vd.op13_vector_dedup(spark, sf).collect()), key=repr) == plain(rows)


def test_odd_rows(spark):
    """Nulls in every column, unusable vectors, several lengths, huge and tiny components, copies, repeated rows and identifiers, clashing columns."""
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, a, 0), (2, a, 0), (2, a, 0), (3, b, 0), (4, b, 1), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, nan, 3.0], 0), (10, [1.0, inf, 3.0], 0), (11, a, None), (None, a, 0), (12, a[:2], 0), (13, [2.0, 4.0, 6.0], 0), (14, [-1.0, -2.0, -3.0], 0)]
    rows += [(15, [1e38, 2e38, 3e38], 0), (16, [1e-40, 2e-40, 3e-40], 0), (17, [1.0, 2.0, 3.0, 0.0], 0), (18, [5.0], 1), (19, [0.1], 1), (20, [-0.0, 1.0], 1), (21, [0.0, 1.0], 1), (3, [9.0, -9.0, 1.0], 0), (22, [9.0, -9.0, 1.1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "vector", "cell", "print", "n", "size", "node", "links", "least", "component")}).repartition(3)
    want = plain(rows)
    for recall in (1.0, vd.RECALL):
        assert got(df, recall=recall) == want


def test_hot_label_with_a_large_family(spark, monkeypatch):
    """A third of the rows are near copies of one another, in blocks of 64."""
    monkeypatch.setattr(vd, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    rows = [(k, (centre + rng.normal(size=24) * 0.02 if k % 3 == 0 else rng.normal(size=24)).astype(np.float32).tolist(), 1 if k % 3 == 0 else k % 5) for k in range(1500)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == plain(rows)


def test_empty_table_and_doubles(spark):
    assert vd.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(spark.createDataFrame([(1, None, None)], SCHEMA)) == [(1, 0, 1, True)]
    rows = [(1, [1e300, 1.0], "x"), (2, [1e300, 2.0], "x"), (3, [1e-300, 1e-301], "y"), (4, [1e-300, 1e-301], "y")]
    got_ = sorted(tuple(r) for r in vd.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect())
    assert got_ == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


def test_cells_come_nearest_first_and_bound_the_distance():
    rng = np.random.default_rng(5)
    x = vd.unit(rng.normal(size=(300, 12)))
    grid = vd.Grid(x, 9)
    row, cell = grid.visits(x[:40], 0.3)
    (_, a), (_, b) = grid.bounds(x[:40])
    for k in range(40):
        sums = [a[k, c // vd.CENTROIDS] + b[k, c % vd.CENTROIDS] for c in cell[row == k]]
        assert sums == sorted(sums) and len(sums) == ((a[k][:, None] + b[k]) <= 0.3).sum()
    y = vd.unit(x[:40] + rng.normal(size=(40, 12)) * 0.1)
    assert (grid.between(x[:40], y) <= ((x[:40] - y) ** 2).sum(axis=1) + 1e-9).all()


def test_recall_of_the_index_on_the_table(spark, sf):
    """Links found at the measured radius, of those that a search to the farthest finds."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    with job(spark):
        _, classes, grid, radius, width, single = vd.index(df, 0.98, vd.RECALL, vd.FILED)
        assert 0 < radius <= 0.0401 and width == 64 and single
        rows = classes.limit(200).collect()
    x = vd.unit(np.frombuffer(b"".join(r["vector"] for r in rows), "<f4").reshape(-1, 64).astype(float))
    for y in vd.made_up(x, 0.98):
        assert (grid.between(x, y) <= radius).mean() >= 0.98
