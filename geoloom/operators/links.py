"""Connected components of links, and joins in which no key is too much for a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.storage import materialize

#: A list of crowded keys is broadcast up to this many rows, joined by shuffle beyond it.
BROADCAST_KEYS = 1_000_000
#: Copies of a crowded key's entry when there are too many crowded keys to broadcast.
SALTS = 64
#: Links of one node that a round of ``components`` brings to one task.
HUB = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast.

    The planner takes what rows are exploded to for no larger than the table before,
    and hands tables of any size to the driver and every executor.
    """
    return df.hint("merge")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, rows: int, how: str = "inner", counts: DataFrame | None = None, long: bool = False) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, so that no key brings more than about ``rows`` left rows to one task.

    A key with more is cut into pieces by a hash of the column ``by``, and its right
    row is copied to each: one copy for ``rows`` left rows. ``counts`` (keys, n), if
    known, spares counting. Where right rows are ``long``, nothing is broadcast to them or
    exploded beside them: Spark holds all rows that come of one at once. They are read twice.
    """
    whole = right
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("n"))
    crowded = materialize(counts.where(F.col("n") > rows).select(*keys, F.ceil(F.col("n") / rows).alias("_pieces")), "crowded")
    many = crowded.count()
    if not many:
        return left.join(shuffled(right) if long else right, keys, how)
    right = right.select(*keys) if long else right
    hashed, one = F.xxhash64(F.col(by), F.lit(11)), F.lit(1).cast("bigint")
    pieces = F.coalesce("_pieces", one)
    if many <= BROADCAST_KEYS:
        left, right = left.join(F.broadcast(crowded), keys, "left"), right.join(F.broadcast(crowded), keys, "left")
    else:
        salted = crowded.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(by), F.lit(12)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")
        right = right.join(crowded, keys, "left")
    left = left.withColumn("_piece", F.pmod(hashed, pieces)).drop("_pieces")
    right = right.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1))).drop("_pieces")
    right = right.join(shuffled(whole), keys) if long else right
    return left.join(shuffled(right) if long else right, [*keys, "_piece"], how).drop("_piece")


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links as links of every node to its set's smallest node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, ends = np.unique(np.concatenate([batch["a"].to_numpy(), batch["b"].to_numpy()]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        n = batch.num_rows
        for x, y in zip(ends[:n].tolist(), ends[n:].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.array([find(x) for x in range(len(nodes))])
        other = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_pydict({"a": nodes[root[other]], "b": nodes[other]})


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node reachable.

    Union-find within each batch shortens the links to stars; then every node is
    led to the smallest of its neighbours' neighbours, round by round, until no
    link changes (large-star and small-star steps). Every round is written to the
    shared folder; nothing but a count, a hash and the largest number of links of a
    node reaches the driver. A node with more than HUB links is met in pieces. The
    number of rounds grows with the logarithm of the longest path.
    """
    stars = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").mapInArrow(union_find, "a bigint, b bigint")
    now, before = materialize(stars.distinct(), "stars"), None
    while True:
        by_a = now.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        *state, largest = by_a.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if state == before:
            break
        before = state
        hub = (largest or 0) > HUB
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both, least, ["a"], "b", HUB) if hub else both.join(least, "a")
        large = large.where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        now = materialize(small, "stars")
    found = now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
