"""Exact dedup by a tree-merge of sorted digest runs.

Every partition turns its rows into a sorted run of digests, equal neighbours
folded into one record that holds the smallest identifier and a count. Runs are
then exchanged in rounds: in a round the runs whose slot numbers agree but for
their last BITS bits meet (a binomial tree of fan-in 2**BITS), each meeting split
over many tasks by the digest's first two bytes. A task merges all runs that reach
it and folds equal neighbours again, so a text that fills a third of the table is
at most one record a run after level 0. A slot is a partition of the table, however
many there are; the tree has as many rounds as it takes to reach one slot.

The merge in a task is Spark's external sorter: it sorts what fits into memory and
merges the sorted spills, so a meeting may be larger than memory. A merge of the
runs in Python would have to hold one batch of every run, and the shuffle doesn't
say where a run begins.

Records are equal only if SHA-256, length and a second 64-bit hash all agree.
The group found at the root goes back down the same tree: root -> run records
-> rows, so no join key is ever hotter than one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.storage import job, materialize, result

#: Fan-in of a round is 2**BITS.
BITS = 6
NO_ID = 2**63 - 1
RUN = "slot int, digest binary, chars int, second bigint, doc_id bigint, n bigint"
KEY = ["digest", "chars", "second"]


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text_col: str = "text") -> Column:
    """What equal texts share: the hex digest of the normalised text."""
    return F.sha2(normalised(F.col(text_col)), 256)


def fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold equal neighbours of a sorted run; the open group is carried over batches."""
    schema = pa.schema([("slot", pa.int32()), ("digest", pa.binary()), ("chars", pa.int32()), ("second", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).cast(schema)
        table = pa.concat_tables([carry, table]) if carry is not None else table
        table = table.combine_chunks()
        digest = table["digest"].combine_chunks()
        raw = np.frombuffer(b"".join(digest.to_pylist()), np.uint8).reshape(-1, 32)
        words = np.ascontiguousarray(raw).view(np.uint64)
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        for name in ("slot", "chars", "second"):
            x = table[name].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        out = table.take(pa.array(at))
        out = out.set_column(5, "n", pa.array(np.add.reduceat(table["n"].to_numpy(), at)))
        out = out.set_column(4, "doc_id", pa.array(np.minimum.reduceat(table["doc_id"].to_numpy(), at)))
        carry = out.slice(len(at) - 1, 1)
        if len(at) > 1:
            yield from out.slice(0, len(at) - 1).combine_chunks().to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def fold(df: DataFrame) -> DataFrame:
    """Sort each partition and fold its equal neighbours."""
    return df.sortWithinPartitions("slot", *KEY, "doc_id").mapInArrow(fold_sorted, RUN)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals empty text. A null identifier sorts after all others and is
    kept only if its whole group has none. Repeated rows of one identifier count
    each and share their fate. Texts of any length are read whole. An empty table
    gives an empty result; further columns are ignored.
    """
    with job(docs.sparkSession):
        return result(_exact_dedup(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), normalised(F.col(text_col)).alias("norm")), bits), "exact-dedup")


def _exact_dedup(texts: DataFrame, bits: int) -> DataFrame:
    base = materialize(
        texts.withColumn("slot", F.spark_partition_id()).select("doc_id", "slot", F.unhex(F.sha2("norm", 256)).alias("digest"), F.length("norm").alias("chars"), F.xxhash64("norm").alias("second")),
        "digests",
    )
    leaves = materialize(
        fold(base.select("slot", *KEY, F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.lit(1).cast("bigint").alias("n"))),
        "runs",
    )
    runs, last = leaves, leaves.agg(F.max("slot")).first()[0] or 0
    while True:
        runs = fold(runs.withColumn("slot", F.shiftright("slot", bits)).repartition("slot", F.substring("digest", 1, 2)))
        last >>= bits
        if not last:
            break
    root = runs.select(*KEY, F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    # a slot's digests may have been read, and folded, in several pieces
    down = leaves.select("slot", *KEY).distinct().join(root, KEY)
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return base.join(down, ["slot", *KEY]).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
