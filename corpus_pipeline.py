"""The corpus pipeline: documents in, a mix of clean and distinct documents out.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of documents, further ones
that docs may have included. A decision names a doc_id and holds for all of its
rows; a row without doc_id can't be named and is kept. Null and empty texts pass
all stages but the exact dedup, where they are one text, and empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.decontaminate import contaminated
from geoloom.llm.exact_dedup import exact_dedup, text_digest
from geoloom.llm.graph import rows_with
from geoloom.llm.mixing import mix_sources
from geoloom.llm.near_dedup import WIDE, WIDE_BANDS, near_dedup
from geoloom.llm.toxicity import score_toxicity, trained
from geoloom.storage import job, materialize, result

#: No SQL twin: lexicon matching and latent search can't be written in SQL.
ORACLE_SQL = None


def without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``rejected``."""
    return rows_with(docs, materialize(rejected.select("doc_id").distinct(), name), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity operator predicts to be toxic. Without toxic labels all are kept."""
    return without(docs, score_toxicity(docs, *trained(spark, docs, sf_dir)).where("predicted = 1"), "toxic")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the smallest doc_id.

    Where a doc_id stands in several rows, each of its texts is judged by itself, and
    of equal ones a single row stays.
    """
    found = exact_dedup(docs)
    repeated = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    gone = found.where("not kept")
    if repeated.isEmpty():
        return without(docs, gone, "copies")
    again = rows_with(docs, repeated).withColumn("_digest", text_digest())
    stay = rows_with(found.where("kept"), repeated).select("doc_id", F.col("text_sha256").alias("_digest"))
    again = again.join(stay, ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id", "_digest"]).select(docs.columns)
    return without(docs, gone.select("doc_id").union(repeated), "copies").union(again)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, of a similarity of 0.8 at least, keep the smallest doc_id."""
    return without(docs, near_dedup(docs, percent=WIDE, bands=WIDE_BANDS).where("not kept"), "near-copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. An empty benchmark drops none."""
    return without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes; a row per document, those without a word included."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with job(spark):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return result(STAGES[-1][1](spark, docs, sf_dir), "mixed")
