"""Importance resampling towards a target text, with features counted by an Aho-Corasick dictionary.

Features are runs of 1 to 3 consecutive words, each filed in a bucket by the CRC-32
of its bytes. The words of a block of texts are joined by single spaces; each
distinct word, with the delimiters on either side, is an entry of an automaton and
carries its CRC and its length as payload. One scan emits the payloads of all words
in order, as delimiters may be shared by neighbours. A run's CRC is put together
from adjacent payloads: the CRC of AB is that of A, moved over the length of B by a
linear map, xor that of B. So bytes are read once per distinct word, and no feature
is ever written out.

Buckets, of which there are a fixed number, are counted in the tasks; the driver
gets one count a bucket for the corpus and for the target. The gains made of them
travel to the tasks that score. The draw numbers the documents in order of their
scores over ranges, without bringing them to one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.words import ALNUM, Words, split
from geoloom.storage import arrow_rows, job, materialize, numbered, result

BUCKETS = 10_000
#: Longest run of words.
RUN = 3
#: Bytes of words that share one automaton, and the longest word that enters it; longer ones get their payload directly.
BLOCK, LONGEST = 500_000, 256
_POLYNOMIAL = 0xEDB88320


def _square(rows: np.ndarray) -> np.ndarray:
    """The linear map of 32 bits, given by the images of single bits, applied twice."""
    return np.array([moved(rows, r) for r in rows], np.uint32)


def moved(rows: np.ndarray, x: int) -> int:
    """The image of ``x``."""
    out = 0
    for k in range(32):
        if int(x) >> k & 1:
            out ^= int(rows[k])
    return out


#: Maps that move a CRC over 1, 2, 4, ... bytes.
_MAPS: list[np.ndarray] = []
#: For a length, the map as four tables by byte.
_TABLES: dict[int, np.ndarray] = {}


def tables(length: int) -> np.ndarray:
    """The map that moves a CRC over ``length`` bytes, as a (4, 256) table. Those of usual lengths are kept."""
    if length in _TABLES:
        return _TABLES[length]
    if not _MAPS:
        bit = np.array([_POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
        for _ in range(3):
            bit = _square(bit)
        _MAPS.append(bit)
    images, k, left = [1 << b for b in range(32)], 0, length
    while left:
        if k == len(_MAPS):
            _MAPS.append(_square(_MAPS[-1]))
        if left & 1:
            images = [moved(_MAPS[k], x) for x in images]
        left, k = left >> 1, k + 1
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for b in range(8):
            out[byte, np.arange(256) >> b & 1 == 1] ^= np.uint32(images[8 * byte + b])
    if length <= LONGEST + 1:
        _TABLES[length] = out
    return out


def follow(crc: np.ndarray, then: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts followed by others, from the CRCs of both and the others' lengths in bytes."""
    kinds, which = np.unique(lengths, return_inverse=True)
    if not len(kinds):
        return crc
    every = np.stack([tables(int(n)) for n in kinds])
    out = then.copy()
    for byte in range(4):
        out ^= every[which, byte, crc >> np.uint32(8 * byte) & np.uint32(255)]
    return out


def payloads(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length of every word, in order, by automata over blocks of words."""
    lengths = words.ends - words.starts
    crc = np.empty(len(lengths), np.uint32)
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
        block = Words(words.data, words.starts[at:end], words.ends[at:end], words.first, 0)
        short = lengths[at:end] <= LONGEST
        text, _ = block.joined()  # a character a byte
        found = ahocorasick.Automaton()
        for word in set(text.split(" ")):
            if 0 < len(word) <= LONGEST:
                found.add_word(f" {word} ", zlib.crc32(word.encode("latin-1")) << 32 | len(word))
        here = crc[at:end]
        if len(found):
            found.make_automaton()
            emitted = np.fromiter((v for _, v in found.iter(text)), np.uint64, int(short.sum()))
            here[short] = (emitted >> np.uint64(32)).astype(np.uint32)
        for k in np.flatnonzero(~short):
            here[k] = zlib.crc32(block.word(k))
        at = end
    return crc, lengths


def features(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all runs of 1 to RUN consecutive words of a text."""
    crc, lengths = payloads(words)
    text, space = words.text_of(), np.uint32(zlib.crc32(b" "))
    runs, of = [crc], [text]
    # a space and a word, as a whole
    tail = follow(np.full(len(crc), space, np.uint32), crc, lengths)
    for n in range(1, RUN):
        whole = text[n:] == text[:-n]
        crc = follow(crc[:-1], tail[n:], lengths[n:] + 1)
        runs.append(crc[whole])
        of.append(text[n:][whole])
    return np.concatenate(of), (np.concatenate(runs) % np.uint32(buckets)).astype(np.int64)


def counting(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in split(batch["text"], ALNUM):
                total += np.bincount(features(words, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held, "n": total[held]})

    return run


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket."""
    rows = df.select(F.col(text_col).alias("text")).mapInArrow(counting(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, both counts smoothed by one, rounded down."""
    s, t, total_s, total_t, n = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum()), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (total_s + n) / ((s + 1) * (total_t + n)))).astype(np.int64)


def weighing(gain: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split(batch["text"], ALNUM):
                n = len(words.first) - 1
                of, bucket = features(words, len(gain))
                weight = np.zeros(n, np.int64)
                np.add.at(weight, of, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(words.at, n), pa.array(words.counts), pa.array(np.bincount(of, minlength=n)), pa.array(weight)], schema=schema)

    return run


def gumbel(seed: int, key: Column) -> Column:
    """Thousandths of a Gumbel variable, rounded down, from a hash of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    ``weight`` sums the gains of a document's features, ``score`` adds Gumbel noise of
    its identifier; the documents of highest score, ``percent`` of those with at least
    ``least_words`` words (rounded down), have their rank from 1 on, which is a draw
    without replacement with chances by weight. Ties go to the smaller doc_id. Null
    and empty texts have no features and a weight of 0. A row without an identifier
    counts as corpus, but has no score, and can't be drawn. Rows that repeat an
    identifier are documents of their own, equal ones in any order. Texts of any length
    are read whole. An empty target or corpus has counts of 0; an empty table of
    documents gives an empty result. Further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, 1000), job(docs.sparkSession):
        gain = gains(bucket_counts(texts, buckets=buckets), bucket_counts(target, text_col, buckets))
        weighed = texts.mapInArrow(weighing(gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
        scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), "scored")
        able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
        drawn = scored.where(able).count() * percent // 100
        order = F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"))
        ranked = numbered(scored.where(able).withColumn("_key", order), "_key").withColumn("rank", F.when(F.col("number") < drawn, F.col("number") + 1))
        out = ranked.drop("_key", "number").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
        return result(out.select("doc_id", "n_features", "weight", "score", "rank"), "resampled")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w)"
_RUNS = "w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k+1]) || list_transform(range(1, len(w)-1), lambda k: w[k] || ' ' || w[k+1] || ' ' || w[k+2])"
#: CRCs of single bytes; the lambda goes over the bytes, of which it sees the hexadecimal digits.
_BYTES = [int(tables(1)[0, k]) for k in range(256)]
OP12_SQL = f"""WITH
d AS (SELECT row_number() OVER () AS r, doc_id, w, {_RUNS} AS f FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT {_RUNS} AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
x AS (SELECT r, unnest(f) AS f FROM d), y AS (SELECT unnest(f) AS f FROM b),
names AS (SELECT DISTINCT f FROM (SELECT f FROM x UNION ALL SELECT f FROM y)),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda k: CAST('0x' || h[k:k+1] AS BIGINT)), lambda c, v: xor(c >> 8, {_BYTES}[1 + (xor(c, v) & 255)]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM names)),
s AS (SELECT bucket, count(*) AS s FROM x JOIN hashed USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM y JOIN hashed USING (f) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * ((SELECT coalesce(sum(s), 0) FROM s) + 1e4) / ((coalesce(s, 0) + 1e0) * ((SELECT coalesce(sum(t), 0) FROM t) + 1e4)))) AS BIGINT) AS g FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM x JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(f) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM scored WHERE n >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * (SELECT count(*) FROM ranked) // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)"""
