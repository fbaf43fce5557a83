"""Language identification by rank-order profiles.

A profile is the list of a language's (or document's) most frequent character
bigrams and trigrams, in order of frequency. A document's distance from a
language is the sum, over its profile, of how far out of place each n-gram is;
n-grams the language's profile lacks count as PROFILE places.

Words are runs of letters, lower-cased, with a space before and after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.words import chunks

#: N-grams in a profile. Profiles go to every executor, PROFILE numbers a language.
PROFILE = 300
SPACE, RARE = 32, 0xFFFF
_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point below 65536 its lower-case letter, or a space for what is no letter."""
    if not _table:
        t = np.full(65536, SPACE, np.uint64)
        for cp in range(65536):
            c = chr(cp)
            if c.isalpha():
                t[cp] = ord(c.lower()) if len(c.lower()) == 1 else cp
        _table.append(t)
    return _table[0]


def grams(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text << 48 | n-gram) of every bigram and trigram, sorted, and the number of letters per text. At most 65535 texts."""
    n = len(offsets) - 1
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])
    offsets = begins[offsets]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    small = np.minimum(points, RARE)
    code = letters()[small]
    for cp in np.unique(points[points >= RARE]):
        code[points == cp] = RARE if chr(cp).isalpha() else SPACE
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    before = np.concatenate([np.full(1, SPACE, np.uint64), code[:-1]])[: len(code)]
    after = np.concatenate([code[1:], np.full(1, SPACE, np.uint64)])[: len(code)]
    full = np.flatnonzero(np.diff(offsets))
    before[offsets[:-1][full]] = SPACE
    after[offsets[1:][full] - 1] = SPACE
    at = np.flatnonzero(code != SPACE)
    own = text[at] << np.uint64(48)
    pair = before[at] << np.uint64(16) | code[at]
    keys = np.concatenate([own | pair, own | pair << np.uint64(16) | after[at]])
    keys.sort()
    return keys, np.bincount(text[at].astype(np.int64), minlength=n)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their counts."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys)))


_GRAM = np.uint64(2**48 - 1)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, n-gram) summed over each batch."""
    for batch in batches:
        names = batch["lang"].to_pylist()
        held: dict[str, list] = {}
        for at, offsets, raw in chunks(batch["text"]):
            keys, count = counted(grams(offsets, raw)[0])
            text = (keys >> np.uint64(48)).astype(np.int64) + at
            langs = np.array([names[t] for t in range(at, at + len(offsets) - 1)], object)[text - at] if len(text) else np.empty(0, object)
            for lang in set(langs):
                mine = langs == lang
                held.setdefault(lang, []).append((keys[mine] & _GRAM, count[mine]))
        for lang, parts in held.items():
            gram, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram.astype(np.int64), "n": total})


def learn_profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, counted over all of ``docs`` that have a language and a text."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = named.mapInArrow(count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).collect()
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(x)] for lang, x in sorted(found.items())}


def predictor(profiles: dict[str, list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = list(profiles)
    known = np.unique(np.array([g for x in profiles.values() for g in x], np.uint64))
    ranks = np.full((len(known) + 1, len(names)), -1, np.int32)  # the last row: n-grams of no profile
    for k, x in enumerate(profiles.values()):
        ranks[np.searchsorted(known, np.array(x, np.uint64)), k] = np.arange(len(x))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, raw in chunks(batch["text"]):
                n = len(offsets) - 1
                keys, n_letters = grams(offsets, raw)
                keys, count = counted(keys)
                text = (keys >> np.uint64(48)).astype(np.int64)
                order = np.argsort(text << 32 | (2**32 - 1 - count), kind="stable")
                first = np.searchsorted(text, np.arange(n + 1))
                place = np.arange(len(keys)) - first[text]
                top = np.flatnonzero(place < PROFILE)
                text, gram, place = text[top], keys[order[top]] & _GRAM, place[top]
                row = np.searchsorted(known, gram)
                row[row == len(known)] = 0
                row = np.where(known[row] == gram, row, len(known)) if len(known) else np.zeros(len(gram), np.int64)
                langs, scores, margins = ["und"] * n, [0.0] * n, [0.0] * n
                if names and len(text):
                    at_lang = ranks[row]
                    out = np.where(at_lang < 0, PROFILE, np.abs(at_lang - place[:, None]))
                    some, begin = np.unique(text, return_index=True)
                    distance = np.add.reduceat(out, begin, axis=0) / (np.diff(np.append(begin, len(text)))[:, None] * PROFILE)
                    best = distance.argmin(axis=1)
                    nearest = np.sort(distance, axis=1)
                    for t, b, d in zip(some.tolist(), best.tolist(), nearest.tolist()):
                        langs[t], scores[t], margins[t] = names[b], 1 - d[0], d[min(1, len(d) - 1)] - d[0]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n).cast(pa.int64()), batch["held_out"].slice(at, n), pa.array(langs), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], schema=schema)

    return predict


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: str = "false") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, margin.

    ``held_out`` is an SQL expression over ``docs`` that is passed through. The
    language nearest by out-of-place distance wins, ties by name. Score is 1 minus
    that distance over its largest value. Texts that are null or have no letter are
    ``und`` with score 0, as is everything if nothing could be learned. Equally
    frequent n-grams rank in the order of their code points. Texts of any length are
    read whole. Rows without a language or text teach nothing. Repeated rows get a
    result each, and count as often in training; an empty table gives an empty
    result; further columns are ignored.
    """
    profiles = learn_profiles(training, id_col, text_col, lang_col)
    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.expr(held_out).alias("held_out"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(predictor(profiles), "doc_id bigint, held_out boolean, lang_pred string, score double, margin double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"
    return identify(docs, docs.where(f"not {held_out}"), held_out=held_out)
