"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: homoglyphs of other alphabets become the Latin letters
they look like, digits and signs the letters they stand for, capitals small ones. The lexicon holds
word beginnings, since inflected languages form many words from one stem. It is
learned from labelled texts: a beginning enters with the log ratio of its
rates per word in toxic and other texts if it is many times as frequent in
toxic ones. Matches inside an exception phrase don't count. The sum of the matches'
weights over the square root of the text's length is turned into a score by the
cut that separates the labelled texts best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.words import LOWER, split

# Letters of other alphabets and full-width forms that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "І": "i", "Ѕ": "s", "Ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "a", "Β": "b", "Ε": "e", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "Ζ": "z",
}
HOMOGLYPHS |= {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Harmless phrases that hold a lexicon word.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "white trash bag", "idiot proof", "idiot board", "stupid simple")

#: Labelled texts learned from: all of them up to SAMPLE, else about SAMPLE chosen by a hash of the identifier.
SAMPLE = 20_000
#: Shortest and longest beginning, in bytes; least toxic texts that hold it, as a number and a share; how much more often it stands in toxic texts, per word.
SHORTEST, LONGEST, SUPPORT, SUPPORT_SHARE, RATIO = 3, 10, 3, 0.02, 15
#: A beginning is made longer as long as it keeps this share of its places in toxic texts.
CLOSE = 0.95

_TABLE = LOWER.copy()
for _from, _to in DIGITS.items():
    _TABLE[ord(_from)] = ord(_to)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_MAP = str.maketrans(HOMOGLYPHS)
_LEADS = [bytes([x]) for x in sorted({c.encode()[0] for c in HOMOGLYPHS})]
_BINS = 20  # of the logarithm of a sum of weights, per unit


def folded(texts: pa.Array) -> pa.Array:
    """Texts with homoglyphs replaced; only texts that hold such a letter's first byte are touched."""
    data = texts.buffers()[2]
    raw = data.to_pybytes() if data is not None else b""
    if not any(x in raw for x in _LEADS):
        return texts
    return pa.array([t.translate(_MAP) if t is not None and not t.isascii() else t for t in texts.to_pylist()], pa.string())


def count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of each word beginning in toxic and in other texts, and the toxic texts that hold it, summed over each batch. The empty beginning counts all words. A text's places count by their logarithm, so that one that repeats itself doesn't decide."""
    for batch in batches:
        toxic = batch["toxic"].to_pylist()
        held: dict[bytes, list[int]] = {}
        for words in split(folded(batch["text"]), _LETTER, _TABLE, accents=True):
            for t in range(len(words.first) - 1):
                label = 1 if toxic[words.at + t] else 0
                own = Counter(words.word(k) for k in range(words.first[t], words.first[t + 1]))
                starts: Counter[bytes] = Counter()
                for w, n in own.items():
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        starts[w[:k]] += n
                damped = {b: n.bit_length() for b, n in starts.items()}
                damped[b""] = sum(n.bit_length() for n in own.values())
                for b, n in damped.items():
                    x = held.setdefault(b, [0, 0, 0])
                    x[label] += n
                    x[2] += label
        yield pa.RecordBatch.from_pydict({"entry": pa.array(list(held), pa.binary()), **{name: pa.array([x[k] for x in held.values()], pa.int64()) for k, name in enumerate(("other", "toxic", "texts"))}})


def choose(rows: list[tuple[bytes, int, int]], n_toxic: int, n_other: int) -> dict[bytes, float]:
    """Entries among (beginning, places in toxic, in other texts): the shortest telling ones, made longer as long as they keep their places."""
    by = {b: (t, o) for b, t, o in rows}
    weight = {b: math.log((t + 0.5) / (n_toxic + 1)) - math.log((o + 0.5) / (n_other + 1)) for b, (t, o) in by.items()}
    telling = {b for b, w in weight.items() if w >= math.log(RATIO)}
    longer: dict[bytes, bytes] = {}
    for b, (t, _) in by.items():
        up = b[:-1]
        if up in by and t >= CLOSE * by[up][0] and (up not in longer or t > by[longer[up]][0]):
            longer[up] = b
    out = {}
    for b in telling:
        if any(b[:k] in telling for k in range(SHORTEST, len(b))):
            continue
        while b in longer and longer[b] in telling:
            b = longer[b]
        out[b] = weight[b]
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def automaton(lexicon: dict[bytes, float]) -> ahocorasick.Automaton:
    """Entries match at a word's beginning; exception phrases as whole words."""
    found = ahocorasick.Automaton()
    for b, weight in lexicon.items():
        found.add_word(" " + b.decode("latin-1"), (weight, 1 + len(b), 0))
    for phrase in EXCEPTIONS:
        own = bytes(_TABLE[np.frombuffer(phrase.encode(), np.uint8)]).decode("latin-1")
        found.add_word(f" {own} ", (0.0, 2 + len(own), phrase.count(" ") + 1))
    if len(found):
        found.make_automaton()
    return found


def matcher(lexicon: dict[bytes, float]) -> Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """A function from texts to (first text, sum of weights, matches, words) of each chunk."""
    found = automaton(lexicon)

    def match(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for words in split(folded(texts), _LETTER, _TABLE, accents=True):
            n = len(words.first) - 1
            joined, at = words.joined()
            weight: dict[int, float] = {}
            excepted: set[int] = set()
            for end, (w, size, phrase) in found.iter(joined) if len(found) else ():
                k = int(np.searchsorted(at, end - size + 2))
                if phrase:
                    if np.searchsorted(words.first, k, "right") == np.searchsorted(words.first, k + phrase - 1, "right"):
                        excepted.update(range(k, k + phrase))
                else:
                    weight[k] = max(w, weight.get(k, 0.0))
            total, hits = np.zeros(n), np.zeros(n, np.int64)
            for k, w in weight.items():
                if k not in excepted:
                    t = int(np.searchsorted(words.first, k, "right")) - 1
                    total[t] += w
                    hits[t] += 1
            yield words.at, total, hits, words.counts

    return match


def normal(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return total / np.sqrt(n_words + 16.0)


def histogram(lexicon: dict[bytes, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(lexicon)
        for batch in batches:
            toxic = np.array(batch["toxic"].to_pylist(), bool)
            for at, total, _, n_words in match(batch["text"]):
                x = normal(total, n_words)
                bins = np.where(x > 0, np.floor(np.log(np.maximum(x, 1e-9)) * _BINS), -10_000).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"bin": bins, "toxic": toxic[at : at + len(bins)].astype(np.int64)})

    return run


def best_cut(counts: dict[int, list[int]]) -> float:
    """The value that separates toxic texts (counts[bin][1]) from others with the fewest errors; in the middle of the gap if several do."""
    bins = sorted(b for b in counts if b > -10_000)
    if not bins:
        return 1.0
    below_toxic = counts.get(-10_000, [0, 0])[1]
    above_other = sum(counts[b][0] for b in bins)
    errors = [(below_toxic + above_other, bins[0])]
    for b in bins:
        below_toxic += counts[b][1]
        above_other -= counts[b][0]
        errors.append((below_toxic + above_other, b + 1))
    least = min(e for e, _ in errors)
    cut = min(b for e, b in errors if e == least)
    if cut == bins[0] and not any(counts[b][0] for b in bins):
        cut -= _BINS  # no other text has a match: leave room below the weakest toxic one
    return math.exp(cut / _BINS)


def about(rows: DataFrame, sample: int) -> DataFrame:
    """All rows if they are at most ``sample``, else about as many, chosen by a hash of doc_id: the same ones whatever the order."""
    n = rows.count()
    return rows if n <= sample else rows.where(F.shiftright(F.xxhash64(F.col("doc_id"), F.lit(6)), 1) + F.lit(2**62) < F.lit(int(2**63 * (sample / n))))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[dict[bytes, float], float]:
    """Lexicon and cut from rows (doc_id, text, toxic), at most about ``sample`` of them.

    Equal texts count once, as toxic if one of them is. Null texts and labels teach
    nothing; empty texts hold no words. Texts of any length are read whole, a text's
    repeats by their logarithm. Without toxic rows the lexicon is empty. Further
    columns are ignored.
    """
    labelled = about(labelled.where("text is not null and toxic is not null").select("doc_id", "text", F.col("toxic").cast("boolean").alias("toxic")), sample)
    once = labelled.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    sizes = {bool(r["toxic"]): r["count"] for r in once.groupBy("toxic").count().collect()}
    counts = once.mapInArrow(count_beginnings, "entry binary, other bigint, toxic bigint, texts bigint").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "texts")))
    support = max(SUPPORT, math.ceil(SUPPORT_SHARE * sizes.get(True, 0)))
    rows = {bytes(r["entry"]): (r["toxic"], r["other"]) for r in counts.where((F.length("entry") == 0) | (F.col("texts") >= support)).collect()}
    all_words = rows.pop(b"", (0, 0))
    lexicon = choose([(b, t, o) for b, (t, o) in rows.items()], *all_words)
    bins: dict[int, list[int]] = {}
    for r in once.mapInArrow(histogram(lexicon), "bin bigint, toxic bigint").groupBy("bin", "toxic").count().collect():
        bins.setdefault(r["bin"], [0, 0])[r["toxic"]] = r["count"]
    once.unpersist()
    return lexicon, best_cut(bins)


def score_toxicity(docs: DataFrame, lexicon: dict[bytes, float], cut: float, id_col: str = "doc_id", text_col: str = "text", held_out: str = "false") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, hits, n_words.

    Null and empty texts have score 0. Texts of any length are read whole. Repeated
    rows get a result each; an empty table gives an empty result; further columns
    are ignored. Without toxic labels the lexicon is empty and every score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(lexicon)
        for batch in batches:
            for at, total, hits, n_words in match(batch["text"]):
                n, x = len(total), normal(total, n_words)
                score = x / (x + cut)
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(at, n).cast(pa.int64()), "held_out": batch["held_out"].slice(at, n), "score": score, "predicted": (score >= 0.5).astype(np.int32), "hits": hits, "n_words": n_words.astype(np.int64)})

    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.expr(held_out).alias("held_out"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, hits bigint, n_words bigint")


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out fold, chosen down to about ``sample`` before the join, so that the labels can be broadcast.

    Of several labels of a document one that says toxic counts; null labels and
    identifiers are left out, as are labels of unknown documents. A document that
    stands in the table several times is returned as often.
    """
    marks = labels.where(f"toxic is not null and doc_id is not null and not {HELD_OUT}").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marks = about(marks, sample)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id")


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[dict[bytes, float], float]:
    return learn(labelled_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 2 * SAMPLE)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, *trained(spark, docs, sf_dir), held_out=HELD_OUT)
