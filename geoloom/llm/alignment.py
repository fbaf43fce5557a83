"""Alignment of two tokenizers' tokens by the bytes they cover.

The text's tokens come from ``tokenizers`` with character offsets and from
``sentencepiece`` with the spans of its proto (the installed version has replaced
the immutable proto by ``return_type="proto"``, with the same spans). A span that
begins where the last token ended and is as long as its token's bytes is a cut as it
stands. Where several tokens share a character, or a byte-fallback token has an empty
span, the cut is refined with the token's decoded bytes. Offsets at which tokens of
both end cut the tokens into groups.

Texts are encoded by units: a text is parted before a space that follows a visible
ASCII character. No token of either vocabulary goes over such a place (the splitting
pattern of the one ends there; the other has no piece with a space after another
character, which is checked when the model is loaded), so the units' tokens, groups and
links are those of the whole text. A unit that comes again is looked up; new ones are
encoded together.

How many documents hold a pair of identifiers linked is counted over the distinct
pairs of each document. The counts go back to the documents by a join: those of the
most frequent pairs, FREQUENT at most, are broadcast, the long rest is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.words import chunks
from geoloom.storage import arrow_rows, job, materialize, result

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of identifiers whose counts are broadcast, 17 bytes each.
FREQUENT = 1_000_000
#: Bytes of texts worked on at once, of units encoded in one piece, and units kept for later texts.
BYTES, BLOCK, KEPT = 1_000_000, 20_000, 400_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the units that are known, by number."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_bpe)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        alphabet = byte_alphabet()
        with open(byte_bpe, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes_a[k] = bytes(alphabet[c] for c in token)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_b, self.whole = len(pieces), any(re.search("[^▁]▁", p) for p in pieces)
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        # tokens of both kinds, groups, links, and 1 for a unit whose tokens' bytes differ from it
        self.counts = np.empty((0, 5), np.int64)
        # linked pairs of unit k, and how often each: from begins[k] to begins[k + 1]
        self.begins, self.codes, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

        # texts looked up in which a unit has been found
        self.uses = np.empty(0, np.int64)

    def forget(self) -> None:
        """Forget the units that have been looked up once since the last time; all, if that are too few."""
        stay = np.flatnonzero(self.uses > 1)
        if len(stay) > KEPT // 2:
            self.clear()
            return
        sizes = np.diff(self.begins)[stay]
        at = ranges(self.begins[stay], sizes)
        names = list(self.number)  # in order of their numbers
        self.number = {names[k]: n for n, k in enumerate(stay.tolist())}
        self.groups = [self.groups[k] for k in stay.tolist()]
        self.counts, self.codes, self.times = self.counts[stay], self.codes[at], self.times[at]
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.uses = np.zeros(len(stay), np.int64)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """The units' numbers. What was known before may be forgotten first."""
        if len(self.groups) > KEPT:
            self.forget()
        # a unit that ends a text otherwise than others do would meet the next one's space
        fresh = sorted({u for u in units if u not in self.number}, key=lambda u: not 32 < u[-1] < 127)
        found, some, held = [], [], 0
        for u in fresh:
            some.append(u)
            held += len(u)
            if held > BLOCK or not 32 < u[-1] < 127:
                found += self.learned(some)
                some, held = [], 0
        found += self.learned(some)
        if found:
            self.number.update(zip(fresh, range(len(self.groups), len(self.groups) + len(fresh))))
            self.groups += [g for part in found for g in part[0]]
            self.counts = np.concatenate([self.counts, *[part[1] for part in found]])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.concatenate([part[2] for part in found]))])
            self.codes, self.times = (np.concatenate([old, *[part[k] for part in found]]) for old, k in ((self.codes, 3), (self.times, 4)))
            self.uses = np.concatenate([self.uses, np.zeros(len(self.groups) - len(self.uses), np.int64)])
        out = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out

    def learned(self, units: list[bytes]) -> list[tuple]:
        """Units encoded in one piece: their groups, counts, numbers of pairs, pairs. Those among them that don't give their bytes are found by halves."""
        if not units:
            return []
        text = b"".join(units)
        tokens = self.tokens(text)
        if tokens is None:
            if len(units) == 1:
                return [([b""], np.array([[0, 0, 0, 0, 1]]), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
            half = len(units) // 2
            return self.learned(units[:half]) + self.learned(units[half:])
        (a, end_a), (b, end_b) = tokens
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        of_unit = np.searchsorted(np.cumsum([len(u) for u in units]), cuts)
        first_a, first_b = (np.searchsorted(e, np.concatenate([[0], cuts]), "right") for e in (end_a, end_b))
        n_a, n_b = np.diff(first_a), np.diff(first_b)
        n = len(units)
        links = n_a * n_b
        counts = np.stack([np.bincount(of_unit, x, n).astype(np.int64) for x in (n_a, n_b, np.ones(len(cuts)), links)] + [np.zeros(n, np.int64)], axis=1)
        # one link, many, and so many that they are counted before they are paired
        one, vast = links == 1, links > 100_000
        some = np.flatnonzero(~one & ~vast)
        of, at = np.repeat(some, links[some]), ranges(np.zeros(len(some), np.int64), links[some])
        codes = [a[first_a[:-1][one]] * self.size_b + b[first_b[:-1][one]], a[first_a[of] + at // n_b[of]] * self.size_b + b[first_b[of] + at % n_b[of]]]
        owners, times = [of_unit[one], of_unit[of]], [np.ones(int(one.sum()), np.int64), np.ones(len(of), np.int64)]
        for g in np.flatnonzero(vast):
            (x, nx), (y, ny) = np.unique(a[first_a[g] : first_a[g + 1]], return_counts=True), np.unique(b[first_b[g] : first_b[g + 1]], return_counts=True)
            codes.append((x[:, None] * self.size_b + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            owners.append(np.full(len(x) * len(y), of_unit[g]))
        owner, code, often = summed(np.concatenate(owners), np.concatenate(codes), np.concatenate(times))
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        parts = [f"{names_a[i]}|{names_b[k]}" if j - i == m - k == 1 else f"{','.join(names_a[i:j])}|{','.join(names_b[k:m])}" for i, j, k, m in zip(first_a.tolist(), first_a[1:].tolist(), first_b.tolist(), first_b[1:].tolist())]
        ends = np.searchsorted(of_unit, np.arange(n), "right").tolist()
        groups = [";".join(parts[i:j]).encode() for i, j in zip([0, *ends], ends)]
        return [(groups, counts, np.bincount(owner, minlength=n), code, often)]

    def tokens(self, text: bytes) -> tuple | None:
        """Identifiers and byte cuts of both tokenizers' tokens of a text that begins with a space; None if their bytes aren't the text's."""
        plain = text.decode()
        encoded, pieces = self.first.encode(plain, add_special_tokens=False), self.second.encode(plain[1:], return_type="proto").pieces
        a, b = encoded.ids, [p.id for p in pieces]
        if any(b"".join(map(names.__getitem__, ids)) != text for names, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        spans_a = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(plain) != len(text):  # characters to bytes
            point = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
            spans_a = np.concatenate([[0], np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))])[spans_a]
        # these don't know of the added space, which the first token holds
        spans_b = np.fromiter((x for p in pieces for x in (p.begin, p.end)), np.int64, 2 * len(b)).reshape(-1, 2) + 1
        spans_b[:1, 0] = 0
        return tuple((np.array(ids, np.int64), cuts(spans, lengths[ids])) for ids, spans, lengths in ((a, spans_a, self.lengths[0]), (b, spans_b, self.lengths[1])))


def cuts(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end: by their span where it begins at the last token's end and is as long as the token's bytes, else by the bytes."""
    decoded = np.cumsum(sizes)
    plain = (spans[:, 0] == decoded - sizes) & (spans[:, 1] - spans[:, 0] == sizes)
    return np.where(plain, spans[:, 1], decoded)


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[k] .. begins[k] + sizes[k] - 1, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def summed(of: np.ndarray, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (of, code) in order, with the sums of their times."""
    if not len(codes):
        return of, codes, times
    span = int(codes.max()) + 1
    keys = of * span + codes
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first] // span, keys[first] % span, np.add.reduceat(times, first)


@dataclass
class Portion:
    """Some texts of a batch, parted into units: ``owner`` is each unit's text, ``empty`` tells texts without a byte."""

    at: int
    n: int
    units: list[bytes]
    owner: np.ndarray
    empty: np.ndarray


def portions(texts: pa.Array, whole: bool = False) -> Iterator[Portion]:
    """Texts of about BYTES bytes at a time, each with a space before it, parted before spaces that follow a visible ASCII character and don't end the text; null texts are empty."""
    for at, offsets, raw in chunks(texts, BYTES):
        n = len(offsets) - 1
        data = np.insert(raw, offsets[:-1], 32)
        starts = offsets[:-1] + np.arange(n)
        ends = offsets[1:] + np.arange(1, n + 1)
        cut = np.zeros(len(data), bool)
        if not whole:
            cut[1:] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)
            cut[ends - 1] = False
        cut[starts] = True
        begins = np.flatnonzero(cut)
        text = data.tobytes()
        units = [text[i:j] for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(text)])]
        yield Portion(at, n, units, np.searchsorted(starts, begins, "right") - 1, ends - starts == 1)


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One a worker."""
    key = byte_bpe, piece_bpe
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<pair:bigint,times:bigint>>"


def aligning(byte_bpe: str, piece_bpe: str):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = aligner(byte_bpe, piece_bpe)
        for batch in batches:
            for part in portions(batch["text"], it.whole):
                unit = it.numbers(part.units)
                first = np.searchsorted(part.owner, np.arange(part.n + 1))
                running = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(it.counts[unit], axis=0)])
                counts = running[first[1:]] - running[first[:-1]]
                fine = (counts[:, 4] == 0) & ~part.empty
                counts[~fine] = 0
                numbers = unit.tolist()
                digests = [hashlib.sha256(b";".join([it.groups[u] for u in numbers[i:j]])).hexdigest() if ok else "" for ok, i, j in zip(fine.tolist(), first[:-1].tolist(), first[1:].tolist())]
                kept = fine[part.owner]
                owner, unit, often = summed(part.owner[kept], unit[kept], np.ones(int(kept.sum()), np.int64))
                sizes = it.begins[unit + 1] - it.begins[unit]
                at = ranges(it.begins[unit], sizes)
                owner, codes, times = summed(np.repeat(owner, sizes), it.codes[at], it.times[at] * np.repeat(often, sizes))
                offsets = pa.array(np.searchsorted(owner, np.arange(part.n + 1)).astype(np.int32))
                pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(codes), pa.array(times)], ["pair", "times"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(part.at, part.n), *map(pa.array, counts[:, :4].T.copy()), pa.array(digests, pa.string()), pairs], names)

    return run


def token_groups(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment itself, one row per group: doc_id, position from 0, start and end (byte offsets in a space and the text) and the identifiers a and b. Texts without tokens have no rows."""
    names = ["doc_id", "position", "start", "end", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = aligner(byte_bpe, piece_bpe)
        ids = pa.list_(pa.int32())
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), ids, ids]
        for batch in batches:
            for part in portions(batch["text"], it.whole):
                unit = it.numbers(part.units)
                first = np.searchsorted(part.owner, np.arange(part.n + 1))
                for k in range(part.n):
                    own = unit[first[k] : first[k + 1]]
                    if part.empty[k] or it.counts[own, 4].any():
                        continue
                    rows, at = [], 0
                    for group in b";".join([it.groups[u] for u in own.tolist()]).decode().split(";"):
                        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
                        end = at + sum(len(it.bytes_a[x]) for x in a)
                        rows.append((batch["doc_id"][part.at + k].as_py(), len(rows), at, end, a, b))
                        at = end
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, position bigint, start bigint, end bigint, a array<int>, b array<int>")


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens' bytes aren't a space and the text
    (such as texts with U+2581), have no tokens: zeros and an empty digest. Each row is a
    document, also if it repeats another or has no identifier. A pair's count is the
    number of documents in which it is linked; a link is best if no other pair of its
    first identifier has a higher count. Texts of any length are aligned whole. An empty
    table gives an empty result; further columns are ignored. The tokenizers' files must
    be readable on every executor at the given paths.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(spark, 1000), job(spark):
        found = texts.mapInArrow(aligning(byte_bpe, piece_bpe), ALIGNED).withColumn("row", F.monotonically_increasing_id())
        found = materialize(found, "aligned")  # the numbers of rows are fixed by writing them
        pairs = found.select("row", F.inline("pairs"))
        counted = materialize(pairs.groupBy("pair").agg(F.count("*").alias("n")), "counts")
        # as many rows as the first vocabulary has identifiers at most
        size_b = _size_b(piece_bpe)
        a = F.floor(F.col("pair") / size_b)
        highest = counted.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
        counted = materialize(counted.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "best")
        usual, rest = most_frequent(counted, frequent)
        parts = [added(pairs.join(F.broadcast(usual), "pair"))]
        if rest is not None:
            parts.append(added(pairs.join(F.broadcast(usual.select("pair")), "pair", "left_anti").join(rest, "pair")))
        sums = parts[0]
        for p in parts[1:]:
            sums = sums.union(p)
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = found.drop("pairs").join(sums, "row", "left")
        zero = F.lit(0).cast("bigint")
        return result(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"), "alignment")


def _size_b(piece_bpe: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe).get_piece_size()


def added(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def most_frequent(counted: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs from a count on that at most ``limit`` reach, and the others, if there are any."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["level"], r["size"]) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()), reverse=True)  # 16 rows a power of two
    total, least = 0, None
    for at, size in sizes:
        if total + size > limit:
            break
        total, least = total + size, at
    if total == sum(size for _, size in sizes):
        return counted, None
    usual = level >= (least if least is not None else 1 << 30)
    return counted.where(usual), counted.where(~usual)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
