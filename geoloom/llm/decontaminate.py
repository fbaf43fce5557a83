"""Benchmark decontamination by latent semantic retrieval.

1. Documents become sequences of benchmark term numbers (other words are -1) and
   are kept in that short form; all later passes read it instead of the texts.
2. Items, in parts of up to PART words, are dealt to blocks of about PARTS parts.
   Each block has a latent space of its own, so its rank keeps up with the benchmark,
   and all blocks of a group are searched in the same pass. A block's TF-IDF
   matrix holds all passages of HALF words of all documents that have any of its terms,
   and its parts, which are HEAVY times as heavy as all passages together. Weights are
   roots of inverse document frequencies over all documents, so that a few rare words
   beside an item don't hide it. The matrix's leading right singular vectors come from
   a randomised SVD: a random subspace goes twice through A'A, with an
   orthonormalisation between, and a small eigenproblem at the end. A distributed job
   sums A'A from the pairs of terms in each passage, for as many blocks at a time as
   have CELLS pairs of terms; a block with more goes through A and A' in two jobs that
   sum a (terms x RANK + EXTRA) matrix.
3. Candidates are windows of HALF and 2 * HALF words (every HALF words) whose cosine
   with a part of an item, within the latent space, is COSINE at least. Since the
   space holds the block's parts, this cosine is never below that of the TF-IDF
   vectors themselves, whatever else is in the block.
4. A candidate is confirmed by the longest common subsequence of the item's words
   and the window's surroundings, or by a shorter one that holds the item's answer
   (its last words), which catches paraphrases. Counts of shared words, which bound
   the subsequence, spare most of these comparisons. An item of frequent words (most
   of them in more than MAX_DF of the passages) is compared by all its words with
   stretches little longer than itself, and in whole if it is short.

The driver and the tasks hold a slice of the benchmark, SLICE bytes of its text, and a
group's matrices, about 40 MB for GROUP blocks of PARTS parts. A larger benchmark takes
more groups, and more slices, each of which codes the documents anew: an item's weights
and candidates don't depend on other items, so the parts' hits are all there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.words import ALNUM, mix, split
from geoloom.storage import job, materialize, result

HALF, RANK, EXTRA, MAX_DF, LITTLE = 24, 160, 16, 0.2, 0.05
#: Words of an item in a row of the matrix; rows in a block; blocks in a pass.
PART, PARTS, GROUP = 2 * HALF, 128, 16
#: Least cosine of a candidate.
COSINE = 0.35
#: Weight of a block's parts in its matrix, all passages together weighing 1.
HEAVY = 16
#: Pairs of terms whose sums a task holds at a time, eight bytes each.
CELLS = 12_000_000
#: Share of an item's words in the common subsequence; the lower one needs ANSWER of the last ANSWER_WORDS words.
LCS, LCS_LOW, ANSWER, ANSWER_WORDS = 0.6, 0.45, 0.8, 8
TOKENS = 60_000  # worked on at a time
#: Bytes of the benchmark's text that the driver holds at a time.
SLICE = 8 << 20


@dataclass
class Benchmark:
    ids: np.ndarray
    items: list[np.ndarray]  # term numbers of each item's words
    terms: np.ndarray  # sorted word hashes


def read_benchmark(rows: list, id_col: str, text_col: str) -> Benchmark:
    """Items with at least one word; null and empty items can't be found anywhere."""
    rows = [r for r in rows if r[text_col]]
    ids, hashes = [], []
    for words in split(pa.array([r[text_col] for r in rows], pa.string()), ALNUM, accents=True):
        h = words.hashes()
        for t in range(len(words.first) - 1):
            if words.first[t + 1] > words.first[t]:
                ids.append(rows[words.at + t][id_col])
                hashes.append(h[words.first[t] : words.first[t + 1]])
    terms = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
    return Benchmark(np.array(ids), [np.searchsorted(terms, h) for h in hashes], terms)


def encode(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id and its words as int32 term numbers. A table of 2**16 bits keeps most other words from the search."""
    seen = np.zeros(65536, bool)
    seen[(terms >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split(batch["text"], ALNUM, accents=True):
                h = words.hashes()
                out = np.full(len(h), -1, np.int32)
                maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
                k = np.searchsorted(terms, h[maybe])
                k[k == len(terms)] = 0
                hit = terms[k] == h[maybe]
                out[maybe[hit]] = k[hit]
                n = len(words.first) - 1
                offsets = pa.py_buffer((words.first * 4).astype(np.int32).tobytes())
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(words.at, n).cast(pa.int64()), blobs], names=["doc_id", "terms"])

    return run


@dataclass
class Tokens:
    """Known words of several documents: term, half-window, place, and per half-window its document."""

    term: np.ndarray
    half: np.ndarray
    place: np.ndarray  # number of the word in the group
    doc_of_half: np.ndarray
    sequences: list[np.ndarray]
    at: int


def halves(batch: pa.RecordBatch) -> Iterator[Tokens]:
    """Groups of documents of about TOKENS words."""
    blobs, i = batch["terms"], 0
    sizes = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]) // 4 if len(blobs) else np.empty(0, int)
    while i < len(blobs):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), TOKENS, "right")))
        sequences = [np.frombuffer(b.as_buffer(), np.int32) if b.is_valid else np.empty(0, np.int32) for b in blobs[i:j]]
        n = np.array([len(s) for s in sequences])
        per_doc = -(-n // HALF)
        first = np.cumsum(per_doc) - per_doc
        flat = np.concatenate(sequences)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        half = np.repeat(first, n) + at // HALF
        known = np.flatnonzero(flat >= 0)
        yield Tokens(flat[known], half[known], known, np.repeat(np.arange(len(n)), per_doc), sequences, i)
        i = j


def count_terms(n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many passages each term is; number n_terms counts all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for t in halves(batch):
                total[:-1] += np.bincount((np.unique(t.half * n_terms + t.term) % n_terms).astype(np.int64), minlength=n_terms)
                total[-1] += len(t.doc_of_half)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), "n": total[some]})

    return run


def unit_passages(term: np.ndarray, half: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages as rows of unit length: the half, term and value of all that isn't 0, in order."""
    cells, counts = np.unique(half * len(weight) + term, return_counts=True)
    half, term = np.divmod(cells, len(weight))
    value = weight[term] * counts
    return half, term, value / np.sqrt(np.maximum(np.bincount(half, value**2), 1e-12))[half]


def sums_of(term: np.ndarray, half: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """Per half (0..n-1, in order) the sum of its tokens' rows: first all halves' first tokens, then all second ones, and so on."""
    counts = np.bincount(half, minlength=n)
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], begin[order]
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    for k in range(counts[0] if n else 0):
        m = int(np.searchsorted(-counts, -k, "left"))
        out[:m] += rows[term[begin[:m] + k]]
    back = np.empty_like(order)
    back[order] = np.arange(n)
    return out[back]


@dataclass
class Block:
    """Items that share a latent space. Terms are the block's own, numbered in the order of the benchmark's."""

    terms: np.ndarray
    weight: np.ndarray
    parts: np.ndarray  # unit rows over the terms
    item_of: np.ndarray  # item of each part
    part_weight: float  # of a part's row, a passage weighing 1
    number: np.ndarray  # the block's number of each of the benchmark's terms up to its last own one, else -1

    def tokens(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Own term numbers and half-windows of a group's tokens that are among the block's terms."""
        known = t.term < len(self.number)
        k = self.number[np.where(known, t.term, 0)]
        own = np.flatnonzero(known & (k >= 0))
        return k[own], t.half[own]


@dataclass
class Weights:
    """Term weights, each item's telling words, and which items have hardly any, so that all their words count as telling."""

    weight: np.ndarray
    telling: list[np.ndarray]
    plain: np.ndarray
    passages: float


def weigh(coded: DataFrame, bench: Benchmark) -> Weights:
    n = len(bench.terms)
    df = np.zeros(n + 1)
    counts = coded.mapInArrow(count_terms(n), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[counts["term"].to_numpy()] = counts["n"].to_numpy()
    passages = max(df[-1], 1)
    idf = np.log((1 + passages) / (1 + df[:-1])) + LITTLE
    rare = df[:-1] <= max(MAX_DF * passages, 2)
    telling = [x[rare[x]] for x in bench.items]
    plain = np.array([len(np.unique(y)) < 2 or 4 * len(y) < len(x) for x, y in zip(bench.items, telling)])
    return Weights(np.sqrt(idf), [x if p else y for x, y, p in zip(bench.items, telling, plain)], plain, passages)


def blocks_of(bench: Benchmark, w: Weights) -> list[Block]:
    """Items in the order of a hash of their words, dealt in turn to blocks of about PARTS parts. The last part of a long item begins early enough to be whole."""
    starts = [[0] if len(x) <= PART else [*range(0, len(x) - PART, PART), len(x) - PART] for x in bench.items]
    order = sorted(range(len(starts)), key=lambda q: (int(mix(bench.terms[bench.items[q][:1]])[0]), q))
    taken, dealt = 0, []
    for q in order:
        if not dealt or taken + len(starts[q]) > PARTS:
            dealt.append([])
            taken = 0
        dealt[-1].append(q)
        taken += len(starts[q])
    out = []
    for items in dealt:
        terms = np.unique(np.concatenate([bench.items[q] for q in items]))
        rows = [(q, bench.items[q][a : a + PART]) for q in items for a in starts[q]]
        parts = np.zeros((len(rows), len(terms)), np.float32)
        for k, (_, x) in enumerate(rows):
            np.add.at(parts[k], np.searchsorted(terms, x), w.weight[x])
        parts /= np.maximum(np.linalg.norm(parts, axis=1, keepdims=True), 1e-9)
        number = np.full(int(terms[-1]) + 1, -1, np.int32)
        number[terms] = np.arange(len(terms))
        out.append(Block(terms, w.weight[terms], parts, np.array([q for q, _ in rows]), HEAVY * w.passages / len(rows), number))
    return out


def through(blocks: list[Block], bases: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, term, values) of each block's A'A times its basis, summed over the partition; A's rows are all passages, of unit length."""
    width = max(b.shape[1] for b in bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(basis.shape, np.float64) for basis in bases]
        for batch in batches:
            for t in halves(batch):
                for b, basis, total in zip(blocks, bases, totals):
                    half, term, value = unit_passages(*b.tokens(t), b.weight)
                    if not len(half):
                        continue
                    begin = np.diff(half, prepend=-1) > 0
                    image = np.add.reduceat(value[:, None] * basis[term], np.flatnonzero(begin), axis=0)
                    order = np.argsort(term, kind="stable")
                    own, row = term[order], (np.cumsum(begin) - 1)[order]
                    begin = np.flatnonzero(np.diff(own, prepend=-1))
                    total[own[begin]] += np.add.reduceat(value[order][:, None] * image[row], begin, axis=0)
        for k, total in enumerate(totals):
            some = np.flatnonzero(np.abs(total).max(axis=1))
            values = np.zeros((len(some), width), np.float32)
            values[:, : total.shape[1]] = total[some]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), *(pa.array(values[:, j]) for j in range(width))], names=["block", "term", *(f"v{j}" for j in range(width))])

    return run


def multiply(coded: DataFrame, blocks: list[Block], bases: list[np.ndarray]) -> list[np.ndarray]:
    """A'A times the basis of each block: partial sums by partition, added by term. The parts are rows of A, too."""
    names = [f"v{j}" for j in range(max(b.shape[1] for b in bases))]
    rows = coded.mapInArrow(through(blocks, bases), "block int, term int, " + ", ".join(f"{c} float" for c in names)).groupBy("block", "term").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    block, term = rows["block"].to_numpy(), rows["term"].to_numpy()
    values = np.stack([rows[c].to_numpy() for c in names], axis=1) if len(rows) else np.zeros((0, len(names)))
    out = []
    for k, (b, basis) in enumerate(zip(blocks, bases)):
        total = np.zeros(basis.shape)
        total[term[block == k]] = values[block == k, : basis.shape[1]]
        out.append(total + b.part_weight * (b.parts.T @ (b.parts @ basis)))
    return out


def products(blocks: list[Block]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, cell, value) of each block's A'A above the diagonal, and the half of it, summed over the partition; A's rows are all passages, of unit length. A cell is the smaller term's number times the number of terms, and the larger's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(b.terms) ** 2) for b in blocks]
        for batch in batches:
            for t in halves(batch):
                for b, total in zip(blocks, totals):
                    half, term, value = unit_passages(*b.tokens(t), b.weight)
                    cells, values = [term * (len(b.terms) + 1)], [value**2 / 2]
                    for d in range(1, HALF):  # terms of a passage are in order
                        at = np.flatnonzero(half[d:] == half[:-d])
                        if not len(at):
                            break
                        cells.append(term[at] * len(b.terms) + term[at + d])
                        values.append(value[at] * value[at + d])
                    np.add.at(total, np.concatenate(cells), np.concatenate(values))
        for k, total in enumerate(totals):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.float32))], names=["block", "cell", "value"])

    return run


def multiplier(coded: DataFrame, blocks: list[Block]) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """What ``multiply`` does for blocks of up to CELLS pairs of terms in all, with A'A summed in one job."""
    rows = coded.mapInArrow(products(blocks), "block int, cell int, value float").groupBy("block", "cell").agg(F.sum("value").cast("float").alias("value")).toArrow()
    block, cell, value = (rows[c].to_numpy() for c in ("block", "cell", "value"))
    squares = []
    for k, b in enumerate(blocks):
        half = np.zeros(len(b.terms) ** 2, np.float32)
        half[cell[block == k]] = value[block == k]
        half = half.reshape(len(b.terms), -1)
        squares.append(half + half.T)
    return lambda bases: [square @ basis + b.part_weight * (b.parts.T @ (b.parts @ basis)) for b, square, basis in zip(blocks, squares, bases)]


def latent_spaces(coded: DataFrame, blocks: list[Block], rank: int = RANK) -> list[np.ndarray]:
    """Terms x rank of each block: the leading right singular vectors of its passages and parts."""
    rng = np.random.default_rng(4)
    starts = [np.linalg.qr(rng.standard_normal((len(b.terms), min(rank + EXTRA, len(b.terms)))))[0] for b in blocks]
    wide, dealt, taken = [], [], 0
    for k, b in enumerate(blocks):
        cells = len(b.terms) ** 2
        if cells > CELLS:
            wide.append(k)
            continue
        if not dealt or taken + cells > CELLS:
            dealt.append([])
            taken = 0
        dealt[-1].append(k)
        taken += cells
    out: list[np.ndarray] = [np.empty(0)] * len(blocks)
    for some in [*dealt, *([wide] if wide else [])]:
        own = [blocks[k] for k in some]
        times = partial(multiply, coded, own) if some is wide else multiplier(coded, own)
        bases = [np.linalg.qr(x)[0] for x in times([starts[k] for k in some])]
        for k, basis, image in zip(some, bases, times(bases)):
            small = basis.T @ image
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            out[k] = basis @ vectors[:, np.argsort(-values)[: min(rank, basis.shape[1])]]
    return out


def positions(a: np.ndarray) -> dict[int, int]:
    """For each value the places where it stands, a bit each."""
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    return at


def common_subsequence(at: dict[int, int], n: int, b: list[int]) -> int:
    """Length of the longest common subsequence of ``b`` and a sequence of ``n`` values with the positions ``at``, a bit per value."""
    full = (1 << n) - 1
    v = full
    for y in b:
        m = at.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


HIT = "doc_id bigint, item_id bigint, start bigint, cosine double, lcs double, answer double"


def present(keys: np.ndarray, n: int, terms: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(terms x stretches) whether a term is at a place from a to before z. keys: term * n + place of all words, sorted, then a larger value; a in order, so that each term's look-ups go forward."""
    low = terms.astype(keys.dtype)[:, None] * keys.dtype.type(n)
    a, z = a.astype(keys.dtype), z.astype(keys.dtype)
    return keys[np.searchsorted(keys, (low + a).reshape(-1)).reshape(len(terms), len(a))] < low + z


def unit_rows(x: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """Rows of unit length; rows shorter than ``least`` stay short."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), least)


def retriever(block: Block, space: np.ndarray) -> Callable[[Tokens, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function from a group of documents, and its tokens in the block, to the candidates by the block's latent space: halves, items (numbers in the block), and cosines."""
    rows = (space * block.weight[:, None]).astype(np.float32)
    query = unit_rows(block.parts @ space, 0.01).astype(np.float32).T
    _, item = np.unique(block.item_of, return_inverse=True)

    def retrieve(t: Tokens, term: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = sums_of(term, at, len(t.doc_of_half), rows)
        next_ = np.append(t.doc_of_half[1:] == t.doc_of_half[:-1], False)
        length = np.einsum("ij,ij->i", one, one)
        both = length.copy()
        both[next_] += length[1:][next_[:-1]] + 2 * np.einsum("ij,ij->i", one[:-1], one[1:])[next_[:-1]]
        near = one @ query
        wide = near.copy()
        wide[next_] += near[1:][next_[:-1]]
        length, both = (np.sqrt(np.maximum(x, 1e-12))[:, None] for x in (length, both))
        half, part = np.nonzero((near >= COSINE * length) | (wide >= COSINE * both))
        cosine = np.maximum(near[half, part] / length[half, 0], wide[half, part] / both[half, 0])
        order = np.lexsort((-cosine, item[part], half))
        half, own, cosine = half[order], item[part][order], cosine[order]
        new = np.ones(len(half), bool)
        new[1:] = (half[1:] != half[:-1]) | (own[1:] != own[:-1])
        return half[new], own[new], cosine[new]

    return retrieve


def held_around(t: Tokens, term: np.ndarray, half: np.ndarray, counts: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Per half (row) and item (column) at least as many of the item's words, of which ``counts`` (terms x items) are asked for, as are around the half: in ``reach`` halves before it, itself, the next, and ``reach`` after that, of the same document."""
    n, n_terms = len(t.doc_of_half), len(counts)
    own = np.unique(half * n_terms + term)
    sums = np.zeros((n + 1, counts.shape[1]), np.int32)
    np.cumsum(sums_of(own % n_terms, own // n_terms, n, counts), axis=0, out=sums[1:])
    begin, end = (np.searchsorted(t.doc_of_half, t.doc_of_half, side) for side in ("left", "right"))
    out, at = np.empty((n, counts.shape[1]), np.int32), np.arange(n)
    for k in np.unique(reach):
        cols = np.flatnonzero(reach == k)
        one = sums[:, cols]
        out[:, cols] = one[np.minimum(at + 2 + k, end)] - one[np.maximum(at - k, begin)]
    return out


def search(bench: Benchmark, w: Weights, blocks: list[Block], spaces: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hits of the items that are near a window in their block's latent space and that the subsequence and answer checks confirm."""
    parts = (bench.items, w.telling, [x[-ANSWER_WORDS:] for x in bench.items])
    telling_sizes, tail_sizes = (np.array([len(x) for x in part]) for part in parts[1:])
    is_telling = [np.isin(x, y) for x, y in zip(bench.items, w.telling)]
    sizes = np.array([len(x) for x in bench.items])
    several = np.array([len(np.unique(x)) >= 2 for x in w.telling])
    stretch, step = sizes + sizes // 4, np.maximum(1, sizes // 4)  # of plain items; the item itself is in one of the stretches
    low, high = (np.where(w.plain & (sizes < ANSWER_WORDS), 1.0, x) for x in (LCS_LOW, LCS))
    reach = -(-np.where(w.plain, stretch, sizes) // HALF)
    placed: list[dict[int, dict[int, int]]] = [{}, {}, {}]
    retrievers = [retriever(block, space) for block, space in zip(blocks, spaces)]
    own_items = [np.unique(block.item_of) for block in blocks]
    asked = []
    for block, items in zip(blocks, own_items):
        asked.append(np.zeros((len(block.terms), 2 * len(items)), np.int16 if sizes.max() < 2**15 else np.int32))  # telling words, then those of the answers
        for k, q in enumerate(items):
            for column, x in ((k, parts[1][q]), (len(items) + k, parts[2][q])):
                np.add.at(asked[-1][:, column], np.searchsorted(block.terms, x), 1)

    def subsequence(kind: int, q: int, around: list[int]) -> float:
        x = parts[kind][q]
        if q not in placed[kind]:
            placed[kind][q] = positions(x)
        return common_subsequence(placed[kind][q], len(x), around) / len(x)

    def confirm(q: int, around: list[int]) -> tuple[float, float] | None:
        lcs = subsequence(1, q, around)  # frequent words alone are no evidence
        if lcs < low[q]:
            return None
        lcs = min(lcs, subsequence(0, q, around))
        if lcs < low[q]:
            return None
        answer = subsequence(2, q, around)
        return (lcs, answer) if lcs >= high[q] or answer >= ANSWER else None

    def candidates(t: Tokens) -> tuple[np.ndarray, ...]:
        """Halves, items, first word and end of the surroundings, and cosines, of what was retrieved and ``confirm`` may accept."""
        near = []
        for block, retrieve, items, counts in zip(blocks, retrievers, own_items, asked):
            tokens = block.tokens(t)
            half, k, cosine = retrieve(t, *tokens)
            if len(half):
                around = held_around(t, *tokens, counts, np.tile(reach[items], 2))
                held, answer, k = around[half, k], around[half, len(items) + k], items[k]
                enough = held >= high[k] * telling_sizes[k] - 1e-9
                enough |= (held >= low[k] * telling_sizes[k] - 1e-9) & (answer >= ANSWER * tail_sizes[k] - 1e-9)
                near.append([x[enough & several[k]] for x in (half, k, cosine)])
        b, q, cosine = (np.concatenate(x) for x in zip(*near)) if near else (np.empty(0, int), np.empty(0, int), np.empty(0))
        lengths = np.array([len(x) for x in t.sequences])
        ends, n = np.cumsum(lengths), int(lengths.sum())
        doc = t.doc_of_half[b]
        start = (b - np.searchsorted(t.doc_of_half, doc)) * HALF
        a, z = np.maximum(0, start - sizes[q]), start + 2 * HALF + sizes[q]
        if w.plain[q].any():  # every stretch that begins in the half
            n_of = np.where(w.plain[q], -(-HALF // step[q]), 1)
            at = np.repeat(np.arange(len(q)), n_of)
            b, q, cosine, doc, start = b[at], q[at], cosine[at], doc[at], start[at]
            a = np.where(w.plain[q], start + (np.arange(len(at)) - (np.cumsum(n_of) - n_of)[at]) * step[q], a[at])
            z = np.where(w.plain[q], a + stretch[q], z[at])
        z = np.minimum(z, lengths[doc])
        small = np.int32 if (len(bench.terms) + 1) * n < 2**31 else np.int64
        keys = np.append(np.sort(t.term.astype(small) * small(n) + t.place.astype(small)), np.iinfo(small).max)
        first = (ends - lengths)[doc]
        order = np.lexsort((first + a, q))
        b, q, a, z, first, cosine = (x[order] for x in (b, q, a, z, first, cosine))
        kept = np.zeros(len(q), bool)
        for x, y in zip(cuts := np.flatnonzero(np.diff(q, prepend=-1)).tolist(), [*cuts[1:], len(q)]):
            k = q[x]
            there = present(keys, n, bench.items[k], (first + a)[x:y], (first + z)[x:y])
            answered = there[-ANSWER_WORDS:].sum(axis=0) >= ANSWER * tail_sizes[k] - 1e-9
            least = np.where(answered, low[k], high[k])
            kept[x:y] = (there[is_telling[k]].sum(axis=0) >= least * telling_sizes[k] - 1e-9) & (there.sum(axis=0) >= least * sizes[k] - 1e-9)
        return b[kept], q[kept], a[kept], z[kept], cosine[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for t in halves(batch):
                if not len(t.term):
                    continue
                seen: dict[tuple[int, int, int, int], tuple[float, float] | None] = {}
                for b, q, a, z, cosine in zip(*(x.tolist() for x in candidates(t))):
                    doc = int(t.doc_of_half[b])
                    start = (b - int(np.searchsorted(t.doc_of_half, doc))) * HALF
                    key = (doc, q, a, z)
                    if key not in seen:
                        around = t.sequences[doc][a:z]
                        seen[key] = confirm(q, around[around >= 0].tolist())
                    if seen[key]:
                        key, score = (t.at + doc, q), (*seen[key], cosine, -start)
                        best[key] = max(best.get(key, (0,)), score)
            keys = list(best)
            docs = batch["doc_id"].take(pa.array([k for k, _ in keys], pa.int64()))
            lcs, answer, cos = (pa.array([best[k][x] for k in keys], pa.float64()) for x in range(3))
            starts = pa.array([-best[k][3] for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([docs, pa.array([int(bench.ids[q]) for _, q in keys], pa.int64()), starts, cos, lcs, answer], names=["doc_id", "item_id", "start", "cosine", "lcs", "answer"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and benchmark item it holds: doc_id, item_id, start (word), cosine, lcs, answer.

    Clean documents have no row. Null and empty texts and items match nothing, nor
    do items of a single word, repeated or not. Repeated rows give repeated results,
    equal items a row each. Texts of any length are read whole. An empty table on
    either side gives an empty result; further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null")
    with job(docs.sparkSession):
        found = None
        for rows in slices(items):
            bench = read_benchmark(rows, "item", "text")
            if len(bench.terms):
                hits = materialize(_contaminated(texts, bench), "hits")
                found = hits if found is None else found.unionByName(hits)
        return docs.sparkSession.createDataFrame([], HIT) if found is None else result(found, "hits")


def slices(items: DataFrame) -> Iterator[list]:
    """The items in parts of about SLICE bytes of text, which the driver and the tasks hold one at a time."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SLICE)
    if n <= 1:
        yield items.orderBy("item", "text").collect()
        return
    dealt = materialize(items.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "benchmark")
    for k in range(n):
        yield dealt.where(F.col("slice") == k).select("item", "text").orderBy("item", "text").collect()


def _contaminated(texts: DataFrame, bench: Benchmark) -> DataFrame:
    coded = materialize(texts.mapInArrow(encode(bench.terms), "doc_id bigint, terms binary"), "coded")
    weights = weigh(coded, bench)
    blocks, found = blocks_of(bench, weights), None
    for k in range(0, len(blocks), GROUP):
        group = blocks[k : k + GROUP]
        hits = coded.mapInArrow(search(bench, weights, group, latent_spaces(coded, group)), HIT)
        found = hits if found is None else found.unionByName(hits)
    return found


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
