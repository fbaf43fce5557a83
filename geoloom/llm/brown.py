"""Language model on Brown classes: exchange clustering of words, class bigrams, word emissions.

Words are mapped to items: the HEAD most frequent words are items of their own,
all others share an item per word ending (a hash of their last bytes, BUCKETS of
them). Every item takes part in the clustering. In a round half of the items, in turn, find the class that raises the
likelihood of the class bigrams most, given the classes of all other items, and
move. Moves at a
time may disturb each other, so the likelihood of the new classes is counted, and
if it fell, only the moves with the largest gains are kept, down to one, whose gain
is exact. So the likelihood never falls, and the rounds end when it gains less than
TOLERANCE a token.

    P(text) = product of P(class | class before) * P(item | class) * P(word | item)

The text's end is an item in a class of its own, and begins the next text. All
three factors are smoothed by adding a little to every count, so the word factor
leaves room for one unseen word in each item. Items, classes and the class bigrams
are tables of bounded size that go to every task; all other words' counts are
joined by shuffle, so the vocabulary may grow with the corpus. Each item's
neighbours are one row, made by a tree of merges, so a round is two scans of that
table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.words import Words, mix, split
from geoloom.storage import arrow_rows, job, materialize, result, running_sums

HEAD, BUCKETS, CLASSES = 2**17, 2**13, 48
#: Words with fewer places share the item of their ending: their few neighbours would choose a class that fits the training texts only.
LEAST_COUNT = 5
#: The clustering ends when a round gains less than this likelihood (natural logarithm) a token.
TOLERANCE = 2e-3
#: Classes whose gain is counted exactly, of those that look best by its slope.
TRIED = 8
ENDING = 3
SMOOTH = 0.5
END = -1  # hash of the text's end
FAN_IN = 8  # bits of the number of tables that a merge of neighbours takes in


def word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A signed hash per word, and the bucket of its ending."""
    h = words.hashes()
    last = np.zeros(len(h), np.uint64)
    for k in range(1, ENDING + 1):
        there = words.ends - k >= words.starts
        last = last * np.uint64(257) + np.where(there, words.data[np.maximum(words.ends - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    key = h.view(np.int64)
    return np.where(key == END, np.int64(1), key), (mix(last + np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int32)


AT_ONCE = 4_000_000  # tokens that are counted before their sums go out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of texts as the word END, summed over some texts at a time."""

    def sums(keys: list[np.ndarray], buckets: list[np.ndarray], texts: int) -> pa.RecordBatch:
        key, first, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        bucket = np.concatenate(buckets)[first]
        return pa.RecordBatch.from_pydict({"word": np.append(key, END), "bucket": np.append(bucket, BUCKETS).astype(np.int32), "n": np.append(n, texts).astype(np.int64)})

    keys, buckets, texts, held = [], [], 0, 0
    for batch in batches:
        for words in split(batch["text"]):
            k, b = word_keys(words)
            keys.append(k)
            buckets.append(b)
            texts += len(words.first) - 1
            held += len(k)
            if held >= AT_ONCE:
                yield sums(keys, buckets, texts)
                keys, buckets, texts, held = [], [], 0, 0
    if texts:
        yield sums(keys, buckets, texts)


@dataclass
class Items:
    """Bounded tables: head words (sorted hashes, counts) and how many words and places each ending's other words have. Items: endings, the end, head words."""

    head: np.ndarray
    head_n: np.ndarray
    bucket_n: np.ndarray
    bucket_words: np.ndarray
    n_texts: int

    @property
    def size(self) -> int:
        return BUCKETS + 1 + len(self.head)

    def of(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Item of each word."""
        at = np.searchsorted(self.head, key)
        at[at == len(self.head)] = 0
        known = self.head[at] == key if len(self.head) else np.zeros(len(key), bool)
        return np.where(known, BUCKETS + 1 + at, bucket)

    def counts(self) -> np.ndarray:
        return np.concatenate([self.bucket_n, [self.n_texts], self.head_n])


def read_items(counts: DataFrame) -> Items:
    """Head words are those of LEAST_COUNT places or more, of the largest counts as many as HEAD has room for."""
    words = counts.where(F.col("word") != END)
    by_n = words.groupBy("n").agg(F.count("*").alias("words"))
    before = running_sums(by_n, [-F.col("n")], {"before": F.col("words")})
    least = before.where(F.col("before") + F.col("words") <= HEAD).agg(F.min("n")).first()[0]
    least = max(least, LEAST_COUNT) if least else None
    head = words.where(F.col("n") >= least).select("word", "n").toArrow() if least else None
    rest = words.where(F.col("n") < least) if least else words
    sums = rest.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    bucket_n, bucket_words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    bucket_n[sums["bucket"].to_numpy()], bucket_words[sums["bucket"].to_numpy()] = sums["n"].to_numpy(), sums["words"].to_numpy()
    ends = counts.where(F.col("word") == END).agg(F.sum("n")).first()[0]
    key, n = (head[c].to_numpy() if head else np.empty(0, np.int64) for c in ("word", "n"))
    order = np.argsort(key)
    return Items(key[order], n[order], bucket_n, bucket_words, ends or 0)


def sequences(words: Words, items: Items, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item before, item) of all tokens in order, each text closed and opened by the end; and each token's text. ``own``: the words' items, if known."""
    own = items.of(*word_keys(words)) if own is None else own
    n = len(words.first) - 1
    at = np.arange(len(own)) + words.text_of()
    line = np.full(len(own) + n, BUCKETS, np.int64)
    line[at] = own
    text = np.repeat(np.arange(n), words.counts + 1)
    return np.concatenate([[BUCKETS], line[:-1]]), line, text


#: An item's neighbours: int32 codes (2 * item after it, 2 * item before it + 1) in order, and int64 counts.
NEIGHBOURS = "slot int, item int, codes binary, counts binary"
#: ... and whose turn it is; the rows of a turn lie together, so that a scan skips the others.
BY_TURN = "item int, turn int, codes binary, counts binary"


def rows_of(item: np.ndarray, code: np.ndarray, n: np.ndarray, slot: int) -> pa.RecordBatch:
    """One row an item from its sorted codes."""
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, int)
    ends = np.append(first[1:], len(item)).astype(int)
    codes, counts = code.astype(np.int32), n.astype(np.int64)
    parts = [pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in (codes, counts)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), slot, np.int32)), pa.array(item[first].astype(np.int32)), *parts], names=["slot", "item", "codes", "counts"])


def count_neighbours(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbours of each item, summed over AT_ONCE tokens at a time."""
    size = items.size

    def sums(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        pair, n = np.unique(np.concatenate(keys), return_counts=True)
        a, b = pair // size, pair % size
        key = np.concatenate([a * (2 * size) + 2 * b, b * (2 * size) + 2 * a + 1])
        order = np.argsort(key)
        item, code, n = key[order] // (2 * size), key[order] % (2 * size), np.concatenate([n, n])[order]
        cuts = np.searchsorted(item, np.arange(0, size + 20_000, 20_000))
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y > x:
                yield rows_of(item[x:y], code[x:y], n[x:y], slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in batches:
            for words in split(batch["text"]):
                before, own, _ = sequences(words, items)
                keys.append(before * size + own)
                held += len(own)
                if held >= AT_ONCE:
                    yield from sums(keys)
                    keys, held = [], 0
        if held:
            yield from sums(keys)

    return run


@dataclass
class Flat:
    """Neighbours of the items in a batch, one entry a code."""

    items: np.ndarray
    row: np.ndarray
    code: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Flat:
        codes = [np.frombuffer(x.as_buffer(), np.int32) for x in batch["codes"]]
        counts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["counts"]]
        row = np.repeat(np.arange(batch.num_rows), [len(x) for x in codes])
        flat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return cls(batch["item"].to_numpy(), row, flat(codes, np.int32).astype(np.int64), flat(counts, np.int64))


def merge_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, item) to one row each. What is open at a batch's end is carried on, merged."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*carry, batch]).combine_chunks().to_batches()[0]
        flat, slot = Flat.of(table), table["slot"].to_numpy().astype(np.int64)
        group = np.cumsum(np.concatenate([[0], (slot[1:] != slot[:-1]) | (flat.items[1:] != flat.items[:-1])]))
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        of = group[flat.row]
        order = np.lexsort((flat.code, of))
        of, code, n = of[order], flat.code[order], flat.n[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (code[1:] != code[:-1])]))
        of, code, n = of[new], code[new], np.add.reduceat(n, new)
        out = rows_of(of, code, n, 0)
        out = pa.RecordBatch.from_arrays([pa.array(slot[first].astype(np.int32)), pa.array(flat.items[first]), out["codes"], out["counts"]], names=["slot", "item", "codes", "counts"])
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
        carry = [out.slice(out.num_rows - 1)]
    yield from carry


def with_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["item"], pa.array(turn_of(b["item"].to_numpy()).astype(np.int32)), b["codes"], b["counts"]], names=["item", "turn", "codes", "counts"])


def neighbours(training: DataFrame, items: Items) -> DataFrame:
    """One row an item with all of its neighbours. Slots (tasks) are merged 2**FAN_IN at a time, so that a frequent word's rows from all tasks don't meet in one."""
    with arrow_rows(training.sparkSession, 500):
        table = materialize(training.mapInArrow(count_neighbours(items), NEIGHBOURS), "neighbours")
        last = table.agg(F.max("slot")).first()[0] or 0
        while True:
            table = table.withColumn("slot", F.shiftright("slot", FAN_IN)).repartition("slot", "item").sortWithinPartitions("slot", "item").mapInArrow(merge_neighbours, NEIGHBOURS)
            last >>= FAN_IN
            if not last:
                turns = table.mapInArrow(with_turn, BY_TURN)
                return materialize(turns.sortWithinPartitions("turn", "item"), "merged")


def by_class(flat: Flat, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items x classes) counts of classes after and before each item, and how often it follows itself, which the others leave out."""
    other, before = flat.code >> 1, flat.code & 1
    itself = other == flat.items[flat.row]
    m = len(flat.items)
    cells = np.bincount((flat.row * 2 + before) * k + classes[other], np.where(itself, 0, flat.n), minlength=2 * k * m).reshape(m, 2, k)
    return cells[:, 0], cells[:, 1], np.bincount(flat.row, flat.n * (itself & (before == 0)), minlength=m)


def count_bigrams(classes: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of the class bigrams, summed over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            flat = Flat.of(batch)
            after, _, itself = by_class(flat, classes, k)
            own = classes[flat.items]
            np.add.at(total, own, after)
            np.add.at(total, (own, own), itself)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(k * k), "n": total.reshape(-1).astype(np.int64)})

    return run


def count_changes(classes: np.ndarray, new: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """By how much the cells of the class bigrams change if classes become ``new``, summed over a partition of the items that move. A bigram of two of them is counted with the first."""
    moves = classes != new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            flat = Flat.of(batch)
            own, other, before = flat.items[flat.row], flat.code >> 1, (flat.code & 1) == 1
            counted = ~(before & moves[other])
            own, other, before, n = own[counted], other[counted], before[counted], flat.n[counted]
            first, second = np.where(before, other, own), np.where(before, own, other)
            for c, sign in ((new, 1), (classes, -1)):
                total += sign * np.bincount(c[first] * k + c[second], n, minlength=k * k)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(k * k), "n": total.astype(np.int64)})

    return run


def summed(cells: DataFrame, k: int) -> np.ndarray:
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(k, k)


def bigrams_of(table: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    return summed(table.mapInArrow(count_bigrams(classes, k), "cell bigint, n bigint"), k)


def bigrams_after(table: DataFrame, bigrams: np.ndarray, classes: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """The class bigrams once classes are ``new``: only rows of items that move are counted."""
    moved = table.sparkSession.createDataFrame(pa.table({"item": np.flatnonzero(classes != new).astype(np.int32)}))
    some = table.join(F.broadcast(moved), "item", "left_semi").select("item", "codes", "counts")
    return bigrams + summed(some.mapInArrow(count_changes(classes, new, k), "cell bigint, n bigint"), k)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(bigrams: np.ndarray) -> float:
    """What of the log-likelihood of the class bigrams and emissions depends on the classes."""
    return float(xlogx(bigrams).sum() - xlogx(bigrams.sum(axis=1)).sum() - xlogx(bigrams.sum(axis=0)).sum())


def shortlist(bigrams: np.ndarray, after: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """(items x k) classes that look best by the slope of the likelihood, which is a matrix product. Not the last class, the end's."""
    cells, rows, columns = (np.log(np.maximum(x, 0.5)) for x in (bigrams, bigrams.sum(axis=1), bigrams.sum(axis=0)))
    slope = after @ cells.T + before @ cells - np.outer(after.sum(axis=1), rows) - np.outer(before.sum(axis=1), columns)
    slope = slope[:, :-1]
    return np.argpartition(-slope, min(k, slope.shape[1]) - 1, axis=1)[:, :k]


def gains(bigrams: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(items x k) by how much the likelihood changes if an item of class ``own`` moves to each of its classes ``to`` (items x k), all others staying."""
    m, r = len(own), np.arange(len(own))
    score, stay = np.zeros(to.shape), np.zeros(m)
    for counts, table in ((after, bigrams), (before, bigrams.T)):
        logs = xlogx(table)
        row, d = np.nonzero(counts)
        if not len(row):
            continue
        x = counts[row, d]
        cell = (to[row], d[:, None])
        change = xlogx(table[cell] + x[:, None]) - logs[cell]
        mine = (own[row], d)
        left = np.where(d == own[row], 0.0, logs[mine] - xlogx(np.maximum(table[mine] - x, 0)))
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        score[row[first]] += np.add.reduceat(change, first, axis=0)
        stay[row[first]] += np.add.reduceat(left, first)
    # the cell of the new class with itself
    rr, diagonal = r[:, None], bigrams.diagonal()
    corner, out_to, into_to = diagonal[to], after[rr, to], before[rr, to]
    score += xlogx(corner + out_to + into_to + itself[:, None]) + xlogx(corner) - xlogx(corner + out_to) - xlogx(corner + into_to)
    # the cells that the item itself leaves with its own class
    for cell, back, x in ((bigrams[to, own[:, None]], into_to, after[r, own][:, None]), (bigrams[own[:, None], to], out_to, before[r, own][:, None])):
        less = np.maximum(cell - back, 0)
        score += xlogx(less + x) - xlogx(less) - xlogx(cell + x) + xlogx(cell)
    rows, columns = bigrams.sum(axis=1), bigrams.sum(axis=0)
    out, into = (after.sum(axis=1) + itself), (before.sum(axis=1) + itself)
    score -= xlogx(rows[to] + out[:, None]) - xlogx(rows[to]) + xlogx(columns[to] + into[:, None]) - xlogx(columns[to])
    # to stay: what the item holds in its own class
    corner = diagonal[own]
    stay += xlogx(corner) - xlogx(np.maximum(corner - after[r, own] - before[r, own] - itself, 0))
    stay -= xlogx(rows[own]) - xlogx(rows[own] - out) + xlogx(columns[own]) - xlogx(columns[own] - into)
    score -= stay[:, None]
    score[to == own[:, None]] = 0.0
    return score


def best_moves(classes: np.ndarray, bigrams: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items whose best class is another, and by how much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = Flat.of(batch)
            after, before, itself = by_class(flat, classes, len(bigrams))
            to = shortlist(bigrams, after, before, TRIED)
            score = gains(bigrams, classes[flat.items], after, before, itself, to)
            best = score.argmax(axis=1)
            r = np.arange(len(best))
            gain = score[r, best]
            some = np.flatnonzero(gain > 1e-6)
            yield pa.RecordBatch.from_pydict({"item": flat.items[some], "best": to[r, best][some].astype(np.int32), "gain": gain[some]})

    return run


def turn_of(item: np.ndarray) -> np.ndarray:
    return (mix(item.astype(np.uint64)) % np.uint64(2)).astype(int)


@dataclass
class Model:
    items: Items
    transition: np.ndarray  # log10, classes before x classes
    emission: np.ndarray  # log10 per item
    classes: np.ndarray
    n_tokens: int
    n_distinct: int
    likelihoods: list[float] = field(default_factory=list)  # by round


def cluster(table: DataFrame, weight: np.ndarray, tolerance: float, k: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all items, their bigrams, and the likelihood after each round."""
    # begin: items by frequency, dealt in turn; the end alone in the last class
    order = np.argsort(-weight, kind="stable")
    used = order[(weight[order] > 0) & (order != BUCKETS)]
    classes = np.zeros(len(weight), np.int64)
    classes[used] = np.arange(len(used)) % (k - 1)
    classes[BUCKETS] = k - 1
    bigrams = bigrams_of(table, classes, k)
    reached, least, idle, turns = [likelihood(bigrams)], tolerance * max(weight.sum(), 1), 0, 0
    while idle < 2:  # both halves had their turn
        mine = table.where((F.col("turn") == turns % 2) & (F.col("item") != BUCKETS)).select("item", "codes", "counts")
        moves = mine.mapInArrow(best_moves(classes, bigrams), "item int, best int, gain double").toArrow()
        item, best, gain = (moves[c].to_numpy() for c in ("item", "best", "gain"))
        turn = np.lexsort((item, -gain))
        before = reached[-1]
        while len(turn):
            new = classes.copy()
            new[item[turn]] = best[turn]
            table_of_new = bigrams_after(table, bigrams, classes, new, k)
            if likelihood(table_of_new) > before:
                classes, bigrams = new, table_of_new
                reached.append(likelihood(bigrams))
                break
            turn = turn[: len(turn) // 2]
        idle = idle + 1 if reached[-1] - before <= least else 0
        turns += 1
    return classes, bigrams, reached


def fit(training: DataFrame, counts: DataFrame, tolerance: float | None = None) -> Model:
    """Classes and probabilities from the texts and their word counts."""
    items = read_items(counts)
    total = counts.agg(F.sum("n"), F.count("*")).first()
    classes, bigrams, reached = cluster(neighbours(training, items), items.counts(), TOLERANCE if tolerance is None else tolerance, CLASSES)
    transition = np.log10((bigrams + SMOOTH) / (bigrams.sum(axis=1, keepdims=True) + SMOOTH * CLASSES))
    n = items.counts().astype(float)
    in_class = np.bincount(classes, n + SMOOTH, minlength=CLASSES)
    emission = np.log10((n + SMOOTH) / in_class[classes])
    # the end is the only item of its class; P(word | item) of other words: (n + SMOOTH) / (bucket_n + SMOOTH * (bucket_words + 1))
    emission[BUCKETS] = 0.0
    room = items.bucket_n + SMOOTH * (items.bucket_words + 1.0)
    emission[:BUCKETS] -= np.log10(room)
    return Model(items, transition, emission, classes, int(total[0] or 0), int(total[1] or 0), reached)


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, head_base double, head_score double, others array<bigint>"


def score_heads(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Everything of a text's scores but the counts of its words outside the head, which are listed."""
    items, of_item = model.items, model.classes
    n = items.counts().astype(float)
    base = np.log10(n + 0.5)
    base[:BUCKETS] = 0.0
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("head_base", pa.float64()), ("head_score", pa.float64()), ("others", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split(batch["text"]):
                t = len(words.first) - 1
                key, bucket = word_keys(words)
                item = items.of(key, bucket)
                before, own, text = sequences(words, items, item)
                score = np.bincount(text, model.transition[of_item[before], of_item[own]] + model.emission[own], minlength=t)
                heads = np.bincount(text, base[own], minlength=t)
                known = np.bincount(text, own > BUCKETS, minlength=t).astype(np.int64) + (items.n_texts > 0)
                rare = np.flatnonzero(item < BUCKETS)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(words.text_of()[rare], minlength=t))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(words.at, t).cast(pa.int64()), batch["held_out"].slice(words.at, t), pa.array(words.counts + 1, pa.int64()), pa.array(known), pa.array(heads), pa.array(score), pa.ListArray.from_arrays(offsets, key[rare])], schema=schema)

    return run


def score_texts(docs: DataFrame, held_out: str = "false", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model is learned from the documents for which the SQL expression ``held_out``
    is false. Null text is empty: one token, the end. Scores are log10 probabilities.
    Repeated rows are scored alike (and counted as often as they stand in the
    table). Texts of any length are read whole. An empty training set leaves
    every word unseen; an empty table gives an empty result.
    """
    with job(docs.sparkSession):
        return result(_score_texts(docs, held_out, id_col, text_col), "scores")


def _score_texts(docs: DataFrame, held_out: str, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.expr(held_out).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = texts.where("not held_out").select("text")
    counts = materialize(training.mapInArrow(count_words, "word bigint, bucket int, n bigint").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")).select("word", "bucket", "n"), "words")
    model = fit(training, counts)
    scored = materialize(texts.mapInArrow(score_heads(model), SCORED), "scored")
    # words outside the head: in a text each once with its number, then joined with the corpus' counts
    places = scored.where(F.size("others") > 0).withColumn("row", F.monotonically_increasing_id())
    places = materialize(places.select("row", "doc_id", "held_out", "n_tokens", "n_known", "head_base", "head_score", "others"), "places")
    found = places.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    found = found.join(counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = found.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 0.5)).alias("tail"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known"))
    kept = ["doc_id", "held_out", "n_tokens", "n_known", "head_base", "head_score"]
    full = places.join(sums, "row").select(*kept, "tail", "known").union(scored.where(F.size("others") == 0).select(*kept, F.lit(0.0), F.lit(0)))
    n, v = float(model.n_tokens), float(model.n_distinct)
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("known")).cast("bigint").alias("n_known"),
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + F.col("tail") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))).alias("base_score"),
        (F.col("head_score") + F.col("tail")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("head_score") + F.col("tail")) / F.col("n_tokens")).alias("perplexity"),
    )


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 1, false)"
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
