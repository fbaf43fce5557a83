"""Near-dedup by SuperMinHash, banding, verification and union-find.

Signatures: each shingle walks through a random permutation of the SLOTS slots;
at step j it offers the value j + r (r random) to its j-th slot. A slot keeps the
smallest value. Since later steps offer larger values, a document stops as soon
as every slot holds a value below the next step; long documents stop after one
step or two. Ranks of one element are a permutation, so its offers are
correlated and the estimate varies less than with independent hashes.

Documents with equal shingle sets are one class from the start. Classes that
agree in a band share a bucket. Linking goes in two rounds, so that a bucket of
m alike documents costs m comparisons. First each member is compared with its
bucket's head, the member that shares buckets with most others, which in a
family of copies is the original. What a head h leaves open are links of a
member x that isn't linked with h. Let D(x) be the shingles that x and h don't
share. If x and y are linked, they differ in at most r * (|x| + |y|) shingles,
r = (1 - s) / (1 + s) for similarity s; they differ in |D(x)| + |D(y)| - 2 *
|D(x) & D(y)|; and |D(x)| > r * (|x| + |h|). So fewer than (|D(y)| + r * (|y| -
|h|)) / 2 of D(y) are outside D(x): of that many elements of D(y) x holds one at
least. The
proof holds for any h, so a family with many open members is compared with its
shortest member near the head: then what y has and h lacks is at least half of
D(y), and in a family of pages around one template it is y's own. Elements are put
into one order, those with the fewest holders in different components first; most
have none. An equi-join on the first elements of D(y) with D(x), or its first ones
if y is open too, finds every open link. Within an element, members of its
commonest component meet the others only, so that two families that are unlike
each other cost no pairs within them; pairs whose distances from h differ too much,
or that have too few elements left to share, are left out.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.graph import components, rows_with, spread_join
from geoloom.llm.words import distinct_pairs, mix, shingles, split
from geoloom.storage import arrow_rows, job, materialize, result

#: BANDS bands of ROWS slots miss a pair of similarity 0.85 with a chance of 1.2e-5.
BANDS, ROWS = 24, 6
SLOTS = BANDS * ROWS
#: Linked: PERCENT[0] * shared >= PERCENT[1] * all shingles of the two.
PERCENT = (100, 85)
#: For links from a similarity of 0.8 on, which the pipeline asks for: 28 bands of 5 miss such a pair with a chance of 1.5e-5.
WIDE, WIDE_BANDS = (100, 80), (28, 5)
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def super_minhash(of: np.ndarray, key: np.ndarray, n: int, slots: int = SLOTS, at_once: int = 50_000) -> np.ndarray:
    """(n, slots) values, rank in the high half, random part in the low half. (of, key): distinct elements, ordered by ``of`` in 0..n-1. Sets are worked on in groups of about ``at_once`` elements."""
    if len(of) > at_once and of[0] != of[-1]:
        cut = min(max(int(of[at_once]), int(of[0]) + 1), int(of[-1]))
        k = int(np.searchsorted(of, cut))
        return np.concatenate([super_minhash(of[:k], key[:k], cut, slots, at_once), super_minhash(of[k:] - cut, key[k:], n - cut, slots, at_once)])
    best = np.full((n, slots), ~np.uint64(0), np.uint64)
    flat = best.reshape(-1)
    of, walk = of.astype(np.int64), None
    for j in range(slots):
        if not len(of):
            break
        z = mix(key + np.uint64(_STEP * (j + 1) % 2**64))
        pick = j + (((z >> _32) * np.uint64(slots - j)) >> _32).astype(np.int64)
        if walk is None:
            slot = pick
        else:
            rows = np.arange(len(of))
            slot = walk[rows, pick].astype(np.int64)
            walk[rows, pick] = walk[:, j]
        np.minimum.at(flat, of * slots + slot, (np.uint64(j) << _32) | (z & _LOW))
        docs = np.unique(of)
        going = np.zeros(n, bool)
        going[docs] = best[docs].max(axis=1) >= np.uint64(j + 1) << _32
        stay = going[of]
        if walk is None:
            pick = pick[stay]
            walk = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(pick), 1))
            walk[np.arange(len(pick)), pick] = 0
        elif not stay.all():
            walk = walk[stay]
        if not stay.all():
            of, key = of[stay], key[stay]
    return best


def sign(n_bands: int, n_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, n_shingles, a 128-bit fingerprint of the shingle set, and a hash per band."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split(batch["text"]):
                n = len(words.first) - 1
                of, key = distinct_pairs(*shingles(words))
                sizes = np.bincount(of, minlength=n).astype(np.int64)
                prints = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(salt)))])
                    ends = np.cumsum(sizes)
                    prints.append((total[ends] - total[ends - sizes]).view(np.int64))
                values = super_minhash(of, key, n, n_bands * n_rows)
                bands = np.zeros((n, n_bands), np.uint64)
                for k in range(n_rows):
                    bands = mix(bands * np.uint64(31) + values[:, k::n_rows] + np.uint64(k))
                bands = bands.view(np.int64).reshape(-1)
                full = sizes > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, n_bands, 0))]).astype(np.int32)
                kept = bands.reshape(n, n_bands)[full].reshape(-1)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(words.at, n).cast(pa.int64()), pa.array(sizes), *map(pa.array, prints), pa.ListArray.from_arrays(offsets, kept)], schema=schema)

    return run


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and its sorted distinct shingles, 8 bytes each."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for words in split(batch["text"]):
            n = len(words.first) - 1
            of, key = distinct_pairs(*shingles(words))
            ends = np.searchsorted(of, np.arange(n), "right")
            blobs = [key[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(words.at, n).cast(pa.int64()), pa.array(blobs, pa.binary())], schema=schema)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, the exact sizes of the two sets' intersection and union, and of the sets."""
    long = pa.int64()
    schema = pa.schema([(c, long) for c in ("a", "b", "shared", "total", "size_a", "size_b")])
    for batch in batches:
        shared, sizes = [], []
        for x, y in zip(batch["set_a"], batch["set_b"]):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared.append(int((both[1:] == both[:-1]).sum()))
            sizes.append((len(x), len(y)))
        both, sizes = np.array(shared, np.int64), np.array(sizes, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *map(pa.array, (both, sizes.sum(axis=1) - both, sizes[:, 0], sizes[:, 1]))], schema=schema)


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``compare``, with the elements that only one of the sets holds."""
    long = pa.int64()
    schema = pa.schema([*((c, long) for c in ("a", "b", "shared", "total", "size_a", "size_b")), ("elements", pa.list_(long))])
    for batch in batches:
        for k in range(batch.num_rows):
            x, y = (np.frombuffer(batch[name][k].as_buffer(), np.int64) for name in ("set_a", "set_b"))
            only = np.setxor1d(x, y, assume_unique=True)
            shared = (len(x) + len(y) - len(only)) // 2
            yield pa.RecordBatch.from_arrays([batch["a"].slice(k, 1), batch["b"].slice(k, 1), *(pa.array([v], long) for v in (shared, shared + len(only), len(x), len(y))), pa.array([only], pa.list_(long))], schema=schema)


COMPARED = "a bigint, b bigint, shared bigint, total bigint, size_a bigint, size_b bigint"
DIFFERENCE = COMPARED + ", elements array<bigint>"
#: Pairs of one head, and rows of one shingle set, that a task meets.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 64, 256
#: Up to this many open members a family keeps its head for the second round.
FEW = 16


def compared(pairs: DataFrame, held: DataFrame, how: Callable = compare, schema: str = COMPARED) -> DataFrame:
    """The pairs (a, b) with their exact similarity. Many may name the same b."""
    full = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    full = spread_join(full, held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), ["b"], "a", PAIRS_AT_ONCE, counts=pairs.groupBy("b").agg(F.count("*").alias("n")))
    return full.select("a", "b", "set_a", "set_b").mapInArrow(how, schema)


def second_heads(stars: DataFrame, linked: Column) -> DataFrame:
    """Families (by head b) with open members as pairs (a, b) of each member and the family's head for the second round: the shortest of the half that is nearest to the first head."""
    distance = F.col("total") - F.col("shared")
    size = F.struct(F.col("size_a").alias("size"), F.col("a").alias("id"))
    family = stars.groupBy("b").agg(F.sum((~linked).cast("bigint")).alias("open"), F.percentile_approx(distance, 0.5).alias("half"), F.count("*").alias("n")).where("open > 0")
    near = spread_join(stars, family.select("b", "open", "half"), ["b"], "a", ROWS_AT_ONCE, counts=family.select("b", "n"))
    shortest = near.where(distance <= F.col("half")).groupBy("b").agg(F.least(F.min(size), F.min(F.struct(F.col("size_b").alias("size"), F.col("b").alias("id")))).alias("shortest"))
    family = materialize(family.join(shortest, "b").select("b", "n", F.when(F.col("open") <= FEW, F.col("b")).otherwise(F.col("shortest.id")).alias("head")), "families")
    members = spread_join(stars.select("a", "b"), family.select("b", "head"), ["b"], "a", ROWS_AT_ONCE, counts=family.select("b", "n"))
    members = members.select("a", F.col("head").alias("b")).union(family.select(F.col("b").alias("a"), F.col("head").alias("b")))
    return members.where("a <> b").distinct()


def meetings(elements: DataFrame, percent: tuple[int, int]) -> DataFrame:
    """Pairs (x, y) that may be linked, from the rows (a, b, component, open, distance, size, head_size, element) of families. x is open; pairs come once an element they meet in.

    Elements have one order in a family: by how many open members outside their
    commonest component hold them, so that most of a member's first ones are held by
    its own component only, and drop out.
    """
    share, least = percent
    reach = (share - least) / (share + least)
    held = elements.groupBy("b", "element", "component").agg(F.sum(F.col("open").cast("bigint")).alias("own"))
    by_element = held.groupBy("b", "element").agg(F.sum("own").alias("opens"), F.max("own").alias("most_own"), F.count("*").alias("components"), F.max_by("component", F.struct("own", "component")).alias("main"))
    several = materialize(by_element.where("components > 1 and opens > 0").select("b", "element", "main", (F.col("opens") - F.col("most_own")).alias("others")), "holders")
    e = elements.join(several, ["b", "element"], "left")
    rank = F.row_number().over(W.partitionBy("b", "a").orderBy(F.coalesce("others", F.lit(-1)), "element"))
    most = F.ceil((F.col("distance") + (F.col("size") - F.col("head_size")) * reach) / 2 - 1e-9)
    e = e.withColumns({"rank": rank, "left": F.col("distance") - F.col("rank"), "in_main": F.col("component") == F.col("main")}).where(F.col("main").isNotNull())
    e = e.withColumn("first", F.col("rank") <= most)
    kept = ["component", "distance", "size", "left"]
    y = e.where("first").select("b", "element", F.explode(F.when(F.col("in_main"), F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), F.lit("main")))).alias("side"), F.col("open").alias("both"), F.col("a").alias("y"), *[F.col(c).alias(f"y_{c}") for c in kept])
    both = F.when(F.col("first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    x = e.where("open").select("b", "element", F.when(F.col("in_main"), "main").otherwise("other").alias("side"), F.explode(both).alias("both"), F.col("a").alias("x"), *kept)
    span = (F.col("size") + F.col("y_size")) * reach
    near = F.abs(F.col("distance") - F.col("y_distance")) <= span + 1e-9
    # an element is the first that the two share only if enough can follow it
    enough = 2 * (F.least("left", "y_left") + 1) >= F.col("distance") + F.col("y_distance") - span - 1e-9
    met = x.join(y, ["b", "element", "side", "both"]).where((F.col("component") != F.col("y_component")) & (~F.col("both") | (F.col("x") < F.col("y"))) & near & enough)
    return met.select("x", "y")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: tuple[int, int] = PERCENT, bands: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents whose sets of 5-word shingles have a similarity of at
    least percent[1] / percent[0]; components are the links' transitive closure and
    ``component_id`` is their smallest doc_id. Null, empty and white-space texts have
    no shingles and are linked with nothing; a text of 1 to 4 words is one shingle.
    Rows without an identifier are linked with nothing. Repeated rows are equal sets
    and share a component. Texts of any length are compared whole. An empty table
    gives an empty result; further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, 1000), job(docs.sparkSession):
        return result(_near_dedup(texts, percent, bands), "near-dedup")


def _near_dedup(texts: DataFrame, percent: tuple[int, int], bands: tuple[int, int]) -> DataFrame:
    signed = materialize(texts.mapInArrow(sign(*bands), "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>"), "signatures")
    prints = ["n_shingles", "print_a", "print_b"]
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(some.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n")), "classes")

    rows = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    # both sides of the joins below are tables, so that Spark can split a hot bucket
    shared = materialize(rows.groupBy("band", "value").agg(F.count("*").alias("members")).where("members > 1"), "crowded")
    shared = materialize(rows.join(shared, ["band", "value"]), "shared")
    central = shared.groupBy("rep").agg(F.sum("members").alias("degree"))
    ranked = shared.join(central, "rep").withColumn("order", F.struct(-F.col("degree"), F.xxhash64("rep"), "rep"))
    heads = materialize(ranked.groupBy("band", "value").agg(F.min("order").alias("head")).select("band", "value", F.col("head.rep").alias("head")), "heads")
    buckets = materialize(shared.drop("members").join(heads, ["band", "value"]), "buckets")
    held = materialize(rows_with(texts, buckets.select(F.col("rep").alias("doc_id")).distinct()).mapInArrow(sets, "doc_id bigint, shingles binary"), "sets")

    share, least = percent
    linked = F.col("shared") * share >= F.col("total") * least
    pairs = materialize(buckets.where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    stars = materialize(compared(pairs, held), "stars")
    first = materialize(components(stars.where(linked)), "first")

    # members that no head took in: what else could they be linked with?
    again = materialize(second_heads(stars, linked), "again")
    family = compared(again, held, differences, DIFFERENCE)
    family = family.join(first.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    family = materialize(family.withColumns({"open": ~linked, "distance": F.col("total") - F.col("shared")}), "differences")
    elements = family.select("a", "b", "component", "open", "distance", F.col("size_a").alias("size"), F.col("size_b").alias("head_size"), F.explode("elements").alias("element"))
    met = meetings(elements, percent).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    late = materialize(compared(materialize(met, "rest"), held).where(linked).select("a", "b"), "late")
    links = stars.where(linked).select("a", "b").union(family.where("not open").select("a", "b")).union(late)
    final = components(links)

    named = classes.select(*prints, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*prints, F.coalesce("component", "rep").alias("component"))
    out = spread_join(signed.select("doc_id", *prints), named, prints, "doc_id", ROWS_AT_ONCE, "left", classes.select(*prints, "n"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
