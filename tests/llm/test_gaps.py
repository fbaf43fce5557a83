"""Cases that the operators' own tests leave open."""

import collections
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

pytest.importorskip("geoloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from geoloom.llm import brown, mixing, near_dedup, toxicity  # noqa: E402
from geoloom.llm.words import split  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("head", [2**17, 30])
def test_scores_of_the_class_model_from_plain_counts(spark, monkeypatch, head):
    """Given the classes, each score is the sum of three factors that are counted here word by word. Columns have the operator's own names."""
    monkeypatch.setattr(brown, "HEAD", head)
    held, fit = {}, brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a, **b: held.setdefault("model", fit(*a, **b)))
    rng = random.Random(1)
    names = [f"{rng.choice('abcdef')}{k}{rng.choice(['ing', 'ed', 'Ly', 'é'])}" for k in range(90)]
    texts = {k: " ".join(names[min(int(rng.expovariate(0.06)), 89)] for _ in range(rng.randrange(0, 40))) for k in range(120)}
    texts |= {200: None, 201: "never seen wording", 202: ""}
    train = {k for k in texts if zlib.crc32(str(k).encode()) % 3}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("slot", "item", "counts", "word", "n", "row")})
    got = {r["doc_id"]: r for r in brown.score_texts(df, "crc32(cast(cast(doc_id as string) as binary)) % 3 = 0").collect()}
    m = held["model"]
    end = brown.BUCKETS

    def item(word):
        (part,) = split(pa.array([word], pa.string()))
        return int(m.items.of(*brown.word_keys(part))[0])

    count = collections.Counter(w for k in train for w in words(texts[k]))
    items = {w: item(w) for t in texts.values() for w in words(t)}
    of_item, distinct = collections.Counter({end: len(train)}), collections.Counter()
    for w, n in count.items():
        of_item[items[w]] += n
        distinct[items[w]] += 1
    pairs = collections.Counter()
    for k in train:
        line = [end, *(items[w] for w in words(texts[k])), end]
        pairs.update((int(m.classes[a]), int(m.classes[b])) for a, b in zip(line, line[1:]))
    leaving = collections.Counter()
    for (a, _), n in pairs.items():
        leaving[a] += n
    in_class = collections.defaultdict(float)
    for k in range(m.items.size):
        in_class[int(m.classes[k])] += of_item[k] + brown.SMOOTH
    for k, r in got.items():
        before, score = end, 0.0
        for w in [*words(texts[k]), None]:
            i = end if w is None else items[w]
            a, b = int(m.classes[before]), int(m.classes[i])
            score += math.log10((pairs[a, b] + brown.SMOOTH) / (leaving[a] + brown.SMOOTH * brown.CLASSES))
            if w is not None:
                score += math.log10((of_item[i] + brown.SMOOTH) / in_class[b])
                if i < end:
                    score += math.log10((count[w] + brown.SMOOTH) / (of_item[i] + brown.SMOOTH * (distinct[i] + 1)))
            before = i
        assert r["score"] == pytest.approx(score, abs=1e-9), k


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    lexicon, cut = toxicity.learn(toxicity.labelled_texts(docs, labels))
    assert lexicon == {} and [r["score"] for r in toxicity.score_toxicity(docs, lexicon, cut).collect()] == [0.0, 0.0]
    only_clean = spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.learn(toxicity.labelled_texts(docs, only_clean))[0] == {}


def test_mixing_with_ties_in_everything(spark, monkeypatch):
    """Equal random numbers and sizes: the identifiers decide, and reruns agree."""
    monkeypatch.setattr(mixing, "uniform", lambda key: F.lit(0.5))
    df = spark.createDataFrame([(k, "one two three", "a" if k % 2 else "b") for k in range(60)] + [(7, "one two three", "a")], "doc_id bigint, text string, source string").repartition(5)
    rows = mixing.mix_sources(df).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(df.repartition(3)).collect())
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == again and len(again) == 61
    for source in "ab":
        own = [r for r in rows if r["source"] == source]
        assert abs(own[0]["target"] - sum(r["taken"] for r in own)) <= 0.3 * len(own) + 9


def test_spun_text_is_linked_whole(spark):
    """Texts of 300 words with 12 slots of two variants each: one family, though few of its members are alike."""
    rng = random.Random(2)
    frame = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(200):
        text = list(frame)
        for slot in range(12):
            text[slot * 25 + 5] = f"v{slot}_{rng.randrange(2)}"
        rows.append((k, " ".join(text)))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {k: find(k) for k, _ in rows}


def test_a_benchmark_in_slices_gives_the_same_hits(spark, monkeypatch):
    from geoloom.llm import decontaminate

    rng = random.Random(3)
    names = [f"term{k}" for k in range(3000)]
    items = [(k, " ".join(rng.sample(names, rng.randrange(8, 60)))) for k in range(60)] + [(60, None), (61, ""), (None, "no number")]
    docs = []
    for k in range(150):
        text = rng.choices(names, k=rng.randrange(20, 200))
        if k % 3 == 0:
            text[10:10] = items[k % 60][1].split()
        docs.append((k, " ".join(text)))
    frames = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    hits = lambda: sorted((r["doc_id"], r["item_id"], r["lcs"], r["answer"]) for r in decontaminate.contaminated(*frames).collect())
    whole = hits()
    assert {(d, q) for d, q, *_ in whole} >= {(k, k % 60) for k in range(0, 150, 3)}
    monkeypatch.setattr(decontaminate, "SLICE", 6000)
    assert hits() == whole
