"""Importance resampling against a plain computation; the SQL twin runs with the others'."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("geoloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from geoloom.llm import resample as rs  # noqa: E402
from geoloom.llm.words import ALNUM, split  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in docs for f in runs(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in runs(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    out = []
    for k, text in docs:
        n, f = runs(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_crc_of_joined_texts():
    rng = random.Random(1)
    for _ in range(100):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(0, 900))) for _ in range(2))
        assert rs.follow(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [rs.BLOCK, 7, 1])
def test_buckets_of_runs(monkeypatch, block):
    import pyarrow as pa

    monkeypatch.setattr(rs, "BLOCK", block)
    texts = ["", None, "one", "One two", "a a a a", "épée 漢字 𝔘 x", "x" * 700 + " y " + "z" * 256 + " " + "q" * 257, "tail-less, 3.14 a_b", " b a b aa aab "]
    got = collections.defaultdict(list)
    for words in split(pa.array(texts), ALNUM):
        of, bucket = rs.features(words)
        for t, b in zip((of + words.at).tolist(), bucket.tolist()):
            got[t].append(b)
    for k, t in enumerate(texts):
        assert sorted(got[k]) == sorted(zlib.crc32(f.encode()) % 10000 for f in runs(t)[1])


def test_draw_against_plain(spark):
    """Nulls, empty and long texts, repeated rows, identifiers missing, clashing columns, more documents drawn than ranges."""
    rng = random.Random(2)
    names = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(names[: 5 + k % 50]) for _ in range(rng.choice([3, 19, 20, 40, 80])))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, "!!"), (503, "long " * 40_000), docs[0], docs[1], (None, docs[5][1]), (None, None)]
    target = [" ".join(rng.choice(names[:10]) for _ in range(30)) for _ in range(12)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("score", "rank", "bucket", "n", "number", "weight")}).repartition(5)
    got = rs.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, target)


def test_equal_scores_go_to_the_smaller_identifier(spark, monkeypatch):
    monkeypatch.setattr(rs, "gumbel", lambda seed, key: F.lit(0).cast("bigint"))
    df = spark.createDataFrame([(k, "same words " * 15) for k in range(200, 0, -1)], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["rank"] for r in rs.resample(df, df, percent=10).collect()}
    assert got == {k: k if k <= 20 else None for k in range(1, 201)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert rs.resample(none, some).count() == 0
    assert sorted((tuple(r) for r in rs.resample(some, none).collect()), key=repr) == plain([(1, "a b")], [])
