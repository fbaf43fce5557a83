"""Token alignment against whole-text encoding and an alignment written out plainly."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("geoloom.llm")
pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from geoloom.llm import alignment as al  # noqa: E402


@pytest.fixture(scope="module")
def both():
    return al.Aligner(al.BYTE_BPE, al.PIECE_BPE)


def plain_groups(it, text):
    """Groups of a whole text from the lengths of decoded tokens only; None without tokens."""
    a, b = it.first.encode(" " + text, add_special_tokens=False).ids, it.second.encode(text)
    tokens = [(k, it.bytes_a[k]) for k in a], [(k, it.bytes_b[k]) for k in b]
    if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in tokens):
        return None
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in tokens]
    cuts, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
    for cut in cuts:
        group = []
        for k in (0, 1):
            to = at[k]
            while ends[k][to] < cut:
                to += 1
            group.append([name for name, _ in tokens[k][at[k] : to + 1]])
            at[k] = to + 1
        groups.append(tuple(group))
    return groups


def expected(it, texts):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = [plain_groups(it, t or "") for t in texts]
    links = [collections.Counter((x, y) for a, b in g or [] for x in a for y in b) for g in found]
    count = collections.Counter(p for c in links for p in c)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, c in zip(found, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
        out.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


AWKWARD = ["", " ", "  ", "a ", "a  ", " a", "hello  world", "\n", "a \n b", "é漢字🙂x", "▁x", "a▁", "<0x41> <|endoftext|> <s> </s>", "a   b", "a　 b", "don't I'll 12345 3.14", "x" * 500, "ab " * 200, "🙂" * 40, "🙂 " * 9, "a\0b \0", "ﬁ ½ ①", "é ñ", "\t\t x", "a !  ?", "𝔘𝔫𝔦 ü Ü", "العربية नमस्ते ไทย", "﻿a b", "a\r\n b", "- ​ -", "<unk> <0x0A>"]


def by_units(it, texts):
    """Per text the groups put together from units; None without tokens."""
    out = []
    for part in al.portions(pa.array(texts, pa.string()), it.whole):
        unit = it.numbers(part.units)
        for k in range(part.n):
            own = unit[part.owner == k]
            fine = not part.empty[k] and not it.counts[own, 4].any()
            out.append(b";".join(it.groups[u] for u in own).decode() if fine else None)
    return out


def written(groups):
    return None if groups is None else ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def test_units_give_the_groups_of_whole_texts(both):
    assert not both.whole
    assert by_units(both, [*AWKWARD, None]) == [written(plain_groups(both, t)) for t in [*AWKWARD, ""]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZ09.,'!-\n\t", *[" "] * 8, "the", " ing", "é", "漢", "🙂", "\u00a0", "▁", "<", "ß", "\u0301", "\u3000"]), max_size=40).map("".join), min_size=1, max_size=4))
def test_units_of_any_texts(texts):
    it = al.aligner(al.BYTE_BPE, al.PIECE_BPE)
    assert by_units(it, texts) == [written(plain_groups(it, t)) for t in texts]


def test_a_group_of_many_links(both):
    """Neither a long run of characters that end together nowhere, nor many links, are cut short."""
    it = al.Aligner(al.BYTE_BPE, al.PIECE_BPE)
    a, b = np.arange(300) % 7, np.arange(500) % 11
    ends = [np.append(np.arange(1, n) * 10 + shift, 9000) for n, shift in ((300, 0), (500, 3))]
    it.tokens = lambda text: ((a, ends[0]), (b, ends[1]))
    groups, counts, n, codes, times = it.learned([b"x" * 9000])[0]
    assert counts.tolist() == [[300, 500, 1, 150_000, 0]] and n.tolist() == [77]
    want = collections.Counter((x, y) for x in a.tolist() for y in b.tolist())
    assert dict(zip(codes.tolist(), times.tolist())) == {x * it.size_b + y: k for (x, y), k in want.items()}


def test_query_against_brute_force(spark, sf, both):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in al.op11_token_alignment(spark, sf).collect()}
    want = expected(both, [texts[k] for k in ids])
    assert got == dict(zip(ids, want))


@pytest.mark.parametrize("frequent", [1_000_000, 40, 0])
def test_odd_rows_and_counts_beyond_the_broadcast(spark, both, frequent):
    """Nulls, repeats of identifiers, hot texts, clashing columns; few or no pairs broadcast."""
    rng = random.Random(3)
    texts = [*AWKWARD, None, *[" ".join(rng.choice(["the", "cat", "Épée", "sat", "on"]) for _ in range(rng.randrange(30))) for _ in range(40)], *["the cat sat on the mat"] * 60]
    rows = [(k if k % 9 else 7, t, "x", 1) for k, t in enumerate(texts)] + [(None, "no name", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string, row bigint").withColumns({c: F.lit(1) for c in ("n_a", "pair", "n", "a", "times")}).repartition(3)
    got = al.align(df, frequent=frequent).collect()
    want = expected(both, [t for _, t, *_ in rows])
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, *w)) for (k, *_), w in zip(rows, want))


def test_groups_hold_the_text(spark, both):
    rows = [(k, t) for k, t in enumerate(AWKWARD)]
    got = collections.defaultdict(list)
    for r in al.token_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r["doc_id"]].append(r)
    for k, t in rows:
        text, at = (" " + t).encode(), 0
        for position, r in enumerate(sorted(got[k], key=lambda r: r["position"])):
            assert (r["position"], r["start"]) == (position, at)
            at = r["end"]
            for ids, names in ((r["a"], both.bytes_a), (r["b"], both.bytes_b)):
                assert b"".join(names[x] for x in ids) == text[r["start"] : at]
        assert at == (len(text) if plain_groups(both, t) else 0)


def test_empty_table(spark):
    assert al.align(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_units_are_forgotten_and_learned_again(both, monkeypatch):
    monkeypatch.setattr(al, "KEPT", 6)
    both.clear()
    first = by_units(both, ["one two three two", "four five one", "a b c d"])
    by_units(both, ["six"])
    assert set(both.number) == {b" one", b" two", b" six"}  # those looked up twice stay
    assert by_units(both, ["one two three two", "four five one", "a b c d"]) == first
    assert by_units(both, ["a a b b c c d d six six one"] * 3)[0] == written(plain_groups(both, "a a b b c c d d six six one"))


@pytest.mark.parametrize("block", [1, 30, 20_000])
def test_units_encoded_in_pieces_of_any_length(block, monkeypatch):
    monkeypatch.setattr(al, "BLOCK", block)
    it = al.Aligner(al.BYTE_BPE, al.PIECE_BPE)
    assert by_units(it, AWKWARD) == [written(plain_groups(it, t)) for t in AWKWARD]
