"""Operators against brute force, their SQL twins, and awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("geoloom.llm")

from geoloom.llm import brown, catalog, decontaminate, exact_dedup, graph, language, licenses, mixing, near_dedup, pii, toxicity, url_filter  # noqa: E402
from geoloom.llm.words import split  # noqa: E402
from geoloom.operators import links  # noqa: E402
from geoloom.storage import materialize  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def odd_rows():
    """Nulls in every column, empty and long texts, copies, ties and repeated rows."""
    rng = random.Random(5)
    base = " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "épée", "omega", "zeta", "eta"]) + str(rng.randrange(40)) for _ in range(300))
    w = base.split()
    near = " ".join(w[:100] + ["changed"] + w[101:])
    other = " ".join(reversed(w))
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    texts = [base, base, near, other, None, "", " \t\n", "one two", "ONE  two", "x", "üÜ 漢字 𝔘 ñ", base + " ", long, base.replace(" ", "\n\t"), "9" * 3000, "a@" * 500]
    rows = [(k, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 3}", 1) for k, t in enumerate(texts)]
    return rows + [rows[0], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    # further columns with names that operators use themselves
    return spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit(1) for c in ("size", "bucket", "u", "n", "score", "band", "value", "digest", "slot", "url", "a", "b")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, compare, name):
    ours, theirs = compare(catalog.queries()[name](spark, sf), duck.sql(catalog.oracle_sql()[name]))
    assert ours == theirs


def test_tokens_against_a_regular_expression():
    import pyarrow as pa

    texts = [t for _, t, *_ in odd_rows()]
    for array in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
        got = {}
        for part in split(array):
            for t in range(len(part.first) - 1):
                got[part.at + t] = [part.word(k).decode() for k in range(part.first[t], part.first[t + 1])]
        assert [got[k] for k in range(len(texts))] == [words(t) for t in texts]


# 10


def test_exact_dedup_odd_rows(odd, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    want = collections.defaultdict(list)
    for k, t, *_ in odd_rows():
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(odd_rows())
    for r in got:
        ids = digest[r["text_sha256"]]
        keep = min((k for k in ids if k is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_one_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, "same  text").otherwise(F.col("id").cast("string")).alias("text")).repartition(7)
    got = exact_dedup.exact_dedup(df).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.max("group_size")).first()
    assert tuple(got) == (1000, 1, 1, 1000)


def test_exact_dedup_of_more_partitions_than_one_round_merges(spark):
    """Eight rounds of fan-in 2; a row per document, whatever the number of partitions."""
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise((F.col("id") % 50).cast("string")).alias("text")).repartition(150)
    got = exact_dedup.exact_dedup(df, bits=1)
    assert got.count() == 900 and got.agg(F.sum(F.col("kept").cast("int"))).first()[0] == 51
    assert got.where("doc_id % 3 = 0").agg(F.min("keep_id"), F.max("keep_id"), F.max("group_size")).first()[:] == (0, 0, 300)


def test_exact_dedup_of_a_digest_file_that_is_read_in_pieces(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")).repartition(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    rows = spark.sparkContext._jsc.hadoopConfiguration()
    rows.set("parquet.block.size", "65536")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = exact_dedup.exact_dedup(df)
        assert got.count() == 20000 and got.where("kept").count() == 10001
    finally:
        rows.unset("parquet.block.size")
        for k, v in before.items():
            spark.conf.set(k, v)


# 3


def linked_components(texts):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_dedup_odd_rows(odd, empty):
    texts = {k: t for k, t, *_ in odd_rows() if k is not None}
    want = linked_components(texts)
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_families_around_the_threshold(spark):
    """Variants of one text with 0 to 6 edits, some of them shared, where links pass by the head."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(160)]
    texts = {0: " ".join(base)}
    for d in range(1, 90):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(160)
            w[k] = f"e{k}" if rng.random() < 0.5 else f"own{d}x{k}"
        texts[d * 3] = " ".join(w[: 160 - rng.randrange(0, 6)])
    want = linked_components(texts)
    got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def families(n, shared=180, own=24):
    """Two families of n near copies whose founders are alike below the threshold, every third member cut short."""
    rng = random.Random(n)
    common, texts = [f"c{k}" for k in range(shared)], {}
    for f in "ab":
        founder = common[:90] + [f"{f}{k}" for k in range(own)] + common[90:]
        for k in range(n):
            w = list(founder)
            w[rng.randrange(len(w))] = f"{f}own{k}"
            texts[2 * k + (f == "b")] = " ".join(w[: len(w) - k % 3])
    return texts


def template(n):
    """Pages around one template, all of them alike below the threshold, of many lengths."""
    return {k: " ".join([*(f"t{j}" for j in range(100)), *(f"p{k}x{j}" for j in range(24 + k % 9))]) for k in range(n)}


def test_near_dedup_compares_members_and_not_pairs_of_families(spark, monkeypatch):
    met = []

    def counted(elements, percent):
        rows = near_dedup_meetings(elements, percent)
        met.append(rows.count())
        return rows

    near_dedup_meetings = near_dedup.meetings
    monkeypatch.setattr(near_dedup, "meetings", counted)
    for make, per_member in ((families, 2), (template, 2)):
        for n in (100, 400):
            texts = make(n)
            got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)).collect()
            assert len({r["component_id"] for r in got}) == (2 if make is families else n)
            assert met[-1] <= per_member * len(texts), (make.__name__, n, met)
        small = make(30)
        got = near_dedup.near_dedup(spark.createDataFrame(list(small.items()), "doc_id bigint, text string"))
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == linked_components(small)


def test_a_crowded_key_is_joined_in_pieces(spark, monkeypatch):
    left = spark.range(1000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("b"))
    right = spark.range(500).select(F.col("id").alias("b"), (F.col("id") * 2).alias("x"))
    want = sorted(left.join(right, ["b"], "left").select("a", "b", "x").collect(), key=repr)
    for bound in (links.BROADCAST_KEYS, 0):
        monkeypatch.setattr(links, "BROADCAST_KEYS", bound)
        assert sorted(graph.spread_join(left, right, ["b"], "a", 20, "left").select("a", "b", "x").collect(), key=repr) == want


def test_super_minhash_estimates_similarity():
    of = np.repeat([0, 1], 1000)
    x = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    y = np.concatenate([x[200:], np.arange(200, dtype=np.uint64) + np.uint64(10**9)])
    v = near_dedup.super_minhash(of, np.concatenate([x, np.sort(y)]), 2)
    assert abs((v[0] == v[1]).mean() - 800 / 1200) < 0.12
    one = near_dedup.super_minhash(np.zeros(1, int), np.array([5], np.uint64), 1)
    assert sorted(one[0] >> np.uint64(32)) == list(range(near_dedup.SLOTS))  # a permutation of ranks


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (9, 8)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in [5, *range(200, 260)]} | {8: 8, 9: 8}


# 8


def test_mixing_hits_targets(spark, sf):
    rows = mixing.op8_source_mix(spark, sf).collect()
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        s = docs[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s]
    again = {(r["doc_id"], r["taken"]) for r in mixing.op8_source_mix(spark, sf).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixing_includes_by_its_probabilities(spark, monkeypatch):
    """600 sources with documents of the same sizes are 600 draws: inclusion rates follow p, and every sample has the same size."""
    monkeypatch.setattr(mixing, "TURNS", 0)
    sizes = [1, 2, 3, 4, 6, 9, 9, 12, 20, 33, 50, 120]
    rows = [(s * 100 + k, " ".join(["w"] * n), f"s{s:04d}") for s in range(600) for k, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4), weights=(1,), share=1.75).collect()
    rate, p, per_source = collections.Counter(), {}, collections.Counter()
    for r in got:
        k = r["doc_id"] % 100
        rate[k] += r["in_sample"] / 600
        assert p.setdefault(k, r["p"]) == pytest.approx(r["p"])
        per_source[r["doc_id"] // 100] += r["in_sample"]
        assert r["copies"] == 1 + r["in_sample"]
    assert sum(p[k] * n for k, n in enumerate(sizes)) == pytest.approx(0.75 * sum(sizes))
    assert p[11] == 1 and len({round(x, 6) for x in p.values()}) == 11  # the longest is certain, equal sizes have equal chances
    assert set(per_source.values()) == {round(sum(p.values()))}
    for k in p:  # Pareto sampling of few documents keeps its probabilities closely, not exactly
        assert abs(rate[k] - p[k]) < 0.08, (k, rate[k], p[k])


def test_mixing_of_many_sources_without_a_broadcast(spark, sf, monkeypatch):
    want = {(r["doc_id"], r["taken"], round(r["target"], 6)) for r in mixing.op8_source_mix(spark, sf).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["taken"], round(r["target"], 6)) for r in mixing.op8_source_mix(spark, sf).collect()} == want


def test_mixing_odd_rows(odd, empty, spark):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(odd_rows()) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0
    nothing = mixing.mix_sources(spark.createDataFrame([(1, None, "a", "s", 0)], "doc_id bigint, text string, lang string, source string, n bigint")).first()
    assert (nothing["size"], nothing["target"], nothing["taken"]) == (0, 0.0, 0)


# 7


def test_url_filter_edges(spark):
    urls = ["http://example.com/en/x", "https://WWW.Example.COM/en/?q", "ftp://a.net/es/", "http://net/fr/1", "http://x.net/esx", "http://example.com", "no scheme", None, "", "http://m.casino-win.example.org/en/", "http://ok.org/wp-login.php", "http://h.org/banner-ads/1", "http://a.com/b#c/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("example.com", "", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][3] == got[10][3] == got[11][3] == "block"
    assert got[12] == ("a.com", "/b", "com/", "allow")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_index_loses_no_rule(spark, sf, monkeypatch):
    """Every rule on every url, with the index in the plan and with rules as a table."""
    rules = [url_filter.PatternRule("block", rf"\bth{a}{b}") for a in "te" for b in "hr"] + [url_filter.PatternRule("allow" if k % 2 else "block", rf"/{k}\b") for k in range(0, 1000, 7)] + [url_filter.PatternRule("block", r"/(?:en|fr)/[0-9]+\.html$")]
    hosts = [*url_filter.BASE_RULES, url_filter.HostRule("block", "example.org", "/de/1"), url_filter.HostRule("allow", "m.therer.example.org", "/")]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.limit(5))  # repeated rows
    want = {}
    for r in url_filter.filter_urls(pages, [], []).collect():
        fits = [h for h in hosts if (r["host"] == h.host or r["host"].endswith("." + h.host)) and r["path"].startswith(h.path)]
        rule = max(fits, key=lambda h: len(h.host + h.path), default=None)
        hit = next((p for p in rules if re.search(p.pattern, r["host"] + r["path"])), None)
        want[r["page_id"]] = (rule and rule.host + rule.path, rule.verdict if rule else hit.verdict if hit else "allow", hit and hit.pattern)
    for inline in (url_filter.INLINE, 0):
        monkeypatch.setattr(url_filter, "INLINE", inline)
        rows = url_filter.filter_urls(pages, hosts, rules).collect()
        assert len(rows) == pages.count() and {r["page_id"]: (r["rule"], r["verdict"], r["pattern"]) for r in rows} == want


def test_url_patterns_tell_their_tokens():
    assert url_filter.required_tokens(r"^[^/]*\bcasino[.-]") == [["casino"]]
    assert url_filter.required_tokens(r"^([^/]*\.)?ads-track\.") == [["ads", "track"], ["ads", "track"]]
    assert url_filter.required_tokens(r"/(?:adserver|banner-ads)/") == [["adserver"], ["ads", "banner"]]
    for loose in (r"casino", r"/casino", r"\bth", r"^[^/]*", r"/[0-9]+/", r"(?:/a/|b)", r"/(?:x|.*)/", r"/ab?/"):
        assert not url_filter.required_tokens(loose) or loose == r"/ab?/"
    tokens = lambda text: {t for t in re.split(r"[^a-z0-9]+", text.lower()) if t}
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab/.-0_A") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for pattern in (r"/a/", r"\bab\b", r"^(?:b\.)?a-b\.", r"/(?:a|b-0)(?:/|$)", r"[./]a?b[/-]", r"^[^/]*\ba[.-]", r"(?i)/ab/", r"/a{1}b\b", r"/(ab|a)/", r"_a_", r"\.(?:b|a0)$"):
        ways = url_filter.required_tokens(pattern)
        for text in texts:
            if ways and re.search(pattern, text):
                assert any(set(way) <= tokens(text) for way in ways), (pattern, text)


def test_url_filter_odd_rows(spark):
    long = "http://casino.example.org/" + "a/" * 40_000 + "en"
    rows = [(1, long), (1, long), (None, "http://x.net/es/1"), (2, None), (3, ""), (4, "://"), (5, "http:///p"), (6, "http://EXAMPLE.com")]
    df = spark.createDataFrame(rows, "page_id int, url string").withColumns({c: F.lit(7) for c in ("row", "key", "path", "target", "rules", "fit", "filed", "hit")})
    got = sorted(((r["page_id"], r["host"], len(r["path"]), r["verdict"]) for r in url_filter.filter_urls(df).collect()), key=repr)
    want = [(1, "casino.example.org", 80_003, "block")] * 2 + [(2, "", 0, "allow"), (3, "", 0, "allow"), (4, "", 0, "allow"), (5, "", 2, "allow"), (6, "example.com", 0, "allow"), (None, "x.net", 5, "block")]
    assert got == sorted(want, key=repr)


# 5


def test_license_scan_against_lists(spark, odd, empty, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op5_license_scan(spark, sf).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (docs[r["doc_id"]] or "").translate(LOWER))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r["n_words"] == len(w) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(odd).count() == len(odd_rows()) and licenses.scan_licenses(empty).count() == 0


def test_license_labels_and_score_one_by_one(spark, sf):
    """Every phrase looked for at every word, every tag's line parsed by recursive descent."""
    names = r"[A-Za-z0-9][A-Za-z0-9.+:-]*"

    def parse(terms):
        def atom():
            if terms and terms[0] == "(":
                terms.pop(0)
                x = level(0)
                terms.pop(0)
                return x
            t = terms.pop(0)
            return {t}, licenses.binding(t)

        def level(k):
            word = ("or", "and", "with")[k]
            below = atom if k == 2 else lambda: level(k + 1)
            x = below()
            while terms and terms[0] == word:
                terms.pop(0)
                y = below()
                x = (x[0], max(0.0, x[1] - licenses.RELAXED)) if word == "with" else (x[0] | y[0], (min if word == "or" else max)(x[1], y[1]))
            return x

        return level(0)

    extra = ["SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nnext", "x SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "GNU General Public License version 3, creative commons; CC BY-SA 4.0", "the MIT\nlicense and Public Domain", "cc0 " * 300]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-1 - k, t) for k, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    phrases = licenses.PHRASES | licenses.BASE
    for d, t in docs:
        text = (t or "").translate(LOWER)
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        w = [text[a:b] for a, b in spans]
        labels = {phrases[p] for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
        score = max(map(licenses.binding, labels), default=0.0)
        for i in range(len(w) - 2):
            if w[i : i + 3] == licenses.TAG.split():
                line = text[spans[i + 2][1] :].split("\n")[0]
                terms = [x.rstrip(".:") for x in re.findall(rf"\(|\)|{names}", line)]
                found, bound = parse(terms) if d < 0 else licenses.evaluate(line)
                labels, score = labels | found, max(score, bound)
        assert got[d]["labels"] == ",".join(sorted(labels)) and got[d]["score"] == pytest.approx(score), (d, t[:80])
    assert got[-1]["labels"] == "bsd-3-clause,gpl-2.0-only,mit" and got[-2]["score"] == pytest.approx(licenses.binding("apache") - licenses.RELAXED)


def test_license_expressions(spark):
    assert licenses.to_postfix("a or b and c".split()) == "a b c and or".split()
    assert licenses.to_postfix("( a or b ) and c with d".split()) == "a b or c d with and".split()
    assert licenses.evaluate(": MIT OR GPL-3.0-only")[1] == licenses.binding("mit")
    assert licenses.evaluate("MIT AND GPL-3.0-only WITH Classpath-exception-2.0") == ({"mit", "gpl-3.0-only"}, licenses.binding("gpl") - licenses.RELAXED)
    for broken, names in (("", set()), ("OR", set()), ("(MIT", {"mit"}), ("MIT OR", {"mit"}), (")", set())):
        assert licenses.evaluate(broken)[0] <= names
    row = licenses.scan_licenses(spark.createDataFrame([(1, "# SPDX-License-Identifier: Apache-2.0 OR MIT\ncode")], "doc_id int, text string")).first()
    assert row["labels"] == "apache-2.0,mit" and row["expressions"] == ["apache-2.0 or mit"]


# 9


def plain_spans(t):
    def luhn(d):
        s = [int(c) for c in d[::-1]]
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(s)) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]


def test_pii_base_spans_random():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("a@.-1234567890+ (.@b9_%é") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_query(spark, sf, odd, empty):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op9_pii(spark, sf).collect():
        base = plain_spans(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_email"] == sum(k == "email" for k, *_ in base)
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert pii.find_pii(odd).count() == len(odd_rows()) and pii.find_pii(empty).count() == 0


def test_pii_secrets_without_digits_and_of_any_length():
    assert pii.candidates("password: CorrectHorseBatteryStaple", []) == [("secret", 10, 35)]
    assert pii.candidates("token=" + "aB3-" * 500 + " end", []) == [("secret", 6, 2006)]
    assert pii.candidates("no secrets: none here", []) == []


def test_pii_added_spans_on_planted_data(spark):
    """Precision and recall of the spans outside the base kinds, decoys among the texts."""
    rng = random.Random(21)
    filler = "lorem tel hotel true monkey data report value table total result order item page note line".split()
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    real = [
        ("secret", "token = ", lambda: hexa(40)), ("secret", "password: ", lambda: hexa(24)), ("secret", "key ", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))),
        ("iban", "bank account ", iban), ("national_id", "ssn ", lambda: f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        ("phone_plain", "phone ", lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"),
        ("person", "signed by Dr. ", lambda: f"{rng.choice(pii.GIVEN)} {rng.choice(['Miller', 'Meyer', 'Lopez', 'Durand'])}"),
        ("address", "lives at ", lambda: f"{rng.randrange(1, 999)} {rng.choice(['Oak', 'Maple', 'Mill'])} Street"),
    ]
    false = [("token = ", lambda: "xxxxxxxxxxxxxxxxxxxxxxxx"), ("row ", lambda: "1" + "".join(rng.choice("0123456789") for _ in range(14)) + "7"), ("part ", lambda: "AB12 ABCD ABCD ABCD"), ("password: ", lambda: "aaaaaaaaaaaaaaaaaaaa")]
    docs, want = [], set()
    for d in range(600):
        text = prose(rng.randrange(3, 20)) + " "
        if d % 3 == 0:
            kind, lead, make = rng.choice(real)
            text += lead
            span = make()
            want.add((d, kind, len(text), len(text) + len(span)))
            text += span + " " + prose(5)
        elif d % 3 == 1:
            lead, make = rng.choice(false)
            text += lead + make() + " " + prose(5)
        docs.append((d, text))
    rows = pii.find_pii(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in rows for s in r["added"]}
    assert len(got & want) >= 0.95 * len(want), sorted({k for _, k, *_ in want - got})
    assert len(got & want) >= 0.95 * len(got), collections.Counter(k for _, k, *_ in got - want)


def test_pii_words_match_as_whole_words():
    assert pii.votes("phone_plain", "a hotel 030 555 1234", 8, 20)[3] == 0
    assert pii.votes("phone_plain", "a tel 030 555 1234", 6, 18)[3] == 1
    assert pii.votes("secret", "monkey abcdefghijklmnopqrst", 7, 27)[3] == 0


def test_labelers_reliability_is_recovered():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.8, 0.6])
    v = np.where(rng.random((4000, 3)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, n = np.unique(v, axis=0, return_counts=True)
    p, yes, no = pii.reliabilities(patterns, n.astype(float))
    of = {tuple(x): q for x, q in zip(patterns, p)}
    assert np.mean([(of[tuple(x)] > 0.5) == t for x, t in zip(v, truth)]) > 0.9
    assert yes[2, 0] > yes[2, 1] > yes[2, 2]


# 2


def test_language_held_out_accuracy(spark, sf, odd, empty):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.op2_language_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, odd).collect() if r["doc_id"] is not None}
    assert got[4] == got[5] == got[6] == got[14] == "und" and got[0] == "en"
    assert language.identify(empty, empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}


def test_language_against_profiles_counted_one_by_one(spark, sf, odd):
    """Profiles, out-of-place distances and ties written out for one document at a time."""

    def of(text):
        counts = collections.Counter()
        for word in re.findall(r"[^\W\d_]+", text or ""):
            w = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in word) + " "
            counts.update(w[i : i + 2] for i in range(len(w) - 2))
            counts.update(w[i : i + 3] for i in range(len(w) - 2))
        return counts

    def ranked(counts):
        code = lambda g: int("".join(f"{ord(c):04x}" for c in g), 16)
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: language.PROFILE]

    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if all(ord(c) < 0x250 for c in r["text"] or "")]
    learned = collections.defaultdict(collections.Counter)
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None:
            learned[r["lang"]] += of(r["text"])
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in learned.items()}
    frame = spark.createDataFrame(docs)
    held_out = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"
    got = {r["doc_id"]: r for r in language.identify(frame, frame.where(f"not {held_out}")).collect()}
    for r in docs:
        own = ranked(of(r["text"]))
        if not own:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else language.PROFILE for k, g in enumerate(own)) / (len(own) * language.PROFILE) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(1 - away[best])
    rows = language.identify(odd, odd).collect()
    assert len(rows) == len(odd_rows())


# 6


def test_toxicity_learns_what_the_labels_say(spark):
    """Word beginnings that are many times as frequent in toxic texts, from labels with nulls, repeats and ties."""
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(400):
        w = rng.choices(plain, k=20)
        if k % 4 == 0:
            w[rng.randrange(20)] = rng.choice(["grumbly", "grumblier", "zork"])
        rows.append((k, " ".join(w), k % 4 == 0))
    rows += [rows[0], rows[0], (None, rows[4][1], True), (901, None, True), (902, "", False), (903, rows[1][1], None), (904, "grumbly " * 5000, True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic boolean").withColumns({c: F.lit(1) for c in ("entry", "other", "digest", "bin")})
    lexicon, cut = toxicity.learn(df)
    assert {b[:4] for b in lexicon} == {b"grum", b"zork"} and cut > 0
    texts = [(k, t) for k, t, _ in rows]
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(texts, "doc_id bigint, text string"), lexicon, cut).collect()}
    assert all(scored[k] == bool(t) for k, _, t in rows[:400])
    for few in (df.where("not toxic"), df.limit(0), df.where("text is null")):
        assert toxicity.learn(few)[0] == {}
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert 300 < toxicity.about(many, 500).count() < 700 and toxicity.about(many, 5000).count() == 5000
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (999999, 1)], "doc_id bigint, toxic int").withColumn("text", F.lit("x"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.labelled_texts(df, labels).collect()}
    assert got == {k: v for k, v in {1: True, 3: False}.items() if zlib.crc32(str(k).encode()) % 5}


def test_toxicity_scores_against_words_one_by_one(spark, sf):
    """Weights of all words that begin with an entry, less those in exceptions, over the root of the length."""
    lexicon, cut = {b"th": 1.5, b"tho": 2.5, b"en": 0.5, b"trash": 3.0}, 0.7
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "trash can trash bag thou en"), (-2, None), (-3, "thrush 7rash $en"), (-4, "trash, can")], "doc_id bigint, text string"))
    table = str.maketrans({**toxicity.HOMOGLYPHS, **toxicity.DIGITS, **{chr(65 + k): chr(97 + k) for k in range(26)}, **{chr(c): chr(c + 32) for c in range(0xC0, 0xDF) if c != 0xD7}})
    for r in docs.join(toxicity.score_toxicity(docs, lexicon, cut), "doc_id").collect():
        w = re.findall(r"[a-z\u0080-\U0010ffff]+", (r["text"] or "").translate(str.maketrans(toxicity.HOMOGLYPHS)).translate(table))
        out = {k + j for p in toxicity.EXCEPTIONS for x in [p.translate(table).split()] for k in range(len(w)) if w[k : k + len(x)] == x for j in range(len(x))}
        total = sum(max((v for b, v in lexicon.items() if x.startswith(b.decode())), default=0.0) for k, x in enumerate(w) if k not in out)
        value = total / math.sqrt(len(w) + 16)
        assert r["n_words"] == len(w) and r["score"] == pytest.approx(value / (value + cut)) and r["predicted"] == (value / (value + cut) >= 0.5)


def test_toxicity_held_out(spark, odd, empty, sf):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = toxicity.op6_toxicity(spark, sf.replace("0.001", "0.01")).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.93 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(odd, {}, 1.0).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score_toxicity(empty, {b"bad": 1.0}, 1.0).count() == 0


def test_toxicity_folding_and_exceptions(spark):
    texts = ["such an IDIOT today", "such an 1d10t", "such an іdіоt", "idiot$$$", "idiotic words", "the trash can is full", "trash talk", "", None, "overidiot"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["hits"] for r in toxicity.score_toxicity(df, {b"idiot": 5.0, b"trash": 5.0}, 0.3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0}


# 1


@pytest.mark.parametrize("head", [2**17, 64])
def test_language_model(spark, sf, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    docs = {r["doc_id"]: words(r["text"]) + ["\n"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = collections.Counter(w for d, t in docs.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    gain = 0.0
    rows = brown.op1_brown_lm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base)
        gain += (r["score"] - base) * r["held_out"]
    assert gain > 0


def test_language_model_adds_up_to_one(spark):
    """Class, item and word factors each sum to at most 1, unseen words included."""
    df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 11}" for j in range(k))) for k in range(40)], "doc_id bigint, text string")
    counts = df.select("text").mapInArrow(brown.count_words, "word bigint, bucket int, n bigint").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))
    m = brown.fit(df.select("text"), counts)
    assert (10**m.transition).sum(axis=1) == pytest.approx(np.ones(brown.CLASSES))
    of = m.classes
    room = np.where(np.arange(m.items.size) < brown.BUCKETS, np.append(m.items.bucket_n + 0.5 * (m.items.bucket_words + 1.0), np.ones(m.items.size - brown.BUCKETS)), 1.0)
    total = np.bincount(of, 10**m.emission * room, minlength=brown.CLASSES)
    assert total[np.unique(of)] == pytest.approx(np.ones(len(np.unique(of))))


def test_language_model_gains_are_the_changes_of_the_likelihood():
    """Each move of each item against the likelihood counted anew, pairs of equal items included."""
    rng = np.random.default_rng(8)
    line = rng.integers(0, 9, 400)
    pair, n = np.unique(line[:-1] * 9 + line[1:], return_counts=True)
    classes = rng.integers(0, 5, 9)

    def bigrams(of):
        out = np.zeros((5, 5))
        np.add.at(out, (of[pair // 9], of[pair % 9]), n)
        return out

    a, b = pair // 9, pair % 9
    key = np.concatenate([a * 18 + 2 * b, b * 18 + 2 * a + 1])
    order = np.argsort(key)
    flat = brown.Flat.of(brown.rows_of(key[order] // 18, key[order] % 18, np.concatenate([n, n])[order], 0))
    got = brown.gains(bigrams(classes), classes, *brown.by_class(flat, classes, 5), np.tile(np.arange(5), (9, 1)))
    for i in range(9):
        for c in range(5):
            moved = classes.copy()
            moved[i] = c
            assert got[i, c] == pytest.approx(brown.likelihood(bigrams(moved)) - brown.likelihood(bigrams(classes)), abs=1e-8)


def test_language_model_likelihood_rises_to_where_no_move_helps(spark, monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 6)
    monkeypatch.setattr(brown, "FAN_IN", 1)
    rng = random.Random(4)
    texts = [" ".join(f"{'abcd'[(k + j) % 4]}{rng.randrange(12)}" for j in range(rng.randrange(3, 30))) for k in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    counts = df.mapInArrow(brown.count_words, "word bigint, bucket int, n bigint").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))
    m = brown.fit(df, counts, tolerance=0)
    assert len(m.likelihoods) > 2 and all(y > x for x, y in zip(m.likelihoods, m.likelihoods[1:]))
    # counted anew from the texts, and every single move tried
    words_of = {int(k): i for i, k in enumerate(m.items.head)}
    import pyarrow as pa

    pairs = collections.Counter()
    for part in split(pa.array(texts)):
        before, own, _ = brown.sequences(part, m.items)
        pairs.update(zip(before.tolist(), own.tolist()))
    assert sum(pairs.values()) == m.n_tokens and len(words_of) == 48

    def reached(classes):
        out = np.zeros((6, 6))
        for (x, y), n in pairs.items():
            out[classes[x], classes[y]] += n
        return brown.likelihood(out)

    best = reached(m.classes)
    assert best == pytest.approx(m.likelihoods[-1])
    for i in range(len(words_of)):
        for c in range(5):
            other = m.classes.copy()
            other[brown.BUCKETS + 1 + i] = c
            assert reached(other) <= best + 1e-5
    # four groups of words that follow each other in turn lie in classes apart
    kinds = collections.defaultdict(set)
    for w in {w for t in texts for w in t.split()}:
        (part,) = split(pa.array([w]))
        kinds[m.classes[m.items.of(*brown.word_keys(part))[0]]].add(w[0])
    assert all(len(x) == 1 for x in kinds.values())


def test_language_model_odd_rows(odd, empty):
    rows = brown.score_texts(odd).collect()
    assert len(rows) == len(odd_rows()) and all(math.isfinite(r["score"]) for r in rows)
    assert brown.score_texts(empty).count() == 0
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in brown.score_texts(odd, "true").collect())


# 4


def test_decontamination_finds_whole_and_changed_items(spark):
    rng = random.Random(11)
    vocabulary = [f"t{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(n)]
    items = [text(n) for n in (16, 24, 40, 75, 120) for _ in range(4)]
    docs, want = [], set()
    for k in range(200):
        w = text(rng.randrange(0, 600))
        if k % 5 == 0:
            q = k // 5 % len(items)
            item = list(items[q])
            if k % 2:  # a paraphrase: every fifth word is another
                item[::5] = text(len(item[::5]))
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
            want.add((k, q))
        docs.append((k, " ".join(w).upper() if k % 3 == 0 else "  ".join(w)))
    b = [(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, "")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(b, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_decontamination_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, odd_rows()[3][1])], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(odd, b).collect()} >= {3}
    assert decontaminate.contaminated(empty, b).count() == 0
    assert decontaminate.contaminated(odd, b.limit(0)).count() == 0


def test_decontamination_finds_every_whole_item_of_a_large_benchmark(spark):
    rng = random.Random(12)
    vocabulary = [f"t{k}" for k in range(4000)]
    items = [rng.choices(vocabulary, k=38) for _ in range(1200)]
    docs = []
    for q in range(0, 1200, 4):
        w = rng.choices(vocabulary, k=120)
        w[q % 97 : q % 97] = items[q]
        docs.append((q, " ".join(w)))
    b = [(k, " ".join(x)) for k, x in enumerate(items)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(b, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(q, q) for q, _ in docs}
    assert all(0.3 < r["cosine"] < 1.001 for r in got)


def test_decontamination_finds_items_that_leaked_often(spark):
    rng = random.Random(13)
    vocabulary = [f"t{k}" for k in range(4000)]
    items = [rng.choices(vocabulary, k=n) for n in (30, 7, 40, 36)]
    docs, want = [], set()
    for k in range(90):  # a third of all rows is the first two items, each text a passage or two
        w = rng.choices(vocabulary, k=rng.randrange(5, 12))
        if k % 3 == 0:
            w[k % 5 : k % 5] = items[0] + items[1]
            want |= {(k, 0), (k, 1)}
        elif k % 30 == 1:
            w += items[2]
            want.add((k, 2))
        docs.append((k, " ".join(w)))
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, text string")
    b = [(k, " ".join(x)) for k, x in enumerate(items)] + [(9, "t1")]
    got = decontaminate.contaminated(frame(docs, "doc_id"), frame(b, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["cosine"] > 0 for r in got)
    # ten texts of one passage, three of them the item
    docs = [(k, " ".join(items[1] if k < 3 else rng.choices(vocabulary, k=20))) for k in range(10)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(docs, "doc_id"), frame(b, "item_id")).collect()) == [(k, 1) for k in range(3)]
    # frequent words in another order are no item
    common = "the of and to in is that for it as was with be by on".split()
    docs = [(k, " ".join(rng.choices(common, k=120) + rng.choices(vocabulary, k=80) if k else common)) for k in range(30)]
    docs = [(k, " ".join(rng.sample(w.split(), len(w.split())) if k else w.split())) for k, w in docs]
    assert 0 in {r["doc_id"] for r in decontaminate.contaminated(frame(docs, "doc_id"), frame([(0, " ".join(common))], "item_id")).collect()}
    assert [r["doc_id"] for r in decontaminate.contaminated(frame(docs, "doc_id"), frame([(0, " ".join(common[::-1]))], "item_id")).collect()] == []


def test_decontamination_loses_nothing_that_would_be_confirmed(spark):
    """Paraphrases keeping 45 to 60 % of the words at all places in a half-window, against the confirmation of every window."""
    rng = random.Random(14)
    vocabulary = [f"t{k}" for k in range(6000)]
    items = [rng.choices(vocabulary, k=n) for n in (18, 30, 38, 50, 75, 110)]
    docs = []
    for kept in (0.45, 0.5, 0.55, 0.6):
        for at in range(24):
            for item in items:
                keep = set(rng.sample(range(len(item) - 8), max(0, math.ceil(kept * len(item)) - 8))) | set(range(len(item) - 8, len(item)))
                docs.append(rng.choices(vocabulary, k=48 + at) + [x if k in keep else rng.choice(vocabulary) for k, x in enumerate(item)] + rng.choices(vocabulary, k=60))
    want = set()
    longest = lambda a, b: decontaminate.common_subsequence({x: sum(1 << k for k, y in enumerate(a) if y == x) for x in a}, len(a), b) / len(a)
    for k, w in enumerate(docs):
        for q, item in enumerate(items):
            around = [w[max(0, s - len(item)) : s + 48 + len(item)] for s in range(0, len(w), 24)] if set(item) & set(w) else []
            if any((lcs := longest(item, x)) >= 0.6 or lcs >= 0.45 and longest(item[-8:], x) >= 0.8 for x in around):
                want.add((k, q))
    b = [(k, " ".join(x)) for k, x in enumerate(items)]
    got = decontaminate.contaminated(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id bigint, text string"), spark.createDataFrame(b, "item_id bigint, text string")).collect()
    assert len(want) >= len(docs)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_decontamination_finds_by_its_latent_spaces(spark, monkeypatch):
    """Candidates are near in the space: with a space of noise away from the items nothing is found, and no cosine is below that of the plain vectors."""
    rng = random.Random(15)
    vocabulary = [f"t{k}" for k in range(2000)]
    items = [rng.choices(vocabulary, k=n) for n in (12, 20, 38, 60, 130) for _ in range(60)]  # three blocks
    docs = []
    for k in range(300):
        item = [x if rng.random() < 0.7 else rng.choice(vocabulary) for x in items[k]]
        docs.append((k, " ".join(rng.choices(vocabulary, k=k % 60) + item + rng.choices(vocabulary, k=50))))
    docs, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    longest = lambda a, b: decontaminate.common_subsequence({x: sum(1 << k for k, y in enumerate(a) if y == x) for x in a}, len(a), b) / len(a)
    want = set()  # every item against every window of every document, by the subsequence alone
    for r in docs.collect():
        w = r["text"].split()
        for q, item in enumerate(items):
            if 2 * len(set(item) & set(w)) >= 0.4 * len(item):
                around = [w[max(0, s - len(item)) : s + 48 + len(item)] for s in range(0, len(w), 24)]
                if any((lcs := longest(item, x)) >= 0.6 or lcs >= 0.45 and longest(item[-8:], x) >= 0.8 for x in around):
                    want.add((r["doc_id"], q))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, b).collect()}
    assert len(want) > 200 and not got - want and len(got) >= 0.99 * len(want)
    learned = decontaminate.latent_spaces

    def noise(coded, blocks, rank=160):
        spaces = []
        for block in blocks:
            basis = np.linalg.qr(block.parts.T)[0]
            x = np.random.default_rng(1).standard_normal((len(block.terms), 40))
            spaces.append(np.linalg.qr(x - basis @ (basis.T @ x))[0])
        return spaces

    def checked(coded, blocks, rank=160):
        spaces = learned(coded, blocks, rank)
        for block, space in zip(blocks, spaces):  # the space holds the block's parts
            assert np.linalg.norm(block.parts @ space, axis=1).min() > 0.9
        return spaces

    monkeypatch.setattr(decontaminate, "latent_spaces", checked)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, b).collect()} == got
    monkeypatch.setattr(decontaminate, "GROUP", 1)  # however the blocks are dealt to passes
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, b).collect()} == got
    monkeypatch.setattr(decontaminate, "latent_spaces", noise)
    assert decontaminate.contaminated(docs, b).count() < 0.1 * len(got)


def test_common_subsequence_against_a_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.positions(np.array(a)), len(a), b) == t[-1][-1]


# the pipeline


def folder_of(spark, path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_pipeline_run_against_plain_python(spark, sf, duck, tmp_path):
    """Each stage of run() written out for one document or pair at a time, the mix in SQL."""
    pipeline = pytest.importorskip("corpus_pipeline")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    lexicon, cut = toxicity.trained(spark, frame, sf)
    bad = {r["doc_id"] for r in toxicity.score_toxicity(frame, lexicon, cut).where("predicted = 1").collect()}
    left = {r["doc_id"]: r["text"] or "" for r in frame.collect() if r["doc_id"] not in bad}
    first = {}
    for d in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[d]), d)
    left = {d: left[d] for d in first.values()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for d, t in left.items()}
    parent = {d: d for d in left}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in left:
        for b in left:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    left = {d: t for d, t in left.items() if find(d) == d}
    low = str.maketrans({chr(c): chr(c + 32) for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7})
    split_ = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
    items = [split_(r["text"] or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    longest = lambda a, b: decontaminate.common_subsequence({x: sum(1 << k for k, y in enumerate(a) if y == x) for x in a}, len(a), b) / len(a)
    leaks = set()
    for d, t in left.items():
        w = split_(t)
        for item in items:
            for s in range(0, len(w), 24):
                x = w[max(0, s - len(item)) : s + 48 + len(item)]
                if sum((collections.Counter(item) & collections.Counter(x)).values()) >= 0.45 * len(item):
                    lcs = longest(item, x)
                    if lcs >= 0.6 or lcs >= 0.45 and longest(item[-8:], x) >= 0.8:
                        leaks.add(d)
    left = [d for d in left if d not in leaks]
    kept = tmp_path / "kept.parquet"
    frame.where(F.col("doc_id").isin(left)).toPandas().to_parquet(kept)
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{kept}'")
    want = {(r[0], r[1], r[4]) for r in c.sql(mixing.OP8_SQL).fetchall()}
    got = pipeline.run(spark, sf)
    assert {(r["doc_id"], r["size"], r["taken"]) for r in got.collect()} == want and len(bad) and len(leaks) and len(left) == got.count()


def test_pipeline_odd_rows_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = odd_rows() + [(3, "another text of the same number", None, None, None), (77, "only once here", "en", "s", 1), (77, "only once here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "digest", "component_id", "kept", "score", "taken", "count")}).repartition(3)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 1), (5, 0, None), (2, 0, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no document holds this item at all"), (None, "x"), (3, None), (4, "")], "item_id bigint, text string")
    path = folder_of(spark, tmp_path / "odd", docs, labels, bench)
    step = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        step = materialize(stage(spark, step, path), "step")
        assert step.columns == docs.columns, name
        if name == "exact dedup":  # equal texts by their smallest number, rows without a number all
            seen = collections.Counter((r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in step.collect())
            assert all(n == 1 for (d, _), n in seen.items() if d is not None) and sum(n for (d, _), n in seen.items() if d is None) == 2
            assert {d for d, _ in seen} == {None, 0, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 14, 15, 77}
            assert sum(d == 3 for d, _ in seen) == 2
    got = pipeline.run(spark, path).collect()
    assert len(got) == step.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    path = folder_of(spark, tmp_path / "empty", docs.limit(0), labels.limit(0), bench.limit(0))
    assert pipeline.run(spark, path).count() == 0
    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() == 0, name


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = materialize(out, "stage")
            assert docs.count() <= n
            n = docs.count()
        else:
            assert out.count() == n


def test_pipeline_drops_near_copies_from_a_similarity_of_four_fifths(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = [[f"d{d}w{k}" for k in range(50)] for d in range(40)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:20], "changed", *w[21:]]) for w in base]  # 41 of 51 shingles shared
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in pipeline.near_copies(spark, docs, sf).collect()} == set(range(40))
