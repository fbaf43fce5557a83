"""Licence scan: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates tag expressions.

The texts of a chunk become one string of words with single spaces, which one
automaton reads once, whatever the number of phrases. What follows an
identifier tag, up to the line's end, is an expression of licence names with
``and``, ``or``, ``with`` and parentheses. It is evaluated to its names and to
how binding it is: ``or`` lets the reader choose the laxest side, ``and`` binds
to the strictest, ``with`` an exception relaxes its licence by a step.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.words import ALNUM, Words, split

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TAG = "spdx license identifier"
PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
}
#: How binding a label is, 0 (none) to 1; names of tags are looked up by their longest known start.
BINDING = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "0bsd": 0.05,
    "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "cc": 0.3, "cc-by": 0.3, "apache": 0.25,
    "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.6, "cc-by-nd": 0.7, "cc-by-nc": 0.8,
    "gpl": 0.7, "agpl": 0.8, "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN, RELAXED = 0.5, 0.1
#: An expression is read from the tag's line as far as these; longer ones are unknown licences.
TERM = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
BINDS = {"or": 1, "and": 2, "with": 3}


def binding(name: str) -> float:
    found = [k for k in BINDING if name == k or name.startswith((k + "-", k + "."))]
    return BINDING[max(found, key=len)] if found else UNKNOWN


def to_postfix(terms: list[str]) -> list[str]:
    """Shunting yard. Raises ValueError where an operand, operator or parenthesis is out of place."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether one must come next
    for t in terms:
        if t == "(":
            if not operand:
                raise ValueError(t)
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if operand or not waiting:
                raise ValueError(t)
            waiting.pop()
        elif t in BINDS:
            if operand:
                raise ValueError(t)
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = True
        else:
            if not operand:
                raise ValueError(t)
            out.append(t)
            operand = False
    while waiting:
        if waiting[-1] == "(":
            raise ValueError("(")
        out.append(waiting.pop())
    if operand:
        raise ValueError("end")
    return out


def evaluate(expression: str) -> tuple[set[str], float]:
    """Licence names of an expression and how binding it is. What follows a complete expression (prose) is left out; no expression gives no name."""
    terms: list[str] = []
    for t in TERM.findall(expression):
        low = t.lower().rstrip(".:")
        if low not in BINDS and low not in "()" and terms and terms[-1] not in BINDS and terms[-1] != "(":
            break
        terms.append(low)
    while terms:
        try:
            postfix = to_postfix(terms)
            break
        except ValueError:
            terms.pop()
    else:
        return set(), 0.0
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t not in BINDS:
            stack.append(({t}, binding(t)))
            continue
        (names_b, b), (names_a, a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((names_a, max(0.0, a - RELAXED)))
        else:
            stack.append((names_a | names_b, min(a, b) if t == "or" else max(a, b)))
    return stack[0]


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *PHRASES, TAG}:
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def scan_words(words: Words) -> dict[int, list[tuple[str, int, int]]]:
    """Per text: (phrase, first word in the text, first word in the chunk) of each place."""
    joined, at = words.joined()
    text_of = np.searchsorted(words.first, np.arange(len(at)), "right") - 1 if len(at) else at
    places = defaultdict(list)
    for end, (phrase, n) in automaton().iter(joined):
        k = int(np.searchsorted(at, end - len(phrase)))
        if text_of[k] == text_of[k + n - 1]:
            places[int(text_of[k])].append((phrase, k - int(words.first[text_of[k]]), k))
    return places


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    string, long = pa.string(), pa.int64()
    schema = pa.schema([("doc_id", long), ("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", string), ("labels", string), ("score", pa.float64()), ("notices", pa.list_(pa.struct([("label", string), ("word", long)]))), ("expressions", pa.list_(string))])
    for batch in batches:
        for words in split(batch["text"], ALNUM):
            n = len(words.first) - 1
            n_base, first, last, base_labels, labels, scores, notices, tags = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
            for text, places in scan_words(words).items():
                base = [(w, BASE[p]) for p, w, _ in places if p in BASE]
                if base:
                    n_base[text], first[text], last[text] = len(base), min(base)[0], max(base)[0]
                own = {x for _, x in base}
                base_labels[text] = ",".join(sorted(own))
                own |= {PHRASES[p] for p, _, _ in places if p in PHRASES}
                score = max(map(binding, own), default=0.0)
                notices[text] = [{"label": BASE.get(p) or PHRASES[p], "word": w} for p, w, _ in places if p != TAG]
                stop = int(words.ends[words.first[text + 1] - 1])
                for _, _, k in (x for x in places if x[0] == TAG):
                    rest = words.data[words.ends[k + 2] : stop].tobytes().decode("utf-8", "replace").split("\n", 1)[0]
                    names, bound = evaluate(rest)
                    tags[text].append(rest.strip(" :"))
                    own |= names
                    score = max(score, bound)
                labels[text], scores[text] = ",".join(sorted(own)), score
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(words.at, n).cast(long), pa.array(words.counts, long), *(pa.array(x, f.type) for x, f in zip((n_base, first, last, base_labels, labels, scores, notices, tags), list(schema)[2:]))], schema=schema)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices, expressions.

    Null text is empty: no words, no labels, score 0. Score is how binding the
    strictest notice is. Texts of any length are read whole. Repeated rows get a result each; an empty table gives an
    empty result; further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<label:string,word:bigint>>, expressions array<string>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
