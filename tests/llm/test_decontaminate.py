"""The matrix behind the latent spaces."""

import random

import numpy as np
import pytest

from geoloom.llm import decontaminate


@pytest.fixture()
def made(spark):
    """Documents coded by a benchmark, its blocks, and the words of the passages and parts."""
    rng = random.Random(8)
    vocabulary = [f"t{k}" for k in range(300)]
    items = [rng.choices(vocabulary, k=n) for n in (5, 30, 70) for _ in range(60)]
    # passages of one, two, and many of the benchmark's words, some repeated
    docs = [" ".join(rng.choices(vocabulary, k=k % 4) + ["other"] * (k % 30) + rng.choices(vocabulary[:9], k=k % 50)) for k in range(400)]
    rows = [{"item": k, "text": " ".join(x)} for k, x in enumerate(items)]
    bench = decontaminate.read_benchmark(rows, "item", "text")
    coded = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3).mapInArrow(decontaminate.encode(bench.terms), "doc_id bigint, terms binary").cache()
    return coded, bench, decontaminate.blocks_of(bench, decontaminate.weigh(coded, bench))


def test_all_passages_are_rows_of_the_matrix(made):
    """Against each passage written out, those of a single known word included."""
    coded, bench, blocks = made
    assert len(blocks) > 1
    rng = np.random.default_rng(0)
    bases = [rng.standard_normal((len(b.terms), 20)) for b in blocks]
    want = []
    for b, basis in zip(blocks, bases):
        rows, few = [], 0
        for r in coded.collect():
            words = np.frombuffer(r["terms"], np.int32)
            for at in range(0, len(words), decontaminate.HALF):
                x = np.zeros(len(b.terms))
                for w in words[at : at + decontaminate.HALF]:
                    if w in b.terms:
                        k = np.searchsorted(b.terms, w)
                        x[k] += b.weight[k]
                if x.any():
                    rows.append(x / np.linalg.norm(x))
                    few += np.count_nonzero(x) < 3
        assert few > 20
        a = np.stack(rows)
        want.append(a.T @ (a @ basis) + b.part_weight * (b.parts.T @ (b.parts @ basis)))
    for times in (lambda x: decontaminate.multiply(coded, blocks, x), lambda x: decontaminate.multiplier(coded, blocks)(x)):
        for x, y in zip(times(bases), want):
            np.testing.assert_allclose(x, y, rtol=1e-4, atol=1e-4 * np.abs(y).max())


def test_spaces_however_the_sums_are_taken(made, monkeypatch):
    """Blocks dealt to one job each, and blocks too wide for sums of pairs, have the same spaces."""
    coded, _, blocks = made
    whole = decontaminate.latent_spaces(coded, blocks, 20)
    widest = max(len(b.terms) for b in blocks)
    for cells in (widest**2, widest**2 - 1, 1):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        for x, y in zip(decontaminate.latent_spaces(coded, blocks, 20), whole):
            np.testing.assert_allclose(x @ x.T, y @ y.T, atol=1e-3)
