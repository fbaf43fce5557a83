"""The class bigrams after a round, from the items that move."""

import numpy as np

from geoloom.llm import brown


def test_bigrams_from_moved_items_are_those_of_all(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(0, 4, (40, 40))  # item before, item
    a, b = np.nonzero(n)
    item, code, count = (np.concatenate(x) for x in ((a, b), (2 * b, 2 * a + 1), (n[a, b], n[a, b])))
    order = np.lexsort((code, item))
    table = spark.createDataFrame(brown.pa.Table.from_batches([brown.rows_of(item[order], code[order], count[order], 0)]))
    old = rng.integers(0, 5, 40)
    new = np.where(rng.random(40) < 0.4, rng.integers(0, 5, 40), old)
    before = brown.bigrams_of(table, old, 5)
    assert np.array_equal(brown.bigrams_after(table, before, old, new, 5), brown.bigrams_of(table, new, 5))
