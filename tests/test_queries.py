"""Every query against its SQL twin on the smallest tables."""

import pytest

from geoloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, compare, name):
    ours, theirs = compare(catalog.queries()[name](spark, sf), duck.sql(catalog.oracle_sql()[name]))
    assert ours == theirs


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_optional_parts_know_the_corpus_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "geoloom.llm" not in f.read_text()
