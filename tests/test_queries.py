"""Every registered query against its SQL, and the plans of some."""

from __future__ import annotations

import pytest

from citegrid.plans import catalog
from tests import oracle

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.views(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got, want, columns, names = oracle.compare(catalog.queries()[name](spark, sf_dir), con, SQL[name])
    assert columns == names
    assert got == want


def test_every_query_has_sql():
    """But for bases over cycles, which tests/test_operators.py compares with a plain version."""
    assert set(catalog.queries()) - set(SQL) == {"cyclic_basis"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark, sf_dir):
    text = plan(catalog.queries()["topk_batch"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in text
    assert "EqualTo(o_orderstatus,O)" in text


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    if name not in ("trust_fixpoint", "scc_members", "composition_closure", "frontier", "spdx_gate", "license_gate"):
        text = plan(catalog.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


def test_texts_are_split_once(spark, sf_dir):
    """Runs of words are made from words that one step has split, not split anew for each word."""
    text = plan(catalog.queries()["leak_scan"](spark, sf_dir))
    runs = [x for x in text.split("\n") if "lambda" in x and "xxhash64" in x]
    assert runs and all(x.count("split(") == 0 for x in runs if "Generate" in x)
    assert not any("Filter" in x and "xxhash64" in x for x in text.split("\n"))


def test_slugs_are_made_once(spark):
    from citegrid.functions import texts

    rows = spark.createDataFrame([("Value 12 of 'x' is TWICE",), ("12",), (None,)], "m string").repartition(1)
    made = rows.select(texts.message_slug(rows["m"]).alias("slug"))
    assert plan(made).count("array_join(") == 1
    assert [r["slug"] for r in made.collect()].count(None) == 1 and {"msg-value-of-is-twice", "msg-unknown"} <= {r["slug"] for r in made.collect()}
