"""Every registered query of the library against its SQL, whole tables on either side."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from broadsheet.plans.registry import ORACLES, QUERIES
from tests.compare import rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, sf):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_is_not_empty(spark):
    assert entry.entry(spark).count() == 30


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLES) == {"html_text", "front_page_rules", "noun_cloud", "pipelines", "vader_scores", "lda_topics", "lda_grid", "nmf_topics", "pca", "density_clusters"}


def test_models_give_rows(spark, sf):
    topics = QUERIES["lda_topics"](spark, sf).collect()
    assert {r.topic for r in topics} == {0, 1, 2, 3, 4} and all(0 < r.pct < 100 for r in topics)
    parts = QUERIES["pca"](spark, sf).collect()
    # As many components as explain 95 per cent of the variance; tests/test_models.py compares them with a decomposition.
    assert len(parts) == 500 and len({len(r.components) for r in parts}) == 1
