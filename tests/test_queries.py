"""A cross-section of registered queries against their SQL at the smallest scale.

All of them are checked by ``python tests/check_oracle.py sf0.01``.
"""

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["normalize_url", "keywords", "importance", "trust_scores", "user_feeds", "repair_source", "detect_states",
           "prefilter_audit", "parse_feeds", "apply_changes", "chronology", "brief", "order_feed", "order_violations", "feed_legacy",
           "merge_master", "upsert_cards", "insert_new", "saved_cards", "evaluate_clusters", "similar_embeddings", "feed_snapshot",
           "insert_counts", "article_files", "live_summary", "client_order"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    assert oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_every_query_has_sql():
    from storyloom.plans import catalog

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set()
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())
