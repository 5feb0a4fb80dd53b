"""A sample of registered queries against their SQL on the smallest tables.

check_oracles.py runs all of them on any folder.
"""

import pytest
from check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "drop_small_talk", "canonicalise_speakers", "assign_speakers_by_time", "context_window", "budget_prefix", "extract_actions",
    "extract_decisions", "extract_risks", "link_provenance_lexical", "phrase_support", "match_items_to_gold", "weighted_criterion_scores",
    "segments_from_text", "segments_from_json", "topic_segments", "summary_coverage",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    _, err = compare(spark, con, name, FOLDER)
    assert err == ""


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
