"""The subpackage's queries against DuckDB, or for rows and form where SQL has no equivalent."""

import pytest
from oracle import compare

from spindrift.llm.queries import ORACLES, QUERIES

COLUMNS = {"p2_found": ["recording_id", "unit"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    if name in ORACLES:
        assert compare(df, small, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_packing_of_the_corpus(spark, small):
    r = QUERIES["p6_summary"](spark, small).first()
    assert r.fullest <= 1024 and r.containers <= r.least * 1.02 + 1
