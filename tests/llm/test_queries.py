import pytest

from foliomill.llm.queries import QUERIES, SQL
from tests.oracle import connect, same

COLUMNS = {
    "p1_found": ["author_id_a", "author_id_b"],
    "p2_found": ["concept_id", "group_id"],
    "p4_found": ["book_id", "publisher_id"],
    "p5_found": ["alignment_edge_id", "verdict"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "sent_start", "sent_end"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(name, spark, sf_dir):
    same(QUERIES[name], SQL[name], spark, sf_dir, connect(sf_dir))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark, sf_dir):
    found = QUERIES[name](spark, sf_dir)
    assert found.columns == COLUMNS[name]
    assert found.count() > 0
