"""Every query of the problems against its SQL where it has one, or for rows."""

from __future__ import annotations

import pytest
from compare import compare, duck

from lodestrata import llm


#: Queries without SQL, and what tests them instead.
NO_SQL = {
    "p2_neighbours": "brute force over vectors", "p3_found": "held-out damage", "p3_tagged": "held-out damage", "p4_found": "brute force over names", "p4_names": "brute force over names", "p5_found": "held-out pages and damage", "p5_repaired": "repair of a known text",
    "p6_pieces": "joined again by p6_joined", "p7_found": "known pages", "p7_main": "known pages", "p8_ids": "the library's ids, and p8_texts", "p10_found": "round trips", "p10_restored": "round trips",
}


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, small, name):
    said = compare(spark, name, llm.queries()[name], llm.oracle_sql().get(name), small, duck(small))
    assert ": ok " in said or (name in NO_SQL and "no SQL" in said), said


def test_stated_columns(spark, small):
    stated = {
        "p1_found": ["id_a", "id_b"], "p2_found": ["space", "id_a", "id_b"], "p3_found": ["pos", "defect"], "p4_found": ["name_a", "name_b"], "p5_found": ["doc_id", "kind"],
        "p6_found": ["id"], "p7_found": ["doc_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
    }
    for name, columns in stated.items():
        frame = llm.queries()[name](spark, small)
        assert frame.columns == columns, name
        if name != "p8_ids":
            assert frame.count() == frame.distinct().count(), name
