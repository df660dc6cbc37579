"""Every core query against its SQL, or for rows where SQL can't say it."""

from __future__ import annotations

import pytest
from compare import compare, duck

from lodestrata import registry

ORACLES = registry.oracle_sql()


#: Queries without SQL, and what tests them instead.
NO_SQL = {
    "dedup_similar_pairs": "brute force", "fold_merged_points": "known points", "sample_randomized": "shares of answers", "sample_variants": "known variants", "hypergraph_largest_eigenvalue": "numpy", "spectral_measures": "known spectra",
    "spectral_graphwave": "known spectra", "spectral_fourier": "known spectra", "topology_persistence": "known graphs", "graph_betweenness": "known graphs", "graph_orbits": "known graphs", "generate_pairs": "rows", "generate_training_file": "rows",
    "executed_tools": "known markers", "embed_walks": "walks along edges", "embed_node2vec": "width", "embed_clusters": "rows", "embed_principal": "width", "analysis_coverage": "known graphs", "analysis_hard_samples": "rows",
    "analysis_random_graph": "number of edges", "chunk_semantic": "known texts", "chunk_summary": "known texts", "generate_summaries": "rows", "text_base_units": "known quantities",
}


@pytest.fixture(scope="module")
def db(small):
    return duck(small)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, small, db, name):
    said = compare(spark, name, registry.queries()[name], ORACLES.get(name), small, db)
    assert ": ok " in said or (name in NO_SQL and "no SQL" in said), said


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_curriculum_has_whole_batches(spark):
    rows = registry.queries()["measure_curriculum"](spark, "/root/testdata/sf0.01").orderBy("position").collect()
    assert len(rows) > 128 and [r.position for r in rows] == list(range(len(rows)))
    assert [r.batch for r in rows] == [i // 64 for i in range(len(rows))]
    assert rows == sorted(rows, key=lambda r: (r.difficulty, r.pos))
