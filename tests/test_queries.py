"""Every query of the catalog against its SQL twin on the smallest tables."""

import pytest

from docketlake.plans import catalog
from tests.oracle import connection, same

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


#: Queries that SQL cannot say; each is held against a plain version in the test named.
PLAIN = {
    "chk3_chk5_token_chunks": "test_token_chunks", "chk4_structure_chunks": "test_structure_chunks", "chk8_paragraph_chunks": "test_paragraph_chunks", "chk6_vocabulary_tokens": "test_vocabulary_tokens", "chr4_dedup_events": "test_events_are_kept_in_order", "chr6_conflicts": "test_conflicts_are_of_classes", "chr4_first_statements": "test_first_statements", "chr6_statement_conflicts": "test_statement_conflicts",
    "dif1_dif2_paragraph_diff": "test_diffs_replay", "dif5_similarity": "test_similarity", "grf10_communities": "test_communities_are_settled", "grf12_entity_communities": "test_entity_communities", "grf13_key_players": "test_ranks_and_closeness",
    "grf7_grf8_path_centrality": "test_ranks_and_closeness", "grf9_pagerank": "test_ranks_and_closeness", "viz4_matrix": "test_matrix", "win6_dep1_topics": "test_topics", "win9_page_layout": "test_pages",
}


def test_every_query_has_a_twin_or_a_plain_version():
    from tests import test_brute

    assert set(QUERIES) - set(SQL) == set(PLAIN) and all(hasattr(test_brute, t) for t in PLAIN.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_stands_without_optional_parts(tmp_path):
    """A copy without the corpus subpackage, its tests and the pipeline imports and lists the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/docketlake", tmp_path / "docketlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.strip() == "fine", done.stderr[-2000:]
