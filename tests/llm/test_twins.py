"""Registered queries over the smallest driver tables: the SQL twin, and brute force where SQL can't express them."""

import os

import pytest
from compare import connect, difference

from tickloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF_DIR), name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_recall_of_linked_vectors(spark):
    """At least 0.9 of the pairs that brute force finds; none below the bound."""
    con = connect(SF_DIR)
    want = dict(con.execute(
        "SELECT a.vec_id, count(*) FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id "
        "AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93 GROUP BY 1"
    ).fetchall())
    found = {r.vec_id: r.n_links for r in queries.QUERIES["op7_cross_polytope"](spark, SF_DIR).collect()}
    assert len(found) == con.execute("SELECT count(*) FROM embeddings").fetchall()[0][0]
    assert all(n <= want.get(k, 0) for k, n in found.items())
    assert sum(found.values()) >= 0.9 * sum(want.values())
