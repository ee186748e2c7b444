"""Exact vector search that skips clusters, against the search over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from parchmill.operators import memory
from parchmill.storage import Scratch

STATE, QUERIES = "tm_id long, embedding array<double>, domain string, origin string", "query_id long, embedding array<double>, domain string"


def tables(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    near = lambda: (centres[r.integers(12)] + 0.25 * r.normal(size=16)).tolist()
    domain = lambda: ["", "a", "b", None][r.integers(4)]
    state = [(i, near() if i % 9 else r.normal(size=5).tolist(), domain(), "human" if i % 11 == 0 else "auto") for i in range(900)]
    state += [(1000, [0.0] * 16, "", "auto"), (1001, [], "", "human"), (1002, None, "", "auto"), (1003, state[1][1], "", "auto"), (1004, state[1][1], "a", "human"), (1005, [1.0, 2.0], "", "auto")]
    queries = [(i, near() if i % 7 else r.normal(size=5).tolist(), domain()) for i in range(60)] + [(90, [0.0] * 16, ""), (91, [], ""), (92, [2.0, 4.0], ""), (93, state[1][1], ""), (94, [1.0] * 3, "")]
    return spark.createDataFrame(queries, QUERIES).repartition(3), spark.createDataFrame(state, STATE).repartition(3)


def rows(found):
    return sorted((r["query_id"], r["rank"], r["tm_id"], r["human"], round(r["similarity"], 9)) for r in found.collect())


@pytest.mark.parametrize("k,least,part_rows", [(3, 0.82, 100_000), (1, 0.0, 20), (5, 0.95, 20)])
def test_clusters_equal_all_pairs(spark, k, least, part_rows):
    queries, state = tables(spark)
    scratch = Scratch(spark)
    found, pairs = memory.Clusters(state, scratch, part_rows=part_rows).search(queries, k, least, block_rows=25)
    assert rows(found) == rows(memory.nearest(queries, state, k, least)) and found.count()
    if least > 0.8:  # of the rows that share a query's dimension, most aren't met
        assert pairs.agg({"pairs": "sum"}).first()[0] < 0.5 * queries.count() * state.count()
    scratch.drop()


def test_empty(spark):
    queries, state = tables(spark)
    assert memory.Clusters(state.where("false"), Scratch(spark)).search(queries)[0].count() == 0
    assert memory.Clusters(state, Scratch(spark)).search(queries.where("false"))[0].count() == 0
