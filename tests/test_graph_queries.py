"""Graph queries where their budgets run out."""

import pytest

from knotwork.operators import fold, traverse
from knotwork.plans import graph_queries
from test_operators import log


def test_paths_tell_that_the_budget_ran_out(spark, sf, monkeypatch):
    edge = fold.edges(log(spark, [("customer:1", "in", "customer:2", 1.0), ("customer:2", "in", "region:1", 2.0)]))
    monkeypatch.setattr(graph_queries, "_whole", lambda *_: edge)
    run = lambda: [(r.length, r.total, r.capped) for r in graph_queries.paths_depth4(spark, sf).collect()]
    assert run() == [(1, 2, False), (2, 2, False)]
    monkeypatch.setattr(traverse, "EXPANSIONS", 0)
    assert run() == [(1, 1, True)]
    monkeypatch.setattr(graph_queries, "_whole", lambda *_: fold.edges(log(spark, [("customer:1", "in", "x", 1.0), ("x", "in", "region:1", 2.0)])))
    with pytest.raises(ValueError, match="budget of trails"):
        graph_queries.paths_depth4(spark, sf)
