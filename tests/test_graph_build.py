"""Edges of a shard: the pruning rule, written out, and reach."""

import numpy as np
import pytest

from vecskein.plans import graph
from vecskein.plans.options import GraphOptions


@pytest.mark.parametrize("inner", ["l2", "ip"])
def test_kept_edges_follow_the_rule(inner):
    rng = np.random.default_rng(1)
    for _ in range(40):
        x = rng.normal(size=(30, 4))
        ids = rng.choice(np.arange(1, 30), 20)
        dist = graph._distances(inner, x[ids], x[0])
        got = graph.prune(dist, ids, x, 7, (1.0, 1.2), inner).tolist()
        near = sorted({(d, i) for d, i in zip(dist.tolist(), ids.tolist(), strict=True)})
        kept, far = [], lambda a, b: graph._distances(inner, x[[b]], x[a])[0]
        for alpha in (1.0, 1.2) if inner == "l2" else (1.0,):
            for d, i in near:
                if i not in kept and len(kept) < 7 and all(d < alpha * far(k, i) for k in kept):
                    kept.append(i)
        kept += [i for _, i in near if i not in kept][: 7 - len(kept)]
        assert got == kept


def test_every_node_is_reached_and_no_list_is_long():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.01, (60, 6)) for c in range(0, 90, 9)])
    start, edges = graph.build_graph(x, "l2", GraphOptions.parse({"m": 4, "ef_construction": 8}))
    seen, stack = {start}, [start]
    while stack:
        for v in edges[stack.pop()].tolist():
            if v not in seen:
                seen.add(v)
                stack.append(v)
    assert len(seen) == 600 and max(map(len, edges)) < 60


def test_walk_estimates_only_what_it_meets():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    start, edges = graph.build_graph(x, "l2", GraphOptions.parse({"m": 12}))
    asked = []

    def coarse(at):
        asked.extend(at.tolist())
        return graph._distances("l2", x[at], x[5])

    found = graph.walk(x[5], x, coarse, start, lambda u: edges[u], "l2", 20)
    assert found[0][1] == 5 and len(asked) == len(set(asked)) < 1200
