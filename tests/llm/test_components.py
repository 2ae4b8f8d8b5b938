"""Connected components against plain Python: contraction inside tasks, its levels, and the star rounds behind them."""

import random

import numpy as np
import pytest

from turnframe.llm import components as module
from turnframe.llm.components import components, stars


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            p, q = sorted((root(u), root(v)))
            parent[q] = p
    return {x: root(x) for x in parent}


def shapes():
    rng = random.Random(9)
    blobs = [(b * 1000 + rng.randrange(40), b * 1000 + rng.randrange(40)) for b in range(30) for _ in range(200)]
    hub = [(77_777, 100_000 + i) for i in range(3000)] + [(200_000, 100_000 + i) for i in range(0, 3000, 7)]
    chain = [(300_000 + i, 300_001 + i) for i in range(500)]
    mixed = [(400_000 + rng.randrange(400), 400_000 + rng.randrange(400)) for _ in range(420)]
    return {"blobs": blobs, "hub": hub, "chain": chain, "mixed": mixed, "all": [*blobs, *hub, *chain, *mixed, (5, 5), (-3, 40)]}


@pytest.mark.parametrize("few", [1, 50, 1 << 20])
def test_stars_and_tasks_that_give_them_out_early(monkeypatch, few):
    import pyarrow as pa

    monkeypatch.setattr(module, "EDGES", few)
    for edges in shapes().values():
        nodes, least = stars(*np.array(edges, np.int64).T)
        want = plain(edges)
        assert {x: y for x, y in zip(nodes.tolist(), least.tolist()) if x in want} == want
        batches = [pa.record_batch({"u": [u for u, _ in edges[i : i + 300]], "v": [v for _, v in edges[i : i + 300]]}) for i in range(0, len(edges), 300)]
        given = [(x, y) for b in module._contracted(iter(batches)) for x, y in zip(b["node"].to_pylist(), b["least"].to_pylist())]
        assert plain(given) == {x: y for x, y in want.items()}


@pytest.mark.parametrize("name", ["blobs", "hub", "chain", "mixed", "all"])
def test_levels(spark, monkeypatch, name):
    edges = shapes()[name]
    random.Random(3).shuffle(edges)
    made, real = [], module.written
    monkeypatch.setattr(module, "written", lambda df, called="table", *a, **k: made.append(called) or real(df, called, *a, **k))
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "u long, v long").repartition(16)
    rows = components(df).collect()
    got = {r.node: r.component for r in rows}
    assert got == plain(edges) and len(got) == len(rows)
    # a round of stars takes eight shuffles, and there were four at least
    assert name not in ("blobs", "hub") or len(made) <= 3 and "edges" not in made


def test_what_does_not_halve_goes_on_in_star_rounds(spark, monkeypatch):
    def each_alone(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            u, v = b["u"].to_numpy(), b["v"].to_numpy()
            low = np.minimum(u, v)
            yield pa.record_batch({"node": np.concatenate([u, v]), "least": np.concatenate([low, low])})

    made, real = [], module.written
    monkeypatch.setattr(module, "_contracted", each_alone)
    monkeypatch.setattr(module, "written", lambda df, called="table", *a, **k: made.append(called) or real(df, called, *a, **k))
    edges = shapes()["chain"]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    assert got == plain(edges) and "edges" in made
