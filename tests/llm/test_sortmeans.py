import hashlib
import math
import random

import duckdb
import numpy as np
import pytest


def plain(rows, dims, k=8, rounds=10):
    """The contract word by word, over all centroids."""
    kept = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in at)
    by = {j: sum(d for d, c in at if c == j) for j in range(len(centroids))}
    return sorted(((i, c, d, by[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v int, cluster int")


def of(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def small(spark, rows, dims):
    from turnframe.llm.sortmeans import clustered, integer_vectors

    return of(clustered(integer_vectors(frame(spark, rows), dims)))


def test_plain_rounds(spark):
    random.seed(5)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 1.0]) + random.gauss(0, 0.05) for _ in range(3)]) for i in range(300)]
    rows += [(None, [0.5, 0.5, 0.5]), (7, rows[7][1]), (8, [1.0, 1.0, -1.0]), (900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, math.nan, 0.0]), (904, [math.inf, 0.0, 0.0]), (905, [1.0] * 4)]
    want = plain([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], 3)
    assert small(spark, rows, 3) == want


def test_ties_copies_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(27)]  # equal vectors, equal distances, empty clusters
    assert small(spark, grid, 2) == plain(grid, 2)
    assert small(spark, [(1, [0.25, 0.5])] * 20, 2) == plain([(1, [0.25, 0.5])] * 20, 2)
    few = [(1, [0.25, -0.5]), (2, [3.0, 1.0])]
    assert small(spark, few, 2) == plain(few, 2)
    assert small(spark, [], 2) == [] and small(spark, [(1, None)], 2) == []
    with pytest.raises(Exception, match="131072"):
        small(spark, [(1, [1e9, 0.0])], 2)


def test_the_scan_stops_early_and_rightly():
    from turnframe.llm.sortmeans import nearest, orders

    r = np.random.default_rng(1)
    x, c = r.integers(-50, 50, (2000, 4)), r.integers(-50, 50, (40, 4))
    before = r.integers(0, 40, 2000)
    order, apart = orders(c)
    cluster, best = nearest(x, before, c, order, apart)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (cluster == d.argmin(axis=1)).all()
    assert (np.diff(apart, axis=1) >= 0).all()


def test_sql_and_whole_table(spark):
    from turnframe.llm.sortmeans import OP12_SQL, op12_sort_means

    at = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}')")
    rel = con.sql(OP12_SQL)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    want = sorted((tuple(r) for r in rel.select(*names).fetchall()), key=repr)
    assert of(op12_sort_means(spark.read.parquet(at))) == want
