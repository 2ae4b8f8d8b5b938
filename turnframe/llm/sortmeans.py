"""Centroid clustering of integer vectors by sort-means.

Vectors become integers, so that distances, sums and means are exact and no order of rows changes a result. In each round
the other centroids are ordered by their distance from each centroid; a vector starts from its previous centroid and
goes through the others in that order, up to the first that lies strictly beyond twice its distance from the previous
one: by the triangle inequality neither that centroid nor any after it is as near.

Spark holds the vectors: a round is a map over them, written to the shared folder, and sums by cluster with partial
aggregation. The driver holds the k centroids only.

Rows: vectors of another length, or with a null or a component that isn't finite, are left out. Repeated rows each count
and get a row of their own. Where fewer than k vectors are kept, each is a first centroid; ties for these (equal vec_id)
go by components; a null vec_id is hashed as an empty one. Extra columns are ignored; an empty table gives an empty
result. Components of 131,072 or more raise an error, as distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from turnframe.llm.common import dropped, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
MOST = 131_072
ROWS = 20_000


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v) of the vectors that are whole: floor(1024 * component) as integers."""
    x = F.col(column)
    whole = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    as_int = lambda c: F.when(F.abs(c.cast("double")) < MOST, F.floor(c.cast("double") * SCALE).cast("int")).otherwise(F.raise_error(F.lit(f"a component is {MOST} or more")).cast("int"))
    return vectors.where(whole).select(F.col(key).alias("vec_id"), F.transform(x, as_int).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()], np.int64)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the others by distance from each centroid, the squared distances in that order)."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, -1)  # a centroid comes first in its own order
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of x, whose scan starts from its cluster before; of equally near ones the smaller number."""
    cluster, best = before.astype(np.int64), ((x - centroids[before]) ** 2).sum(axis=1)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        limit = 4 * best[rows]  # twice the distance, squared
        for other, gap in zip(order[c], apart[c]):
            on = gap <= limit
            rows, limit = rows[on], limit[on]
            if not len(rows):
                break
            d = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | (d == best[rows]) & (other < cluster[rows])
            best[rows[nearer]], cluster[rows[nearer]] = d[nearer], other
    return cluster, best


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (vec_id, v, cluster) with their new cluster and distance."""
    order, apart = orders(centroids)
    kind = StructType([vectors.schema["vec_id"], vectors.schema["v"], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
                cluster, distance = nearest(x, batch.column("cluster").to_numpy(zero_copy_only=False), centroids, order, apart)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(scan, kind)


def means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of each cluster's mean; empty clusters keep their centroid."""
    sums = vectors.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():  # k rows
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def sort_means(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of integer vectors (vec_id, v) after so many rounds and one more assignment, and the centroids."""
    rows = written(vectors, "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    at, last = rows.withColumn("cluster", F.lit(0)), rows
    for turn in range(rounds + 1):
        at = written(assigned(at, centroids), f"round_{turn}")
        dropped(last)
        last = at
        if turn < rounds:
            centroids = means(at, centroids)
    return at, centroids


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of integer vectors."""
    rows, centroids = sort_means(vectors, k, rounds, seed)
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    told = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    kind = StructType([StructField("cluster", IntegerType()), StructField("cluster_inertia", LongType()), StructField("inertia", LongType()), StructField("centroid_sha256", StringType())])
    each = rows.sparkSession.createDataFrame(told, kind)
    return rows.drop("v").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sort_means(embeddings: DataFrame) -> DataFrame:
    return clustered(integer_vectors(embeddings))


def _sql() -> str:
    """Plain rounds over all centroids: DuckDB needs no shortcut."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT i, v, vec_id, d.c, d.d FROM (SELECT x.i, x.v, x.vec_id, min({{'d': {far}::BIGINT, 'c': c.c}}) AS d FROM x, c{k} AS c GROUP BY ALL))")
        if k < ROUNDS:
            steps.append(f"s{k} AS MATERIALIZED (SELECT c, j, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY c, j)")
            steps.append(f"m{k} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{k} GROUP BY c)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} AS c LEFT JOIN m{k} AS m USING (c))")
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM x QUALIFY c < {CLUSTERS}),
{", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON a.c = c.c"""


OP12_SQL = _sql()
