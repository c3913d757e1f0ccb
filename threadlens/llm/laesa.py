"""Centroid clustering with a LAESA pivot table.

Every vector's distances to a few fixed pivots are computed once and stored. In each round, the difference between a vector's and
a centroid's distance to the same pivot bounds their own distance from below (triangle inequality), so most centroids are ruled
out by subtractions; the others get an exact squared distance in integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import stored

DIMS, SCALE = 64, 64
CLUSTERS, ROUNDS, PIVOTS = 16, 3, 8
#: Pivots are chosen among this many vectors, those with the smallest hashes. They are no part of the result, only of its cost.
PIVOT_SAMPLE = 256
#: Components are held below this, so that a squared distance of up to 1,024 components is exact in 64 bits.
LARGEST = 1 << 25


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS,
                    scale: float = SCALE) -> DataFrame:
    """``id, x``: vectors of exactly ``dims`` finite components, each as the integer floor(scale * component).

    Null vectors, other lengths, and vectors with a null, NaN or infinite component are left out.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.where((F.size(v) == dims) & finite)
    return kept.select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * float(scale))).alias("x"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as an array of rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(values) // max(len(column), 1))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``y`` (or of one row ``y``)."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(squared(x, p).astype(np.float64)) for p in pivots], axis=1)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` rows of ``sample``, each the one with the largest sum of distances to those before it."""
    taken, total = [0], np.zeros(len(sample))
    while len(taken) < min(count, len(sample)):
        total += np.sqrt(squared(sample, sample[taken[-1]]).astype(np.float64))
        total[taken] = -1.0
        taken.append(int(total.argmax()))
    return sample[taken]


def nearest(x: np.ndarray, pd: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its exact squared distance, and how many exact distances it took.

    ``pd`` holds the rows' distances to ``pivots``. Bounds are lowered by more than their rounding error before anything is
    ruled out, so a centroid at an equal distance is never lost.
    """
    cd = pivot_distances(centroids, pivots)
    bound = np.zeros((len(x), len(centroids)))
    for p in range(pd.shape[1]):
        gap = np.abs(pd[:, p, None] - cd[None, :, p])
        np.maximum(bound, gap - (pd[:, p, None] + cd[None, :, p]) * 1e-14, out=bound)
    bound = bound * bound * (1 - 1e-12)
    cluster = bound.argmin(axis=1)
    first, best = cluster.copy(), squared(x, centroids[cluster])
    exact = len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        d = squared(x[rows], centroids[c])
        exact += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], c
    return cluster, best, exact


def _table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, x, pd``: the pivot table, written once."""
    kind = vectors.schema["id"].dataType.simpleString()

    def measure(batches):
        for b in batches:
            x = matrix(b.column("x"))
            if x.size and max(x.max(), -x.min()) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}")
            pd = pivot_distances(x, pivots)
            flat = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.ravel())
            yield pa.RecordBatch.from_arrays([b.column("id"), flat(x.astype(np.int32)), flat(pd)], ["id", "x", "pd"])

    return stored(vectors.mapInArrow(measure, f"id {kind}, x array<int>, pd array<double>"), "pivots")


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``cluster, dim, total, n``: sums of the vectors next to each centroid, added up in each task before the shuffle."""
    def add(batches):
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = matrix(b.column("x")).astype(np.int64)
            cluster, _, _ = nearest(x, matrix(b.column("pd")), centroids, pivots)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0)
            n += np.bincount(cluster, minlength=len(n))
        used = np.flatnonzero(n)
        if len(used):
            d = centroids.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(used, d), pa.int32()), pa.array(np.tile(np.arange(d), len(used)), pa.int32()),
                pa.array(total[used].ravel()), pa.array(np.repeat(n[used], d))], ["cluster", "dim", "total", "n"])

    parts = table.select("x", "pd").mapInArrow(add, "cluster int, dim int, total long, n long")
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS,
        seed: str = "1:") -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """``(pivot table, centroids, pivots)`` of ``integer_vectors`` rows after ``rounds`` rounds; None without a vector to start from.

    Centroids start as the vectors with the smallest lowercase-hex sha256 of ``seed`` and the id (ties: smaller components; a
    vector without id is clustered but starts none). Each round moves a centroid to its vectors' componentwise floor(sum / count);
    empty ones stay. The driver holds only centroids, pivots and one sum for each centroid and component.
    """
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    sample = [r.x for r in vectors.where("id IS NOT NULL").select(key.alias("key"), "x").orderBy("key", "x")
              .limit(max(clusters, PIVOT_SAMPLE)).collect()]
    if not sample:
        return None
    sample = np.array(sample, np.int64)
    fixed = choose_pivots(sample, pivots)
    table, centroids = _table(vectors, fixed), sample[:clusters].copy()
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(table, centroids, fixed).collect():
            moved[r.cluster, r.dim] = int(r.total) // r.n
        centroids = moved
    return table, centroids, fixed


def assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every row of the pivot table."""
    kind = table.schema["id"].dataType.simpleString()

    def place(batches):
        for b in batches:
            cluster, best, _ = nearest(matrix(b.column("x")).astype(np.int64), matrix(b.column("pd")), centroids, pivots)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), pa.array(best)], ["id", "cluster", "distance"])

    return table.mapInArrow(place, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: float = SCALE,
            clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256`` for each vector that is kept.

    Repeated rows are vectors of their own; other columns are not read; an empty table, or one without a kept vector that has an
    id, gives no rows. A component whose integer is beyond 2^25 raises. Vectors never move between tasks, so a large cluster is
    no burden; the table that is joined last has a row for each centroid.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    found = fit(integer_vectors(vectors, id_col, vector_col, dims, scale), clusters, rounds, pivots)
    more = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, " + more.split(", ", 1)[1])
    table, centroids, fixed = found
    placed = stored(assign(table, centroids, fixed), "placed")
    inertia = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    shown = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist(),
              hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    return placed.join(F.broadcast(spark.createDataFrame(shown, more)), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``embeddings``."""
    near = """d{r} AS (SELECT u.k, c.cluster, sum((u.v - c.v) * (u.v - c.v)) AS d FROM u JOIN c{r} c USING (i) GROUP BY u.k, c.cluster),
a{r} AS (SELECT k, cluster, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, cluster) = 1)"""
    move = """c{n} AS (SELECT c.cluster, c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT a.cluster, u.i, CAST(floor(CAST(sum(u.v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM a{r} a JOIN u USING (k) GROUP BY ALL) m
  ON m.cluster = c.cluster AND m.i = c.i)"""
    steps = ",\n".join(",\n".join((near.format(r=r), move.format(r=r, n=r + 1))) for r in range(ROUNDS)) + ",\n" + near.format(r=ROUNDS)
    return f"""
WITH e AS (SELECT row_number() OVER () AS k, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS}
           AND NOT list_contains(list_transform(embedding, lambda c: coalesce(isfinite(c), FALSE)), FALSE)),
u AS (SELECT k, unnest(range(1, {DIMS + 1})) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * {SCALE}) AS BIGINT) AS v FROM e),
s AS (SELECT k, CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster FROM e
      WHERE vec_id IS NOT NULL QUALIFY cluster < {CLUSTERS}),
c0 AS (SELECT cluster, i, v FROM s JOIN u USING (k)),
{steps},
h AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT e.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN e USING (k) JOIN h USING (cluster)"""
