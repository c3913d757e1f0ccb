"""G8, dense form: the nearest rows of a stated query set by cosine, exactly in blocks or through an inverted-file index.

Similarities are rounded to nine places before they are ranked, and ties go to the smaller id, so both modes and SQL agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.ranking import top_k_per_group
from threadlens.operators.sampling import sample_n
from threadlens.session import materialize, scratch_path

#: Query vectors that one pass of the exact mode sends to every task (64 components: 2 MB).
QUERY_BLOCK = 4096
#: Rows, and queries, that meet in one group of the index's probe join.
CELL_BLOCK = 4096
#: Similarities that a task holds at once (8 MB, and some copies of them).
SIMILARITIES = 1_000_000
#: Vectors that the index's centroids are fitted on (those with the smallest hash keys), and the most centroids.
FIT_SAMPLE = 20_000
MAX_CELLS = 4096
#: Queries that the number of probed cells is tuned on, and the share of their neighbours that must lie in those cells.
TUNE_QUERIES = 256
TARGET_RECALL = 0.95
DIGITS = 9


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: vectors of length 1. Null, empty and zero vectors and those with a null or non-finite component are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    df = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), x.alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))
    df = df.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return df.select("id", F.transform("x", lambda c: c / F.col("norm")).alias("v"))


def _best(ids: np.ndarray, sims: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query row, row)`` of the ``k`` best rows of each query (similarity descending, id ascending), without the query itself."""
    sims = np.where(ids[None, :] == own[:, None], -np.inf, sims)
    k = min(k, sims.shape[1])
    # all rows that could be among the k best, ties at the border included, are ranked exactly
    border = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
    q, r = np.nonzero((sims >= border[:, None]) & (sims > -np.inf))
    order = np.lexsort((ids[r], -sims[q, r], q))
    q, r = q[order], r[order]
    first = np.searchsorted(q, np.arange(len(own)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], r[keep]


def _pairs(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    if not len(ids) or not len(query_ids):
        return pd.DataFrame({"query": [], "id": [], "cosine": []}).astype({"query": "int64", "id": "int64", "cosine": "float64"})
    step, found = max(1, SIMILARITIES // len(ids)), []
    for at in range(0, len(query_ids), step):
        own = query_ids[at:at + step]
        sims = np.round(queries[at:at + step] @ rows.T, DIGITS)
        q, r = _best(ids, sims, own, k)
        found.append(pd.DataFrame({"query": own[q], "id": ids[r], "cosine": sims[q, r]}))
    return pd.concat(found, ignore_index=True)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(pairs, ["query"], [F.col("cosine").desc(), F.col("id")], k).select("query", "id", "cosine", "rank")


def nearest_exact(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query, id, cosine, rank``: the ``k`` nearest rows (not the query's own) of every query; both are :func:`unit_vectors`.

    The queries go out in blocks of a fixed size; a task keeps the ``k`` best of its rows for each query of the block, so what is
    shuffled is tasks x queries x k and never the pairs. Ids are integers.
    """
    rows, spark = materialize(rows, "rows"), rows.sparkSession
    queries = materialize(queries, "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    path, found_any = scratch_path(spark, "nearest"), False
    for b in range(blocks):     # dealt by hash: each block has about QUERY_BLOCK queries, however many there are
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast((block["id"].to_numpy(), np.stack(block["v"].to_numpy())))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            query_ids, q = sent.value
            best = None
            for batch in batches:
                if len(batch):
                    found = _pairs(query_ids, q, batch["id"].to_numpy(), np.stack(batch["v"].to_numpy()), k)
                    best = found if best is None else pd.concat([best, found])
                    best = best.sort_values(["query", "cosine", "id"], ascending=[True, False, True]).groupby("query").head(k)
            if best is not None:
                yield best

        # every block's best rows go to one table and its queries are given back, so neither the plan nor the driver grows with the blocks
        rows.mapInPandas(search, "query long, id long, cosine double").write.mode("append").parquet(path)
        sent.destroy()
        found_any = True
    if not found_any:
        return spark.createDataFrame([], "query long, id long, cosine double, rank int")
    return _ranked(spark.read.schema("query long, id long, cosine double").parquet(path), k)


@dataclass
class InvertedFile:
    """``rows``: (cell, block, id, v) of every row, in blocks of at most about :data:`CELL_BLOCK`. ``sizes``: blocks of each cell."""

    centroids: np.ndarray
    rows: DataFrame
    sizes: DataFrame


def _cells(df: DataFrame, centroids: np.ndarray, n: int, name: str) -> DataFrame:
    """Add ``name``: the ``n`` cells whose centroids have the largest dot product with ``v``, best first."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch, len(centroids)):
                yield part.assign(**{name: list(_order(part, centroids)[:, :n].astype("int32"))})

    return df.mapInPandas(place, f"id long, v array<double>, {name} array<int>")


def _slices(batch: pd.DataFrame, columns: int) -> Iterator[pd.DataFrame]:
    """The rows of ``batch``, so many at a time that :data:`SIMILARITIES` are held at once."""
    step = max(1, SIMILARITIES // max(columns, 1))
    for at in range(0, len(batch), step):
        yield batch.iloc[at:at + step]


def _order(batch: pd.DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The cells of each row, best first."""
    return np.argsort(-(np.stack(batch["v"].to_numpy()) @ centroids.T), axis=1, kind="stable")


def _places(homes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``place, n``: how often a cell of ``homes`` (id, v, cells ARRAY<INT>) is the row's ``place``-th best, from 0."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for part in _slices(batch, len(centroids)):
                rank = np.argsort(_order(part, centroids), axis=1)
                cells = part["cells"].to_numpy()
                row = np.repeat(np.arange(len(part)), [len(c) for c in cells])
                counts += np.bincount(rank[row, np.concatenate(cells)], minlength=len(counts))
        at = np.nonzero(counts)[0]
        yield pd.DataFrame({"place": at.astype("int32"), "n": counts[at]})

    return homes.mapInPandas(place, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))


def build_index(rows: DataFrame, cells: int | None = None, seed: int = 42, fit_on: int | None = FIT_SAMPLE) -> InvertedFile:
    """Assign every row to its nearest centroid; centroids are fitted on at most ``fit_on`` rows (None: on all).

    ``cells`` is the root of the number of rows by default, and :data:`MAX_CELLS` at most. A cell with many rows is stored in
    blocks, so no later group depends on how full a cell is.
    """
    rows = materialize(rows, "unit")
    n = rows.count()
    cells = min(cells or max(1, round(n ** 0.5)), MAX_CELLS, max(n, 1))
    fitted = rows if fit_on is None else sample_n(rows, fit_on, seed, "id")
    sample = materialize(fitted.select(array_to_vector("v").alias("features")), "fit")
    centers = KMeans(k=cells, seed=seed, maxIter=10).fit(sample).clusterCenters() if n else []
    centroids = np.array(centers, np.float64)
    if not n:
        empty = rows.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("block"), "id", "v")
        return InvertedFile(centroids, empty, empty.groupBy("cell").agg(F.lit(1).cast("long").alias("blocks")))
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    placed = materialize(_cells(rows, centroids, 1, "near").select(F.col("near")[0].alias("cell"), "id", "v"), "cells")
    sizes = materialize(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    return InvertedFile(centroids, materialize(placed.join(F.broadcast(sizes), "cell").select("cell", block.alias("block"), "id", "v"), "index"), sizes)


def tuned_probes(index: InvertedFile, k: int = 10, target: float = TARGET_RECALL, seed: int = 7, true: DataFrame | None = None) -> int:
    """The number of cells to probe so that ``target`` of the true ``k`` nearest rows lie in them.

    ``true`` are the exact neighbours ``(query, id)`` of the rows to tune on; without it, of a sample: the :data:`TUNE_QUERIES` rows
    with the smallest hash keys, searched exactly among all rows. How many cells it takes depends on how well the vectors cluster.
    """
    rows = index.rows.select("id", "v")
    if true is None:
        true = nearest_exact(rows, materialize(sample_n(rows, TUNE_QUERIES, seed, "id"), "tune"), k)
    homes = true.select("query", "id").join(index.rows.select("id", "cell"), "id")
    homes = homes.groupBy(F.col("query").alias("id")).agg(F.collect_list("cell").alias("cells"))    # k cells at most
    places = _places(rows.join(homes, "id").select("id", "v", "cells"), index.centroids).orderBy("place").collect()
    left = target * sum(r.n for r in places)
    for r in places:        # one row for each place, at most MAX_CELLS
        left -= r.n
        if left <= 0:
            return r.place + 1
    return max(len(index.centroids), 1)


def nearest_indexed(index: InvertedFile, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """``query, id, cosine, rank`` among the rows of the ``probes`` cells nearest to each query (default: :func:`tuned_probes`).

    Similarities are exact; a neighbour in a cell that is not probed is missed. With all cells probed the result is that of
    :func:`nearest_exact`. Queries and rows meet by (cell, block of rows, block of queries), each of bounded size.
    """
    spark = queries.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], "query long, id long, cosine double, rank int")
    probes = min(probes or tuned_probes(index, k), len(index.centroids))
    probing = materialize(_cells(queries, index.centroids, probes, "near").select("id", "v", F.explode("near").alias("cell")), "probes")
    asked = materialize(probing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).alias("asks")), "asked")
    # at most MAX_CELLS rows in sizes and asked
    left = probing.join(F.broadcast(asked), "cell").join(F.broadcast(index.sizes), "cell") \
        .select("cell", F.pmod(F.xxhash64("id"), F.col("asks")).alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "v")
    right = index.rows.join(F.broadcast(asked), "cell") \
        .select("cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)).alias("ask"), "id", "v")

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return _pairs(np.zeros(0), None, np.zeros(0), None, k)
        return _pairs(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), r["id"].to_numpy(), np.stack(r["v"].to_numpy()), k)

    by = ["cell", "block", "ask"]
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query long, id long, cosine double")
    return _ranked(pairs, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n, hits, recall``: the share of the exact pairs that were found (one row)."""
    hit = found.select("query", "id", F.lit(1).alias("hit"))
    both = exact.select("query", "id").join(hit, ["query", "id"], "left")
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return counts.select("n", "hits", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("recall"))
