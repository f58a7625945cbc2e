"""An index of vectors by cells around centroids (inverted file), for approximate nearest neighbours by cosine.

Centroids are fitted by k-means on the driver to at most ``SAMPLE`` unit vectors, picked by the hash
of their key; every vector is indexed. A query visits its nearest cells, and the rows of
those are ranked exactly. How many cells a query must visit depends on how well the vectors cluster,
so ``fit`` measures it on the sample: the least number with which up to ``TRIALS`` of its vectors find
``TARGET`` of their ten nearest ones. A cell is an equi-join key of plain tables, so a crowded one can
be split by AQE.

Defined results: null vectors are left out; a zero vector has cosine 0 with all; ties go to the smaller
key; without vectors the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators.retrieval import _unit, top_per
from foliomill.runtime import cut, spread

#: Most vectors that the centroids are fitted to, rounds of k-means, and most cells (the centroids are broadcast).
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 4096
#: Recall that is aimed at, and vectors it is measured with.
TARGET, TRIALS = 0.94, 200


def fit(vectors: DataFrame, key: str, vector: str, cells: int | None = None) -> tuple[np.ndarray, int]:
    """Unit centroids of about sqrt(rows) cells, and the number of cells to visit."""
    rows = vectors.where(F.col(vector).isNotNull())
    n = rows.count()
    if not n:
        return np.zeros((0, 0)), 0
    # a limit on the sample is part of the method: it bounds what the driver fits, not what is indexed
    picked = rows.select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(SAMPLE).toPandas()
    points = _unit(np.stack(picked["v"].to_numpy()).astype(np.float64))
    k = min(cells or max(1, int(n**0.5)), MOST_CELLS, len(points))
    centre = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (points @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, points)
        filled = np.linalg.norm(sums, axis=1) > 0
        centre[filled] = _unit(sums[filled])
    cell = (points @ centre.T).argmax(1)
    asking = points[: TRIALS]
    nearest = np.argsort(-(asking @ points.T), axis=1, kind="stable")[:, :10]
    place = np.argsort(np.argsort(-(asking @ centre.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[nearest], 1).ravel()) + 1
    return centre, int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))])


def _in_cells(rows: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, cell, v) of each row for its ``probes`` nearest cells; ``v`` is the unit vector."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = shared.value
        for batch in batches:
            unit = _unit(np.stack(batch["v"].to_numpy()).astype(np.float64))
            near = np.argsort(-(unit @ centre.T), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), near.shape[1]), "cell": near.ravel(), "v": list(np.repeat(unit, near.shape[1], axis=0))})

    picked = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null")
    return spread(picked, "id").mapInPandas(assign, "id long, cell int, v array<double>")


def indexed_search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, top: int, probes: int | None = None) -> DataFrame:
    """(query, doc, score, rank) of the best ``top`` rows out of each query's nearest cells (``probes``, or as many as ``fit`` finds necessary)."""
    centroids, necessary = fit(vectors, key, vector)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "query long, doc long, score double, rank int")
    index = cut(_in_cells(vectors, key, vector, centroids, 1))
    asked = cut(_in_cells(queries, key, vector, centroids, probes or necessary))
    pairs = asked.select(F.col("id").alias("query"), "cell", F.col("v").alias("q")).join(index.select(F.col("id").alias("doc"), "cell", "v"), "cell")
    cosine = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return top_per(pairs.select("query", "doc", F.round(cosine, 6).alias("score")), "query", [F.col("score").desc(), F.col("doc")], top)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_queries, n_exact, recall): the share of the exact results that were found."""
    hit = exact.select("query", "doc").join(found.select("query", "doc", F.lit(1).alias("hit")), ["query", "doc"], "left")
    return hit.agg(F.countDistinct("query").alias("n_queries"), F.count("*").alias("n_exact"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
