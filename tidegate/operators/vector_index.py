"""An inverted-file index of vectors: rows lie in lists by their nearest centroid, and a search reads few lists.

Centroids are fitted on a bounded sample; every row is indexed. Lists are folders of Parquet files, so a search prunes to
the lists that it names. Approximate searches read the `probes` nearest lists, a number chosen by measured recall; exact
ones go on to every list that the triangle inequality leaves in question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators import search
from tidegate.storage import new_path

#: Rows that centroids are fitted on, in expectation; rounds of fitting; lists at most.
FIT_ROWS, FIT_ROUNDS, MOST_LISTS = 20_000, 10, 1024
#: Recall of the ten nearest that `probes` must reach among the sample, and how many of its vectors are asked for theirs.
RECALL, ASKED = 0.97, 200
LIST = "_list"


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame  # all rows of the table, with their list; -1: no vector of the index's dimensions
    column: str
    centroids: np.ndarray
    radii: np.ndarray  # of each list, the greatest distance of a row from the centroid
    probes: int


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)))


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    centers = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = _distances(x, centers).argmin(1)
        for i in np.unique(nearest):
            centers[i] = x[nearest == i].mean(0)
    return centers


def _probes(x: np.ndarray, centers: np.ndarray) -> int:
    """The least number of lists that holds RECALL of the sample's own ten nearest."""
    asked, mine = x[:ASKED], _distances(x, centers).argmin(1)
    near = np.argsort(_distances(asked, x), axis=1, kind="stable")[:, :10]
    rank = np.argsort(np.argsort(_distances(asked, centers), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(rank, mine[near], axis=1).ravel() + 1
    return int(np.quantile(needed, RECALL, method="higher"))


def build(df: DataFrame, column: str) -> VectorIndex:
    """Index every row of df by its vectors. Those that are null, hold a null, or have other than the most usual dimensions
    lie in list -1; an empty table gives an index without lists."""
    spark = df.sparkSession
    vector = F.col(f"`{column}`").cast("array<double>")
    good = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    sizes = df.filter(good).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    fits = good & (F.size(vector) == dims)
    draw = F.pmod(F.xxhash64(vector), F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 30)))
    x = np.array([r[0] for r in df.filter(fits & draw).select(vector).limit(2 * FIT_ROWS).collect()], float).reshape(-1, max(1, dims))
    lists = min(MOST_LISTS, max(1, int(len(x) ** 0.5))) if len(x) else 0
    centers = _fit(x, lists) if lists else np.zeros((0, max(1, dims)))

    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            out = pd.DataFrame({"list": np.full(len(v), -1), "away": np.zeros(len(v))})
            ok = v.notna().to_numpy() & bool(len(centers))
            if ok.any():
                d = _distances(np.stack(v[ok].to_list()).astype(float), centers)
                out.loc[ok, "list"], out.loc[ok, "away"] = d.argmin(1), d.min(1)
            yield out

    place = F.pandas_udf(assign, "list int, away double")
    found = df.withColumn("_place", place(F.when(fits, vector))).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_place.list").alias(LIST), F.col("_place.away").alias("_away"))
    path = new_path(spark, "vectors")
    found.repartition(LIST).write.partitionBy(LIST).parquet(path)
    rows = spark.read.schema(found.schema).parquet(path)
    radii = np.zeros(lists)
    for r in rows.filter(f"{LIST} >= 0").groupBy(LIST).agg(F.max("_away").alias("r")).collect():  # a row for each list
        radii[r[LIST]] = r["r"]
    return VectorIndex(rows.drop("_away"), column, centers, radii, _probes(x, centers) if lists > 1 else lists)


def nearest(index: VectorIndex, q: list[float], k: int, tie: str | None = None, exact: bool = True) -> DataFrame:
    """The k nearest rows by L2 distance, with it as `distance`.

    exact: all of them, whatever lists they lie in. Otherwise those of the `probes` nearest lists, of which now and then
    one is missing. If the lists hold fewer than k rows, the whole table is searched.
    """
    whole = index.rows.drop(LIST)
    if not len(index.centroids) or len(q) != index.centroids.shape[1]:
        return search.knn(whole, index.column, q, k, tie=tie)
    away = _distances(np.array([q], float), index.centroids)[0]
    near = np.argsort(away, kind="stable")[: index.probes].tolist()
    found = search.knn(index.rows.filter(F.col(LIST).isin(near)).drop(LIST), index.column, q, k, tie=tie)
    if not exact:
        return found
    rows = [r["distance"] for r in found.select("distance").collect()]  # k at most
    if len(rows) < k or rows[-1] is None:
        return search.knn(whole, index.column, q, k, tie=tie)
    reach = np.flatnonzero(away - index.radii <= rows[-1] * (1 + 1e-9) + 1e-9).tolist()
    return search.knn(index.rows.filter(F.col(LIST).isin(reach)).drop(LIST), index.column, q, k, tie=tie)
