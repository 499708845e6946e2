"""Vector and full-text search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import vector


def _query(q: list[float]) -> str:
    return f"array({', '.join(f'{float(x)!r}D' for x in q)})"


def knn(df: DataFrame, column: str, q: list[float], k: int, metric: str = "L2_DISTANCE", tie: str | None = None) -> DataFrame:
    """The k nearest rows by exact distance, with it as `distance`; a partial top-k in every task.

    L2 distances ascend; similarities (COSINE_SIMILARITY, INNER_PRODUCT) descend.
    """
    out = df.withColumn("distance", F.expr(vector.FUNCTIONS[metric](column, _query(q))))
    order = F.col("distance").asc_nulls_last() if metric.startswith("L2") else F.col("distance").desc_nulls_last()
    return out.orderBy(order, *([F.col(tie)] if tie else [])).limit(k)


def within(df: DataFrame, column: str, q: list[float], radius: float) -> DataFrame:
    """The rows within an L2 distance."""
    return df.withColumn("distance", F.expr(vector.l2_distance(column, _query(q)))).filter(F.col("distance") <= radius)


def knn_join(queries: DataFrame, df: DataFrame, key: str, query_column: str, tie: str, column: str, k: int, block: int = 256) -> DataFrame:
    """For each query row its k nearest rows of df by L2 distance: (key, tie, distance, rank). Queries are a stated set, in blocks.

    Each block of queries is broadcast to a scan of df, in which every task keeps its k nearest rows of each query only.
    Rows and queries without a vector are near nothing; vectors of different dimensions are infinitely far apart. key and
    tie are whole numbers; of equal distances the least tie comes first.
    """
    spark, out, part = df.sparkSession, None, []
    narrow = df.select(F.col(tie).cast("long").alias("_t"), F.col(column).cast("array<double>").alias("_v")).filter("_v IS NOT NULL AND NOT exists(_v, x -> x IS NULL)")

    def nearest(part: list[tuple[int, list[float]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [(q, np.array(v, float)) for q, v in shared.value]
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in asked]
            for batch in batches:
                ids, vectors = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.diff(vectors.offsets.to_numpy())
                flat = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()]
                starts = np.cumsum(sizes) - sizes
                by_size = {n: flat[(starts[sizes == n][:, None] + np.arange(n)).ravel()].reshape(-1, n) for n in {len(v) for _, v in asked} & set(sizes.tolist())}
                for i, (_, v) in enumerate(asked):
                    away = np.full(len(ids), np.inf)
                    if len(v) in by_size:
                        away[sizes == len(v)] = np.sqrt(((by_size[len(v)] - v) ** 2).sum(1))
                    if len(best[i][0]) == k:  # few rows of a batch come into question
                        some = away <= best[i][0][-1]
                        away, mine = away[some], ids[some]
                    else:
                        mine = ids
                    away, mine = np.concatenate([best[i][0], away]), np.concatenate([best[i][1], mine])
                    first = np.lexsort((mine, away))[:k]
                    best[i] = away[first], mine[first]
            for (q, _), (away, mine) in zip(asked, best):
                yield pa.record_batch([pa.array(np.full(len(mine), q, np.int64)), pa.array(mine), pa.array(away)], [key, tie, "distance"])

        return narrow.mapInArrow(search, f"`{key}` long, `{tie}` long, distance double")

    for r in queries.filter(F.col(query_column).isNotNull()).select(key, F.col(query_column).cast("array<double>")).toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == block:
            out, part = nearest(part) if out is None else out.unionAll(nearest(part)), []
    if part or out is None:
        out = nearest(part) if out is None else out.unionAll(nearest(part))
    w = Window.partitionBy(key).orderBy("distance", tie)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tokens(column: str) -> str:
    """Words of a text: runs of ASCII letters and digits, lower-cased."""
    return f"regexp_extract_all(lower({column}), '[a-z0-9]+', 0)"


def match(df: DataFrame, columns: list[str], words: str) -> DataFrame:
    """MATCH (columns) AGAINST (words): each word is part of some column."""
    found = re.findall("[a-z0-9]+", words.lower())
    test = F.lit(bool(found))
    for w in found:
        any_column = F.lit(False)
        for c in columns:
            any_column = any_column | F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False))
        test = test & any_column
    return df.filter(test)


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A full-text index: (word, key), each pair once."""
    text = f"concat_ws(' ', {', '.join(columns)})"
    return df.select(key, F.explode(F.array_distinct(F.expr(tokens(text)))).alias("word")).select("word", key)


def search(index: DataFrame, key: str, words: str) -> DataFrame:
    """Keys whose rows hold every word: the words' postings only are read, and counted by key."""
    found = sorted(set(re.findall("[a-z0-9]+", words.lower())))
    hits = index.filter(F.col("word").isin(found) if found else F.lit(False))
    return hits.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(found)).select(key)
