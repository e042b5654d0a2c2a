"""Embedding columns: class means, cosine scores, exact nearest neighbours.

Class means are partial aggregates and as few as there are classes; scoring multiplies Arrow batches
with their matrix. Neighbours are searched for blocks of queries of bounded size: each task keeps the
best k of its rows per query, and only those are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import shared_path
from docloom.sources.raw import address

MAX_CLASSES = 10_000
QUERY_BLOCK = 1024
BASE_BLOCK = 4096


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> tuple[list, np.ndarray]:
    """Labels in order and the mean vector of each; null vectors and labels are left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("k"), F.posexplode(vector).alias("i", "x"))
    means = rows.groupBy("k", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    per = means.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v")).orderBy("k").limit(MAX_CLASSES + 1).collect()
    if len(per) > MAX_CLASSES:
        raise ValueError("more classes than class means may be sent to the executors for")
    return [r["k"] for r in per], np.array([r["v"] for r in per], float).reshape(len(per), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def scores(df: DataFrame, means: np.ndarray, keep: list[str], vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``keep`` and ``scores``: similarity to each class mean (cosine, or minus the squared distance)."""
    chosen = df.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).alias("__v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", scores array<double>"
    unit = unit_rows(means) if len(means) else means

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(b.num_columns - 1))
            s = unit_rows(x) @ unit.T if metric == "cosine" else -((x[:, None, :] - means[None]) ** 2).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], "scores"])

    return chosen.mapInArrow(run, schema)


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """``(query, neighbour, similarity, rank)``: the exact k nearest of ``base`` by cosine, the query itself left out.

    Queries are written to the shared folder in blocks of ``block``; the base is scanned once, and every task takes its rows
    in blocks of ``BASE_BLOCK`` through all query blocks, which it reads one at a time. Only the best k of a pair of
    blocks are shuffled. Ties go to the smaller key.
    """
    spark = queries.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    path = shared_path(spark, "queries")
    q.mapInArrow(_blocked(block), "ids binary, vectors binary").write.parquet(path)
    b = base.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    found = b.mapInArrow(_best(address(spark, path), k), "query bigint, neighbour bigint, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _blocked(block: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([unit_rows(_matrix(part.column(1))).tobytes()], pa.binary())], ["ids", "vectors"])

    return run


def _query_blocks(uri: str):
    """The blocks of the folder, one at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.base_name.endswith(".parquet"):
            for batch in pq.ParquetFile(fs.open_input_file(f.path)).iter_batches(1):
                for ids, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = np.frombuffer(ids, np.int64)
                    yield own, np.frombuffer(vectors, float).reshape(len(own), -1)


def _best(uri: str, k: int):
    def compared(rows: list):
        own = np.concatenate([r[0] for r in rows])
        base = np.concatenate([r[1] for r in rows])
        for ids, m in _query_blocks(uri):
            # Rounded so that equal similarities are equal in every engine and block.
            s = np.round(m @ base.T, 9)
            s[ids[:, None] == own[None]] = -np.inf
            take = min(k, len(own))
            order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :take]
            sims = np.take_along_axis(s, order, 1)
            ok = np.isfinite(sims).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)[ok]), pa.array(own[order].ravel()[ok]), pa.array(sims.ravel()[ok])], ["query", "neighbour", "similarity"])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for part in (b.slice(lo, BASE_BLOCK) for lo in range(0, b.num_rows, BASE_BLOCK)):
                rows.append((part.column(0).to_numpy(), unit_rows(_matrix(part.column(1)))))
                size += part.num_rows
                if size >= BASE_BLOCK:
                    yield from compared(rows)
                    rows, size = [], 0
        if rows:
            yield from compared(rows)

    return run
