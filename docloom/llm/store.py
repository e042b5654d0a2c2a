"""The folder of a history: runs, the manifest that names them, and lookups in place.

A store is a folder all executors share. ``manifest-N.json`` is its state number N: the parameters the
store was made with, the number of documents taken so far, and the runs. A new state is written beside
the old one and renamed to its final name, which fails if another writer was there first; readers take
the highest number. So a job that dies leaves the state before it, and files no state names.

A run has Parquet tables in folders ``bucket=B``; a bucket is a power-of-two share of a hash, so buckets
of runs of different size nest. Tables are sorted by their key within a bucket and have small row
groups, so a task that looks for some keys reads the row groups whose range holds one of them and
nothing else. Files are opened through Arrow's file systems, by the address Hadoop gives the folder.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from docloom.sources.raw import address  # noqa: F401

#: Bytes of a row group, before compression: what a lookup reads at least.
ROW_GROUP = 256 << 10
#: Largest number of buckets of a run; a document's number ends with its bucket.
MAX_BUCKETS = 1 << 16
#: Bytes read by lookups of this process, for tests.
READ = {"bytes": 0}


def power(n: float, most: int = MAX_BUCKETS) -> int:
    """The smallest power of two not below ``n``, between 1 and ``most``."""
    return min(most, 1 << max(0, int(np.ceil(np.log2(max(1.0, n))))))


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table of ``bucket`` folders; rows must lie together by bucket and be sorted already."""
    df.write.mode(mode).option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", ROW_GROUP // 4).option("parquet.enable.dictionary", "false").partitionBy("bucket").parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def state(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the latest state; ``(0, None)`` of a folder without any."""
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return 0, None
    found = [int(m[1]) for f in fs.listStatus(p) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()))]
    if not found:
        return 0, None
    file, _ = _hadoop(spark, f"{path}/manifest-{max(found)}.json")
    with_stream = fs.open(file)
    try:
        return max(found), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8"))
    finally:
        with_stream.close()


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Makes ``content`` the state ``number``; fails if that state exists."""
    draft, fs = _hadoop(spark, f"{path}/.draft-{uuid.uuid4().hex}")
    final, _ = _hadoop(spark, f"{path}/manifest-{number}.json")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has made state {number} of {path}")


# In tasks ------------------------------------------------------------------------------------


def _files(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            yield pq.ParquetFile(fs.open_input_file(f.path))


def overlapping(uri: str, first: str, last: str, lo: np.ndarray, hi: np.ndarray, columns: list[str]):
    """Row groups of a bucket that hold rows whose range (columns ``first`` to ``last``) meets one of
    the ranges ``lo`` to ``hi``; these are ascending and do not overlap."""
    for file in _files(uri):
        meta, names = file.metadata, file.schema_arrow.names
        a, b = names.index(first), names.index(last)
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            x, y = group.column(a).statistics, group.column(b).statistics
            if x is not None and y is not None and x.has_min_max and y.has_min_max:
                at = int(np.searchsorted(hi, x.min))
                if at == len(hi) or lo[at] > y.max:
                    continue
            READ["bytes"] += sum(group.column(names.index(c)).total_compressed_size for c in columns)
            yield file.read_row_group(g, columns=columns)


def everything(uri: str, columns: list[str]):
    """All row groups of a bucket."""
    for file in _files(uri):
        for g in range(file.metadata.num_row_groups):
            yield file.read_row_group(g, columns=columns)


def rows_of(uri: str, key: str, wanted: np.ndarray, columns: list[str]):
    """The rows of a bucket whose ``key`` (bigint, never null) is among the ascending ``wanted``."""
    for table in overlapping(uri, key, key, wanted, wanted, list(dict.fromkeys([key, *columns]))):
        own = table[key].to_numpy()
        at = np.searchsorted(wanted, own)
        found = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == own)
        if len(found):
            yield table.take(pa.array(found))


def buckets_of(bucket: int, among: int, stored: int) -> list[int]:
    """The buckets of a run with ``stored`` of them that hold the keys of ``bucket`` of ``among``."""
    return [bucket % stored] if stored <= among else list(range(bucket, stored, among))
