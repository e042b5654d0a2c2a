"""Folders of raw files as tables: listed and read in the executors.

Spark's own ``binaryFile`` reader silently drops empty files, names that begin with ``_`` and hidden
folders; an archive must not. Here a tree is listed level by level, each level a job over the folders of the one
before, so neither names nor contents pass the driver. Regular files are taken, but for names that begin
with ``~$`` or ``.``. The folder may lie in any file system Arrow reaches and must be visible to all executors under
the same address. An unreadable file fails the job.
"""

from __future__ import annotations

import posixpath
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import materialize, shuffle_partitions

# Lock files and hidden files by the start of their name.
IGNORED = ("~$", ".")
#: Bytes of contents of a task, about, and of a batch of rows.
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
FILES = "source_path string, size_bytes bigint"


def address(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Arrow reads it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", full)


def _list(root: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(posixpath.join(base, folder) if folder else base))
                names = [posixpath.join(folder, f.base_name) if folder else f.base_name for f in found]
                keep = [i for i, f in enumerate(found) if f.type == pafs.FileType.Directory or f.type == pafs.FileType.File and not f.base_name.startswith(IGNORED)]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.string()), pa.array([found[i].size for i in keep], pa.int64()), pa.array([found[i].type == pafs.FileType.Directory for i in keep], pa.bool_())], ["source_path", "size_bytes", "is_folder"])

    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(source_path, size_bytes)``: relative paths, with ``/``; empty if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], FILES)
    uri, files = address(spark, root), None
    folders = spark.createDataFrame([("",)], "source_path string")
    while True:
        level = materialize(folders.mapInArrow(_list(uri), f"{FILES}, is_folder boolean"), "listing")
        own = level.where("not is_folder").select("source_path", "size_bytes")
        files = own if files is None else files.unionByName(own)
        if not level.where("is_folder").limit(1).count():
            return files
        folders = level.where("is_folder").select("source_path").repartition(shuffle_partitions(spark))


def _read(root: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            contents, first, size = [], 0, 0
            for i, path in enumerate(b.column(0).to_pylist()):
                with fs.open_input_stream(posixpath.join(base, path)) as f:
                    contents.append(f.read())
                size += len(contents[-1])
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*b.schema.names, "content"])
                    contents, first, size = [], i + 1, 0

    return run


def spread(files: DataFrame) -> DataFrame:
    """``files (source_path, size_bytes)`` in partitions of about ``PARTITION_BYTES``, whatever their order."""
    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    return files.repartition(max(1, -(-total // PARTITION_BYTES)), "source_path")


def read_contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``files (source_path, ...)`` with their ``content``; what is sent are the other columns only."""
    rows = files.select("source_path", *(c for c in files.columns if c != "source_path"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_read(address(spark, root)), f"{types}, content binary")


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """All files of a folder with their contents."""
    return read_contents(spark, root, spread(list_files(spark, root)).select("source_path"))
