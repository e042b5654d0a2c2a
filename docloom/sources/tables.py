"""Parquet tables and YAML configuration.

Tables are appended to by adding files, never by rewriting what is there. Paths may lie in any
file system Hadoop can reach.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources import schemas

HEADER = "# The frozen assignment of templates to splits. Entries never change; new templates are appended.\n"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the archive; one that is not there yet is empty, not an error."""
    path, schema = f"{folder}/{name}.parquet", schemas.TABLES[name]
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def append_table(df: DataFrame, folder: str, name: str) -> None:
    """Adds rows; columns must be those of the schema (by name), else the write is refused."""
    schema = schemas.TABLES[name]
    if set(df.columns) != set(schema.fieldNames()):
        raise ValueError(f"{name}: columns {sorted(df.columns)} are not {sorted(schema.fieldNames())}")
    have = dict(df.dtypes)
    wrong = [f.name for f in schema if have[f.name] != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{name}: other types than the schema's in {wrong}")
    df.select(*schema.fieldNames()).write.mode("append").parquet(f"{folder}/{name}.parquet")


def overwrite_table(df: DataFrame, folder: str, name: str) -> None:
    df.select(*schemas.TABLES[name].fieldNames()).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def load_classes(spark: SparkSession, path: str) -> DataFrame:
    """The class configuration; a key given twice is an error that names the keys."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    rows = [(c["key"], c["name"], c["description"], c["not"], bool(c.get("residual", False))) for c in data["classes"]]
    df = schemas.to_frame(spark, rows, "classes")
    twice = sorted(r["key"] for r in df.groupBy("key").count().where("count > 1").collect())
    if twice:
        raise ValueError(f"class keys given twice: {', '.join(twice)}")
    return df


def class_keys(classes: DataFrame) -> DataFrame:
    return classes.select("key")


def get_class(classes: DataFrame, key: str):
    row = classes.where(F.col("key") == key).first()
    if row is None:
        raise KeyError(f"unknown class {key!r}")
    return row


def trainable(classes: DataFrame) -> DataFrame:
    """All but the residual class, which is reached by rejection."""
    return classes.where(~F.col("residual"))


def load_splits(path: str) -> dict[str, str]:
    """The frozen assignment; a missing or empty file is an empty one, an unknown split an error."""
    import yaml

    p = Path(path)
    data = (yaml.safe_load(p.read_text(encoding="utf-8")) if p.exists() else None) or {}
    out = {str(k): str(v) for k, v in (data.get("splits") or {}).items()}
    wrong = sorted({v for v in out.values() if v not in schemas.SPLIT_VALUES})
    if wrong:
        raise ValueError(f"unknown splits: {', '.join(wrong)}")
    return out


def save_splits(splits: dict[str, str], path: str) -> None:
    """Writes the assignment in the order of its keys; the file is replaced at once or not at all."""
    import yaml

    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    temp = p.with_name(p.name + ".tmp")
    temp.write_text(HEADER + yaml.safe_dump({"version": 1, "splits": dict(sorted(splits.items()))}, allow_unicode=True, sort_keys=False), encoding="utf-8")
    os.replace(temp, p)


def splits_frame(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    return schemas.to_frame(spark, sorted(splits.items()), "splits")


def register(spark: SparkSession, folder: str) -> None:
    """The tables of an archive as views for SQL, and the text functions under their names."""
    from docloom.functions import detect, text

    for name in schemas.TABLES:
        if name != "classes":
            read_table(spark, folder, name).createOrReplaceTempView(name)
    spark.udf.register("normalize_text", text.normalize_text)
    spark.udf.register("nfkc", text.nfkc)
    spark.udf.register("archive_kind", detect._archive_kind)
