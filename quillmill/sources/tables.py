"""JSON lines, JSON arrays, CSV, Parquet, GraphML, reports and snapshots."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines skipped; a missing path gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Run log with broken lines dropped: rows with an id and without error."""
    corrupt = "_broken"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)
    fine = F.col(corrupt).isNull() & F.col("id").isNotNull()
    return rows.filter(fine & F.col("error").isNull() if "error" in schema.names else fine).drop(corrupt)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Overwritten as a whole or appended to per batch; text stays UTF-8."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str, field: str = "questions") -> DataFrame:
    """A JSON array of rows, or an object that holds them under ``field``."""
    raw = spark.read.text(path, wholetext=True)
    is_list = F.trim("value").startswith("[")
    rows = F.when(is_list, F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.from_json("value", f"struct<{field}:array<struct<{schema}>>>").getField(field))
    return raw.select(F.inline(rows))


def read_manifest(spark: SparkSession, path: str, status: str | None = "ok") -> DataFrame:
    """CSV with header and quoted fields; only rows of one status unless that is None."""
    df = spark.read.csv(path, header=True, schema="group string, requested string, title string, url string, words int, status string", quote='"', escape='"')
    return df if status is None else df.filter(F.col("status") == status)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet with a check that the columns are there."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*columns)


def read_text_map(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``id, text`` of one JSON object that maps numbers to texts."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "text"))
    return raw.select(F.expr("try_cast(id as bigint)").alias("id"), "text")


def read_key_value(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Columns ``key`` and those of ``value`` of one JSON object keyed by id."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("key", "v")).select("key", "v.*")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes) and edges (source, target, attributes), attributes as a map named by the file's keys."""
    key = spark.read.format("xml").option("rowTag", "key").schema("`_id` string, `_attr.name` string").load(path)
    names = {r[0]: r[1] for r in key.collect()}  # one row per attribute name
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map(F.lit(""), F.lit(""))
    data = "data array<struct<`_key`:string,`_VALUE`:string>>"

    def rows(tag: str, ids: str) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", tag).schema(f"{ids}, {data}").load(path)
        pairs = F.transform("data", lambda x: F.struct(F.coalesce(mapping[x["_key"]], x["_key"]).alias("k"), x["_VALUE"].alias("v")))
        return df.withColumn("attributes", F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")))).drop("data")

    nodes = rows("node", "`_id` string").withColumnRenamed("_id", "id")
    edges = rows("edge", "`_source` string, `_target` string").withColumnsRenamed({"_source": "source", "_target": "target"})
    return nodes, edges


def encode_matrix(df: DataFrame, vector: str, out: str = "encoded") -> DataFrame:
    """Vectors as base64 of their float32 bytes."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import numpy as np

        for pdf in batches:
            yield pdf.assign(**{out: [None if v is None else base64.b64encode(np.asarray(v, dtype=np.float32).tobytes()).decode() for v in pdf[vector]]})

    return df.mapInPandas(run, f"{fields}, `{out}` string")


def decode_matrix(df: DataFrame, column: str, dims: int, out: str = "vectors") -> DataFrame:
    """The rows of a base64 float32 matrix, one array per row of ``dims`` numbers."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import numpy as np

        for pdf in batches:
            yield pdf.assign(**{out: [None if s is None else [list(map(float, r)) for r in np.frombuffer(base64.b64decode(s), dtype=np.float32).reshape(-1, dims)] for s in pdf[column]]})

    return df.mapInPandas(run, f"{fields}, `{out}` array<array<float>>")


def replace_vectors(store: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """A vector store with new vectors where there are some; everything else is kept."""
    return store.join(vectors.select(key, F.col(vector).alias("_new")), key, "left").withColumn(vector, F.coalesce("_new", vector)).drop("_new")


def write_report(df: DataFrame, path: str, heading: str, body: str) -> None:
    """A markdown report: headings and bodies in order of heading."""
    lines = df.select(F.concat(F.lit("## "), F.col(heading), F.lit("\n\n"), F.col(body), F.lit("\n")).alias("value")).orderBy("value")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_json_report(path: str, **parts: DataFrame | dict) -> None:
    """Small summary tables as one nested JSON file."""
    out = {k: v if isinstance(v, dict) else [r.asDict(recursive=True) for r in v.collect()] for k, v in parts.items()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=2, default=str)


def ensure_cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at ``path`` if it was written before, else the computed one, written there."""
    if not _exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)
