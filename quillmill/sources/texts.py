"""Folders of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import slugify


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Columns ``file, text`` of all files below a folder: trimmed, empty ones dropped, Latin-1 where a file is no UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    out = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
    return out.filter("text <> ''")


def joined_texts(texts: DataFrame) -> DataFrame:
    """One row with all texts, in order of file, a blank line between; for corpora that fit one value."""
    return texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def ordered_texts(spark: SparkSession, texts: DataFrame, files: list[str]) -> DataFrame:
    """Texts in a given order of files, numbered; ``files`` is the stated list."""
    order = spark.createDataFrame(list(enumerate(files)), "global_index int, file string")
    return F.broadcast(order).join(texts, "file").select("global_index", "file", "text")


def resolve_files(articles: DataFrame, files: DataFrame, title: str = "title", requested: str = "requested", prefix: int = 8) -> DataFrame:
    """``file`` added: by the title's slug, else the requested name's, else the first file whose name holds the slug's start; null if none."""
    f = files.select(F.col("file"), F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"))
    a = articles.withColumn("_row", F.monotonically_increasing_id()).withColumn("_s1", slugify(F.col(title))).withColumn("_s2", slugify(F.col(requested)))
    x = a.join(f.select(F.col("stem").alias("_s1"), F.col("file").alias("_f1")), "_s1", "left").join(f.select(F.col("stem").alias("_s2"), F.col("file").alias("_f2")), "_s2", "left")
    open_ = x.filter("_f1 IS NULL AND _f2 IS NULL AND length(_s1) > 0").select("_row", F.substring("_s1", 1, prefix).alias("_p"))
    # a stem that holds the start anywhere has it as one of its substrings of that length
    grams = f.filter(F.length("stem") > 0).select("file", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.substring(F.col("stem"), i, F.lit(prefix))))).alias("_p"))
    third = open_.join(grams, "_p").groupBy("_row").agg(F.min("file").alias("_f3"))
    x = x.join(third, "_row", "left").withColumn("file", F.coalesce("_f1", "_f2", "_f3"))
    w = Window.partitionBy("_row").orderBy("file")
    return x.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_row", "_s1", "_s2", "_f1", "_f2", "_f3", "_k")
