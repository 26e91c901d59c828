"""Answer runs: latest state, resuming, summaries, deltas, intervals, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.skew import numbered
from quillmill.functions.text import unit_hash


def ok_rows(runs: DataFrame, run_id: str = "id", error: str = "error") -> DataFrame:
    return runs.filter(F.col(run_id).isNotNull() & F.col(error).isNull())


def latest(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: a struct maximum, combined before the shuffle."""
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def still_to_do(tasks: DataFrame, runs: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Tasks without a run that ended well; failed runs are tried again."""
    done = runs.filter(F.col(error).isNull()).select(*keys).distinct()
    return tasks.join(done, keys, "left_anti")


def complete(runs: DataFrame, target: int, keys: list[str], error: str = "error") -> Column:
    """Gate: whether as many keys as wanted are done."""
    return runs.filter(F.col(error).isNull()).agg(F.countDistinct(*keys).alias("done")).select((F.col("done") >= target).alias("complete"), "done")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cached(texts: DataFrame, cache: DataFrame, text: str, key: str = "key") -> DataFrame:
    """Texts with the cached result of their content hash, null where there is none."""
    return texts.withColumn(key, F.md5(text)).join(cache, key, "left")


def delta(runs: DataFrame, name: str, phase: Column, value: str, before: str, after: str) -> DataFrame:
    """Columns ``name, pre, post, delta``: means per phase side by side, 0 where one is missing."""
    side = lambda p: F.round(F.coalesce(F.avg(F.when(phase == p, F.col(value))), F.lit(0.0)), 4)
    out = runs.groupBy(name).agg(side(before).alias("pre"), side(after).alias("post"))
    return out.withColumn("delta", F.round(F.col("post") - F.col("pre"), 4))


def bootstrap(df: DataFrame, record_id: str, value: str, resamples: int = 1000, seed: str = "42", max_rows: int = 100_000) -> DataFrame:
    """One row ``mean, low, high``: the mean with a 95 % interval from resamples drawn by hash.

    Resample b draws position j from floor(n·hash(seed, b, j)). Rows are numbered by rank of id, so the same
    draws come out in any engine. Fewer than two rows give the mean three times, none gives zeros. The
    position table is broadcast only up to ``max_rows`` rows.
    """
    x = df.filter(F.col(value).isNotNull()).select(record_id, F.col(value).cast("double").alias("x"))
    x = numbered(x, [record_id, "x"], "pos")
    n = x.count()
    if n < 2:
        return x.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean")).select("mean", F.col("mean").alias("low"), F.col("mean").alias("high"))
    spark = df.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    draws = draws.withColumn("pos", F.floor(unit_hash(F.lit(seed), F.col("b").cast("string"), F.col("j").cast("string")) * n).cast("long"))
    means = draws.join(F.broadcast(x) if n <= max_rows else x, "pos").groupBy("b").agg(F.avg("x").alias("m"))
    interval = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return x.agg(F.avg("x").alias("mean")).join(F.broadcast(interval)).select(*[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


def freeze(df: DataFrame, folder: str, tag: str) -> None:
    """Writes a snapshot under its tag."""
    df.write.mode("overwrite").parquet(f"{folder}/baselines/tag={tag}")
