"""Joins that survive one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut_lineage


#: Below this number of rows a hot key is no more than a task handles, and hot keys are not looked for.
LEAST_ROWS = 2_000_000


def hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", max_hot: int = 1000, total: int | None = None, least_rows: int | None = None) -> DataFrame:
    """Equi-join on ``key`` where ``small`` has one row per key and ``big`` may have a hot key.

    Keys that hold more than ``1/max_hot`` of the rows of ``big`` number fewer than ``max_hot``, so their
    rows of ``small`` are a set of proven size and are broadcast; the rows of ``big`` with such a key are
    joined where they lie. All other keys go through an ordinary shuffled join. ``big`` is read several
    times, so its lineage should be short. A ``big`` of fewer than ``least_rows`` rows is joined plainly.
    """
    total = big.count() if total is None else total
    if total < (LEAST_ROWS if least_rows is None else least_rows):
        return big.join(small, key, how)
    hot = [r[0] for r in big.groupBy(key).count().filter(F.col("count") > total / max_hot).select(key).collect()]
    hot = [k for k in hot if k is not None]
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (
        big.filter(is_hot)
        .join(F.broadcast(small.filter(is_hot)), key, how)
        .unionByName(big.filter(~is_hot).join(small.filter(~is_hot), key, how))
    )


def salts_for(size: Column, per_task: int) -> Column:
    """Number of salts that keeps a group of ``size`` rows under ``per_task`` rows per task."""
    return F.greatest(F.lit(1), F.ceil(size / F.lit(per_task))).cast("int")


def pair_join(left: DataFrame, right: DataFrame, key: str, right_id: str, per_task: int = 20_000) -> DataFrame:
    """All pairs with equal ``key``, the rows of a hot key of ``right`` spread over salts.

    ``right`` is salted by its id, every row of ``left`` is repeated once per salt of its key, so each pair
    comes out exactly once and no task sees more than about ``per_task`` rows of ``right`` for a key.
    """
    sizes = right.groupBy(key).agg(salts_for(F.count("*"), per_task).alias("_salts"))
    hot = sizes.filter("_salts > 1")
    l = left.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    r = right.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(right_id), F.coalesce(F.col("_salts"), F.lit(1))).cast("int"))
    return l.drop("_salts").join(r.drop("_salts"), [key, "_salt"]).drop("_salt")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out`` added: 0, 1, 2 … in order of the columns, without gathering the rows in one task.

    Rows are range-partitioned and sorted; the driver sees one count per partition, rows are ranked inside theirs.
    Rows that tie in all columns of ``order`` share neither number nor a fixed order.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    offsets, total = [], 0
    for r in parts.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r["_part"], total))
        total += r["count"]
    if not offsets:
        return parts.withColumn(out, F.lit(0).cast("long")).drop("_part")
    before = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair])
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(out, rank.cast("long") + before[F.col("_part").cast("long")]).drop("_part")
