"""Problem 1: splits that keep related records together.

Records linked by a shared key (here a group and a page) form families; families are balanced over splits
by largest differencing: the extreme weights are combined again and again into many equal bins, in parts and then
parts among each other, and whole bins then go to the splits by target proportion.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.skew import hot_join
from quillmill.operators.components import connected_components
from quillmill.session import cut_lineage


def families(records: DataFrame, record_id: str, keys: list[str]) -> DataFrame:
    """Columns ``record_id, family``: records that share a value of a key column, also through others.

    Null keys link nothing; a record without any key is a family of its own. A repeated ``record_id`` is one
    record. The family is named by one of its keys. Work is on distinct keys, not on pairs of records: the
    keys of one record are linked to its first key, which leaves a graph over keys that holds every link.
    """
    tagged = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    nodes = records.filter(F.col(record_id).isNotNull()).select(F.col(record_id).alias("_r"), F.array_compact(F.array(*tagged)).alias("_k"))
    nodes = nodes.withColumn("_first", F.coalesce(F.try_element_at("_k", F.lit(1)), F.concat(F.lit("r:"), F.col("_r").cast("string"))))
    own = cut_lineage(nodes.select("_r", "_first").distinct())
    edges = cut_lineage(nodes.select(F.col("_first").alias("a"), F.explode("_k").alias("b")).filter("a != b").distinct())
    # the rows of one record id may carry different keys: they are linked too
    several = own.groupBy("_r").agg(F.min("_first").alias("_lo"), F.max("_first").alias("_hi")).filter("_lo != _hi").select(F.col("_r").alias("_q"), "_lo")
    repeated = own.join(several, F.col("_r") == F.col("_q")).select(F.col("_lo").alias("a"), F.col("_first").alias("b"))
    one = own.groupBy("_r").agg(F.min("_first").alias("node"))
    if len(keys) == 2:  # a second key that stands with one first key, and not in repeated, links nothing and leads to that key
        ends = edges.groupBy("b").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
        met = repeated.select(F.explode(F.array("a", "b")).alias("b")).filter(F.col("b").startswith("1:"))
        edges = hot_join(edges, ends.filter("lo != hi").select("b").unionByName(met).distinct(), "b")
        second = F.col("node").startswith("1:")
        led = hot_join(one.filter(second), ends.select(F.col("b").alias("node"), "lo"), "node", how="left")
        one = one.filter(~second).unionByName(led.select("_r", F.coalesce("lo", "node").alias("node")))
    comp = connected_components(edges.unionByName(repeated.filter("a != b")))
    out = hot_join(one, comp, "node", how="left")
    return out.select(F.col("_r").alias(record_id), F.coalesce("component", "node").alias("family"))


def difference_bins(tuples: np.ndarray) -> np.ndarray:
    """Largest differencing over tuples of bin weights (rows, each of ``bins`` values).

    The two tuples with the largest spread are combined, the heaviest bin of one with the lightest of the
    other, until one tuple is left. Returns the final bin of every (row, column), heaviest bin first.
    """
    rows, bins = tuples.shape
    parent = np.arange(rows * bins)
    heap = []
    for i in range(rows):
        order = np.argsort(-tuples[i], kind="stable")
        sums = tuples[i][order]
        heap.append((-(sums[0] - sums[-1]), i, sums, i * bins + order))
    heapq.heapify(heap)
    count = rows
    while len(heap) > 1:
        _, _, s1, k1 = heapq.heappop(heap)
        _, _, s2, k2 = heapq.heappop(heap)
        parent[k2[::-1]] = k1
        sums = s1 + s2[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), count, sums, k1[order]))
        count += 1
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    place = np.empty(rows * bins, dtype=np.int64)
    place[heap[0][3]] = np.arange(bins)
    return place[parent].reshape(rows, bins)


def weight_bins(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin of every weight by largest differencing; weights of near rank start as one tuple."""
    order = np.argsort(-weights, kind="stable")
    padded = np.zeros(-(-len(weights) // bins) * bins)
    padded[: len(weights)] = weights[order]
    out = np.empty(len(weights), dtype=np.int64)
    out[order] = difference_bins(padded.reshape(-1, bins)).ravel()[: len(weights)]
    return out


def allot(weights: np.ndarray, shares: list[float]) -> np.ndarray:
    """Split of every bin: heaviest bin first, each to the split that misses most of its target."""
    target = np.asarray(shares, dtype=float) / sum(shares) * weights.sum()
    out = np.zeros(len(weights), dtype=np.int64)
    for i in np.argsort(-weights, kind="stable"):
        s = int(np.argmax(target))
        out[i] = s
        target[s] -= weights[i]
    return out


def balanced_splits(members: DataFrame, family: str, shares: dict[str, float], bins: int = 1000, part_families: int = 100_000, fan: int = 64) -> DataFrame:
    """Columns ``family, new_split``: whole families dealt to splits so that record counts meet ``shares``.

    ``members`` has one row per record. Families are dealt by hash to parts of about ``part_families``, each of which a
    task bins by largest differencing into ``bins`` bins. Parts are then combined by the same rule, ``fan`` at a time in
    as many rounds as it takes, so no task holds more than ``part_families`` families or ``fan * bins`` bins; the driver sees the
    last ``fan * bins`` weights at most, at any size of the data. Null families are left out; empty input gives an
    empty result.
    """
    spark = members.sparkSession
    kind = members.schema[family].dataType.simpleString()
    weights = cut_lineage(members.filter(F.col(family).isNotNull()).groupBy(F.col(family).cast("string").alias("f")).agg(F.count("*").alias("w")))
    count = weights.count()
    if not count:
        return spark.createDataFrame([], f"`{family}` {kind}, new_split string")
    parts = -(-count // part_families)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "f"], ascending=[False, True], ignore_index=True)
        return pdf.assign(bin=weight_bins(pdf.w.to_numpy(float), bins))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        final = _combined(pdf, bins)[0]
        return pdf.assign(up=final)

    part = F.pmod(F.xxhash64("f"), F.lit(parts))
    placed = cut_lineage(weights.withColumn("part", part).groupBy("part").applyInPandas(local, "f string, w long, part long, bin long"))
    level = placed.groupBy("part", "bin").agg(F.sum("w").alias("w"))
    placed = placed.select("f", "part", "bin")
    while parts > fan:
        parts = -(-parts // fan)
        level = level.withColumn("group", F.col("part") % F.lit(parts)).groupBy("group").applyInPandas(combine, "part long, bin long, w long, group long, up long")
        level = cut_lineage(level)
        step = level.select("part", "bin", "group", "up")
        placed = placed.join(step, ["part", "bin"]).select("f", F.col("group").alias("part"), F.col("up").alias("bin"))
        level = level.groupBy(F.col("group").alias("part"), F.col("up").alias("bin")).agg(F.sum("w").alias("w"))
    sums = level.toPandas().sort_values(["part", "bin"], ignore_index=True)
    final, weight = _combined(sums, bins)
    split = allot(weight, list(shares.values()))
    sums["new_split"] = np.asarray(list(shares))[split[final]]
    plan = spark.createDataFrame(sums[["part", "bin", "new_split"]])
    return placed.join(F.broadcast(plan), ["part", "bin"]).select(F.col("f").cast(kind).alias(family), "new_split")


def _combined(rows: pd.DataFrame, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin after combining the tuples of ``rows``, which has part, bin and w, for each row; weights of these bins)."""
    names = sorted(rows.part.unique())
    tuples = np.zeros((len(names), bins))
    at = rows.part.map({p: i for i, p in enumerate(names)}).to_numpy()
    tuples[at, rows.bin] = rows.w
    final = difference_bins(tuples)
    return final[at, rows.bin.to_numpy()], np.bincount(final.ravel(), weights=tuples.ravel(), minlength=bins)


def mixed_families(members: DataFrame, family: str, split: str) -> DataFrame:
    """Rows of ``members`` with a split whose family has records in more than one split."""
    known = members.filter(F.col(split).isNotNull() & F.col(family).isNotNull())
    mixed = known.groupBy(family).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi")).filter("_lo != _hi").select(family)
    return hot_join(known, mixed, family)
