"""Problem 2: most similar vectors for every vector, with randomly rotated one-bit codes.

Vectors are dealt to cells around centroids fitted on a bounded sample. A vector lives in its nearest cell and
visits the next nearest ones. Where the rows need more cells than the sample can place, each cell is parted again by
centroids fitted on a sample of its own, in the tasks, so cells stay small at any number of vectors; the residents
of a cell that is still large are spread over blocks. In a cell every resident has a code of one bit per rotated
dimension of its residual and two correction scalars. A query is rotated and rounded at random to four bits a
dimension; four ANDs and bit counts over packed codes then give an unbiased estimate of each inner product with an
error bound. Only residents whose bound reaches the k-th best similarity known so far are compared exactly.
``exact_neighbors`` compares a stated set of queries with every vector, for recall and for small query sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut_lineage

#: Width of the error bound in standard errors of the estimate.
EPSILON = 3.0
QUERY_BITS = 4


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


class Codes:
    """One-bit codes of unit vectors around a centre, and estimates of inner products with queries."""

    def __init__(self, data: np.ndarray, centre: np.ndarray, turn: np.ndarray, seed: int = 5):
        self.centre, self.turn, self.rng = centre, turn, np.random.default_rng(seed)
        n, dims = data.shape
        self.dims = dims
        res = data - centre
        self.norm = np.linalg.norm(res, axis=1)
        rotated = (res / np.maximum(self.norm, 1e-12)[:, None]) @ turn
        bits = rotated > 0
        pad = -dims % 64
        self.packed = np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64).T)
        self.ones = bits.sum(axis=1).astype(np.float32)
        fit = np.maximum(np.abs(rotated).sum(axis=1) / np.sqrt(dims), 1e-6)  # <code, vector>
        self.scale = (self.norm / fit / np.sqrt(dims)).astype(np.float32)
        spread = np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dims - 1, 1))
        self.error = (EPSILON * self.norm * spread).astype(np.float32)
        self.shift = (data @ centre - centre @ centre).astype(np.float32)

    def prepare(self, queries: np.ndarray) -> tuple:
        """Rotated residuals of queries as four bit planes, with what is needed to undo the rounding."""
        res = queries - self.centre
        norm = np.linalg.norm(res, axis=1).astype(np.float32)
        y = (res / np.maximum(norm, 1e-12)[:, None]) @ self.turn
        low = y.min(axis=1)
        step = np.maximum((y.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-12)
        u = np.minimum(np.floor((y - low[:, None]) / step[:, None] + self.rng.random(y.shape)), 2**QUERY_BITS - 1).astype(np.uint8)
        pad = -self.dims % 64
        planes = [np.packbits(np.pad((u >> j) & 1, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64) for j in range(QUERY_BITS)]
        return planes, norm, low.astype(np.float32), step.astype(np.float32), y.sum(axis=1).astype(np.float32), (queries @ self.centre).astype(np.float32)

    def estimate(self, prepared: tuple, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products of queries a..b with all data, upper bounds)."""
        planes, norm, low, step, total, shift = prepared
        size = (b - a, self.packed.shape[1])
        acc = np.zeros(size, dtype=np.uint16)
        buf = np.empty(size, dtype=np.uint64)
        cnt = np.empty(size, dtype=np.uint8)
        for w in range(self.packed.shape[0]):
            for j in range(QUERY_BITS):
                np.bitwise_and(planes[j][a:b, w, None], self.packed[w][None, :], out=buf)
                np.bitwise_count(buf, out=cnt)
                acc += cnt if j == 0 else cnt.astype(np.uint16) << j
        est = acc.astype(np.float32)
        est *= 2 * step[a:b, None]
        est += (2 * low[a:b, None]) * self.ones[None, :]
        est -= total[a:b, None]
        est *= norm[a:b, None]
        est *= self.scale[None, :]
        est += shift[a:b, None]
        est += self.shift[None, :]
        # the rounding of a query adds up to a quarter step squared of variance in each dimension
        rounding = (EPSILON / 2 * np.sqrt(self.dims)) * norm[a:b] * step[a:b]
        return est, est + np.hypot(norm[a:b, None] * self.error[None, :], rounding[:, None] * self.scale[None, :])


class BestK:
    """Exact hits of queries, thinned to the k best of each."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.rows: list[np.ndarray] = []

    def add(self, q: np.ndarray, d: np.ndarray, cos: np.ndarray) -> None:
        if len(q):
            self.rows.append(np.rec.fromarrays([q.astype(np.int32), d.astype(np.int32), cos], names="q,d,c"))

    def result(self, names: np.ndarray) -> np.ndarray:
        if not self.rows:
            return np.rec.fromarrays([np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)], names="q,d,c")
        r = np.concatenate(self.rows)
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        r = r[np.lexsort((rank[r["d"]], -r["c"], r["q"]))]
        new = np.r_[True, r["q"][1:] != r["q"][:-1]]
        place = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        return r[place < self.k]

    def kth(self, floor: float) -> np.ndarray:
        """The k-th best similarity of each query so far, or the floor."""
        out = np.full(self.n, floor)
        r = self.result(np.arange(1 + max((int(x["d"].max()) for x in self.rows), default=0)))
        if len(r):
            new = np.r_[True, r["q"][1:] != r["q"][:-1]]
            place = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
            full = place == self.k - 1
            out[r["q"][full]] = np.maximum(floor, r["c"][full])
        return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for s in range(0, len(a), 100_000):
        out[s : s + 100_000] = np.einsum("ij,ij->i", a[s : s + 100_000].astype(np.float64), b[s : s + 100_000].astype(np.float64))
    return out


def search_cell(home: np.ndarray, home_ids: np.ndarray, visit: np.ndarray, visit_ids: np.ndarray, k: int, floor: float | None, turn: np.ndarray, known: np.ndarray | None = None, tile: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """k best of each resident among residents and visitors, and of each visitor among residents.

    ``known`` holds a similarity that k other vectors of each visitor are known to reach; what lies below it is
    of no use to that visitor. Returns two record arrays (q, d, c); a ``d`` at or beyond the number of
    residents is a visitor.
    """
    nh = len(home)
    centre = home.mean(axis=0)
    codes = Codes(home, centre, turn)
    least = -2.0 if floor is None else floor
    both = np.concatenate([home, visit])
    ids = np.concatenate([home_ids, visit_ids])
    own, guest = BestK(nh, k), BestK(len(visit), k)
    step = max(1, tile // max(nh, 1))
    for queries, q_ids, best, back in ((home, home_ids, own, None), (visit, visit_ids, guest, own)):
        if not len(queries):
            continue
        prepared = codes.prepare(queries)
        reverse = own.kth(least) - 1e-6 if back is not None else None
        for a in range(0, len(queries), step):
            b = min(a + step, len(queries))
            est, bound = codes.estimate(prepared, a, b)
            if back is None:  # not itself
                est[np.arange(b - a), np.arange(a, b)] = -9
                bound[np.arange(b - a), np.arange(a, b)] = -9
            if floor is None and nh > k + 3:
                top = np.argpartition(est, nh - (k + 3), axis=1)[:, nh - (k + 3) :]
                exact = np.einsum("ij,ikj->ik", queries[a:b], home[top])
                exact[np.take_along_axis(est, top, 1) < -8] = -9
                need = np.partition(exact, 3, axis=1)[:, 3] - 1e-5
            else:
                need = np.full(b - a, least - 1e-6)
            if back is not None and known is not None:
                need = np.maximum(need, known[a:b] - 1e-5)
            mask = bound >= need[:, None]
            if reverse is not None:
                mask |= bound >= reverse[None, :]
            if np.count_nonzero(mask) > mask.size // 50:  # the bound leaves many: their products come from one of matrices
                near = queries[a:b] @ home.T
                wanted = near >= need[:, None]
                if reverse is not None:
                    wanted |= near >= reverse[None, :]
                mask &= wanted
            i, j = np.nonzero(mask)
            if not len(i):
                continue
            cos = _exact(queries[a + i], home[j])
            keep = (cos >= least) & (q_ids[a + i] != home_ids[j]) & (bound[i, j] > -8)
            i, j, cos = i[keep], j[keep], cos[keep]
            fit = cos >= need[i]
            best.add(a + i[fit], j[fit], cos[fit])
            if reverse is not None:
                more = cos >= reverse[j]
                own.add(j[more], nh + a + i[more], cos[more])
    return own.result(ids), guest.result(home_ids)


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Unit centroids: the largest cluster is halved again and again, then all are moved twice to their means.

    Halving by size keeps cells of a dense spot as small as others; only vectors that are equal stay together,
    and those are taken out before (see ``nearest_vectors``).
    """
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(sample))]
    while len(groups) < cells:
        groups.sort(key=len)
        g = groups.pop()
        if len(g) < 2:
            groups.append(g)
            break
        x = sample[g]
        c = x[rng.choice(len(g), 2, replace=False)]
        for _ in range(6):
            side = x @ c[1] > x @ c[0]
            if side.all() or not side.any():
                break
            c = unit(np.stack([x[~side].mean(axis=0), x[side].mean(axis=0)]))
        if side.all() or not side.any() or min(side.sum(), len(side) - side.sum()) < len(g) // 50:
            along = x @ (c[1] - c[0])
            side = np.argsort(np.argsort(along, kind="stable"), kind="stable") >= len(g) // 2
        groups += [g[~side], g[side]]
    cent = unit(np.stack([sample[g].mean(axis=0) for g in groups]))
    for _ in range(2):
        near = np.argmax(sample @ cent.T, axis=1)
        size = np.bincount(near, minlength=len(cent))
        if size.max() > 4 * max(1, len(sample) // len(cent)):
            break
        sums = np.zeros_like(cent)
        np.add.at(sums, near, sample)
        cent = np.where(size[:, None] > 0, unit(sums + 1e-12), cent)
    return cent


def reached_in_chunk(x: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """For each vector a similarity that k others of its cell in this chunk reach; -2 where there are fewer. Repeated ids count once."""
    out = np.full(len(x), -2.0, dtype=np.float32)
    _, one = np.unique(ids, return_index=True)
    one = one[np.argsort(cell[one], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, cell[one][1:] != cell[one][:-1], True])
    for a, b in zip(cuts, cuts[1:]):
        if b - a > k:
            v = x[one[a:b]]
            s = v @ v.T
            np.fill_diagonal(s, -2)
            out[one[a:b]] = np.partition(s, b - a - k, axis=1)[:, b - a - k]
    return out


def usable_vectors(df: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(vec_id).isNotNull() & (F.size(v) == dims) & fine & F.exists(v, lambda x: x != 0))


def current_vectors(df: DataFrame, vec_id: str, vector: str, version: str | None, dims: int) -> DataFrame:
    """Columns ``id, seq, v`` of the usable vectors."""
    seq = F.coalesce(F.col(version), F.lit(-1)).cast("long") if version else F.lit(0).cast("long")
    return usable_vectors(df, vec_id, vector, dims).select(F.col(vec_id).cast("string").alias("id"), seq.alias("seq"), F.col(vector).cast("array<float>").alias("v"))


HASH_SPAN = 1 << 62


def hash_bound(rows: float, total: int) -> int:
    """Below this of ``HASH_SPAN`` values lie the hashes of about ``rows`` of ``total`` rows; no size of a table rounds it to nothing."""
    return HASH_SPAN if rows >= total else max(1, int(rows * HASH_SPAN) // total)


def thinned(df: DataFrame, rows: float, total: int, seed: int) -> DataFrame:
    """About ``rows`` of ``total`` rows by a hash of their id."""
    return df.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(HASH_SPAN)) < F.lit(hash_bound(rows, total)))


def nearest_cells(x: np.ndarray, cent: np.ndarray, probes: int) -> np.ndarray:
    """Indexes of the ``probes`` nearest centroids of each vector, nearest first."""
    probes = min(probes, len(cent))
    near = np.empty((len(x), probes), dtype=np.int64)
    for s in range(0, len(x), 4096):
        dots = x[s : s + 4096] @ cent.T
        part = np.argpartition(-dots, probes - 1, axis=1)[:, :probes] if probes < len(cent) else np.tile(np.arange(len(cent)), (len(dots), 1))
        order = np.argsort(-np.take_along_axis(dots, part, 1), axis=1, kind="stable")
        near[s : s + 4096] = np.take_along_axis(part, order, 1)
    return near


def spread(ids: np.ndarray, near: np.ndarray, at_home: bool, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, block, visitor, row) of vectors dealt to their ``near`` cells, the first of them home if ``at_home``.

    A resident of a cell of several blocks lives in one by its id's hash and visits the later ones; the earlier
    ones visit its own. A visitor of the cell goes to all of them. So each pair still meets once.
    """
    cell, row = near.ravel(), np.repeat(np.arange(len(near)), near.shape[1])
    visitor = np.tile(np.arange(near.shape[1]) > 0, len(near)) if at_home else np.ones(near.size, dtype=bool)
    if blocks.max(initial=1) == 1:
        return cell, np.zeros(len(cell), dtype=np.int64), visitor, row
    of = blocks[cell]
    own = np.fromiter((zlib.crc32(str(i).encode()) for i in ids), np.int64, len(ids))[row] % of
    times = np.where(visitor, of, of - own)
    first = np.where(visitor, 0, own)
    start = np.cumsum(times) - times
    step = np.arange(times.sum()) - np.repeat(start, times)
    block = np.repeat(first, times) + step
    guest = np.repeat(visitor, times) | (step > 0)
    return np.repeat(cell, times), block, guest, np.repeat(row, times)


_DEALT = "cell long, block int, visitor boolean, ids array<string>, vecs binary, reached binary"


def _chunks(ids: np.ndarray, x: np.ndarray, reached: np.ndarray, dealt: tuple, base: int = 0, again: bool = False) -> pa.RecordBatch:
    """One row per cell, block and role with the ids and vectors dealt to it; ``reached`` goes with visitors, and with all that are dealt ``again``."""
    cell, block, visitor, row = dealt
    order = np.lexsort((visitor, block, cell))
    cell, block, visitor, row = cell[order], block[order], visitor[order], row[order]
    new = (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (visitor[1:] != visitor[:-1])
    cuts = np.flatnonzero(np.r_[True, new, True]) if len(cell) else np.zeros(1, dtype=np.int64)
    names = [ids[row[a:b]].tolist() for a, b in zip(cuts, cuts[1:])]
    vecs = [x[row[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
    least = [reached[row[a:b]].tobytes() if len(reached) and (again or visitor[a]) else b"" for a, b in zip(cuts, cuts[1:])]
    columns = [pa.array(cell[cuts[:-1]] + base, pa.int64()), pa.array(block[cuts[:-1]], pa.int32()), pa.array(visitor[cuts[:-1]], pa.bool_()), pa.array(names, pa.list_(pa.string())), pa.array(vecs, pa.binary()), pa.array(least, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "block", "visitor", "ids", "vecs", "reached"])


def nearest_vectors(
    df: DataFrame,
    vec_id: str = "__id__",
    vector: str = "vector",
    version: str | None = "__write_seq__",
    dims: int = 64,
    k: int = 5,
    min_cosine: float | None = None,
    visits: int = 11,
    cell_rows: int = 1500,
    sample_rows: int = 20_000,
    block_rows: int = 12_000,
    chunk_rows: int = 60_000,
) -> DataFrame:
    """Columns ``id, neighbour, cosine, rank``: the ``k`` most similar other vectors of every usable vector.

    Usable are vectors of ``dims`` finite numbers that are not all zero; of rows with one id the one with the
    highest ``version`` counts. Ties in cosine go by id. ``min_cosine`` leaves out neighbours below it, early
    (the error bound is held against it). A null id is left out, an empty table gives an empty result. What is
    missed are true neighbours in cells that neither of the two vectors visits.

    There is one centroid per ``cell_rows`` vectors. A sample of about ``sample_rows`` vectors places up to a quarter
    as many of them on the driver. If the table needs more, each of these cells is parted by centroids of its own,
    fitted in a task on the share of its vectors that gives four to a centroid; vectors then visit fewer cells, and
    more parts of each. Every vector is indexed, lives in its own cell and is searched for in about ``visits`` more.
    Residents of a cell that the sample shows to hold more than ``block_rows`` are spread over blocks.

    Of more than ``k + 1`` exact copies only the ``k + 1`` with the smallest ids enter the search, as no list can
    hold another one; the rest take their list from these copies. So equal vectors make no cell large.
    """
    spark = df.sparkSession
    base = current_vectors(df, vec_id, vector, version, dims)
    facts = cut_lineage(base.select("id", "seq", F.xxhash64("v").alias("h")))
    total = facts.count()
    out_schema = "id string, neighbour string, cosine double, rank int"
    if not total:
        return spark.createDataFrame([], out_schema)

    def few(small: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(small) if rows <= 100_000 else small

    stale = cut_lineage(facts.groupBy("id").agg(F.min("seq").alias("lo"), F.max("seq").alias("seq")).filter("lo < seq").select("id", "seq"))
    stale_rows = stale.count()
    current = base
    if stale_rows:
        current = base.join(few(stale.withColumnRenamed("seq", "last"), stale_rows), "id", "left").filter("last IS NULL OR seq = last").drop("last")
        facts = facts.join(few(stale.withColumnRenamed("seq", "last"), stale_rows), "id", "left").filter("last IS NULL OR seq = last").drop("last")
    crowd = cut_lineage(facts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).select("h"))
    crowds = crowd.count()
    copies = None
    searched = current.select("id", "v")
    if crowds:
        own = current.withColumn("h", F.xxhash64("v")).join(few(crowd, crowds), "h", "left_semi").select("h", "id", "v").dropDuplicates(["h", "id"])
        first = own.withColumn("place", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).filter(F.col("place") <= k + 1)
        first = cut_lineage(first)
        searched = current.withColumn("h", F.xxhash64("v")).join(few(crowd, crowds), "h", "left_anti").select("id", "v").unionByName(first.select("id", "v"))
        lists = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") == k + 1)
        rest = own.join(few(lists, crowds), ["h", "v"]).filter(~F.array_contains("ids", F.col("id")))
        copies = rest.select("id", F.posexplode(F.slice("ids", 1, k)).alias("pos", "neighbour")).select("id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("pos") + 1).alias("rank"))

    picked = thinned(searched, 1.2 * sample_rows, total, 3).limit(2 * sample_rows).select("v").toPandas()
    sample = unit(np.stack(picked.v.to_numpy())) if len(picked) else np.eye(dims, dtype=np.float32)[:1]
    wanted = max(1, round(total / cell_rows))
    cells = min(wanted, max(1, len(sample) // 4))
    cent = fit_centroids(sample, cells)
    held = np.bincount(nearest_cells(sample, cent, 1)[:, 0], minlength=len(cent)) * (total / len(sample))  # rows of each cell, from the sample
    parted = wanted > 2 * len(cent)
    blocks = np.ones(len(cent), dtype=np.int64) if parted else np.maximum(1, np.ceil(held / block_rows)).astype(np.int64)
    top_visits = min(visits, 2) if parted else visits
    shared = spark.sparkContext.broadcast((cent, rotation(dims), blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cent, _, blocks = shared.value
        waiting: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            ids = np.asarray(t.column("id").to_pylist(), dtype=object)
            x = unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            near = nearest_cells(x, cent, 1 + top_visits)
            reached = reached_in_chunk(x, ids.astype(str), near[:, 0], k) if min_cosine is None else np.empty(0, np.float32)
            return _chunks(ids, x, reached, spread(ids, near, True, blocks), again=parted)

        rows = 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                rows += b.num_rows
            if rows >= chunk_rows:
                yield flush()
                rows = 0
        if waiting:
            yield flush()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        sides, known = [], None
        for visitor in (False, True):
            part = pdf[pdf.visitor == visitor]
            ids = np.concatenate([np.asarray(x, dtype=object) for x in part.ids]) if len(part) else np.empty(0, dtype=object)
            x = np.frombuffer(b"".join(part.vecs), dtype=np.float32).reshape(-1, dims)
            _, first = np.unique(ids.astype(str), return_index=True)  # repeated rows are one
            sides += [x[first], ids[first].astype(str)]
            if visitor and min_cosine is None:
                known = np.frombuffer(b"".join(part.reached), dtype=np.float32)[first]
        home, home_ids, visit, visit_ids = sides
        if not len(home):
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []})
        own, guest = search_cell(home, home_ids, visit, visit_ids, k, min_cosine, shared.value[1], known)
        ids = np.concatenate([home_ids, visit_ids])
        return pd.DataFrame(
            {
                "id": np.concatenate([home_ids[own["q"]], visit_ids[guest["q"]]]),
                "neighbour": np.concatenate([ids[own["d"]], home_ids[guest["d"]]]),
                "cosine": np.concatenate([own["c"], guest["c"]]).astype(float),
            }
        )

    dealt = searched.mapInArrow(deal, _DEALT)
    if parted:
        dealt = _parted(dealt, searched, shared, held, total, wanted, visits, cell_rows, block_rows, dims)
    hits = dealt.groupBy("cell", "block").applyInPandas(search, "id string, neighbour string, cosine double")
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    hits = hits.repartition("id").dropDuplicates(["id", "neighbour"])  # one shuffle serves this and the window
    found = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")
    return found if copies is None else found.unionByName(copies)


def _parted(dealt: DataFrame, searched: DataFrame, shared, held: np.ndarray, total: int, wanted: int, visits: int, cell_rows: int, block_rows: int, dims: int) -> DataFrame:
    """The rows of ``dealt`` dealt again to parts of their cells.

    The centroids of a cell's parts are fitted in a task on about four vectors to a part and lie ahead of the cell's rows in
    the partition that deals them, so they reach neither the driver nor a broadcast. Cells are spread over as many
    salts as keep a partition at some millions of vectors.
    """
    rows_per_salt = 2_000_000
    salts = np.maximum(1, np.ceil(held * 3 / rows_per_salt)).astype(int)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cent = shared.value[0]
        for b in batches:
            if b.num_rows:
                x = unit(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                near = nearest_cells(x, cent, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], names=["cell", "v"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(sorted(pdf.v)), dtype=np.float32).reshape(-1, dims)
        cent = fit_centroids(x, max(1, len(x) // 4))
        rows = np.bincount(nearest_cells(x, cent, 1)[:, 0], minlength=len(cent)) * (cell_rows / 4)
        blocks = np.maximum(1, np.ceil(rows / block_rows)).astype(np.int64)
        return pd.DataFrame({"cell": [int(pdf.cell.iloc[0])], "vecs": [cent.tobytes()], "reached": [blocks.tobytes()]})

    sampled = thinned(searched, 4.0 * wanted, total, 29).mapInArrow(settle, "cell long, v binary")
    side = sampled.groupBy("cell").applyInPandas(fit, "cell long, vecs binary, reached binary")
    salt_of = F.element_at(F.lit(salts.tolist()), (F.col("cell") + 1).cast("int"))
    side = side.select("cell", F.explode(F.sequence(F.lit(0), salt_of - 1)).alias("salt"), F.lit(-1).alias("block"), F.lit(False).alias("visitor"), F.array().cast("array<string>").alias("ids"), "vecs", "reached")
    rows = dealt.select("cell", F.pmod(F.xxhash64("ids"), salt_of).cast("int").alias("salt"), "block", "visitor", "ids", "vecs", "reached")
    ordered = side.unionByName(rows).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "block")

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cent, blocks = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] < 0:
                    place = (r["cell"], r["salt"])
                    cent = np.frombuffer(r["vecs"], dtype=np.float32).reshape(-1, dims)
                    blocks = np.frombuffer(r["reached"], dtype=np.int64)
                    continue
                if place != (r["cell"], r["salt"]):  # a cell of which the sample holds nothing stays whole
                    place, cent, blocks = (r["cell"], r["salt"]), np.zeros((1, dims), dtype=np.float32), np.ones(1, dtype=np.int64)
                ids = np.asarray(r["ids"], dtype=object)
                x = np.frombuffer(r["vecs"], dtype=np.float32).reshape(-1, dims)
                near = nearest_cells(x, cent, max(1, (1 + visits) // 4) if r["visitor"] else 1 + visits // 2)
                yield _chunks(ids, x, np.frombuffer(r["reached"], dtype=np.float32), spread(ids, near, not r["visitor"], blocks), base=r["cell"] << 32)

    return ordered.mapInArrow(deal_again, _DEALT)


def exact_neighbors(df: DataFrame, queries: DataFrame, vec_id: str = "__id__", vector: str = "vector", version: str | None = "__write_seq__", dims: int = 64, k: int = 5, query_block: int = 20_000) -> DataFrame:
    """Columns ``id, neighbour, cosine, rank``: the ``k`` most similar other vectors of each of a stated set of queries, by comparing all.

    ``queries`` has a column of the name ``vec_id``; ids without a usable vector give nothing. The queries' vectors come in blocks
    of ``query_block``, each one pass over the table in which every task keeps ``k`` hits of each query.
    """
    spark = df.sparkSession
    base = current_vectors(df, vec_id, vector, version, dims).groupBy("id").agg(F.max_by("v", F.struct("seq", "v")).alias("v"))
    base = cut_lineage(base)
    asked = cut_lineage(base.join(queries.select(F.col(vec_id).cast("string").alias("id")).distinct(), "id", "left_semi").withColumn("part", F.floor(F.rand(3) * F.lit(max(1, -(-queries.count() // query_block))))))
    schema = "id string, neighbour string, cosine double"
    out = spark.createDataFrame([], schema)
    for (part,) in asked.select("part").distinct().orderBy("part").collect():
        own = asked.filter(F.col("part") == part).select("id", "v").toPandas()
        shared = spark.sparkContext.broadcast((own.id.to_numpy(dtype=str), unit(np.stack(own.v.to_numpy()))))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = pd.DataFrame({"id": [], "neighbour": [], "cosine": []})
            least = np.full(len(q), -2.0)
            for b in batches:
                if not b.num_rows:
                    continue
                ids = np.asarray(b.column("id").to_pylist(), dtype=str)
                x = unit(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                found = []
                for s in range(0, len(q), 1000):
                    dots = q[s : s + 1000] @ x.T
                    dots[names[s : s + 1000, None] == ids[None, :]] = -9
                    low = least[s : s + 1000]
                    if len(x) > k:
                        low = np.maximum(low, np.partition(dots, len(x) - k, axis=1)[:, len(x) - k])
                    i, j = np.nonzero(dots >= np.maximum(low, -2)[:, None] - 1e-6)
                    found.append(pd.DataFrame({"id": names[s + i], "neighbour": ids[j], "cosine": _exact(q[s + i], x[j])}))
                best = pd.concat([best, *found]).sort_values(["id", "cosine", "neighbour"], ascending=[True, False, True], ignore_index=True)
                best = best[best.groupby("id").cumcount() < k]
                full = best.groupby("id").cosine.agg(["size", "min"])
                full = full[full["size"] == k]
                place = pd.Series(np.arange(len(names)), index=names)
                least[place.loc[full.index].to_numpy()] = full["min"].to_numpy()
            if len(best):
                yield pa.RecordBatch.from_pandas(best[["id", "neighbour", "cosine"]], preserve_index=False)

        out = out.unionByName(base.mapInArrow(compare, schema))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def close_pairs(df: DataFrame, min_cosine: float = 0.9, vec_id: str = "__id__", visits: int = 3, **options) -> DataFrame:
    """Columns ``id_a, id_b``: pairs of at least ``min_cosine`` of which one is among the k most similar of the other."""
    near = nearest_vectors(df, vec_id=vec_id, min_cosine=min_cosine, visits=visits, **options)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
