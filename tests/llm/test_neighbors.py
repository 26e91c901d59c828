import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm.neighbors import HASH_SPAN, Codes, close_pairs, exact_neighbors, hash_bound, nearest_vectors, rotation, unit
from tests.conftest import DATA

SCHEMA = "__id__ string, __write_seq__ long, vector array<float>"


def frame(spark, x, names=None, seq=None):
    names = names if names is not None else [f"v{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(n, int(s), [float(a) for a in v]) for n, v, s in zip(names, x, seq or [1] * len(x))], SCHEMA)


def brute(x, k):
    u = unit(x).astype(np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def clustered(n, seed=0, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    return (centres[rng.integers(0, 12, n)] + 0.9 * rng.standard_normal((n, dims))).astype(np.float32)


def test_estimates_stay_within_their_bounds():
    x = unit(clustered(600))
    c = Codes(x, x.mean(axis=0), rotation(64))
    est, bound = c.estimate(c.prepare(x[:200]), 0, 200)
    true = x[:200] @ x.T
    assert np.abs(est - true).mean() < 0.08 and (true <= bound + 1e-3).mean() > 0.995


def test_recall_over_many_cells(spark):
    x = clustered(1500)
    got = {}
    for r in nearest_vectors(frame(spark, x), cell_rows=100, visits=7).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.cosine))
    s, top = brute(x, 5)
    hit = sum(len({f"v{j:04d}" for j in top[i]} & {n for _, n, _ in got[f"v{i:04d}"]}) for i in range(len(x)))
    assert hit / top.size >= 0.9
    assert all(sorted(q for q, *_ in v) == [1, 2, 3, 4, 5] for v in got.values())
    assert all(abs(c - s[int(k[1:]), int(n[1:])]) < 1e-5 for k, v in got.items() for _, n, c in v)


def recall(spark, rows, want, k=5, **options):
    """Share of the true neighbours found, over rows with a brute-force answer."""
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(r.neighbour)
    return sum(len(v & got.get(i, set())) for i, v in want.items()) / sum(map(len, want.values()))


def test_recall_at_the_default_share_of_cells(spark):
    vectors = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/vdb_chunks.parquet")
    asked = vectors.filter(F.crc32("__id__") % 50 == 0)
    want = {}
    for r in exact_neighbors(vectors, asked).collect():
        want.setdefault(r.id, set()).add(r.neighbour)
    assert want and all(len(v) == 5 for v in want.values())
    rows = nearest_vectors(vectors, cell_rows=30).collect()  # about 75 cells, of which 12 are searched
    assert recall(spark, rows, want) >= 0.9


def test_parted_cells_keep_recall(spark):
    x = clustered(4000, 21)
    df = frame(spark, x)
    _, top = brute(x, 5)
    want = {f"v{i:04d}": {f"v{j:04d}" for j in top[i]} for i in range(len(x))}
    rows = nearest_vectors(df, cell_rows=60, sample_rows=40, visits=23).collect()  # 66 cells out of 12 or fewer on the driver
    assert recall(spark, rows, want) >= 0.9
    near = {(r.id_a, r.id_b) for r in close_pairs(df, min_cosine=0.8, cell_rows=60, sample_rows=40, visits=7).collect()}
    s, top = brute(x, 5)
    true = {tuple(sorted((f"v{i:04d}", f"v{j:04d}"))) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.8}
    assert near <= true and len(near) >= 0.9 * len(true)


def test_blocks_of_a_large_cell_change_nothing(spark):
    x = clustered(600, 4)
    plain = {tuple(r) for r in nearest_vectors(frame(spark, x)).collect()}
    assert {tuple(r) for r in nearest_vectors(frame(spark, x), block_rows=100).collect()} == plain
    near = {tuple(r) for r in close_pairs(frame(spark, x), min_cosine=0.8).collect()}
    assert {tuple(r) for r in close_pairs(frame(spark, x), min_cosine=0.8, block_rows=100).collect()} == near


def test_sample_does_not_run_dry():
    for total in (10**6, 10**9, 10**12, 10**14):
        share = hash_bound(24_000, total) / HASH_SPAN
        assert abs(share * total - 24_000) < 1


def test_exact_neighbors(spark):
    x = clustered(500, 8)
    x[40:60] = x[40]
    df = frame(spark, x)
    s, _ = brute(x, 5)
    got = {}
    for r in exact_neighbors(df, df.filter("__id__ < 'v0120'"), query_block=50).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert len(got) == 120
    for i in range(120):
        order = sorted((j for j in range(500) if j != i), key=lambda j: (-round(s[i, j], 6), j))[:5]
        assert [n for _, n in sorted(got[f"v{i:04d}"])] == [f"v{j:04d}" for j in order]
    assert exact_neighbors(df, df.filter("false")).count() == 0


def test_one_cell_is_exact(spark):
    x = clustered(300, 3)
    _, top = brute(x, 5)
    got = {(r.id, r.neighbour) for r in nearest_vectors(frame(spark, x)).collect()}
    assert got == {(f"v{i:04d}", f"v{j:04d}") for i in range(300) for j in top[i]}


def test_close_pairs_equal_brute_force(spark):
    x = clustered(400, 5)
    x[200:260] = x[:60] + 0.1 * np.random.default_rng(1).standard_normal((60, 64)).astype(np.float32)
    s, top = brute(x, 5)
    want = {tuple(sorted((f"v{i:04d}", f"v{j:04d}"))) for i in range(400) for j in top[i] if s[i, j] >= 0.9}
    assert {(r.id_a, r.id_b) for r in close_pairs(frame(spark, x), cell_rows=60).collect()} == want


def test_dirt(spark):
    x = clustered(20, 7)
    rows = [(f"v{i:04d}", 1, [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [("n", 1, None), ("s", 1, [1.0] * 32), ("z", 1, [0.0] * 64), ("i", 1, [float("inf")] + [1.0] * 63), ("q", 1, [float("nan")] * 64), (None, 1, rows[0][2]), ("h", 1, [None] + [1.0] * 63)]
    old = [("v0001", 0, [float(a) for a in x[0]])]  # an older state counts for nothing
    df = spark.createDataFrame(rows + rows[:3] + bad + old, SCHEMA).withColumn("id", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("rank", F.lit(0))
    got = nearest_vectors(df).collect()
    assert {r.id for r in got} == {r[0] for r in rows} and len(got) == 100
    assert not {r.neighbour for r in got} & {"n", "s", "z", "i", "q", "h"}
    _, top = brute(x, 5)
    assert {(r.id, r.neighbour) for r in got} == {(f"v{i:04d}", f"v{j:04d}") for i in range(20) for j in top[i]}


def test_crowd_of_copies(spark):
    x = clustered(40, 9)
    x[10:30] = x[10]
    got = nearest_vectors(frame(spark, x)).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        lists.setdefault(r.id, []).append(r.neighbour)
    assert len(lists) == 40 and all(len(v) == 5 for v in lists.values())
    first = [f"v{i:04d}" for i in range(10, 16)]
    assert lists["v0025"] == first[:5] and lists["v0011"] == [n for n in first if n != "v0011"]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    got = nearest_vectors(frame(spark, clustered(max(n, 1))[:n]) if n else spark.createDataFrame([], SCHEMA))
    assert got.count() == (0 if n < 2 else 2)
