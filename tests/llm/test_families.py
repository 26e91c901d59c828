import random

import numpy as np
import pytest

from quillmill.llm import keys, queries
from quillmill.llm.families import allot, balanced_splits, difference_bins, families, mixed_families, weight_bins
from pyspark.sql import functions as F
from tests.conftest import DATA

SCHEMA = "id long, g string, u string, split string"


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, g, u, _ in rows:
        for k in (("g", g), ("u", u)):
            if k[1] is not None:
                parent[find(("r", i))] = find(k)
        find(("r", i))
    return {i: find(("r", i)) for i, *_ in rows}


def same_partition(got, want):
    pairs = {(got[i], want[i]) for i in want}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("seed", range(3))
def test_families_equal_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *[f"g{k}" for k in range(25)]]), rng.choice([None, *[f"u{k}" for k in range(60)]]), None) for i in range(80)]
    rows += [(100 + i, f"c{i}", f"c{i + 1}u", None) for i in range(40)] + [(200 + i, f"c{i + 1}", f"c{i + 1}u", None) for i in range(40)]  # a long chain
    rows += rows[:10]
    got = {r.id: r.family for r in families(spark.createDataFrame(rows, SCHEMA), "id", ["g", "u"]).collect()}
    assert same_partition(got, union_find(rows))


@pytest.mark.parametrize("seed", range(3))
def test_ids_whose_rows_carry_different_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(1, "A", None, None), (1, None, "U", None), (2, "B", "U", None)]  # 1 and 2 share a page
    rows += [(3, None, "V", None), (3, None, "W", None), (4, "C", "V", None), (5, "D", "W", None)]
    rows += [(10 + rng.randrange(60), rng.choice([None, f"g{rng.randrange(80)}"]), rng.choice([None, f"u{rng.randrange(80)}"]), None) for _ in range(80)]
    got = {r.id: r.family for r in families(spark.createDataFrame(rows, SCHEMA), "id", ["g", "u"]).collect()}
    assert same_partition(got, union_find(rows))


def test_hot_group_and_repeats(spark):
    rows = [(i, "hot" if i % 3 == 0 else None, f"u{i}", "train") for i in range(300)] + [(0, "hot", "u7", "train")]
    got = families(spark.createDataFrame(rows, SCHEMA).withColumn("family", F.lit("clash")), "id", ["g", "u"])
    fam = {r.id: r.family for r in got.collect()}
    assert len(fam) == 300 and len({fam[i] for i in range(0, 300, 3)} | {fam[7]}) == 1 and fam[1] != fam[2]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    fam = families(df, "id", ["g", "u"])
    assert fam.count() == 0
    assert balanced_splits(fam, "family", {"train": 0.8, "test": 0.2}).count() == 0


def test_mixed_leaves_out_missing_splits(spark):
    rows = [(1, "a", "train"), (2, "a", None), (3, "b", "train"), (4, "b", "val"), (5, None, "val")]
    got = mixed_families(spark.createDataFrame(rows, "id long, family string, split string"), "family", "split")
    assert sorted(r.id for r in got.collect()) == [3, 4]


def test_differencing_is_close():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 40, 2000).astype(float)
    load = np.bincount(weight_bins(w, 50), weights=w, minlength=50)
    assert load.max() - load.min() <= 2
    t = rng.integers(0, 100, (7, 10)).astype(float)
    out = difference_bins(t)
    assert sorted(map(tuple, np.sort(out, axis=1))) == [tuple(range(10))] * 7


def test_allot_follows_shares():
    split = allot(np.full(1000, 3.0), [0.8, 0.1, 0.1])
    assert np.bincount(split).tolist() == [800, 100, 100]


def test_splits_keep_families_and_shares(spark):
    got = queries.p1_splits(spark, DATA)
    m = queries._members(spark, DATA).join(got, "article_id")
    assert m.groupBy("family").agg(F.countDistinct("new_split").alias("n")).filter("n > 1").count() == 0
    share = {r.new_split: r.n for r in m.groupBy("new_split").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    assert abs(share["train"] / total - 0.8) < 0.06 and abs(share["val"] - share["test"]) / total < 0.06


def test_keys(spark):
    rows = [
        ("http://EN.m.site.example:80/wiki/A_%C4%90?oldid=3#x", "en.site.example/wiki/A_Đ", " Song / Đại_Việt ", "song/dai viet", " Training "),
        ("https://www.site.example/wiki/a+b/", "site.example/wiki/a+b", "", None, "VALIDATION"),
        (None, None, None, None, "other"),
    ]
    df = spark.createDataFrame(rows, "url string, k string, g string, n string, s string")
    got = df.select(keys.url_key(F.col("url")).alias("a"), "k", keys.name_key(F.col("g")).alias("b"), "n", keys.split_key(F.col("s")).alias("s")).collect()
    assert all(r.a == r.k and r.b == r.n for r in got) and [r.s for r in got] == ["train", "val", None]


def test_rounds_of_parts_keep_balance(spark):
    """A family of a tenth of the records, a long tail, parts combined over several rounds."""
    rows = [("giant", 3000), *((f"f{i}", 1 + i % 13) for i in range(4000))]
    members = spark.createDataFrame(rows, "fam string, n int").select("fam", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("f", F.lit("clash")).withColumn("w", F.lit(0))
    plan = balanced_splits(members, "fam", {"train": 0.8, "val": 0.1, "test": 0.1}, bins=200, part_families=90, fan=3)
    got = plan.collect()
    assert len(got) == len({r.fam for r in got}) == len(rows)
    size = dict(rows)
    load = {}
    for r in got:
        load[r.new_split] = load.get(r.new_split, 0) + size[r.fam]
    total = sum(size.values())
    assert {k: round(v / total, 2) for k, v in load.items()} == {"train": 0.8, "val": 0.1, "test": 0.1}


def test_the_way_of_hot_keys(spark, monkeypatch):
    from quillmill.functions import skew

    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(400)}", f"u{rng.randrange(900)}", None) for i in range(1500)]
    want = union_find(rows)
    monkeypatch.setattr(skew, "LEAST_ROWS", 0)
    got = {r.id: r.family for r in families(spark.createDataFrame(rows, SCHEMA), "id", ["g", "u"]).collect()}
    assert same_partition(got, want)
