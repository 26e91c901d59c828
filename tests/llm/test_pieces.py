import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import queries
from quillmill.llm.pieces import Boundaries, doubled_cuts, split_texts, successors, wrongly_cut
from tests.conftest import DATA


def walk(n, inner, size, overlap):
    """The greedy cuts one after another."""
    cuts, at = [0], 0
    while at < n:
        limit = min(n, at - min(at, overlap) + size)
        near = [b for b in [*inner, n] if at < b <= limit]
        at = max(near) if near else limit
        cuts.append(at)
    return cuts


@pytest.mark.parametrize("seed", range(20))
def test_doubling_equals_the_walk(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        n = rng.randrange(0, 700)
        texts.append((n, sorted(rng.sample(range(1, max(n, 2)), min(n // rng.choice([3, 20, 150]), max(n - 1, 0))))))
    size, overlap = rng.choice([(120, 15), (30, 5), (7, 0)])
    got = doubled_cuts([successors(n, inner, size, overlap) for n, inner in texts])
    assert [list(map(int, g)) for g in got] == [walk(n, inner, size, overlap) for n, inner in texts]


def test_boundaries():
    b = Boundaries("St. Anne met Mr. Lý. [7] In 75.5 years c. 1200.[2a] No. 9 is “good”. Next\nLine two feat. X\n1. Item one\n\nEnd")
    words = b.text.split()
    ends = [words[i - 1] for i in b.inner]
    assert ends == ["[7]", "1200.[2a]", "“good”.", "Next", "X", "one"]


def test_pieces_rebuild_the_text(spark):
    docs = spark.read.parquet(f"{DATA}/kv_store_full_docs.parquet").select("_id", "content").distinct()
    texts = {r._id: r.content.split() for r in docs.collect()}
    got = {}
    for r in split_texts(docs).orderBy("_id", "chunk_order_index").collect():
        assert len(r.content.split()) == r.words <= 120
        got.setdefault(r._id, []).append(r.content.split())
    for k, parts in got.items():
        out = list(parts[0])
        for p, q in zip(parts, parts[1:]):
            n = min(15, len(p))
            assert q[:n] == p[-n:]
            out += q[n:]
        assert out == texts[k]
    assert set(got) == set(texts)


def test_edges(spark):
    rows = [("e", ""), ("b", " \n "), ("n", None), (None, "x"), ("one", "w" * 5000), ("long", "word " * 1000), ("same", "a b c."), ("same", "a b c.")]
    df = spark.createDataFrame(rows, "_id string, content string").withColumn("d", F.lit(1)).withColumn("words", F.lit(1))
    got = {}
    for r in split_texts(df).collect():
        got.setdefault(r._id, []).append(r)
    assert set(got) == {"one", "long", "same"} and len(got["same"]) == 2 and len(got["one"]) == 1
    assert [len(r.content.split()) for r in sorted(got["long"], key=lambda r: r.chunk_order_index)][:-1] == [120] * (len(got["long"]) - 1)
    assert split_texts(df.filter("false")).count() == 0


def _brute(docs, chunks):
    bad = set()
    now = {}
    for c in chunks:
        if c[0] not in now or now[c[0]][4] <= c[4]:
            now[c[0]] = c
    by = {}
    for c in now.values():
        by.setdefault(c[1], []).append(c)
    for doc, rows in by.items():
        b = Boundaries(docs[doc])
        rows.sort(key=lambda c: c[2])
        before = None
        for i, c in enumerate(rows):
            w = c[3].split()
            n = min(15, len(before)) if before is not None else 0
            if len(w) > 120 or (before is not None and w[:n] != before[len(before) - n :]):
                bad.add((doc, c[2]))
            elif i < len(rows) - 1:
                at = docs[doc].find(c[3])
                s = sum(x < at for x in b.starts) if at else 0
                e = s + len(w)
                if e not in {*b.inner, b.words} and any(s + n < p < e for p in b.inner):
                    bad.add((doc, c[2]))
            before = w
    return bad


def test_wrongly_cut_equals_brute_force(spark):
    d = spark.read.parquet(f"{DATA}/kv_store_full_docs.parquet")
    c = spark.read.parquet(f"{DATA}/kv_store_text_chunks.parquet")
    docs = {r._id: r.content for r in d.collect()}
    rows = [(r._id, r.full_doc_id, r.chunk_order_index, r.content, r.update_time) for r in c.collect()]
    got = [(r.full_doc_id, r.chunk_order_index) for r in queries.p3_found(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(docs, rows)


def test_wrongly_cut_over_blocks_and_dirt(spark):
    text = " ".join(f"w{i} x{i} y{i}." for i in range(3000))
    words = text.split()
    rows, at = [], 0
    for i in range(2500):  # spans three blocks of indexes
        a = max(0, at - 15)
        rows.append((f"c{i}", "doc", i, " ".join(words[a : at + 3]), 1))
        at += 3
    rows[1023] = ("c1023", "doc", 1023, " ".join(rows[1023][3].split()[1:]), 1)
    rows[1500] = ("c1500", "doc", 1500, rows[1500][3] + " " + words[4503], 2)  # stops inside a sentence
    rows += [("c1500", "doc", 1500, "old state", 1), ("x", None, 1, "a", 1), ("y", "doc", None, "a", 1), ("z", "doc", 9999, None, 1), ("lone", "other", 0, "", 1), rows[3]]
    df = spark.createDataFrame(rows, "_id string, full_doc_id string, chunk_order_index int, content string, update_time long").withColumn("doc", F.lit(1)).withColumn("n", F.lit(2))
    docs = spark.createDataFrame([("doc", text)], "_id string, content string")
    got = {r.chunk_order_index for r in wrongly_cut(df, docs).collect()}
    assert got == {1023, 1500, 1501}  # piece 1023 lost its first word, its end is whole
    assert wrongly_cut(df.filter("false"), docs).count() == 0


def test_any_overlap_can_be_checked(spark):
    words = [f"w{i}." if i % 50 == 49 else f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([("doc", " ".join(words))], "_id string, content string")
    cut = split_texts(docs, size=100, overlap=40)
    stored = cut.select(F.concat(F.lit("c"), F.col("chunk_order_index")).alias("_id"), F.col("_id").alias("full_doc_id"), "chunk_order_index", "content", F.lit(1).cast("long").alias("update_time"))
    assert wrongly_cut(stored, docs, size=100, overlap=40).count() == 0
    spoilt = stored.withColumn("content", F.when(F.col("chunk_order_index") == 4, F.regexp_replace("content", r" \S+$", "")).otherwise(F.col("content")))
    assert sorted(r.chunk_order_index for r in wrongly_cut(spoilt, docs, size=100, overlap=40).collect()) == [5]  # no sentence ends in piece 4 now
    assert sorted(r.chunk_order_index for r in wrongly_cut(stored, docs, size=99, overlap=40).collect()) != []
