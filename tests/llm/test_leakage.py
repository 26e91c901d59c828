import random

import pytest
from pyspark.sql import functions as F

import numpy as np

from quillmill.llm.leakage import ItemAutomaton, Seeds, leaked_items, run_hashes, without_leaks
from quillmill.llm.textnorm import folded_words, folded_words_at


def brute(items, words, k):
    return {i for i, w in items for a in range(len(words) - k + 1) for b in range(len(w) - k + 1) if words[a : a + k] == w[b : b + k]}


@pytest.mark.parametrize("seed", range(30))
def test_scan_equals_brute_force(seed):
    rng = random.Random(seed)
    alphabet = "abcd" if seed % 2 else "abcdefghij"
    items = [(i, [rng.choice(alphabet) for _ in range(rng.randrange(1, 40))]) for i in range(8)]
    words = [rng.choice(alphabet + "z") for _ in range(120)] + items[3][1]
    k = rng.choice([2, 3, 5])
    auto = ItemAutomaton(items, k)
    found = {i for _, _, g in auto.scan(words) for i in auto.items.get(g, ())}
    assert found == brute(items, words, k)
    for at, run, _ in auto.scan(words):  # the run is the longest one that ends there
        text = ["".join(w) for _, w in items]
        assert any("".join(words[at - run + 1 : at + 1]) in t for t in text)
        assert run > at or not any("".join(words[at - run : at + 1]) in t for t in text)


def test_normal_words():
    text = "<p>Đại&nbsp;Việt[24] l&agrave; “quasi-autonomous” *x* wo­rd.[2a]</p>"
    assert folded_words(text) == ["dai", "viet", "la", "quasi", "autonomous", "x", "word"]
    words, places = folded_words_at(text)
    assert words == folded_words(text) and text[slice(*places[-1])].startswith("wo")


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_leaks_and_removal(spark):
    docs = [(1, "x " + PASSAGE.upper().replace(" ", ", ") + " y"), (2, " ".join(PASSAGE.split()[:11])), (3, None), (4, ""), (5, "start " * 60 + " ".join(PASSAGE.split()[1:13]) + " stop" * 30), (None, PASSAGE), (1, "x " + PASSAGE)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("d", F.lit(0)).withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(7, PASSAGE), (8, PASSAGE + " more"), (9, "short one"), (10, None), (None, PASSAGE), (7, PASSAGE)], "item_id long, passage string")
    for options in ({}, {"block_words": 14}, {"block_words": 14, "pass_words": 15}):
        got = sorted((r.doc_id, r.item_id, r.longest) for r in leaked_items(d, items, **options).collect())
        assert got == [(1, 7, 14), (1, 7, 14), (1, 8, 14), (1, 8, 14), (5, 7, 12), (5, 8, 12)]
    clean = {r.doc_id: (r.text, r.removed_words) for r in without_leaks(d.filter("doc_id <> 1"), items).collect()}
    for options in ({"block_words": 14}, {"block_words": 14, "pass_words": 15}):
        assert clean == {r.doc_id: (r.text, r.removed_words) for r in without_leaks(d.filter("doc_id <> 1"), items, **options).collect()}
    everything = without_leaks(d, items, block_words=14, pass_words=15).collect()
    assert len(everything) == 7 and [r.text for r in everything if r.doc_id is None] == [PASSAGE]
    assert clean[3] == (None, 0) and clean[4] == ("", 0) and clean[2][1] == 0 and clean[5][1] == 12 and "seven" not in clean[5][0] and clean[5][0].startswith("start")
    assert without_leaks(d.filter("doc_id = 1"), items).first().text == ""
    assert leaked_items(d, items.filter("false")).count() == 0 and leaked_items(d.filter("false"), items).count() == 0


def test_seeds_find_each_shared_run():
    rng = random.Random(5)
    items = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    texts = [[rng.choice("abcdefghi") for _ in range(rng.randrange(0, 80))] for _ in range(60)]
    hashes, owner = run_hashes(items, 4)
    own, block = Seeds(hashes, owner).hits(*run_hashes(texts, 4))
    runs = [{tuple(w[a : a + 4]) for a in range(len(w) - 3)} for w in items]
    want = {(t, i) for t, w in enumerate(texts) for i, r in enumerate(runs) if any(tuple(w[a : a + 4]) in r for a in range(len(w) - 3))}
    assert set(zip(own.tolist(), block.tolist())) == want


def test_many_items_take_one_pass(spark):
    """Two hundred blocks of items: each document meets the blocks of its own items only."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    passages = [" ".join(words[rng.integers(0, 5000, 50)]) for _ in range(2000)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    docs = [(d, " ".join(words[rng.integers(0, 5000, 40)]) + " " + " ".join(passages[d * 7].split()[5:30])) for d in range(200)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items, block_words=500)
    assert sorted((r.doc_id, r.item_id, r.longest) for r in got.collect()) == [(d, d * 7, 25) for d in range(200)]
