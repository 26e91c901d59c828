import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm.packing import RANKS, Packing, WordCounts, cut_text, encoding, pack_texts, token_count
from tests.conftest import DATA


@pytest.mark.parametrize("seed", range(5))
def test_search_keeps_items_and_improves(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(300, 1300, 800)
    p = Packing(size, 2048)
    start = sum(map(bool, p.bins))
    p.improve()
    load = np.bincount(p.home, weights=size)
    assert load.max() <= 2048 and sorted(i for b in p.bins for i in b) == list(range(800))
    assert p.least_bins() <= sum(map(bool, p.bins)) <= start
    assert all(p.free[b] == 2048 - sum(size[i] for i in own) for b, own in enumerate(p.bins))


def test_exchange_empties_a_light_container():
    p = Packing(np.array([6, 5, 4, 3]), 9)  # best fit: 6+3, 5+4
    assert sum(map(bool, p.bins)) == 2
    q = Packing(np.array([4, 4, 4, 3, 3, 3, 3]), 12)
    q.improve()
    assert sum(map(bool, q.bins)) == q.least_bins() == 2


def test_two_for_one_looks_at_small_items_too():
    p = Packing(np.array([95, *[7] * 12, 4, 3, 2]), 100)  # best fit: 95+4, the rest; only 3 and 2 can go for 4
    assert p._step(1) and p.free == [0, 12]


def test_cut_text_rebuilds_and_fits():
    enc = encoding(RANKS)
    text = "Đại Việt  is  a\n\nland. " * 400 + "x" * 9000 + " end"
    parts = cut_text(text, 256, enc)
    assert "".join(text[a:b] for a, b, _ in parts) == text
    assert all(n <= 256 and token_count(text[a:b], enc) <= 256 for a, b, n in parts)


class _Counted:
    """A tokenizer that notes what it encodes."""

    def __init__(self):
        self.enc, self.seen = encoding(RANKS), []

    def encode_ordinary(self, text):
        self.seen.append(text)
        return self.enc.encode_ordinary(text)


def test_repeated_words_are_encoded_once():
    enc = _Counted()
    text = "Đại Việt is a land. " * 2000
    parts = cut_text(text, 2048, enc)
    assert "".join(text[a:b] for a, b, _ in parts) == text and len(parts) > 1
    assert sum(n for _, _, n in parts) == token_count(text, enc.enc)
    assert len(enc.seen) < 10 + 10 * len(parts)


def test_words_add_up_to_the_text():
    enc, rng = encoding(RANKS), np.random.default_rng(3)
    letters = [*"ab1'sé .,!\n\t\r \x1c\x1d\x1f\x85\u00a0\u2003\u3000\u200b\u0301ạ漢字😀٣²Ⅳ", "'s", "  ", "\n\n", " \n", "Việt", "don't"]
    counts = WordCounts(enc, most=50, longest=6)  # dropped and refilled on the way
    for n in rng.integers(0, 15, 3000):
        text = "".join(rng.choice(letters, n))
        assert counts.of(text) == token_count(text, enc), repr(text)
    assert len(counts) <= 50 and max(map(len, counts)) <= 6


def test_full_containers_are_not_searched(monkeypatch):
    step, looked = Packing._step, []
    monkeypatch.setattr(Packing, "_step", lambda self, light: looked.append(self.free[light]) or step(self, light))
    p = Packing(np.array([10] * 300 + [6, 6, 6]), 10)  # 6 and 6 never meet
    p.improve()
    assert sum(map(bool, p.bins)) == 303 and looked and min(looked) > 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = pack_texts(docs, shard_items=60).toPandas()
    enc = encoding(RANKS)
    size = {r.doc_id: token_count(r.text, enc) for r in docs.collect() if r.text}
    assert got.groupby("doc_id").tokens.sum().to_dict() == {k: n for k, n in size.items() if n}
    load = got.groupby("container").tokens.sum()
    assert load.max() <= 2048 and (got[got.pieces == 1].groupby("doc_id").size() == 1).all()
    assert set(got[got.pieces > 1].doc_id) == {k for k, n in size.items() if n > 2048}
    assert (got.groupby("container").position.max() + 1 == got.groupby("container").size()).all()
    assert load.sum() / (2048 * len(load)) > 0.9


def test_dirt(spark):
    rows = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "lost id"), (4, "a b c " * 4000)]
    got = pack_texts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit(1)).withColumn("tokens", F.lit(1)).withColumn("shard", F.lit(1))).toPandas()
    assert got[got.doc_id == 3].shape[0] == 2 and not set(got.doc_id.dropna()) & {1, 2} and got[got.doc_id == 4].shape[0] > 1 and got.doc_id.isna().sum() == 1
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
