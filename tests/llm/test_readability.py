import numpy as np
from pyspark.sql import functions as F

from quillmill.llm.readability import cut_points, grade, is_vietnamese, reading_levels, running_text, sentences, syllables

SF = "/root/testdata/sf0.01"


def test_syllables():
    words = "the=1 make=1 table=2 consolidation=5 wanted=2 loved=1 rhythm=2 x=1 being=2 science=2 poem=2 created=3 idea=3 every=2 business=2 tables=2 houses=2 churches=2 national=3 special=2 radio=3 area=3 people=2 quiet=2 queen=1 language=2 actual=3 ruin=2 fruit=1 movement=2 beautiful=3 prism=2 society=4 young=1 museum=3 theatre=3 lion=2 nation=2 union=2 million=2 influence=3 guard=1 cooperate=4 ocean=2 linear=3 association=5 everything=3 something=2 changes=2 royal=2 whole=1 walked=1"
    want = {w: int(n) for w, n in (x.split("=") for x in words.split())}
    assert {w: syllables(w) for w in want} == want
    assert syllables("") == 1 and syllables("Đại") == 1


def test_running_text():
    text = "Early life\nThe king met St. Anne c. 1200. It was <b>good</b>.[2a]\n\n1. Song (4:45)\n2. Other (3:20)\nA wrapped\nline ends here.\nRetrieved from here"
    prose = running_text(text)
    assert "Early" not in prose and "Song" not in prose and "Retrieved" not in prose and "wrapped line ends" in prose
    assert len(sentences(prose)) == 3
    assert is_vietnamese("Vua của làng này là người tốt.") and not is_vietnamese("The king of the town was good.")


def test_grades_rise_with_difficulty():
    easy = "The king was good. He had a boat. It was red."
    hard = "Notwithstanding the institutionalization of bureaucratic jurisdiction, several accounts describe how the confederation consolidated an unprecedented administration, thereby reducing the province to a ceremonial sovereignty."
    assert grade(easy, frozenset())[1] + 10 < grade(hard, frozenset())[1] and grade("…", frozenset()) is None
    one, joined = "Vua có chủ quyền quốc thể.", frozenset({("chủ", "quyền"), ("quyền", "quốc"), ("quốc", "thể")})
    assert grade(one, frozenset())[1] < grade(one, joined)[1]


def test_cut_points_are_best():
    rng = np.random.default_rng(2)
    lev = rng.integers(1, 6, 60)
    g = lev + rng.normal(0, 0.6, 60)
    wrong = lambda cuts: (1 + np.searchsorted(cuts, g) != lev).sum()
    got = wrong(cut_points(g, lev))
    tries = [np.sort(rng.choice(np.r_[g - 1e-9, g + 1e-9], 4)) for _ in range(4000)]
    assert got <= min(wrong(t) for t in tries) and got <= wrong([1.5, 2.5, 3.5, 4.5])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/reading_labels.parquet")
    half = F.pmod(F.hash("doc_id"), F.lit(2))
    level = {r.doc_id: r.level for r in reading_levels(docs, labels.filter(half == 0)).collect()}
    held = labels.filter((half == 1) & F.col("level").isNotNull()).groupBy("doc_id").agg(F.expr("percentile(level, 0.5)").alias("l")).collect()
    held = [r for r in held if r.doc_id in level]
    assert np.mean([level[r.doc_id] == round(r.l) for r in held]) > 0.7 and np.mean([abs(level[r.doc_id] - r.l) <= 1 for r in held]) > 0.97


def test_dirt(spark):
    rows = [(1, None), (2, " \n\t"), (3, "..."), (4, "The king was good."), (4, "The king was good."), (5, "word " * 50000), (None, "The end is here.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit(1)).withColumn("level", F.lit(9)).withColumn("grade", F.lit("x"))
    labels = spark.createDataFrame([(4, None), (4, 9), (99, 3)], "doc_id long, level int")
    got = sorted((r.doc_id or 0, r.level) for r in reading_levels(docs, labels).collect())
    assert [d for d, _ in got] == [0, 3, 4, 4, 5] and all(1 <= n <= 5 for _, n in got) and dict(got)[3] == 1
    assert reading_levels(docs.filter("false"), labels).count() == 0


def test_without_ratings_levels_are_fifths(spark):
    docs = spark.createDataFrame([(i, "The king " + "was very good " * i + ".") for i in range(1, 51)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, level int")
    got = {r.level: r.n for r in reading_levels(docs, none).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(8 <= n <= 12 for n in got.values())
    vietnamese = spark.createDataFrame([(99, "Vua của làng này là người tốt.")], "doc_id long, text string")
    rated = spark.createDataFrame([(i, 1 + i // 11) for i in range(1, 51)], "doc_id long, level int")
    assert reading_levels(docs.unionByName(vietnamese), rated).filter("doc_id = 99").first().level in (1, 2)
