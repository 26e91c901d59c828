"""Scores of answers and of retrieved chunks against plain Python, and how often their inputs are worked out."""

import random
import unicodedata
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import text as T
from quillmill.functions.folding import compat
from quillmill.plans import catalogue
from tests.conftest import DATA
from tests.test_oracles import canon


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_an_answer_are_made_once(spark):
    df = spark.createDataFrame([("The cat sat.", "a cat")], "a string, b string")
    f1 = df.select(M.token_prf(T.eval_words(F.col("a")), T.eval_words(F.col("b"))).getField("f1").alias("f1"))
    assert planned(f1).count("split(") == 2
    assert f1.first().f1 == 0.6667


def test_shared_words_are_a_multiset(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(9))], [rng.choice("abcdef") for _ in range(rng.randrange(9))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r.n for r in df.select(M.shared_count(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [sum((Counter(a) & Counter(b)).values()) for a, b in rows]


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    """The smallest tables with chunks without text, of equal or no date, spans over two chunks, and runs with one or no number."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.sql(f"CREATE TABLE k AS SELECT * FROM '{DATA}/kv_store_text_chunks.parquet'")
    con.sql(f"CREATE TABLE o AS SELECT * FROM '{DATA}/raw_outputs.parquet'")
    pieces = [("no text", None, 5), ("tie", "met Ana Bel", 5), ("tie", "met Zoe Zed", 5), ("late", "met Ana Bel", None), ("late", "nobody", 5), ("one", "by the long wall stood Ana", 5), ("two", "Bel was there and long gone", 5), ("all", "Ana  Bel, Cor Dan.", 5)]
    for key, text, at in pieces:
        con.execute("INSERT INTO k SELECT * REPLACE (?::VARCHAR AS _id, ?::VARCHAR AS content, ?::BIGINT AS update_time) FROM (FROM k LIMIT 1)", [key, text, at])
    asked = "Who met Ana Bel and Cor Dan?"
    odd = [(9001, ["no text"]), (9002, ["tie"]), (9003, ["late"]), (9004, ["one", "two"]), (9005, ["unknown", "no text", "one", "all"]), (9006, None), (9007, []), (9007, ["all", "tie"]), (None, ["all"]), (None, ["all"]), (9008, ["all", None])]
    for n, (number, ids) in enumerate(odd):
        con.execute("INSERT INTO o SELECT * REPLACE (?::BIGINT AS output_id, ?::INT AS id, ? AS doc, ? AS question, ?::VARCHAR[] AS retrieved_chunks, ?::DOUBLE AS latency_sec) FROM (FROM o LIMIT 1)", [number, 100003 + n * 2310, f"odd_{n}", asked, ids, float(n)])
    con.sql("INSERT INTO o SELECT * FROM o WHERE output_id = 9005")
    for name, file in (("k", "kv_store_text_chunks"), ("o", "raw_outputs")):
        con.sql(f"COPY {name} TO '{folder}/{file}.parquet'")
        con.sql(f"CREATE VIEW {file} AS SELECT * FROM {name}")
    return str(folder), con


def same_as_sql(spark, odd_tables, name):
    folder, con = odd_tables
    df, rel = catalogue.queries()[name](spark, folder), con.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    want = Counter(tuple(canon(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert Counter(tuple(canon(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["scorer_summary", "evaluation_report"])
def test_scores_of_odd_runs(spark, odd_tables, name):
    same_as_sql(spark, odd_tables, name)
    assert planned(catalogue.queries()[name](spark, odd_tables[0])).count(r"\[\d+[ab]?\]") <= 3  # each text is made plain once


def test_forms_of_long_texts(spark):
    long = "Lẽnfam “x” … ① ﬁn ệ " * 2000
    df = spark.createDataFrame([(long,)], "x string")
    assert df.select(compat(F.col("x")).alias("y")).first().y == unicodedata.normalize("NFKC", long)


def test_hits_of_odd_runs(spark, odd_tables):
    same_as_sql(spark, odd_tables, "span_hit_recall")
