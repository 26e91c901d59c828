"""Functions and operators of the core on edge cases."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import text as T
from quillmill.functions.folding import compat, compose, fold
from quillmill.functions.skew import hot_join, numbered, pair_join
from quillmill.functions.vectors import as_double, cosine, fit_dims, l2_unit
from quillmill.operators import chunking as C
from quillmill.operators import curation, graph, parsing, runs
from quillmill.operators.components import connected_components
from quillmill.plans import catalogue
from tests.conftest import DATA


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalisers(spark):
    odd = ["Đại  Việt", "café ﬁn", "", None, "the A an", "!?"]
    assert one(spark, odd, fold) == ["dai  viet", "cafe fin", "", None, "the a an", "!?"]
    assert one(spark, odd, T.normalize_eval) == ["dai viet", "cafe ﬁn", "", "", "", ""]
    assert one(spark, odd, T.slugify) == ["dai_viet", "cafe_fin", "", None, "the_a_an", ""]
    assert one(spark, ["a–b “x” [12] [2a] C", None], T.normalize_span) == ['a-b "x" c', None]
    assert one(spark, ["A, b!  c."], T.normalize_legacy) == ["a b c"]
    assert one(spark, [" A, b!  c. "], T.normalize_dedup) == ["a b c"]
    assert one(spark, ["a  b c", "", None], T.word_count) in ([3, 0, -1], [3, 0, None])


def test_cleaners(spark):
    assert one(spark, ["Body\n\n\n\nmore\nReferences\n[1] x", "See also here", None], T.clean_article) == ["Body\n\nmore", "See also here", None]
    assert one(spark, ["\"'x'\" ", None], T.clean_field) == ["x", None]
    assert one(spark, ["<think>a\nb</think> yes"], T.without_thinking) == ["yes"]
    assert one(spark, ['x ```json{"a":1}``` y', "plain"], T.without_fence) == ['{"a":1}', "plain"]
    assert one(spark, ["con của", "1 is-a", "***", "", None], T.relation_type) == ["CON_CỦA", "R_1_IS_A", "RELATED_TO", "RELATED_TO", "RELATED_TO"]
    assert one(spark, ["9/10", "high", "3.5", None, "0"], T.scraped_number) == [10.0, 5.0, 3.5, 5.0, 1.0]
    assert one(spark, ["ID: 7", "id_x", "y"], T.clean_id) == ["7", "x", "y"]
    assert one(spark, ["a", "p: a"], lambda c: T.prefixed(c, "p: ")) == ["p: a", "p: a"]


@pytest.mark.parametrize(("a", "b", "want"), [("x y", "x y z", 0), ("a b c d e f", "q a b c d e r", 5), ("a b c d e f", "a b c d e f", 6), ("a b c", "c b a", 0), ("a b x a b c d", "a b c d", 4)])
def test_longest_shared_run(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.longest_shared_run(F.split("a", " "), F.split("b", " ")).alias("r")).first().r == want


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "b", "c", "d"]), ([], ["a"]), (["a"], [])], "a array<string>, b array<string>")
    assert [tuple(r.m) for r in df.select(M.token_prf(F.col("a"), F.col("b")).alias("m")).collect()] == [(0.6667, 0.5, 0.5714), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    rows = [(["alpha beta"], ["x alpha", "beta y"]), ([], ["x"]), (["x"], [])]
    s = spark.createDataFrame(rows, "s array<string>, c array<string>")
    got = s.select(M.span_hit(F.col("s"), F.col("c"), None).alias("inside"), M.joined_hit(F.col("s"), F.col("c"), 2).alias("joined"), M.joined_rr(F.col("s"), F.col("c")).alias("rr"), M.span_recall(F.col("s"), F.col("c"), None).alias("rec")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0.0, 0.0), (None, None, None, None), (0, 0, 0.0, 0.0)]
    a = spark.createDataFrame([("it is not mentioned", "True"), ("", " unanswerable"), (" ", "FALSE"), ("he was king", "partial"), ("the duration is not stated", "partial"), ("không tìm thấy", "answerable"), (None, "x")], "s string, k string")
    got = [tuple(r.v) for r in a.select(M.answerability(F.col("s"), F.col("k")).alias("v")).collect()]
    assert got == [(True, None, True, False, None), (True, 1.0, False, False, None), (False, 0.0, False, True, None), (False, None, False, False, 0.5), (True, None, False, False, 1.0), (False, None, False, False, None), (True, None, False, False, None)]
    q = spark.createDataFrame([("Ai?\nLý Nam Đế\n ai \n", 1), (" unknown.\n", 2), (None, 3), ("UNKNOWN\nX", 4)], "x string, i int")
    assert [r.e for r in q.select("i", parsing.query_entities(F.col("x")).alias("e")).orderBy("i").collect()] == [["Ai?", "Lý Nam Đế"], [], [], ["X"]]


def test_composed_forms(spark):
    odd = ["ﬁn ①", "De\u0302\u0301", "e\u0323\u0302", "Ａｂ\u00a0…", "plain", None]
    assert one(spark, odd, compat) == [unicodedata.normalize("NFKC", x) if x else None for x in odd]
    assert one(spark, odd[1:3], compose) == [unicodedata.normalize("NFC", x) for x in odd[1:3]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    v = as_double(F.col("v"))
    got = df.select(l2_unit(v).alias("u"), fit_dims(v, 3).alias("f"), cosine(v, v).alias("c")).collect()
    assert [r.u for r in got] == [[0.6, 0.8], [0.0, 0.0], None] and [r.f for r in got] == [[3.0, 4.0, 0.0], [0.0] * 3, [0.0] * 3] and [r.c for r in got] == [1.0, None, None]


def merged(parts, size, overlap):
    """The merging rule on lists of parts."""
    out, run = [], []
    for p in parts:
        if run and sum(map(len, run)) + len(p) > size:
            out.append("".join(run).strip())
            while run and (sum(map(len, run)) > overlap or sum(map(len, run)) + len(p) > size):
                run = run[1:]
        run = [*run, p]
    return out + (["".join(run).strip()] if run else [])


def split_by_rule(text, size, overlap, separators):
    at = next((k for k, x in enumerate(separators) if x == "" or x in text), None)
    sep = "" if at is None else separators[at]
    parts = [p for p in re.findall(f"(?s).*?{re.escape(sep)}|.+", text) if p] if sep else list(text)
    out, short = [], []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out, short = out + merged(short, size, overlap), []
        out += split_by_rule(p, size, overlap, separators[at + 1 :]) if sep and separators[at + 1 :] else [p]
    return out + merged(short, size, overlap)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,?;", max_size=200), st.integers(1, 60), st.integers(0, 20))
def test_recursive_split_follows_the_rule(text, size, overlap):
    assert C.recursive_split(text, size, overlap) == split_by_rule(text, size, overlap, C.RECURSIVE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["w", ".", "\n"]), max_size=120), st.integers(5, 30))
def test_packed_spans(tokens, size):
    spans = C.separator_ends(tokens, [["."], ["\n"]])
    assert [t for a, b in spans for t in tokens[a:b]] == tokens
    lengths = [b - a for a, b in spans]
    packed = C.packed_spans(lengths, size, 0)
    if max(lengths, default=0) <= size:
        assert [t for k, a, b in packed for t in tokens[a - k : b]] == tokens and all(b - a <= size for _, a, b in packed)
    assert all(i == 0 or k + b - a <= size for i, (k, a, b) in enumerate(C.packed_spans(lengths, size, 3)))


def test_long_single_piece_becomes_windows():
    lengths = lambda n: [k + b - a for k, a, b in C.packed_spans([n], 1200, 100)]
    assert lengths(1300) == [1200, 200] and lengths(1200) == [1200] and lengths(2290) == [1200, 1190]
    assert C.separator_ends([], [["."]]) == [] and C.packed_spans([], 5, 1) == []
    assert C.separator_ends("a..b", [[".", "."], ["."]]) == [(0, 3), (3, 4)] and C.separator_ends("a.b", [["."]], keep=False) == [(0, 1), (2, 3)]


def test_separator_chunks(spark):
    df = spark.createDataFrame([(1, "One sentence here. " * 40), (2, ""), (3, None), (4, "x" * 300)], "d int, t string").withColumn("tokens", F.lit("clash"))
    got = {}
    for r in C.separator_chunks(df, "d", "t", 50, 10).orderBy("d", "chunk_order_index").collect():
        got.setdefault(r.d, []).append(r)
    assert set(got) == {1, 4} and all(r.tokens <= 50 for r in got[1]) and got[1][0].chunk.startswith("One sentence here.")


def test_close_matches_equal_brute_force(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10))) for _ in range(60)]
    asked = ["abxde", *["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10))) for _ in range(40)]]
    names = sorted({*names, "abcde"})
    got = {r.query: r.ratio for r in graph.close_matches(spark.createDataFrame([(a,) for a in asked], "q string"), "q", spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    for a in set(asked):
        best = max(graph.ratio(a, n) for n in names)
        assert got[a] == (round(best, 6) if best >= 0.8 else 0.0), a


def test_window_chunks(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), (None,)], "t string")
    assert [r.chunk for r in C.window_chunks(df, "t", 4, 1).filter("t <> ''").orderBy("start").collect()] == ["abcd", "defg", "ghij"]
    assert C.window_chunks(df, "t", 4, 1).filter("t = ''").count() == 1 and C.window_chunks(df, "t", 0, 0).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_skewed_joins(spark):
    big = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    small = spark.range(-1, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        a = {tuple(r) for r in hot_join(big, small, "k", how, max_hot=2).collect()}
        assert a == {tuple(r) for r in big.join(small, "k", how).collect()}
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("r"))
    assert sorted((x.l, x.r) for x in pair_join(left, right, "k", "r", per_task=7).collect()) == [("a", i) for i in range(500)]


def test_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    assert [(r.k, r.n) for r in numbered(df, ["k"], "n").orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert numbered(df.filter("false"), ["k"], "n").count() == 0


def test_records(spark):
    raw = '<think>(x)</think>("entity"<|>"Lý"<|>"Person"<|>"a (b) c")##("entity"<|>"lý"<|>person<|>again)\n("relationship"<|>A<|>B<|>knows<|>9/10)##("relationship"<|>B<|>A<|>knows<|>x)##("relationship"<|>A<|>A<|>self<|>1)##("entity"<|>short)##text ("entity"<|>X<|>alien<|>d)<|COMPLETE|>'
    df = spark.createDataFrame([(raw,), ("",), (None,)], "x string").withColumn("r", parsing.records(F.col("x")))
    got = df.select(parsing.entities(F.col("r")).alias("e"), parsing.relationships(F.col("r")).alias("l"), parsing.record_errors(F.col("r")).alias("n")).collect()
    assert [tuple(x) for x in got[0].e] == [("LÝ", "person", "a (b) c")] and [tuple(x) for x in got[0].l] == [("A", "B", "knows", 10.0)] and got[0].n == 1
    assert got[1].e == [] and got[2].e is None
    m = spark.createDataFrame([('{"match_index": 2, "evidence": "e"}',), ('{"match_index": 9, "evidence": "e"}',), ('{"match_index": 1, "evidence": " "}',), ("bad",)], "x string")
    assert [r.y for r in m.select(parsing.match_json(F.col("x"), F.lit(3)).alias("y")).collect()] == [2, None, None, None]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x"), ("p", "q")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.hops) for r in graph.k_hop(e, s, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    nodes = spark.createDataFrame([("a", "long name", 1), ("b", "nm", 1), ("z", "n", 9)], "id string, name string, w int")
    alias = graph.alias_clusters(nodes, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))
    got = {r.id: (r.cluster_id, r.is_canonical) for r in graph.canonical(alias, "cluster_id", "id", "name", "w").collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "z": ("z", True)}
    two = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    df = spark.createDataFrame(two, "src string, dst string")
    labels = graph.label_communities(df)
    assert len({r.community for r in labels.collect()}) == 2 and graph.modularity(df, labels).first().modularity > 0.3
    m = graph.close_matches(spark.createDataFrame([("Nguyen",), ("zzz",)], "q string"), "q", spark.createDataFrame([("Nguyenn",), ("Tran",)], "n string"), "n")
    assert {(r.query, r.match) for r in m.collect()} == {("Nguyen", "Nguyenn"), ("zzz", "zzz")}


def test_runs(spark):
    log = spark.createDataFrame([(1, "timeout", 1), (1, None, 2), (2, "timeout", 1), (3, None, 1)], "id int, error string, t int")
    tasks = spark.createDataFrame([(1,), (2,), (4,)], "id int")
    assert sorted(r.id for r in runs.still_to_do(tasks, log, ["id"]).collect()) == [2, 4]
    assert {(r.id, r.t) for r in runs.latest(log, ["id"], ["t"]).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert runs.complete(log, 2, ["id"]).first().complete is True
    up = runs.upsert(log.select("id", "t"), spark.createDataFrame([(3, 9), (7, 9)], "id int, t int"), ["id"])
    assert sorted((r.id, r.t) for r in up.collect()) == [(1, 1), (1, 2), (2, 1), (3, 9), (7, 9)]
    x = spark.createDataFrame([(1, 2.0)], "id int, v double")
    assert tuple(runs.bootstrap(x, "id", "v").first()) == (2.0, 2.0, 2.0) and tuple(runs.bootstrap(x.filter("false"), "id", "v").first()) == (0.0, 0.0, 0.0)


def test_curation(spark):
    groups = spark.createDataFrame([(g, i) for g, n in (("a", 1), ("b", 3), ("c", 40)) for i in range(n)], "g string, id int")
    val = {r.g: r.n for r in curation.stratified_split(groups, "g", "id").filter("split = 'val'").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert val == {"a": 1, "b": 1, "c": 6}
    q = spark.createDataFrame([("Who?",), ("What is this text about here now?",), ("what does the thing do over there then",), ("Who ordered the palace of Zefler today?",)], "x string")
    assert [r.y for r in q.select(curation.question_verdict(F.col("x"), F.array(F.lit("river"))).alias("y")).collect()] == ["too_short", "vague_pattern", "lacks_named_entity_or_topic", "ok"]
    docs = spark.createDataFrame([(1, "Sơn Tinh ở núi Tản  Viên"), (2, "nothing"), (3, None)], "id int, t string")
    terms = spark.createDataFrame([("sơn tinh",), ("tản viên",), ("",)], "term string")
    assert [(r.id, r.terms) for r in curation.blocked_terms(docs, "id", "t", terms, "term").collect()] == [(1, ["son tinh", "tan vien"])]


def test_plans_stay_in_the_jvm(spark):
    queries = catalogue.queries()
    python = {"separator_chunks", "recursive_chunks", "close_match"}
    for name in ("normalize_eval_tokens", "token_prf", "metric_rollup", "stratified_split", "chunk_overlap_lag", "parse_extraction", "khop_neighbourhood"):
        plan = queries[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert name in python or not any(x in plan for x in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas")), name
    plan = queries["cosine_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    scan = queries["corpus_totals"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "title" not in scan.split("ReadSchema")[-1]


def test_a_name_far_into_a_question_counts(spark):
    q = spark.createDataFrame([("Who " + "went " * 10_050 + "to Gorven",), ("Who " + "went " * 10_050 + "to it",), (None,), ("",)], "x string")
    verdicts = [r.y for r in q.select(curation.question_verdict(F.col("x"), F.array(F.lit("river"))).alias("y")).collect()]
    assert verdicts[:2] == ["ok", "lacks_named_entity_or_topic"]
