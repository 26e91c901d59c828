import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.models import StubModel, completed, embedded, extracted, with_cache
from quillmill.sources import tables, texts
from quillmill.streaming import runs as stream


def test_json_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"id": 1, "a": "x"}\n\nbroken\n{"id": 2, "error": "timeout"}\n{"a": "no id"}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("error", T.StringType())])
    assert [r.id for r in tables.read_runs(spark, str(p), schema).collect()] == [1]
    assert tables.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    tables.write_jsonl(spark.createDataFrame([(1, "Đại Việt")], "id int, t string"), str(tmp_path / "out"))
    tables.write_jsonl(spark.createDataFrame([(2, "b")], "id int, t string"), str(tmp_path / "out"), append=True)
    assert {tuple(r) for r in tables.read_jsonl(spark, str(tmp_path / "out"), "id int, t string").collect()} == {(1, "Đại Việt"), (2, "b")}


def test_json_arrays_and_maps(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "q": "x"}]')
    (tmp_path / "b.json").write_text('{"questions": [{"id": 2, "q": "y"}]}')
    (tmp_path / "m.json").write_text('{"3": "three", "x": "bad"}')
    (tmp_path / "kv.json").write_text('{"k1": {"content": "c", "tokens": 3}}')
    assert [tuple(r) for r in tables.read_json_array(spark, str(tmp_path / "a.json"), "id:int,q:string").collect()] == [(1, "x")]
    assert [tuple(r) for r in tables.read_json_array(spark, str(tmp_path / "b.json"), "id:int,q:string").collect()] == [(2, "y")]
    assert {tuple(r) for r in tables.read_text_map(spark, str(tmp_path / "m.json")).collect()} == {(3, "three"), (None, "bad")}
    assert [tuple(r) for r in tables.read_key_value(spark, str(tmp_path / "kv.json"), "content:string,tokens:int").collect()] == [("k1", "c", 3)]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('group,requested,title,url,words,status\nh,a,A,u,700,ok\nh,b,B,u,10,"blocked: x, y"\n')
    assert [r.words for r in tables.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [700]
    assert {r.status for r in tables.read_manifest(spark, str(tmp_path / "m.csv"), None).collect()} == {"ok", "blocked: x, y"}


def test_texts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "ly_thai_to.txt").write_bytes("  Đại Việt \n".encode())
    (tmp_path / "sub" / "old.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "empty.txt").write_text("  \n")
    t = texts.read_texts(spark, str(tmp_path))
    assert {tuple(r) for r in t.collect()} == {("ly_thai_to.txt", "Đại Việt"), ("old.txt", "café")}
    assert texts.joined_texts(t).first().text == "Đại Việt\n\ncafé"
    assert [r.global_index for r in texts.ordered_texts(spark, t, ["old.txt", "ly_thai_to.txt"]).orderBy("global_index").collect()] == [0, 1]
    a = spark.createDataFrame([("Lý Thái Tổ", "x"), ("Other", "old"), ("Ly_thai_to II", "z"), ("Nothing", "none")], "title string, requested string")
    got = {r.title: r.file for r in texts.resolve_files(a, t).collect()}
    assert got == {"Lý Thái Tổ": "ly_thai_to.txt", "Other": "old.txt", "Ly_thai_to II": "ly_thai_to.txt", "Nothing": None}


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<graphml><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d1" for="edge" attr.name="weight" attr.type="double"/>'
        '<graph edgedefault="undirected"><node id="A"><data key="d0">geo</data></node><node id="B"/><edge source="A" target="B"><data key="d1">2.5</data></edge></graph></graphml>'
    )
    nodes, edges = tables.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: dict(r.attributes) for r in nodes.collect()} == {"A": {"entity_type": "geo"}, "B": {}}
    assert [(r.source, r.target, dict(r.attributes)) for r in edges.collect()] == [("A", "B", {"weight": "2.5"})]


def test_matrix_codec_round_trip(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<float>")
    out = tables.decode_matrix(tables.encode_matrix(df, "v"), "encoded", 2).collect()
    assert [r.vectors for r in out] == [[[1.0, 2.0]], None]
    new = tables.replace_vectors(df, spark.createDataFrame([(2, [5.0, 6.0])], "id int, v array<float>"), "id", "v")
    assert {r.id: r.v for r in new.collect()} == {1: [1.0, 2.0], 2: [5.0, 6.0]}


def test_reports_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("b", "two"), ("a", "one")], "h string, t string")
    tables.write_report(df, str(tmp_path / "md"), "h", "t")
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first().value.startswith("## a")
    tables.write_json_report(str(tmp_path / "r" / "report.json"), summary={"n": 2}, rows=df)
    assert json.loads((tmp_path / "r" / "report.json").read_text())["summary"] == {"n": 2}
    calls = []
    for _ in range(2):
        tables.ensure_cached(spark, str(tmp_path / "cache"), lambda: calls.append(1) or df)
    assert len(calls) == 1
    assert tables.read_columns(spark, str(tmp_path / "cache"), ["h"]).columns == ["h"]


def test_models(spark):
    df = spark.createDataFrame([(1, "one"), (2, None), (3, "one")], "id int, t string")
    got = completed(df, "t", StubModel(reply=str.upper)).orderBy("id").collect()
    assert [r.completion for r in got] == ["ONE", None, "ONE"]
    vec = embedded(df, "t", StubModel(16), 20).orderBy("id").collect()
    assert [len(r.embedding) for r in vec] == [20, 20, 20] and set(vec[1].embedding) == {0.0} and vec[0].embedding == vec[2].embedding
    whole = "a" * 240 + "\n" + "b" * 240
    long = spark.createDataFrame([(whole,)], "t string")
    parts = extracted(long, "t", StubModel(reply=lambda p: p if len(p) < 300 else ""), bool).first().parts
    assert len(parts) == 2 and "".join(parts) == whole
    cache = spark.createDataFrame([], "key string, completion string")
    assert with_cache(df.filter("t IS NOT NULL"), "t", cache, lambda x: completed(x, "t", StubModel(reply=str.upper)), "completion").count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 00:10:00"), (1, "a", 1.0, "2024-01-01 00:10:00"), (2, "a", 3.0, "2024-01-01 00:20:00"), (3, "b", 5.0, "2024-01-02 00:00:00")], "id int, g string, v double, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "id int, g string, v double, ts timestamp"
    for _ in range(2):  # a second run over the same input adds nothing
        stream.append_new(stream.read_stream(spark, str(tmp_path / "in"), schema, "parquet"), str(tmp_path / "out"), ["id"], str(tmp_path / f"cp{_}")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    s = stream.first_per_key(stream.read_stream(spark, str(tmp_path / "in"), schema, "parquet"), ["id"], "ts")
    q = s.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 3
    q = stream.windowed_rollup(stream.read_stream(spark, str(tmp_path / "in"), schema, "parquet"), "ts", "g", "v").writeStream.format("memory").queryName("roll").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.g, r.n, r.total) for r in spark.table("roll").collect()} == {("a", 3, 5.0), ("b", 1, 5.0)}
