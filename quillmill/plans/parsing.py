"""Queries that parse model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.operators import parsing as P
from quillmill.plans.catalogue import query
from quillmill.plans.evaluation import _RUNS, _SAID, runs
from quillmill.session import table

_RAW_SQL = """w AS (SELECT article_id, '<think>plan ## (x)</think>("entity"<|>"' || title || '"<|>"' || CASE article_id % 5 WHEN 4 THEN 'planet' WHEN 3 THEN ' Person' ELSE 'geo' END || '"<|>"page of ' || coalesce("group", '') || '")##("entity"<|>' || lower(title) || '<|>geo<|>again)##("relationship"<|>' || title || '<|>' || requested
    || '<|>stands for<|>' || coalesce(words::VARCHAR, 'many') || '/10)' || chr(10) || '("Relationship"<|>' || coalesce("group", '') || '<|>' || title || '<|>holds<|>9)##("entity"<|>short)##("claim"<|>a<|>b)##noise' || chr(10) || CASE WHEN article_id % 2 = 0 THEN '("relationship"<|>a<|>b<|>c)' ELSE '' END || '<|COMPLETE|>' AS raw
  FROM (SELECT DISTINCT article_id, title, requested, "group", words FROM val_articles WHERE title IS NOT NULL AND requested IS NOT NULL)),
p AS (SELECT article_id, unnest(string_split(replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), chr(10) || '(', '##('), '##')) AS p, generate_subscripts(string_split(replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), chr(10) || '(', '##('), '##'), 1) AS i FROM w),
f AS (SELECT article_id, i, list_transform(string_split(trim(regexp_extract(replace(p, '<|COMPLETE|>', ''), '(?s)\\((.*)\\)', 1)), '<|>'), lambda x: trim(regexp_replace(trim(x), '^["'']+|["'']+$', '', 'g'))) AS f FROM p WHERE regexp_matches(replace(p, '<|COMPLETE|>', ''), '(?s)\\(.*\\)')),
e AS (SELECT article_id, upper(f[2]) AS name FROM f WHERE lower(f[1]) = 'entity' AND len(f) >= 4 AND f[2] <> '' AND f[4] <> '' AND lower(f[3]) IN ('organization', 'person', 'geo', 'event')),
r AS (SELECT article_id, i, upper(f[2]) AS src, upper(f[3]) AS tgt, least(10.0, greatest(1.0, coalesce(TRY_CAST(regexp_replace(f[5], '[^\\d.]', '', 'g') AS DOUBLE), 5.0))) AS strength FROM f WHERE lower(f[1]) = 'relationship' AND len(f) >= 5 AND f[2] <> '' AND f[3] <> '' AND upper(f[2]) <> upper(f[3]) AND f[4] <> ''),
u AS (SELECT article_id, min(i) AS i FROM r GROUP BY article_id, least(src, tgt), greatest(src, tgt)),
x AS (SELECT w.article_id, (SELECT count(DISTINCT name) FROM e WHERE e.article_id = w.article_id)::INT AS entities, (SELECT count(*) FROM u WHERE u.article_id = w.article_id)::INT AS relations,
  (SELECT arg_min(src, i) FROM r WHERE r.article_id = w.article_id) AS src, (SELECT arg_min(strength, i) FROM r WHERE r.article_id = w.article_id) AS strength,
  (SELECT count(*) FROM f WHERE f.article_id = w.article_id AND (lower(f[1]) = 'entity' AND len(f) < 4 OR lower(f[1]) = 'relationship' AND len(f) < 5))::INT AS errors FROM w)"""


def raw_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Model output in the record format, written from the articles: repeated names, unknown kinds, lacking fields."""
    a = table(spark, d, "val_articles").filter("title IS NOT NULL AND requested IS NOT NULL").select("article_id", "title", "requested", F.coalesce("group", F.lit("")).alias("g"), "words").distinct()
    kind = F.when(F.col("article_id") % 5 == 4, "planet").when(F.col("article_id") % 5 == 3, " Person").otherwise("geo")
    raw = F.concat(
        F.lit('<think>plan ## (x)</think>("entity"<|>"'), "title", F.lit('"<|>"'), kind, F.lit('"<|>"page of '), "g", F.lit('")##("entity"<|>'), F.lower("title"), F.lit('<|>geo<|>again)##("relationship"<|>'), "title", F.lit("<|>"), "requested", F.lit("<|>stands for<|>"),
        F.coalesce(F.col("words").cast("string"), F.lit("many")), F.lit('/10)\n("Relationship"<|>'), "g", F.lit("<|>"), "title", F.lit('<|>holds<|>9)##("entity"<|>short)##("claim"<|>a<|>b)##noise\n'),
        F.when(F.col("article_id") % 2 == 0, '("relationship"<|>a<|>b<|>c)').otherwise(""), F.lit("<|COMPLETE|>"),
    )
    return a.select("article_id", raw.alias("raw"))


def extractions(spark: SparkSession, d: str) -> DataFrame:
    x = raw_extractions(spark, d).select("article_id", P.records(F.col("raw")).alias("r"))
    return x.select("article_id", P.entities(F.col("r")).alias("e"), P.relationships(F.col("r")).alias("l"), P.record_errors(F.col("r")).alias("errors"))


@query(f"WITH {_RAW_SQL} SELECT article_id, entities, relations, src, strength, errors FROM x")
def parse_extraction(spark: SparkSession, d: str) -> DataFrame:
    return extractions(spark, d).select("article_id", F.size("e").alias("entities"), F.size("l").alias("relations"), F.get("l", F.lit(0))["src"].alias("src"), F.get("l", F.lit(0))["strength"].alias("strength"), "errors")


@query(f"WITH {_RAW_SQL} SELECT count(*) AS processed, sum(entities)::BIGINT AS total_entities, sum(relations)::BIGINT AS total_relations, sum(errors)::BIGINT AS total_errors, count(*) FILTER (WHERE entities = 0) AS empty_chunks FROM x")
def extraction_totals(spark: SparkSession, d: str) -> DataFrame:
    return P.extraction_totals(extractions(spark, d), "e", "l", "errors")


_GROUND = "(contains(lower(text), lower({0})) OR len(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3 AND contains(lower(text), w))) > 0)"


@query(f"""WITH x AS (SELECT doc_id, text, title, source FROM documents WHERE text IS NOT NULL AND title IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, {_GROUND.format('title')} AS title_grounded, {_GROUND.format('source')} AS source_grounded, {_GROUND.format('title')} AND {_GROUND.format('source')} AS relation_kept FROM x""")
def grounded_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Names are verified against their text first; a relation stays only between verified names."""
    x = table(spark, d, "documents").filter("text IS NOT NULL AND title IS NOT NULL AND source IS NOT NULL")
    x = x.select("doc_id", P.grounded(F.col("title"), F.col("text")).alias("title_grounded"), P.grounded(F.col("source"), F.col("text")).alias("source_grounded"))
    return x.withColumn("relation_kept", F.col("title_grounded") & F.col("source_grounded"))


@query("SELECT event_type, (props->>'k')::INT % 10 AS k_mod, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def parse_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "struct<k:int>").getField("k")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("k_mod")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH m AS (SELECT output_id, regexp_extract_all(answer, '\\[Data:[^\\]]*?\\([\\d\\s,;+more]+\\)\\]|(?:Sources|Text|Input Text)\\s*\\([\\d\\s,]+\\)') AS m FROM {_RUNS} WHERE answer IS NOT NULL),
n AS (SELECT output_id, unnest(m) AS one, generate_subscripts(m, 1) AS i FROM m), k AS (SELECT output_id, i, regexp_extract_all(regexp_extract(one, '\\(([\\d\\s,;+more]+)\\)\\]?$', 1), '\\d+') AS ids FROM n),
e AS (SELECT output_id, i, unnest(ids)::BIGINT AS id, generate_subscripts(ids, 1) AS j FROM k)
SELECT output_id, id AS cited, (row_number() OVER (PARTITION BY output_id ORDER BY min((i, j))) - 1)::INT AS place FROM e GROUP BY output_id, id""")
def citation_ids(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).filter("answer IS NOT NULL").select("output_id", F.posexplode(P.cited_ids(F.col("answer"))).alias("place", "cited"))


_CTX = """c AS (SELECT _id, content, chunk_order_index % 3 AS form, replace(replace(content, chr(10), ' '), chr(13), ' ') AS flat FROM kv_store_text_chunks QUALIFY row_number() OVER (PARTITION BY _id ORDER BY update_time DESC, content) = 1)"""


@query(f"""WITH {_CTX} SELECT _id, form, CASE form WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 1 END::INT AS chunks, md5(CASE form WHEN 0 THEN trim(flat) || '|' || 'second part' WHEN 1 THEN trim(flat) ELSE trim(flat) END) AS joined_md5, trim(flat) AS answer FROM c""")
def context_sections(spark: SparkSession, d: str) -> DataFrame:
    """Contexts written in the three forms that retrievers print, parsed back into chunks; and a tool's output cleaned."""
    c = table(spark, d, "kv_store_text_chunks")
    c = c.groupBy("_id").agg(F.max_by(F.struct("content", "chunk_order_index"), F.struct("update_time")).alias("s")).select("_id", "s.*")
    c = c.withColumn("flat", F.translate("content", "\n\r", "  ")).withColumn("form", F.col("chunk_order_index") % 3)
    context = (
        F.when(F.col("form") == 0, F.concat("flat", F.lit("--New Chunk--"), F.lit("second part"))).when(F.col("form") == 1, F.concat(F.lit("head-----Sources-----\n\n"), "flat", F.lit("\n\n")))
        .otherwise(F.concat(F.lit("Entities\nDocument Chunks\n```json\n"), F.to_json(F.struct(F.col("flat").alias("content"))), F.lit("\nbroken {\n```\n")))
    )
    parsed = F.when(F.col("form") < 2, P.marked_context(context)).otherwise(P.fenced_context(context))
    answer = P.tool_answer(F.concat(F.lit(">> log line\n  >> more\nSUCCESS: Local Search Response: "), "flat"))
    return c.select("_id", "form", F.size(parsed).alias("chunks"), F.md5(F.array_join(parsed, "|")).alias("joined_md5"), answer.alias("answer"))


@query("SELECT r_name, count(n_name)::INT AS entities, (count(*) - 1)::INT AS relations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def kg_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """A graph in JSON per region: its nations, a chain of relations given both ways, one with an unknown end, one nameless entity."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    ents = F.concat(F.transform("n", lambda x: F.struct(x["n_nationkey"].cast("string").alias("id"), x["n_name"].alias("name"), F.lit("geo").alias("type"))), F.array(F.struct(F.lit("99").alias("id"), F.lit("").alias("name"), F.lit("geo").alias("type"))))
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"), F.lit("NEAR").alias("type"))
    at = lambda i: F.col("n")[i].getField("n_nationkey").cast("string")
    steps = F.sequence(F.lit(0), F.size("n") - 2)
    rels = F.concat(F.transform(steps, lambda i: pair(at(i), at(i + 1))), F.transform(steps, lambda i: pair(at(i + 1), at(i))), F.array(pair(at(F.lit(0)), F.lit("99"))))
    raw = F.concat(F.lit("<think>x</think>```json\n"), F.to_json(F.struct(ents.alias("entities"), rels.alias("relations"))), F.lit("\n```"))
    v = P.valid_graph(P.graph_json(raw))
    return g.select("r_name", F.size(v.getField("entities")).alias("entities"), F.size(v.getField("relations")).alias("relations"))


@query(f"""SELECT output_id, CASE WHEN output_id % 7 = 0 THEN 0.0 ELSE (output_id % 11) / 10.0 END::DOUBLE AS correctness, CASE WHEN output_id % 7 = 0 THEN 0 ELSE output_id % 4 END::INT AS covered,
  CASE WHEN output_id % 3 > 0 THEN least(1.0, CASE WHEN output_id % 7 = 0 THEN 0 ELSE output_id % 4 END / (output_id % 3)) END::DOUBLE AS key_point_recall, coalesce(nullif({_SAID}, ''), coalesce(answer, '')) AS said FROM {_RUNS}""")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Judge output in JSON, some broken, read with defaults; key-point recall; the answer without its thinking unless nothing is left."""
    i = F.col("output_id")
    raw = F.when(i % 7 == 0, F.lit("no json")).otherwise(F.concat(F.lit('<think>hm</think>```json\n{"answer_correctness": '), ((i % 11) / 10.0).cast("string"), F.lit(', "key_points_covered": '), (i % 4).cast("string"), F.lit("}\n```")))
    from quillmill.functions.text import without_thinking

    a = F.coalesce("answer", F.lit(""))
    x = runs(spark, d).select("output_id", P.judge_json(raw).alias("j"), F.coalesce(F.nullif(without_thinking(a), F.lit("")), a).alias("said"))
    return x.select("output_id", F.col("j.answer_correctness").alias("correctness"), F.col("j.key_points_covered").alias("covered"), M.key_point_recall(F.col("j.key_points_covered"), F.col("output_id") % 3).alias("key_point_recall"), "said")


_TRIG = "|".join(P.ALIAS_TRIGGERS)


@query(f"""WITH x AS (SELECT DISTINCT article_id, requested AS a, title AS b, article_id % 4 AS form FROM val_articles),
t AS (SELECT *, CASE form WHEN 0 THEN a || ', còn gọi là ' || b || ' sinh ở đây' WHEN 1 THEN 'Ở đây ' || b || ' tức ' || a WHEN 2 THEN a || ' (' || b || ', 1200)' ELSE a || ' và ' || b END AS text FROM x)
SELECT article_id, CASE form WHEN 0 THEN a || ', còn gọi là ' || b WHEN 1 THEN b || ' tức ' || a WHEN 2 THEN a || ' (' || b || ', 1200)' ELSE '' END AS evidence, CASE form WHEN 0 THEN 'POSITIVE' WHEN 1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS meaning FROM t""")
def alias_evidence(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "val_articles").select("article_id", F.col("requested").alias("a"), F.col("title").alias("b"), (F.col("article_id") % 4).alias("form")).distinct()
    text = F.when(F.col("form") == 0, F.concat("a", F.lit(", còn gọi là "), "b", F.lit(" sinh ở đây"))).when(F.col("form") == 1, F.concat(F.lit("Ở đây "), "b", F.lit(" tức "), "a")).when(F.col("form") == 2, F.concat("a", F.lit(" ("), "b", F.lit(", 1200)"))).otherwise(F.concat("a", F.lit(" và "), "b"))
    kind = F.when(F.col("form") == 0, "TÊN_KHÁC").when(F.col("form") == 1, "CON_CỦA").otherwise("Ở_GẦN")
    return x.select("article_id", P.alias_evidence(F.col("a"), F.col("b"), text).alias("evidence"), P.relation_meaning(kind).alias("meaning"))
