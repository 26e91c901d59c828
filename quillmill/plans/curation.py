"""Queries that filter, sample and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import curation as C
from quillmill.plans.catalogue import query
from quillmill.plans.text import sql_strip, sql_words
from quillmill.plans.vectors import SQL_UNIT
from quillmill.session import table

_BARE = "trim(regexp_replace(lower(strip_accents(translate({0}, 'đĐ', 'dD'))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_TERMS = f"""t AS (SELECT DISTINCT {_BARE.format('subject')} AS run FROM eval_passages),
w AS (SELECT doc_id, string_split({_BARE.format('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT DISTINCT len(string_split(run, ' ')) AS k FROM t WHERE run <> ''),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, k WHERE len(w) >= k)),
b AS (SELECT doc_id, list_sort(list(DISTINCT run)) AS terms FROM g JOIN t USING (run) GROUP BY doc_id)"""


@query(f"WITH {_TERMS} SELECT doc_id, terms FROM b")
def leak_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.blocked_terms(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"), "subject")


@query(f"""WITH {_TERMS}, s AS (SELECT d.doc_id, text, b.terms, len({sql_words('text')}) AS n FROM documents d LEFT JOIN b USING (doc_id)),
f AS (SELECT lower(title) AS lt, min(doc_id) AS first FROM documents WHERE title IS NOT NULL GROUP BY 1)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN 'missing' WHEN f.first <> s.doc_id THEN 'duplicate'
  WHEN len(terms) > 0 THEN 'blocked: ' || array_to_string(terms[1:5], ', ') || CASE WHEN len(terms) > 5 THEN ' (+' || (len(terms) - 5) || ' more)' ELSE '' END
  WHEN n < 100 THEN 'too short (' || n || ')' ELSE 'ok' END AS status
FROM s JOIN documents d USING (doc_id) LEFT JOIN f ON lower(d.title) = f.lt""")
def article_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "title", "text")
    first = docs.filter("title IS NOT NULL").groupBy(F.lower("title").alias("lt")).agg(F.min("doc_id").alias("first"))
    x = docs.withColumn("lt", F.lower("title")).join(first, "lt", "left").join(leak_filter(spark, d), "doc_id", "left")
    seen = F.coalesce(F.col("first") != F.col("doc_id"), F.lit(False))
    return x.select("doc_id", C.article_status(F.col("text"), seen, F.coalesce("terms", F.array().cast("array<string>")), 100).alias("status"))


@query("SELECT min(article_id) AS article_id, lower(title) AS lt, count(DISTINCT article_id) AS records FROM val_articles GROUP BY lower(title)")
def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "val_articles").select("article_id", F.lower("title").alias("lt")).distinct()
    n = a.groupBy("lt").agg(F.count("*").alias("records"))
    return C.keep_first(a, ["lt"], ["article_id"]).join(n, "lt").select("article_id", "lt", "records")


@query(f"""WITH a AS (SELECT DISTINCT article_id, coalesce("group", '') AS grp FROM val_articles),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {SQL_UNIT.format("'42|' || article_id")}, article_id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM a)
SELECT article_id, CASE WHEN k <= greatest(1, round_even(0.15 * n, 0)) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "val_articles").select("article_id", F.coalesce("group", F.lit("")).alias("grp")).distinct()
    return C.stratified_split(a, "grp", "article_id").select("article_id", "split")


@query(f"""WITH p AS (SELECT DISTINCT output_id, question, answer FROM raw_outputs WHERE answer IS NOT NULL),
w AS (SELECT output_id, {sql_words("regexp_replace(lower(question), '[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]', ' ', 'g')")} AS q, ' ' || array_to_string({sql_words("regexp_replace(lower(answer), '[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]', ' ', 'g')")}, ' ') || ' ' AS a FROM p),
g AS (SELECT output_id, q, a, unnest(range(1, len(q) + 1)) AS i FROM w), k AS (SELECT *, unnest(range(3, len(q) - i + 2)) AS k FROM g),
m AS (SELECT output_id, max(k) AS run FROM k WHERE contains(a, ' ' || array_to_string(q[i:i + k - 1], ' ') || ' ') GROUP BY output_id)
SELECT output_id, coalesce(run, 0)::INT AS run, coalesce(run, 0) >= 6 AS verbatim FROM w LEFT JOIN m USING (output_id)""")
def verbatim_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of question words in the answer, of three words or more; six or more count as verbatim."""
    p = table(spark, d, "raw_outputs").filter("answer IS NOT NULL").select("output_id", "question", "answer").distinct()
    p = p.select("output_id", T.plain_words(F.col("question")).alias("q"), T.plain_words(F.col("answer")).alias("a"))
    return p.select("output_id", T.longest_shared_run(F.col("q"), F.col("a")).alias("run")).withColumn("verbatim", F.col("run") >= 6)


_Q = sql_strip("question")
_VERDICT = f"""CASE WHEN len({sql_words(_Q)}) < 5 OR length({_Q}) < 22 THEN 'too_short'
  WHEN regexp_matches({_Q}, '(?i)^what (is|are) (this|the) (text|passage|article|paragraph)|^what (happened|happens) in (this|the) (text|passage|article)|who (is|was) mentioned in (this|the) (text|passage)|^can you tell me about (this|the) (text|passage|article)|what is described in the passage|what does the author say') THEN 'vague_pattern'
  WHEN NOT len(list_filter({sql_words(_Q)}[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}\\p{{L}}*$'))) > 0 AND NOT list_has_any({sql_words("regexp_replace(lower(question), '[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]', ' ', 'g')")}, string_split(doc, '_')) THEN 'lacks_named_entity_or_topic' ELSE 'ok' END"""


@query(f"SELECT DISTINCT output_id, {_VERDICT} AS verdict FROM raw_outputs")
def generic_question_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_outputs").select("output_id", C.question_verdict(F.col("question"), F.split("doc", "_")).alias("verdict")).distinct()


@query(f"""WITH v AS (SELECT DISTINCT id, system, output_id, {_VERDICT} AS verdict FROM raw_outputs), k AS (SELECT *, row_number() OVER (PARTITION BY id, system ORDER BY output_id) AS k FROM v WHERE verdict = 'ok')
SELECT output_id, 'q-' || substr(md5(id || '|' || system), 1, 12) || '-' || k AS query_id FROM k""")
def kept_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ids numbered over the questions kept, per question and system."""
    from pyspark.sql import Window

    v = table(spark, d, "raw_outputs").select("id", "system", "output_id", C.question_verdict(F.col("question"), F.split("doc", "_")).alias("verdict")).distinct().filter("verdict = 'ok'")
    k = F.row_number().over(Window.partitionBy("id", "system").orderBy("output_id"))
    return v.select("output_id", F.concat(F.lit("q-"), F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), "system")), 1, 12), F.lit("-"), k.cast("string")).alias("query_id"))


@query(f"""WITH r AS (SELECT doc_id, lang, title, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY {SQL_UNIT.format("'42|' || doc_id")}, doc_id) AS k FROM documents)
SELECT doc_id, '## ' || coalesce(title, 'untitled') AS heading FROM r WHERE k <= 20""")
def inspection_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty documents a language for a report; the sampling is the feature."""
    docs = table(spark, d, "documents").withColumn("l", F.coalesce("lang", F.lit("")))
    return C.hash_sample(docs, "l", "doc_id", 20).select("doc_id", F.concat(F.lit("## "), F.coalesce("title", F.lit("untitled"))).alias("heading"))


@query("""WITH u AS (SELECT 'doc' AS kind, doc_id::VARCHAR AS id, lang FROM documents UNION ALL SELECT 'item', item_id::VARCHAR, lang FROM eval_passages)
SELECT kind, coalesce(lang, 'none') AS lang, count(*) AS n, list_sort(list(DISTINCT substr(id, 1, 1))) AS lead FROM u GROUP BY kind, coalesce(lang, 'none')""")
def split_union_order(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), "lang").unionByName(table(spark, d, "eval_passages").select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("id"), "lang"))
    return u.groupBy("kind", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.substring("id", 1, 1))).alias("lead"))


@query(f"""SELECT coalesce(source, 'none') AS source, count(*) AS docs, sum(len({sql_words('text')}))::BIGINT AS words, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank, count(DISTINCT lang) AS langs FROM documents GROUP BY 1""")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count("*").alias("docs"), F.sum(F.when(F.col("text").isNotNull(), T.word_count(F.col("text")))).alias("words"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), F.countDistinct("lang").alias("langs")
    )


@query("""WITH f AS (SELECT DISTINCT _id AS full_doc_id, content AS text FROM kv_store_full_docs), c AS (SELECT * FROM kv_store_text_chunks QUALIFY row_number() OVER (PARTITION BY _id ORDER BY update_time DESC, content) = 1)
SELECT full_doc_id, count(*) AS spans, count(*) FILTER (WHERE NOT contains(f.text, c.content)) AS missing, count(*) - count(DISTINCT c.content) AS repeated FROM c JOIN f USING (full_doc_id) GROUP BY full_doc_id""")
def span_validation(spark: SparkSession, d: str) -> DataFrame:
    """Stored pieces are checked to stand in their document, which is joined by its id; repeated pieces are counted."""
    c = table(spark, d, "kv_store_text_chunks")
    c = c.groupBy("_id").agg(F.max_by(F.struct("full_doc_id", "content"), F.col("update_time")).alias("s")).select("s.full_doc_id", "s.content")
    f = table(spark, d, "kv_store_full_docs").select(F.col("_id").alias("full_doc_id"), F.col("content").alias("text")).distinct()
    s = c.join(f, "full_doc_id").withColumn("found", F.contains("text", "content"))
    return s.groupBy("full_doc_id").agg(F.count("*").alias("spans"), F.count_if(~F.col("found")).alias("missing"), (F.count("*") - F.countDistinct("content")).alias("repeated"))


@query("""WITH r AS (SELECT DISTINCT output_id, question, answer, doc FROM raw_outputs WHERE answer IS NOT NULL),
p AS (SELECT output_id, answer, list_filter([question, doc], lambda s: contains(lower(answer), lower(s))) AS f, list_filter(string_split_regex(question, '[.!?]\\s+'), lambda s: length(s) > 15 AND contains(lower(answer), lower(s))) AS t, split_part(question, ' ', 1) AS short FROM r)
SELECT output_id, CASE WHEN len(f) > 0 THEN f WHEN len(t) > 0 THEN t[1:1] WHEN short <> '' AND contains(lower(answer), lower(short)) THEN [short] ELSE [substr(split_part(answer, chr(10), 1), 1, 80)] END AS spans FROM p""")
def span_repair(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_outputs").filter("answer IS NOT NULL").select("output_id", "question", "answer", "doc").distinct()
    return r.select("output_id", C.repaired_spans(F.array("question", "doc"), F.col("answer"), F.col("question"), F.split_part("question", F.lit(" "), F.lit(1))).alias("spans"))
