"""Queries over text: normalisers, ids, chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.skew import numbered
from quillmill.operators import chunking
from quillmill.plans.catalogue import query
from quillmill.session import table

_BL = "'[\\s\\p{Z}]+'"
_UNACC = "coalesce(strip_accents(translate({0}, 'đĐ', 'dD')), '')"
_PUNCT_BLANKS = " " * 32
_P = T.PUNCTUATION.replace("'", "''")
def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sql_span(c: str) -> str:
    """Only no-break blanks and split letters have another compatibility form in these tables."""
    return "lower(" + sql_collapse(f"translate(regexp_replace(nfc_normalize(replace({c}, chr(160), ' ')), '\\[\\d+[ab]?\\]', ' ', 'g'), '“”‘’–—', chr(34) || chr(34) || chr(39) || chr(39) || '--')") + ")"


def sql_eval_words(c: str) -> str:
    plain = f"translate({_UNACC.format(f'lower({c})')}, '{_P}', '{_PUNCT_BLANKS}')"
    return f"list_filter(regexp_split_to_array({plain}, {_BL}), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {_BL}), lambda w: w <> '')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {_BL}, ' ', 'g'))"


def sql_slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(strip_accents(translate({c}, 'đĐ', 'dD'))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT doc_id, array_to_string({sql_eval_words('text')}, ' ') AS norm, len({sql_eval_words('text')})::INT AS n_words FROM documents WHERE text IS NOT NULL")
def normalize_eval_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", T.eval_words(F.col("text")).alias("w")).select("doc_id", F.array_join("w", " ").alias("norm"), F.size("w").alias("n_words"))


@query(f"SELECT doc_id, {sql_collapse(f'''translate(lower(text), '{_P}', '')''')} AS norm FROM documents")
def normalize_legacy_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_legacy(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {sql_span('text')} AS norm FROM documents")
def normalize_span(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_span(F.col("text")).alias("norm"))


@query(f"""WITH n AS (SELECT DISTINCT output_id, regexp_replace(regexp_replace(trim(lower(question)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), {_BL}, ' ', 'g') AS norm FROM raw_outputs)
SELECT norm, min(output_id) AS output_id, count(*) AS copies FROM n GROUP BY norm""")
def dedup_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first of equal normalised questions, as a minimum that is combined before the shuffle (no window over a hot question)."""
    n = table(spark, d, "raw_outputs").select("output_id", T.normalize_dedup(F.col("question")).alias("norm")).distinct()
    return n.groupBy("norm").agg(F.min("output_id").alias("output_id"), F.count("*").alias("copies"))


@query(f"""SELECT DISTINCT article_id, {sql_slug('title')} AS title_slug, 'https://pages.example/wiki/' || replace(title, ' ', '_') AS page, 'chunk-' || md5(title) AS title_key FROM val_articles""")
def slugify_ids(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    a = table(spark, d, "val_articles")
    return a.select("article_id", T.slugify(t).alias("title_slug"), T.page_url(t, "https://pages.example/wiki/").alias("page"), T.chunk_key(t).alias("title_key")).distinct()


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(chr(10) || text, '(?is)\\n\\s*(={2,}\\s*)?(References|External links|See also|Notes|Further reading|Sources|Bibliography|Citations|Footnotes)(\\s*={2,})?\\s*\\n.*', ''), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM documents")
def clean_article_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_article(F.col("text")).alias("body"))


@query(f"""SELECT DISTINCT _id, 'chunk-' || md5(content) AS chunk_key, 'entity_' || substr(md5(lower({sql_collapse('nfc_normalize(file_path)')})), 1, 16) AS entity_key,
  substr(md5(content), 1, 12) AS short_key, substr(md5(content), 1, 16) AS cache_key, 'eval-chunk-' || lpad((create_time % 100)::VARCHAR, 2, '0') || '-' || parse_format || '-0-' || substr(md5(content), 1, 8) AS eval_key FROM kv_store_full_docs""")
def content_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return table(spark, d, "kv_store_full_docs").select(
        "_id", T.chunk_key(c).alias("chunk_key"), T.entity_key(F.col("file_path")).alias("entity_key"), T.short_key(c, 12).alias("short_key"), T.short_key(c, 16).alias("cache_key"),
        T.ordered_chunk_key(F.col("create_time") % 100, F.col("parse_format"), F.lit(0), c).alias("eval_key"),
    ).distinct()


@query("WITH r AS (SELECT item_id, row_number() OVER (ORDER BY subject, item_id) AS new_id FROM eval_passages) SELECT new_id::INT AS new_id, item_id, CASE WHEN new_id <> item_id THEN item_id END AS old_id FROM r")
def renumber_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids 1..n in order of subject; the former id kept where it changed."""
    p = numbered(table(spark, d, "eval_passages").select("subject", "item_id"), ["subject", "item_id"], "at").withColumn("new_id", (F.col("at") + 1).cast("int"))
    return p.select("new_id", "item_id", F.when(F.col("new_id") != F.col("item_id"), F.col("item_id")).alias("old_id"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 400) / 350.0))::BIGINT + 1)) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i::INT AS chunk_order_index, (i * 350)::INT AS start, length(substr(text, (i * 350 + 1)::BIGINT, 400))::INT AS n_chars, 'chunk-' || md5(substr(text, (i * 350 + 1)::BIGINT, 400)) AS chunk_key FROM s""")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.window_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 400, 50)
    return c.select("doc_id", "chunk_order_index", "start", F.length("chunk").alias("n_chars"), T.chunk_key(F.col("chunk")).alias("chunk_key"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 100)) AS start FROM w)
SELECT doc_id, start::INT AS start, array_to_string(w[start + 1:start + 120], ' ') AS chunk FROM s WHERE len(w[start + 1:start + 120]) > 20""")
def sliding_token_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.sliding_words(table(spark, d, "documents").select("doc_id", "text"), "text", 120, 20)
    return c.select("doc_id", "start", F.array_join("chunk_words", " ").alias("chunk"))


@query(f"""WITH c AS (SELECT _id, full_doc_id, chunk_order_index, content FROM kv_store_text_chunks QUALIFY row_number() OVER (PARTITION BY _id ORDER BY update_time DESC, content) = 1),
w AS (SELECT *, {sql_words('content')} AS w FROM c),
p AS (SELECT *, lag(w[greatest(len(w) - 14, 1):len(w)]) OVER (PARTITION BY full_doc_id ORDER BY chunk_order_index, _id) AS p FROM w)
SELECT _id, array_to_string(CASE WHEN p IS NULL THEN w ELSE list_concat(p, w)[1:120] END, ' ') AS overlapped FROM p""")
def chunk_overlap_lag(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "kv_store_text_chunks")
    now = c.groupBy("_id").agg(F.max_by(F.struct("full_doc_id", "chunk_order_index", "content"), F.struct("update_time")).alias("s")).select("_id", "s.*")
    return chunking.with_previous_tail(now, "content", "full_doc_id", ["chunk_order_index", "_id"], 120, 15).select("_id", "overlapped")


@query()
def separator_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.separator_chunks(table(spark, d, "documents"), "doc_id", "text", 1200, 100)


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, d, "documents"), "doc_id", "text")


_ANS = sql_strip("regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g')")


@query(f"""SELECT DISTINCT output_id, lower({sql_collapse('nfc_normalize(question)')}) AS name_form, strip_accents(question) AS bare, {_ANS} AS said,
  trim(CASE WHEN contains({_ANS}, '```') THEN regexp_replace(split_part({_ANS}, '```', 2), '^json', '') ELSE {_ANS} END) AS unfenced,
  trim(regexp_replace(doc, '(?i)^ID\\s*[:_]?\\s*', '')) AS plain_id, substr(question, 1, 40) AS head, contains(lower({_ANS}), lower(question)) AS repeats,
  'Question: ' || question || ' Mode: ' || mode AS prompt, CASE WHEN starts_with(trim(question), 'search_query: ') THEN trim(question) ELSE 'search_query: ' || trim(question) END AS search_text
  FROM raw_outputs""")
def text_cleanups(spark: SparkSession, d: str) -> DataFrame:
    q, a = F.col("question"), T.without_thinking(F.col("answer"))
    return table(spark, d, "raw_outputs").select(
        "output_id", T.normalize_name(q).alias("name_form"), T.strip_marks(q).alias("bare"), a.alias("said"), T.without_fence(a).alias("unfenced"), T.clean_id(F.col("doc")).alias("plain_id"),
        F.substring(q, 1, 40).alias("head"), T.contains_norm(a, q).alias("repeats"), F.format_string("Question: %s Mode: %s", q, F.col("mode")).alias("prompt"), T.prefixed(q, "search_query: ").alias("search_text"),
    ).distinct()


@query("""WITH t AS (SELECT DISTINCT p_type FROM part), r AS (SELECT p_type, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(p_type)), '[\\s-]+', '_', 'g'), '[^A-Z0-9_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS r FROM t)
SELECT p_type, CASE WHEN r = '' THEN 'RELATED_TO' WHEN regexp_matches(r, '^\\d') THEN 'R_' || r ELSE r END AS relation FROM r""")
def relation_type_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_type").distinct().select("p_type", T.relation_type(F.col("p_type")).alias("relation"))
