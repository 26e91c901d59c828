"""Queries that score runs and roll scores up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import text as T
from quillmill.operators import parsing as P
from quillmill.operators import runs as R
from quillmill.operators import scoring as S
from quillmill.plans.catalogue import query
from quillmill.plans.text import sql_collapse, sql_eval_words, sql_span, sql_strip, sql_words
from quillmill.session import table

_RUNS = "(SELECT DISTINCT * EXCLUDE (retrieved_chunks), retrieved_chunks FROM raw_outputs)"
_SAID = sql_strip("regexp_replace(coalesce(answer, ''), '(?s)<think>.*?</think>', '', 'g')")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run once; whole repeated rows are one record."""
    return table(spark, d, "raw_outputs").distinct()


def _sql_prf(a: str, b: str, source: str) -> str:
    return f"""WITH x AS (SELECT output_id, {a} AS a, {b} AS b FROM {source}),
m AS (SELECT output_id, len(a) AS na, len(b) AS nb, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda z: z = w)), len(list_filter(b, lambda z: z = w)))))::DOUBLE AS c FROM x),
p AS (SELECT output_id, CASE WHEN na > 0 THEN coalesce(c, 0) / na ELSE 0 END AS p, CASE WHEN nb > 0 THEN coalesce(c, 0) / nb ELSE 0 END AS r FROM m)"""


@query(_sql_prf(sql_eval_words(_SAID), sql_eval_words("question"), _RUNS) + " SELECT output_id, round(p, 4)::DOUBLE AS precision, round(r, 4)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4)::DOUBLE AS f1 FROM p")
def token_prf(spark: SparkSession, d: str) -> DataFrame:
    said = T.without_thinking(F.coalesce("answer", F.lit("")))
    x = runs(spark, d).select("output_id", T.eval_words(said).alias("a"), T.eval_words(F.col("question")).alias("b"))
    return x.select("output_id", M.token_prf(F.col("a"), F.col("b")).alias("m")).select("output_id", "m.*")


_LEG = lambda c: f"regexp_replace(translate(lower({c}), '{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '[\\s\\p{{Z}}]+', ' ', 'g')"


@query(_sql_prf(sql_words(_LEG(_SAID)), sql_words(_LEG("question")), _RUNS) + f" SELECT p.output_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4)::DOUBLE AS f1, (trim({_LEG(_SAID)}) = trim({_LEG('question')}))::INT AS exact FROM p JOIN {_RUNS} o USING (output_id)")
def exact_match_legacy_f1(spark: SparkSession, d: str) -> DataFrame:
    said = T.normalize_legacy(T.without_thinking(F.coalesce("answer", F.lit(""))))
    x = runs(spark, d).select("output_id", said.alias("a"), T.normalize_legacy(F.col("question")).alias("b"))
    return x.select("output_id", M.token_prf(T.words(F.col("a")), T.words(F.col("b"))).getField("f1").alias("f1"), (F.col("a") == F.col("b")).cast("int").alias("exact"))


_ASKED = f"""r AS (SELECT output_id, question, retrieved_chunks FROM {_RUNS}),
c AS (SELECT _id, content FROM kv_store_text_chunks QUALIFY row_number() OVER (PARTITION BY _id ORDER BY update_time DESC, content) = 1),
e AS (SELECT output_id, unnest(retrieved_chunks) AS _id, generate_subscripts(retrieved_chunks, 1) AS rank FROM r),
x AS (SELECT output_id, list(content ORDER BY rank) AS chunks FROM e JOIN c USING (_id) GROUP BY output_id),
s AS (SELECT output_id, regexp_extract_all(question, '\\p{{Lu}}\\p{{L}}+ \\p{{Lu}}\\p{{L}}+') AS spans, coalesce(chunks, []) AS chunks FROM r LEFT JOIN x USING (output_id))"""


def retrieved_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Columns ``_id, content`` of the pieces that a run retrieved: the latest of each id, of those the first content."""
    c = table(spark, d, "kv_store_text_chunks").join(table(spark, d, "raw_outputs").select(F.explode("retrieved_chunks").alias("_id")).distinct(), "_id", "left_semi")
    first = F.struct(F.col("update_time").isNull().alias("n"), F.bitwise_not("update_time").alias("t"), F.col("content").isNull().alias("m"), "content")
    return c.groupBy("_id").agg(F.min(first).getField("content").alias("content"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the names in their question as spans and the texts of the pieces they retrieved, in rank order."""
    c = table(spark, d, "kv_store_text_chunks")
    c = c.groupBy("_id").agg(F.max_by("content", F.struct("update_time")).alias("content"))
    r = runs(spark, d).select("output_id", "question", "retrieved_chunks")
    e = r.select("output_id", F.posexplode("retrieved_chunks").alias("rank", "_id")).join(c, "_id")
    x = e.groupBy("output_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: s.getField("content")).alias("chunks"))
    spans = F.regexp_extract_all("question", F.lit(r"(\p{Lu}\p{L}+ \p{Lu}\p{L}+)"), F.lit(1))
    return r.join(x, "output_id", "left").select("output_id", spans.alias("spans"), F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))


_sp = sql_span


@query(f"""WITH {_ASKED}, n AS (SELECT output_id, list_transform(spans, lambda s: {_sp('s')}) AS p, list_transform(chunks, lambda c: {_sp('c')}) AS c FROM s)
SELECT output_id, CASE WHEN len(p) > 0 THEN (len(list_filter(p, lambda a: len(list_filter(c[1:1], lambda b: contains(b, a))) > 0)) > 0)::INT END AS hit_1, CASE WHEN len(p) > 0 THEN (len(list_filter(p, lambda a: len(list_filter(c[1:3], lambda b: contains(b, a))) > 0)) > 0)::INT END AS hit_3,
  CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda a: len(list_filter(c, lambda b: contains(b, a))) > 0)) / len(p), 4) END AS recall_all FROM n""")
def span_hit_recall(spark: SparkSession, d: str) -> DataFrame:
    names = F.regexp_extract_all("question", F.lit(r"(\p{Lu}\p{L}+ \p{Lu}\p{L}+)"), F.lit(1))
    r = table(spark, d, "raw_outputs").repartition("output_id").distinct()  # as in runs(), laid out for the key
    c = retrieved_pieces(spark, d).select("_id", T.normalize_span(F.col("content")).alias("text"))
    x = S.with_found(r.select("output_id", M.plain_spans(names).alias("spans"), "retrieved_chunks"), "output_id", "retrieved_chunks", c, "_id", {"spans": "text"})
    s, f = F.col("spans"), F.col("found")
    return x.select("output_id", M.found_hit(s, f, "spans", 1).alias("hit_1"), M.found_hit(s, f, "spans", 3).alias("hit_3"), M.found_recall(s, f, "spans", None).alias("recall_all"))


def _ev(c: str) -> str:
    return f"array_to_string({sql_eval_words(c)}, ' ')"


@query(f"""WITH {_ASKED}, n AS (SELECT output_id, list_transform(spans, lambda s: {_ev('s')}) AS p, {_ev("array_to_string(chunks[1:3], ' ')")} AS t3, list_transform(chunks, lambda c: {_ev('c')}) AS c FROM s),
k AS (SELECT output_id, p, t3, list_min(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN len(list_filter(p, lambda a: contains(c[i], a))) > 0 THEN i END), lambda i: i IS NOT NULL)) AS first FROM n)
SELECT output_id, CASE WHEN len(p) > 0 THEN (len(list_filter(p, lambda a: contains(t3, a))) > 0)::INT END AS hit_3, CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda a: contains(t3, a))) / len(p), 4) END AS recall_3,
  CASE WHEN len(p) > 0 THEN round(coalesce(1.0 / first, 0), 4)::DOUBLE END AS rr FROM k""")
def concat_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    s, c = F.col("spans"), F.col("chunks")
    return contexts(spark, d).select("output_id", M.joined_hit(s, c, 3).alias("hit_3"), M.joined_recall(s, c, 3).alias("recall_3"), M.joined_rr(s, c).alias("rr"))


@query(f"""WITH {_ASKED}, n AS (SELECT output_id, spans, {_ev("array_to_string(chunks, ' ')")} AS t, lower(array_to_string(chunks, ' ')) AS raw FROM s)
SELECT output_id, CASE WHEN len(spans) = 0 THEN 1.0 WHEN t = '' THEN 0.0 ELSE round(len(list_filter(spans, lambda e: contains(t, {_ev('e')}))) / len(spans), 4) END::DOUBLE AS coverage,
  round(CASE WHEN len(spans) > 0 THEN len(list_filter(spans, lambda e: contains(raw, {_sp('e')}))) / len(spans) END, 9) AS raw_coverage FROM n""")
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    s, c = F.col("spans"), F.col("chunks")
    return contexts(spark, d).select("output_id", M.entity_coverage(s, F.array_join(c, " ")).alias("coverage"), F.round(M.raw_entity_coverage(s, c), 9).alias("raw_coverage"))


_BARE_ANSWER = "coalesce(strip_accents(translate(lower(answer), 'đĐ', 'dD')), '')"
_REF = f"""(coalesce(answer = '', true) OR regexp_matches({_BARE_ANSWER},
  'không\\s+(tìm\\s+thấy|có|nhắc\\s+đến|được\\s+đề\\s+cập|cung\\s+cấp|rõ)|tài\\s+liệu\\s+không\\s+(nói|nêu|ghi|chứa)|not\\s+mentioned|not\\s+(found|provided|stated|specified|available)|does\\s+not\\s+(mention|contain|state|provide)|cannot\\s+(find|answer|determine)|no\\s+information'))"""
_ANSWERABLE = "CASE id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'partial' END"
_SPELT = "CASE id % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'Unanswerable' WHEN 2 THEN ' partial' WHEN 3 THEN 'answerable' WHEN 4 THEN 'FALSE' ELSE 'unclear' END"


@query(f"""WITH x AS (SELECT output_id, answer, {_REF} AS refused, lower(trim({_SPELT})) AS able FROM {_RUNS})
SELECT output_id, refused AS is_refused, coalesce(contains(lower(answer), 'không tìm thấy đủ thông tin'), false) AS legacy, CASE WHEN able IN ('false', 'unanswerable') THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END END::DOUBLE AS correctly_refused,
  able IN ('true', 'answerable') AND refused AS false_refusal, able IN ('false', 'unanswerable') AND NOT refused AS hallucination,
  CASE WHEN able = 'partial' THEN CASE WHEN refused OR regexp_matches({_BARE_ANSWER}, 'không\\s+nói\\s+rõ\\s+thời\\s+gian|không\\s+được\\s+đề\\s+cập|does\\s+not\\s+mention\\s+the\\s+duration|duration.*not.*stated') THEN 1.0 ELSE 0.5 END END::DOUBLE AS partial_credit FROM x""")
def refusal_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 6
    able = F.when(k == 0, "True").when(k == 1, "Unanswerable").when(k == 2, " partial").when(k == 3, "answerable").when(k == 4, "FALSE").otherwise("unclear")
    legacy = F.coalesce(F.contains(F.lower("answer"), F.lit("không tìm thấy đủ thông tin")), F.lit(False))
    x = runs(spark, d).select("output_id", legacy.alias("legacy"), M.answerability(F.col("answer"), able).alias("a"))
    return x.select("output_id", "legacy", "a.*")


@query(f"""SELECT system, mode, count(*) AS runs, round(avg(latency_sec), 4) AS latency, round(avg(total_tokens), 4) AS tokens, round(avg(length(answer)), 4) AS answer_chars, count(DISTINCT doc) AS docs
FROM {_RUNS} GROUP BY GROUPING SETS ((), (system), (mode))""")
def metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Means by system, by mode and overall from one set of grouping sets; means leave nulls out."""
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    x = runs(spark, d).withColumn("chars", F.length("answer"))
    return x.groupingSets([[], ["system"], ["mode"]], "system", "mode").agg(F.count("*").alias("runs"), mean("latency_sec", "latency"), mean("total_tokens", "tokens"), mean("chars", "answer_chars"), F.countDistinct("doc").alias("docs"))


@query(f"""WITH x AS (SELECT system, {_ANSWERABLE} AS able, {_REF} AS refused FROM {_RUNS})
SELECT system, round(count(*) FILTER (WHERE refused) / count(*), 4) AS refusal_ratio, coalesce(round(avg((NOT refused)::INT) FILTER (WHERE able = 'false'), 4), 0.0) AS hallucination_rate, coalesce(round(avg(refused::INT) FILTER (WHERE able = 'true'), 4), 0.0) AS false_refusal_rate FROM x GROUP BY system""")
def conditional_rates(spark: SparkSession, d: str) -> DataFrame:
    x = runs(spark, d).select("system", (F.col("id") % 3).alias("k"), M.is_refusal(F.col("answer")).alias("refused"))
    r = F.col("refused").cast("int")
    return x.groupBy("system").agg(
        F.round(F.sum(r) / F.count("*"), 4).alias("refusal_ratio"), F.coalesce(F.round(F.avg(F.when(F.col("k") == 1, 1 - r)), 4), F.lit(0.0)).alias("hallucination_rate"), F.coalesce(F.round(F.avg(F.when(F.col("k") == 0, r)), 4), F.lit(0.0)).alias("false_refusal_rate")
    )


@query("""WITH x AS (SELECT level::DOUBLE AS x, row_number() OVER (ORDER BY doc_id * 1000 + hash_id, level) - 1 AS pos, count(*) OVER () AS n FROM (SELECT doc_id, level, substr(rater, 7)::INT AS hash_id FROM (SELECT DISTINCT doc_id, level, rater FROM reading_labels WHERE level IS NOT NULL AND rater IS NOT NULL))),
d AS (SELECT b, floor(('0x' || substr(md5('42|' || b || '|' || j), 1, 8))::BIGINT / 4294967296.0 * (SELECT max(n) FROM x))::BIGINT AS pos FROM range(1000) t(b), range((SELECT max(n) FROM x)) s(j)),
m AS (SELECT b, avg(x) AS m FROM d JOIN x USING (pos) GROUP BY b)
SELECT round((SELECT avg(x) FROM x), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "reading_labels").filter("level IS NOT NULL AND rater IS NOT NULL").select("doc_id", "level", "rater").distinct()
    l = l.withColumn("key", F.col("doc_id") * 1000 + F.substring("rater", 7, 10).cast("int"))
    return R.bootstrap(l, "key", "level")


@query(f"""WITH x AS (SELECT system, CASE WHEN day(ingested_at) % 2 = 0 THEN 'pre' ELSE 'post' END AS ph, latency_sec FROM {_RUNS}),
g AS (SELECT system, round(coalesce(avg(latency_sec) FILTER (WHERE ph = 'pre'), 0), 4) AS pre, round(coalesce(avg(latency_sec) FILTER (WHERE ph = 'post'), 0), 4) AS post FROM x GROUP BY system) SELECT system, pre, post, round(post - pre, 4) AS delta FROM g""")
def pre_post_delta(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.dayofmonth("ingested_at") % 2 == 0, "pre").otherwise("post")
    return R.delta(runs(spark, d), "system", phase, "latency_sec", "pre", "post")


@query(f"""SELECT system, sum(prompt_tokens)::BIGINT AS prompt, sum(completion_tokens)::BIGINT AS completion, round(avg(latency_sec), 4) AS latency, round(sum(total_tokens) / sum(latency_sec), 4) AS tokens_per_sec, round(100.0 * count(error) / count(*), 4)::DOUBLE AS failed_pct FROM {_RUNS} GROUP BY system""")
def token_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("system").agg(
        F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.round(F.avg("latency_sec"), 4).alias("latency"),
        F.round(F.sum("total_tokens") / F.sum("latency_sec"), 4).alias("tokens_per_sec"), F.round(100.0 * F.count("error") / F.count("*"), 4).alias("failed_pct"),
    )


@query("""SELECT DISTINCT r.id, r.system FROM raw_outputs r WHERE NOT EXISTS (SELECT 1 FROM raw_outputs o WHERE o.id = r.id AND o.system = r.system AND o.error IS NULL)""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_outputs")
    return R.still_to_do(r.select("id", "system").distinct(), r, ["id", "system"])


@query("""SELECT id, system, arg_max(output_id, (timestamp, output_id)) AS output_id, arg_max(error IS NULL, (timestamp, output_id)) AS fine, count(DISTINCT output_id) AS tries FROM raw_outputs GROUP BY id, system""")
def resume_latest_state(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_outputs")
    now = R.latest(r.select("id", "system", "timestamp", "output_id", F.col("error").isNull().alias("fine")), ["id", "system"], ["timestamp", "output_id"])
    tries = r.groupBy("id", "system").agg(F.countDistinct("output_id").alias("tries"))
    return now.join(tries, ["id", "system"]).select("id", "system", "output_id", "fine", "tries")


@query(f"""SELECT round(avg(length(answer)) FILTER (WHERE error IS NULL), 4) AS mean_chars, count(*) FILTER (WHERE error IS NULL) AS fine, count(*) FILTER (WHERE contains(lower(coalesce(answer, '')), 'không tìm thấy')) AS legacy_refused, round(100.0 * avg((error IS NOT NULL)::INT), 4) AS failure_rate FROM {_RUNS}""")
def legacy_summary(spark: SparkSession, d: str) -> DataFrame:
    fine = F.col("error").isNull()
    return runs(spark, d).agg(
        F.round(F.avg(F.when(fine, F.length("answer"))), 4).alias("mean_chars"), F.count_if(fine).alias("fine"), F.count_if(F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit("không tìm thấy"))).alias("legacy_refused"),
        F.round(100.0 * F.avg((~fine).cast("int")), 4).alias("failure_rate"),
    )


def _any(c: str, ws: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"


_NAMED = f"list_filter({sql_words('question')}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))"


@query(f"""WITH x AS (SELECT output_id, question, list_filter({_NAMED}, lambda w: upper(trim(w, '. ')) <> 'UNKNOWN' AND lower(nfc_normalize(w)) NOT IN ('ai', 'gì', 'nào', 'đâu', 'sao', 'thế nào', 'bao nhiêu', 'khi nào')) AS e FROM {_RUNS})
SELECT output_id, len(e)::INT AS entities, CASE WHEN {_any('question', ["tổng quan", "tóm tắt", "nói về gì", "nói về những gì", "chủ đề chính", "toàn bộ", "khái quát", "tổng hợp", "nội dung chính"])} THEN 'global' WHEN len(e) > 0 THEN 'local'
  WHEN {_any('question', ["sắp xếp", "trình tự", "liệt kê", "những người nào", "những ai"])} THEN 'all_chunks' ELSE 'global' END AS route FROM x""")
def question_router(spark: SparkSession, d: str) -> DataFrame:
    """The names a stand-in model sees in a question, one a line or UNKNOWN, and where the question goes."""
    named = F.array_join(F.filter(T.words(F.col("question")), lambda w: w.rlike(r"^\p{Lu}")), "\n")
    reply = F.coalesce(F.nullif(named, F.lit("")), F.lit("UNKNOWN."))
    x = runs(spark, d).select("output_id", "question", P.query_entities(reply).alias("e"))
    return x.select("output_id", F.size("e").alias("entities"), M.question_route(F.col("question"), F.col("e")).alias("route"))
