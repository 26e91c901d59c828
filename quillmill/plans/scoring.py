"""Queries that score runs against a question table and follow a run through its phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import text as T
from quillmill.operators import curation as C
from quillmill.operators import parsing as P
from quillmill.operators import runs as R
from quillmill.operators import scoring as S
from quillmill.plans.catalogue import query
from quillmill.plans.curation import _VERDICT
from quillmill.plans.evaluation import _ASKED, _REF, _RUNS, _SAID, _ev, _sp, _sql_prf, retrieved_pieces, runs
from quillmill.plans.text import sql_eval_words, sql_words
from quillmill.session import table

_NAMES = "regexp_extract_all(min(question), '\\p{Lu}\\p{L}+ \\p{Lu}\\p{L}+')"
_QUESTIONS = f"""qt AS (SELECT id, min(doc) AS doc, 'type' || (id % 5) AS question_type, id % 3 <> 0 AS answerable, CASE WHEN id % 7 = 0 THEN [] ELSE {_NAMES} END AS gold_spans, CASE WHEN id % 5 = 0 THEN [] ELSE {_NAMES} END AS ents,
  CASE WHEN id % 4 = 0 THEN '' ELSE replace(min(doc), '_', ' ') END AS short_answer, min(question) AS ground_truth, id % 3 AS key_points FROM raw_outputs WHERE id % 11 <> 0 GROUP BY id)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """A question table made from the runs: some without spans, entities or short answer, some left out."""
    i = F.col("id")
    names = F.regexp_extract_all("q", F.lit(r"(\p{Lu}\p{L}+ \p{Lu}\p{L}+)"), F.lit(1))
    none = F.array().cast("array<string>")
    q = table(spark, d, "raw_outputs").filter(i % 11 != 0).groupBy("id").agg(F.min("doc").alias("doc"), F.min("question").alias("q"))
    return q.select(
        "id", "doc", F.concat(F.lit("type"), (i % 5).cast("string")).alias("question_type"), (i % 3 != 0).alias("answerable"), F.when(i % 7 == 0, none).otherwise(names).alias("gold_spans"), F.when(i % 5 == 0, none).otherwise(names).alias("supporting_entities"),
        F.when(i % 4 == 0, "").otherwise(F.translate("doc", "_", " ")).alias("short_answer"), F.col("q").alias("ground_truth"), (i % 3).alias("key_points"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Every run of a known question with its metrics; the judge's reply is made from the run's number."""
    o = F.col("output_id")
    reply = F.when(o % 7 == 0, F.lit("no json")).otherwise(F.format_string('<think>hm</think>{"answer_correctness": %s, "key_points_covered": %s, "context_sufficiency": %s, "faithfulness": %s}', ((o % 11) / 10.0).cast("string"), (o % 4).cast("string"), (o % 6).cast("string"), (o % 5 + 1).cast("string")))
    r = runs(spark, d).select("output_id", "id", "doc", "answer", "latency_sec", "total_tokens", "retrieved_chunks", P.judge_json(reply).alias("judge"))
    t = F.col("content")
    c = retrieved_pieces(spark, d).select("_id", T.normalize_span(t).alias("c_plain"), T.normalize_eval(t).alias("c_words"), F.lower(t).alias("c_low"))
    return S.scored_runs(r, questions(spark, d), c)


def _mean(c: str) -> str:
    return f"(sum(({c})::DECIMAL(24, 9))::DOUBLE / nullif(count({c}), 0))"


def _hit(k: int) -> str:
    return f"CASE WHEN len(p) > 0 THEN (len(list_filter(p, lambda a: len(list_filter(c[1:{k}], lambda b: contains(b, a))) > 0)) > 0)::INT END AS hit_{k}, CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda a: len(list_filter(c[1:{k}], lambda b: contains(b, a))) > 0)) / len(p), 4) END AS recall_{k}"


_GIVEN = f"CASE WHEN {_SAID} <> '' THEN {_SAID} ELSE coalesce(answer, '') END"
_SCORED = f"""{_ASKED}, {_QUESTIONS},
j AS (SELECT o.output_id, o.answer, o.latency_sec, qt.*, s.chunks FROM {_RUNS} o JOIN qt USING (id) JOIN s ON s.output_id = o.output_id),
w AS (SELECT *, list_transform(gold_spans, lambda s: {_sp('s')}) AS p, list_transform(chunks, lambda c: {_sp('c')}) AS c, {sql_eval_words(_GIVEN)} AS a, {sql_eval_words("CASE WHEN short_answer <> '' THEN short_answer ELSE coalesce(ground_truth, '') END")} AS b, lower(array_to_string(chunks, ' ')) AS raw,
  list_transform(gold_spans, lambda s: {_ev('s')}) AS ep, list_transform(chunks, lambda c: {_ev('c')}) AS ec, {_REF} AS refused FROM j),
v AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda z: z = w)), len(list_filter(b, lambda z: z = w))))), 0)::DOUBLE AS same FROM w),
t AS (SELECT *, CASE WHEN len(a) > 0 THEN same / len(a) ELSE 0 END AS pr, CASE WHEN len(b) > 0 THEN same / len(b) ELSE 0 END AS re FROM v),
d AS (SELECT output_id, id, doc, question_type, answerable, latency_sec, {_hit(1)}, {_hit(3)}, {_hit(5)}, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4)::DOUBLE AS token_f1, round(pr, 4)::DOUBLE AS token_precision, round(re, 4)::DOUBLE AS token_recall,
  CASE WHEN len(ents) > 0 THEN len(list_filter(ents, lambda e: contains(raw, {_sp('e')}))) / len(ents) END AS entity_coverage,
  CASE WHEN len(ep) > 0 THEN round(coalesce(1.0 / list_min(list_filter(list_transform(range(1, len(ec) + 1), lambda i: CASE WHEN len(list_filter(ep, lambda a: contains(ec[i], a))) > 0 THEN i END), lambda i: i IS NOT NULL)), 0), 4)::DOUBLE END AS rr,
  CASE WHEN output_id % 7 = 0 THEN 0.0 ELSE (output_id % 11) / 10.0 END::DOUBLE AS answer_correctness, CASE WHEN output_id % 7 = 0 THEN 0 ELSE output_id % 6 END AS context_sufficiency, CASE WHEN output_id % 7 = 0 THEN 0 ELSE output_id % 5 + 1 END AS faithfulness,
  CASE WHEN key_points > 0 THEN least(1.0, CASE WHEN output_id % 7 = 0 THEN 0 ELSE output_id % 4 END / key_points) END::DOUBLE AS key_point_recall, answerable AND refused AS false_refusal, NOT answerable AND NOT refused AS hallucination FROM t)"""


@query(f"""WITH {_SCORED} SELECT doc, question_type, count(*) AS count, {', '.join(f'round({_mean(c)}, 4) AS {c}' for c in S.SUMMARY)}, round({_mean('false_refusal::INT')}, 4) AS false_refusal_rate, round({_mean('latency_sec')}, 4) AS avg_latency_sec
FROM d GROUP BY GROUPING SETS ((), (doc), (question_type))""")
def scorer_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.score_summary(scored(spark, d), ["doc", "question_type"])


@query(f"""WITH {_SCORED}, k AS (SELECT *, CASE WHEN answer_correctness >= 0.7 THEN 'c' WHEN answer_correctness >= 0.3 THEN 'p' ELSE 'i' END AS kind FROM d)
SELECT question_type, count(*) AS count, coalesce(round({_mean('token_f1')}, 4), 0.0) AS f1_mean, coalesce(round({_mean('rr')}, 4), 0.0) AS mrr_mean, coalesce(round({_mean('entity_coverage')}, 4), 0.0) AS entity_coverage_mean, coalesce(round({_mean('context_sufficiency')}, 4), 0.0) AS context_sufficiency_mean,
  round(count(*) FILTER (WHERE kind = 'c') / count(*), 4) AS correct_ratio, round(count(*) FILTER (WHERE kind = 'p') / count(*), 4) AS partially_correct_ratio, round(count(*) FILTER (WHERE kind = 'i') / count(*), 4) AS incorrect_ratio,
  coalesce(round(avg(false_refusal::INT) FILTER (WHERE answerable), 4), 0.0) AS false_refusal_rate, coalesce(round(avg(hallucination::INT) FILTER (WHERE NOT answerable), 4), 0.0) AS hallucination_rate FROM k GROUP BY GROUPING SETS ((), (question_type))""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    return S.evaluation_report(scored(spark, d))


@query(f"""WITH {_QUESTIONS}, c AS (SELECT _id, lower(content) AS t FROM kv_store_text_chunks QUALIFY row_number() OVER (PARTITION BY _id ORDER BY update_time DESC, content) = 1),
m AS (SELECT _id, id FROM c JOIN qt ON len(gold_spans) > 0 AND contains(t, lower(gold_spans[1])) WHERE len(list_filter(gold_spans, lambda s: NOT contains(t, lower(s)))) = 0)
SELECT _id, count(*) AS matches, min(id) AS first_question FROM m GROUP BY _id""")
def question_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Questions all of whose spans stand in a chunk: their number and the first, per chunk."""
    c = table(spark, d, "kv_store_text_chunks")
    c = c.groupBy("_id").agg(F.max_by("content", F.struct("update_time")).alias("content"))
    m = S.chunks_with_all_spans(questions(spark, d), c, "id", "gold_spans", "_id", "content")
    return m.groupBy("_id").agg(F.count("*").alias("matches"), F.min("id").alias("first_question"))


_PLAIN = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g')"


@query(f"""WITH r AS (SELECT DISTINCT output_id, question, doc, coalesce(answer, '') AS answer FROM raw_outputs),
w AS (SELECT *, {sql_words(_PLAIN.format('question'))} AS q, ' ' || array_to_string({sql_words(_PLAIN.format('answer'))}, ' ') || ' ' AS a FROM r),
x AS (SELECT output_id, {_VERDICT} <> 'ok' AS generic, len(list_filter(range(1, len(q) - 4), lambda i: contains(a, ' ' || array_to_string(q[i:i + 5], ' ') || ' '))) > 0 AS verbatim,
  regexp_replace(regexp_replace(trim(lower(question)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g') AS norm FROM w),
f AS (SELECT norm, min(output_id) AS first FROM x WHERE NOT generic AND NOT verbatim GROUP BY norm),
y AS (SELECT x.*, NOT generic AND coalesce(output_id > first, false) AS again FROM x LEFT JOIN f USING (norm))
SELECT count(*) AS total_generated, count(*) FILTER (WHERE generic) AS filtered_generic, count(*) FILTER (WHERE again) AS filtered_duplicate, count(*) FILTER (WHERE NOT generic AND NOT again AND verbatim) AS filtered_verbatim, count(*) FILTER (WHERE NOT generic AND NOT again AND NOT verbatim) AS kept FROM y""")
def question_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_outputs").select("output_id", "question", "doc", F.coalesce("answer", F.lit("")).alias("answer")).distinct()
    run = T.longest_shared_run(T.plain_words(F.col("question")), T.plain_words(F.col("answer")))
    x = r.select("output_id", T.normalize_dedup(F.col("question")).alias("norm"), (C.question_verdict(F.col("question"), F.split("doc", "_")) != "ok").alias("generic"), (run >= 6).alias("verbatim"))
    return S.filter_counts(x, "norm", "output_id", "generic", "verbatim")


@query("""WITH l AS (SELECT id, system, arg_max(output_id, (timestamp, output_id)) AS output_id, arg_max(error IS NOT NULL, (timestamp, output_id)) AS failed FROM raw_outputs GROUP BY id, system)
SELECT id, system, output_id, CASE WHEN failed THEN 'fail' WHEN output_id % 3 = 0 THEN 'success' ELSE 'pending_judge' END AS status, NOT failed AND output_id % 3 <> 0 AS judge_now FROM l""")
def two_phase_state(spark: SparkSession, d: str) -> DataFrame:
    """Where each question of a system stands between answering and judging; judged are the runs divisible by three."""
    r = table(spark, d, "raw_outputs").select("id", "system", "timestamp", "output_id", F.col("error").isNotNull().alias("failed"))
    s = S.phase_states(R.latest(r, ["id", "system"], ["timestamp", "output_id"]), F.col("failed"), F.col("output_id") % 3 == 0)
    return s.select("id", "system", "output_id", "status", "judge_now")


_PRF = _sql_prf(sql_eval_words(_SAID), sql_eval_words("question"), _RUNS)


@query(_PRF + f""", f AS (SELECT o.id, o.system, max(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4)::DOUBLE) AS f1 FROM p JOIN {_RUNS} o USING (output_id) GROUP BY o.id, o.system),
b AS (SELECT id, max(f1) AS f1 FROM f WHERE contains(system, 'graph') GROUP BY id), a AS (SELECT id, max(f1) AS f1 FROM f WHERE contains(system, 'rag') AND NOT contains(system, 'graph') GROUP BY id)
SELECT id, b.f1 > 0.5 AS hit_before, a.f1 > 0.5 AS hit_after, b.f1 AS score_before, a.f1 AS score_after FROM b JOIN a USING (id) WHERE (b.f1 > 0.5) <> (a.f1 > 0.5) OR abs(round(a.f1 - b.f1, 6)) > 0.15""")
def changed_results(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose best score differs between two kinds of systems, named by a part of their names."""
    x = runs(spark, d).select("id", "system", M.token_prf(T.eval_words(T.without_thinking(F.coalesce("answer", F.lit("")))), T.eval_words(F.col("question"))).getField("f1").alias("f1"))
    best = lambda keep: x.filter(keep).groupBy("id").agg(F.max("f1").alias("f1")).withColumn("hit", F.col("f1") > 0.5)
    graph = F.contains("system", F.lit("graph"))
    return S.changed(best(graph), best(F.contains("system", F.lit("rag")) & ~graph), "id", "hit", "f1")
