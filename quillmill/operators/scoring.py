"""Runs joined to their questions, scored and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import text as T

#: Names of the means of a summary, in order. (fixed values)
SUMMARY = ["hit_1", "hit_3", "hit_5", "recall_1", "recall_3", "recall_5", "token_f1", "token_precision", "token_recall", "entity_coverage", "answer_correctness", "key_point_recall", "context_sufficiency", "faithfulness"]


def exact_mean(c: Column | str) -> Column:
    """Mean by a decimal sum, so that it doesn't depend on the order of rows; null without values."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(24,9)")).cast("double") / F.nullif(F.count(c), F.lit(0))


def with_found(rows: DataFrame, key: str, retrieved: str, chunks: DataFrame, chunk_id: str, forms: dict[str, str], joined: str | None = None) -> DataFrame:
    """``found`` and ``shared`` added to every row: what stands in the chunks it retrieved, and how many rows have its key.

    ``forms`` names columns of spans and, for each, the column of ``chunks`` (one row per ``chunk_id``) they are looked for in, both in
    the same form already. ``found`` has one entry per known chunk that a row with the same key names in ``retrieved``, in order of
    rank; its fields, named as the columns of spans, hold those that stand in the chunk. For the spans of ``joined``, ``edges`` is what
    one must see of the chunk to find spans that straddle two: all of it or both ends as long as a span, with a line end between, which
    no span may have. Rows without a key find nothing. Only spans travel to the chunks, so no text of a chunk is shuffled twice.
    """
    none = F.array().cast("array<string>")
    apart = F.when(F.col(key).isNull(), F.xxhash64(*rows.columns))  # rows without a key share no chunks and no task
    g = rows.groupBy(key, apart.alias("_apart")).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    ids = F.flatten(F.transform("_rows", lambda r: F.transform(F.coalesce(r.getField(retrieved), none), lambda c, i: F.struct(i.alias("rank"), c.alias("id")))))
    of_all = lambda s: F.array_distinct(F.flatten(F.transform("_rows", lambda r: F.coalesce(r.getField(s), none))))
    e = g.select(key, "_apart", "_rows", *[of_all(s).alias(f"_q_{s}") for s in forms], F.explode_outer(F.when(F.col(key).isNotNull(), ids)).alias("_p"))
    e = e.withColumn("_at", F.coalesce("_p.id", F.concat_ws(" ", key, "_apart")))  # those without a chunk are spread
    x = e.join(chunks.withColumnRenamed(chunk_id, "_c"), (F.col("_at") == F.col("_c")) & F.col("_p.id").isNotNull(), "left")
    standing = lambda s, text: F.filter(f"_q_{s}", lambda q: F.contains(text, q)).alias(s)
    inside = [standing(s, F.col(t)) for s, t in forms.items()]
    if joined:
        text, longest = F.col(forms[joined]), F.array_max(F.transform(f"_q_{joined}", lambda q: F.length(q)))
        inside.append(F.when(F.length(text) <= 2 * longest, text).otherwise(F.concat(F.left(text, longest), F.lit("\n"), F.right(text, longest))).alias("edges"))
    marks = F.when(F.col("_c").isNotNull(), F.struct(F.col("_p.rank").alias("rank"), *inside))
    y = x.groupBy(key, "_apart").agg(F.any_value("_rows").alias("_rows"), F.array_sort(F.collect_list(marks)).alias("found"))
    return y.select(F.explode("_rows").alias("_r"), "found", F.size("_rows").alias("shared")).select("_r.*", "found", "shared")


def scored_runs(runs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per run whose question is known, with all metrics of the scorer.

    ``runs`` has output_id, id, doc, answer, retrieved_chunks (ids), latency_sec, total_tokens and judge (a struct of scores); ``questions`` has
    one row per id: doc, question_type, answerable, gold_spans, supporting_entities, short_answer, ground_truth and key_points (a number);
    ``chunks`` has one row per _id with its content as c_plain (``normalize_span``), c_words (``normalize_eval``) and c_low (lower case).
    The answer is compared without its thinking unless nothing else is in it, and with the short answer or, where that is missing or
    empty, the full one. A run without a question is dropped; runs with one output_id share their chunks and count once for each other.
    """
    q = questions.select(
        "id", *[F.col(c).alias(f"q_{c}") for c in questions.columns if c not in ("id", "gold_spans", "supporting_entities")], F.lit(True).alias("known"),
        M.plain_spans("gold_spans").alias("plain"), F.transform("gold_spans", T.normalize_eval).alias("words"), M.plain_spans("supporting_entities").alias("low"),
    )
    x = runs.join(q, "id", "left")
    answer = F.coalesce("answer", F.lit(""))
    given = M.bound(lambda bare, said: T.eval_words(F.when(bare != "", bare).otherwise(said)), T.without_thinking(answer), answer)
    short = F.coalesce(F.nullif("q_short_answer", F.lit("")), "q_ground_truth", F.lit(""))
    x = x.select(
        "output_id", "id", F.coalesce("q_doc", "doc", F.lit("unknown")).alias("doc"), F.coalesce("q_question_type", F.lit("unknown")).alias("question_type"), F.col("q_answerable").alias("answerable"), "latency_sec", F.col("total_tokens").alias("tokens"),
        F.col("q_key_points").alias("points"), "judge", "known", "plain", "words", "low", "retrieved_chunks", F.when(F.col("known"), M.token_prf(given, T.eval_words(short))).alias("m"), F.when(F.col("known"), M.is_refusal(F.col("answer"))).alias("refused"),
    )
    x = with_found(x, "output_id", "retrieved_chunks", chunks, "_id", {"plain": "c_plain", "words": "c_words", "low": "c_low"}, "low")
    x = x.filter(F.col("known") & F.col("output_id").isNotNull()).withColumn("_again", F.explode(F.sequence(F.lit(1), "shared")))
    plain, found = F.col("plain"), F.col("found")
    return x.select(
        "output_id", "id", "doc", "question_type", "answerable", "latency_sec", "tokens",
        *[M.found_hit(plain, found, "plain", k).alias(f"hit_{k}") for k in (1, 3, 5)], *[M.found_recall(plain, found, "plain", k).alias(f"recall_{k}") for k in (1, 3, 5)],
        F.col("m.f1").alias("token_f1"), F.col("m.precision").alias("token_precision"), F.col("m.recall").alias("token_recall"),
        M.found_coverage(F.col("low"), found, "low").alias("entity_coverage"), M.found_rr(F.col("words"), found, "words").alias("rr"),
        F.col("judge.answer_correctness").alias("answer_correctness"), M.key_point_recall(F.col("judge.key_points_covered"), F.col("points")).alias("key_point_recall"),
        F.col("judge.context_sufficiency").alias("context_sufficiency"), F.col("judge.faithfulness").alias("faithfulness"),
        (F.col("answerable") & F.col("refused")).alias("false_refusal"), (~F.col("answerable") & ~F.col("refused")).alias("hallucination"),
    )


def score_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Sixteen means overall and by each column of ``by``, from one set of grouping sets; missing values count in no mean."""
    means = [F.round(exact_mean(c), 4).alias(c) for c in SUMMARY]
    rate = F.round(exact_mean(F.when(F.col("false_refusal"), 1.0).otherwise(0.0)), 4).alias("false_refusal_rate")
    return scored.groupingSets([[], *[[c] for c in by]], *by).agg(F.count("*").alias("count"), *means, rate, F.round(exact_mean("latency_sec"), 4).alias("avg_latency_sec"))


def correctness(score: Column) -> Column:
    """correct, partially_correct or incorrect by a judge's score from 0 to 1."""
    return F.when(score >= 0.7, "correct").when(score >= 0.3, "partially_correct").otherwise("incorrect")


def evaluation_report(scored: DataFrame, by: str = "question_type") -> DataFrame:
    """Means, shares of correct answers and rates of refusal and invention, overall and by type; 0 where a rate has no base."""
    share = lambda kind, n: F.round(F.count_if(correctness(F.col("answer_correctness")) == kind) / F.count("*"), 4).alias(n)
    zero = lambda c, n: F.coalesce(F.round(c, 4), F.lit(0.0)).alias(n)
    of = lambda base, hit: exact_mean(F.when(base, hit.cast("int")))
    return scored.groupingSets([[], [by]], by).agg(
        F.count("*").alias("count"), zero(exact_mean("token_f1"), "f1_mean"), zero(exact_mean("rr"), "mrr_mean"), zero(exact_mean("entity_coverage"), "entity_coverage_mean"), zero(exact_mean("context_sufficiency"), "context_sufficiency_mean"),
        share("correct", "correct_ratio"), share("partially_correct", "partially_correct_ratio"), share("incorrect", "incorrect_ratio"),
        zero(of(F.col("answerable"), F.col("false_refusal")), "false_refusal_rate"), zero(of(~F.col("answerable"), F.col("hallucination")), "hallucination_rate"),
    )


def chunks_with_all_spans(questions: DataFrame, chunks: DataFrame, question_id: str, spans: str, chunk_id: str, text: str, gram: int = 6) -> DataFrame:
    """Columns ``question_id, chunk_id``: chunks in which every span of a question stands, case aside.

    Chunks are joined with the first characters of each question's longest span, as many as all questions have and ``gram`` at most, so no question is
    compared with a chunk that lacks them. Questions without spans, or with an empty longest span, match nothing.
    """
    low = F.transform(spans, lambda s: F.lower(s))
    q = questions.select(F.col(question_id), low.alias("_s")).withColumn("_l", F.array_max(F.transform("_s", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))).filter("_l.n > 0")
    size = q.agg(F.least(F.lit(gram), F.min("_l.n")).alias("n")).first().n
    if size is None:
        return q.join(chunks.select(chunk_id).limit(0), F.lit(False)).select(question_id, chunk_id)
    q = q.withColumn("_g", F.substring("_l.s", 1, size))
    c = chunks.filter(F.col(text).isNotNull()).select(chunk_id, F.lower(text).alias("_t")).filter(F.length("_t") >= size)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_t") - size + 1), lambda i: F.substring(F.col("_t"), i, F.lit(size))))
    hits = c.select(chunk_id, F.explode(grams).alias("_g")).join(q.select("_g").distinct(), "_g")
    pairs = hits.join(q.select(question_id, "_s", "_g"), "_g").join(c, chunk_id)
    return pairs.filter(F.forall("_s", lambda s: F.contains(F.col("_t"), s))).select(question_id, chunk_id)


def filter_counts(candidates: DataFrame, norm: str, order: str, generic: str, verbatim: str) -> DataFrame:
    """One row: total_generated, filtered_generic, filtered_duplicate, filtered_verbatim, kept of questions that are looked at in ``order``.

    A question is generic, or repeats one kept before it, or is copied from its text, or is kept; the first that holds counts.
    """
    fine = ~F.col(generic) & ~F.col(verbatim)
    first = candidates.groupBy(norm).agg(
        F.min(F.when(fine, F.col(order))).alias("first"), F.count("*").alias("n"), F.count_if(generic).alias("g")
    )
    # what follows the first kept one of its kind is a repeat; only a kind with a kept one has repeats
    x = candidates.join(first.filter("first IS NOT NULL").select(norm, "first"), norm, "left")
    repeat = ~F.col(generic) & F.coalesce(F.col(order) > F.col("first"), F.lit(False))
    copied = ~F.col(generic) & ~repeat & F.col(verbatim)
    return x.agg(F.count("*").alias("total_generated"), F.count_if(generic).alias("filtered_generic"), F.count_if(repeat).alias("filtered_duplicate"), F.count_if(copied).alias("filtered_verbatim"), F.count_if(~F.col(generic) & ~repeat & ~F.col(verbatim)).alias("kept"))


def phase_states(latest: DataFrame, failed: Column, judged: Column) -> DataFrame:
    """``status`` added: fail, pending_judge or success; ``run_again`` and ``judge_now`` tell what is left of the two phases."""
    status = F.when(failed, "fail").when(judged, "success").otherwise("pending_judge")
    return latest.withColumn("status", status).withColumn("run_again", F.lit(False)).withColumn("judge_now", F.col("status") == "pending_judge")


def changed(before: DataFrame, after: DataFrame, key: str, hit: str, score: str, least: float = 0.15) -> DataFrame:
    """Rows of two results, paired by key and not by place, whose hit changed or whose score moved by more than ``least``."""
    b = before.select(key, F.col(hit).alias("hit_before"), F.col(score).alias("score_before"))
    a = after.select(key, F.col(hit).alias("hit_after"), F.col(score).alias("score_after"))
    return b.join(a, key).filter((F.col("hit_before") != F.col("hit_after")) | (F.abs(F.round(F.col("score_after") - F.col("score_before"), 6)) > least))
