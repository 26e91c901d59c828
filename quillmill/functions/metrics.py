"""Per-row metrics of answers and retrieved contexts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.once import bound
from quillmill.functions.text import contains_norm, normalize_eval, normalize_span, unaccented


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays; only words of both are counted."""
    of = lambda arr, w: F.size(arr) - F.size(F.array_remove(arr, w))
    least = lambda x, y, w: F.coalesce(F.least(of(x, w), of(y, w)), F.lit(0))
    return bound(lambda x, y: F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, w: s + least(x, y, w)), a, b)


def token_prf(answer: Column, truth: Column) -> Column:
    """precision, recall and f1 of two word arrays, each to four places; zeros where nothing is shared."""

    def scores(na: Column, nt: Column, common: Column) -> Column:
        p = F.when(na > 0, common / na).otherwise(F.lit(0.0))
        r = F.when(nt > 0, common / nt).otherwise(F.lit(0.0))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return F.struct(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))

    return bound(lambda a, t: bound(scores, F.size(a), F.size(t), shared_count(a, t).cast("double")), answer, truth)


def _top(chunks: Column, k: int | None) -> Column:
    return F.slice(chunks, 1, k) if k else chunks


def plain_spans(texts: Column) -> Column:
    return F.transform(texts, normalize_span)


def plain_hit(spans: Column, chunks: Column, k: int | None) -> Column:
    """As ``span_hit``, of spans and chunks that are normalised already."""
    hit = F.exists(spans, lambda s: F.exists(_top(chunks, k), lambda c: F.contains(c, s)))
    return F.when(F.size(spans) > 0, hit.cast("int"))


def plain_recall(spans: Column, chunks: Column, k: int | None) -> Column:
    found = F.size(F.filter(spans, lambda s: F.exists(_top(chunks, k), lambda c: F.contains(c, s))))
    return F.when(F.size(spans) > 0, F.round(found / F.size(spans), 4))


def span_hit(spans: Column, chunks: Column, k: int | None) -> Column:
    """1 if a span stands inside one of the first k chunks; null without spans."""
    return plain_hit(plain_spans(spans), plain_spans(chunks), k)


def span_recall(spans: Column, chunks: Column, k: int | None) -> Column:
    """Share of the spans that stand inside one of the first k chunks; null without spans."""
    return plain_recall(plain_spans(spans), plain_spans(chunks), k)


def found_hit(spans: Column, found: Column, form: str, k: int | None) -> Column:
    """1 if one of the first k found chunks (see ``with_found``) holds a span; null without spans."""
    return F.when(F.size(spans) > 0, F.exists(spans, lambda s: _held(s, found, form, k)).cast("int"))


def found_recall(spans: Column, found: Column, form: str, k: int | None) -> Column:
    """Share of the spans that the first k found chunks hold; null without spans."""
    return F.when(F.size(spans) > 0, F.round(F.size(F.filter(spans, lambda s: _held(s, found, form, k))) / F.size(spans), 4))


def found_rr(spans: Column, found: Column, form: str) -> Column:
    """Reciprocal of the first place whose chunk holds a span; 0 if none does; null without spans."""
    place = F.array_position(F.transform(found, lambda c: F.exists(spans, lambda s: F.array_contains(c.getField(form), s))), True)
    return F.when(F.size(spans) > 0, F.round(F.coalesce(1.0 / F.nullif(place, F.lit(0)), F.lit(0.0)), 4))


def found_coverage(entities: Column, found: Column, form: str) -> Column:
    """Share of entities in the found chunks joined by blanks; null without entities; not rounded."""

    def share(edges: Column) -> Column:
        return F.size(F.filter(entities, lambda e: _held(e, found, form, None) | F.contains(edges, e))) / F.size(entities)

    return F.when(F.size(entities) > 0, bound(share, F.array_join(F.transform(found, lambda c: c.getField("edges")), " ")))


def _held(span: Column, found: Column, form: str, k: int | None) -> Column:
    return F.exists(_top(found, k), lambda c: F.array_contains(c.getField(form), span))


def joined_hit(spans: Column, chunks: Column, k: int) -> Column:
    """1 if a span stands in the first k chunks joined by a blank, so it may straddle two; null without spans."""
    text = normalize_eval(F.array_join(_top(chunks, k), " "))
    return F.when(F.size(spans) > 0, F.exists(spans, lambda s: F.contains(text, normalize_eval(s))).cast("int"))


def joined_recall(spans: Column, chunks: Column, k: int) -> Column:
    text = normalize_eval(F.array_join(_top(chunks, k), " "))
    return F.when(F.size(spans) > 0, F.round(F.size(F.filter(spans, lambda s: F.contains(text, normalize_eval(s)))) / F.size(spans), 4))


def joined_rr(spans: Column, chunks: Column) -> Column:
    """Reciprocal of the first rank whose chunk holds a span; 0 if none does; null without spans."""
    norms = F.transform(spans, normalize_eval)
    hits = F.filter(F.transform(chunks, lambda c, i: F.when(F.exists(norms, lambda s: F.contains(normalize_eval(c), s)), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(spans) > 0, F.round(F.coalesce(1.0 / F.array_min(hits), F.lit(0.0)), 4))


def entity_coverage(entities: Column, context: Column) -> Column:
    """Share of entities that stand in a context after normalisation; 1 without entities, 0 in an empty context."""
    text = normalize_eval(context)
    n = F.size(entities)
    found = F.size(F.filter(entities, lambda e: F.contains(text, normalize_eval(e))))
    return F.when(n == 0, F.lit(1.0)).when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(F.round(found / n, 4))


def raw_entity_coverage(entities: Column, chunks: Column) -> Column:
    """Share of entities in the lower-cased joined chunks; null without entities; not rounded."""
    text = F.lower(F.array_join(chunks, " "))
    return F.when(F.size(entities) > 0, F.size(F.filter(entities, lambda e: F.contains(text, normalize_span(e)))) / F.size(entities))


#: Patterns of a refusal. The answer is compared without accents, so those with accents never match; kept as they are. (fixed values)
REFUSAL_PATTERNS = [
    r"không\s+(tìm\s+thấy|có|nhắc\s+đến|được\s+đề\s+cập|cung\s+cấp|rõ)",
    r"tài\s+liệu\s+không\s+(nói|nêu|ghi|chứa)",
    r"not\s+mentioned",
    r"not\s+(found|provided|stated|specified|available)",
    r"does\s+not\s+(mention|contain|state|provide)",
    r"cannot\s+(find|answer|determine)",
    r"no\s+information",
]
#: Patterns that say which part of a question stays open. (fixed values)
PARTIAL_PATTERNS = [r"không\s+nói\s+rõ\s+thời\s+gian", r"không\s+được\s+đề\s+cập", r"does\s+not\s+mention\s+the\s+duration", r"duration.*not.*stated"]
#: Spellings of whether a question can be answered. (fixed values)
UNANSWERABLE, ANSWERABLE = ["false", "unanswerable"], ["true", "answerable"]


def is_refusal(answer: Column) -> Column:
    """A missing or empty answer, or one that matches a refusal pattern."""
    return F.coalesce(answer == "", F.lit(True)) | unaccented(F.lower(answer)).rlike("|".join(REFUSAL_PATTERNS))


def answerability(answer: Column, answerable: Column) -> Column:
    """is_refused, correctly_refused, false_refusal, hallucination and partial_credit of an answer.

    ``answerable`` says whether the question can be answered, in any of the spellings or as ``partial``; for anything else only
    ``is_refused`` is told.
    """
    refused = is_refusal(answer)
    kind = F.lower(F.trim(answerable.cast("string")))
    no, yes = kind.isin(*UNANSWERABLE), kind.isin(*ANSWERABLE)
    open_part = refused | unaccented(F.lower(answer)).rlike("|".join(PARTIAL_PATTERNS))
    told = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        refused.alias("is_refused"), F.when(no, F.when(refused, 1.0).otherwise(0.0)).alias("correctly_refused"), told(yes & refused).alias("false_refusal"),
        told(no & ~refused).alias("hallucination"), F.when(kind == "partial", F.when(open_part, 1.0).otherwise(0.5)).alias("partial_credit"),
    )


def key_point_recall(covered: Column, points: Column) -> Column:
    """Covered over all key points, at most 1; null without points."""
    return F.when(points > 0, F.least(F.lit(1.0), covered / points))


def mentions(text: Column, phrases: list[str]) -> Column:
    return F.greatest(*[F.contains(F.lower(text), F.lit(p)).cast("int") for p in [*phrases, phrases[0]]]) == 1


def in_text(part: Column, text: Column) -> Column:
    return contains_norm(text, part)


#: Words that send a question to the whole collection, to a listing, and that are no entity. (fixed values)
GLOBAL_KEYWORDS = ["tổng quan", "tóm tắt", "nói về gì", "nói về những gì", "chủ đề chính", "toàn bộ", "khái quát", "tổng hợp", "nội dung chính"]
LISTING_KEYWORDS = ["sắp xếp", "trình tự", "liệt kê", "những người nào", "những ai"]
QUESTION_WORDS = ["ai", "gì", "nào", "đâu", "sao", "thế nào", "bao nhiêu", "khi nào"]


def question_route(question: Column, entities: Column) -> Column:
    """global for a question about the whole; else local with entities, all_chunks for a listing without, global without either."""
    return F.when(mentions(question, GLOBAL_KEYWORDS), "global").when(F.size(entities) > 0, "local").when(mentions(question, LISTING_KEYWORDS), "all_chunks").otherwise("global")
