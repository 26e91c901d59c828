"""Parsers of model output: delimited records, JSON graphs, citations, context sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.metrics import QUESTION_WORDS
from quillmill.functions.text import clean_field, clean_id, normalize_name, scraped_number, without_fence, without_thinking

#: Delimiters of the record format and the entity types it may name. (fixed values)
TUPLE, RECORD, COMPLETE = "<|>", "##", "<|COMPLETE|>"
ENTITY_TYPES = ["organization", "person", "geo", "event"]


def records(raw: Column) -> Column:
    """Array of the cleaned field arrays of all records in a raw extraction."""
    parts = F.transform(F.split(without_thinking(raw), r"##|\n(?=\()"), lambda p: F.replace(p, F.lit(COMPLETE), F.lit("")))
    inside = F.transform(F.filter(parts, lambda p: p.rlike(r"(?s)\(.*\)")), lambda p: F.trim(F.regexp_extract(p, r"(?s)\((.*)\)", 1)))
    return F.transform(inside, lambda p: F.transform(F.split(p, r"<\|>"), clean_field))


def _tagged(kind: str) -> Callable[[Column], Column]:
    return lambda r: F.lower(clean_field(r.getItem(0))) == kind


def entities(recs: Column) -> Column:
    """Valid entities, the first of each name: name in capitals, type, description all there and the type known."""
    valid = F.transform(
        F.filter(recs, lambda r: _tagged("entity")(r) & (F.size(r) >= 4)),
        lambda r: F.struct(F.upper(clean_field(r.getItem(1))).alias("name"), F.lower(clean_field(r.getItem(2))).alias("type"), F.trim(r.getItem(3)).alias("description")),
    )
    valid = F.filter(valid, lambda e: (e["name"] != "") & (e["description"] != "") & e["type"].isin(*ENTITY_TYPES))
    return F.filter(valid, lambda e, i: F.array_position(F.transform(valid, lambda x: x["name"]), e["name"]) == i + 1)


def relationships(recs: Column) -> Column:
    """Valid relationships, the first of each unordered pair, ends in capitals, with the strength scraped from the fifth field."""
    valid = F.transform(
        F.filter(recs, lambda r: _tagged("relationship")(r) & (F.size(r) >= 5)),
        lambda r: F.struct(F.upper(clean_field(r.getItem(1))).alias("src"), F.upper(clean_field(r.getItem(2))).alias("tgt"), F.trim(r.getItem(3)).alias("description"), scraped_number(r.getItem(4)).alias("strength")),
    )
    valid = F.filter(valid, lambda x: (x["src"] != "") & (x["tgt"] != "") & (x["src"] != x["tgt"]) & (x["description"] != ""))
    key = lambda x: F.concat_ws("\u0001", F.least(x["src"], x["tgt"]), F.greatest(x["src"], x["tgt"]))
    return F.filter(valid, lambda x, i: F.array_position(F.transform(valid, key), key(x)) == i + 1)


def record_errors(recs: Column) -> Column:
    """Number of entity and relationship records that lack fields; records of another kind are none."""
    return F.size(F.filter(recs, lambda r: (_tagged("entity")(r) & (F.size(r) < 4)) | (_tagged("relationship")(r) & (F.size(r) < 5))))


def extraction_totals(parsed: DataFrame, entities: str, relations: str, errors: str) -> DataFrame:
    """One row of counters over parsed extractions: processed, total_entities, total_relations, total_errors, empty_chunks."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return parsed.agg(F.count("*").alias("processed"), total(F.size(entities)).alias("total_entities"), total(F.size(relations)).alias("total_relations"), total(errors).alias("total_errors"), F.count_if(F.size(entities) == 0).alias("empty_chunks"))


def query_entities(raw: Column) -> Column:
    """Names a model found in a question, one a line; none for UNKNOWN, question words left out."""
    bare = lambda c: F.upper(F.regexp_replace(c, r"^[. \n]+|[. \n]+$", ""))
    lines = F.filter(F.transform(F.split(raw, r"\n"), lambda x: F.trim(x)), lambda x: (x != "") & (bare(x) != "UNKNOWN") & ~normalize_name(x).isin(*QUESTION_WORDS))
    return F.when(F.coalesce(raw, F.lit("")).isin("") | (bare(raw) == "UNKNOWN"), F.array().cast("array<string>")).otherwise(lines)


def questions_json(raw: Column) -> Column:
    """The questions of a model's reply, ``{"questions": [...]}``, in order; an empty array for anything else."""
    parsed = F.from_json(without_thinking(raw), "struct<questions:array<struct<question:string,type:string>>>")
    return F.coalesce(parsed["questions"], F.array().cast("array<struct<question:string,type:string>>"))


def groups_json(raw: Column) -> Column:
    """The groups of community ids of a model's reply, ``{"merged_groups": [[...]]}``, ids cleaned; null for anything else."""
    groups = F.from_json(raw, "struct<merged_groups:array<array<string>>>")["merged_groups"]
    return F.transform(groups, lambda g: F.transform(g, clean_id))


def grounded(name: Column, text: Column) -> Column:
    """The whole name in a text, or any of its words longer than three letters; case aside."""
    low = F.lower(text)
    parts = F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) > 3)
    return F.contains(low, F.lower(name)) | F.exists(parts, lambda w: F.contains(low, w))


GRAPH = "struct<entities:array<struct<id:string,name:string,type:string>>,relations:array<struct<source:string,target:string,type:string>>>"
JUDGE = "struct<answer_correctness:double,key_points_covered:int,context_sufficiency:int,faithfulness:int>"


def graph_json(raw: Column) -> Column:
    return F.from_json(without_fence(without_thinking(raw)), GRAPH)


def valid_graph(g: Column) -> Column:
    """Entities with id and name, first of each id; relations whose ends are both such entities, first of each unordered pair."""
    named = F.filter(g["entities"], lambda e: e["id"].isNotNull() & (e["id"] != "") & e["name"].isNotNull() & (e["name"] != ""))
    ids = F.transform(named, lambda e: e["id"])
    ents = F.filter(named, lambda e, i: F.array_position(ids, e["id"]) == i + 1)
    rels = F.filter(g["relations"], lambda r: F.array_contains(ids, r["source"]) & F.array_contains(ids, r["target"]) & (r["source"] != r["target"]))
    key = lambda r: F.concat_ws("\u0001", F.least(r["source"], r["target"]), F.greatest(r["source"], r["target"]))
    rels = F.filter(rels, lambda r, i: F.array_position(F.transform(rels, key), key(r)) == i + 1)
    return F.struct(ents.alias("entities"), rels.alias("relations"))


def judge_json(raw: Column) -> Column:
    """Scores of a judge with defaults where a field is missing or the text is no JSON."""
    j = F.from_json(without_fence(without_thinking(raw)), JUDGE)
    return F.struct(*[F.coalesce(j.getField(n), F.lit(v)).alias(n) for n, v in (("answer_correctness", 0.0), ("key_points_covered", 0), ("context_sufficiency", 0), ("faithfulness", 0))])


def match_json(raw: Column, size: Column) -> Column:
    """The 1-based index of a match; null without index, evidence or within bounds."""
    m = F.from_json(without_fence(without_thinking(raw)), "struct<match_index:int,confidence:double,evidence:string>")
    return F.when(m["match_index"].between(1, size) & (F.trim(m["evidence"]) != ""), m["match_index"])


def cited_ids(answer: Column) -> Column:
    """Numbers cited in an answer, in order, each once."""
    marks = F.regexp_extract_all(answer, F.lit(r"(\[Data:[^\]]*?\([\d\s,;+more]+\)\]|(?:Sources|Text|Input Text)\s*\([\d\s,]+\))"), F.lit(1))
    inner = F.transform(marks, lambda m: F.regexp_extract(m, r"\(([\d\s,;+more]+)\)\]?$", 1))
    return F.array_distinct(F.transform(F.flatten(F.transform(inner, lambda m: F.regexp_extract_all(m, F.lit(r"\b(\d+)\b"), F.lit(1)))), lambda n: n.cast("bigint")))


def _kept(parts: Column, least: int = 0) -> Column:
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > least)


def marked_context(context: Column) -> Column:
    """Chunks of a context with chunk marks, else of its sources block, else its paragraphs over 30 characters, else itself."""
    marked = _kept(F.split(context, "--New Chunk--"))
    block = _kept(F.split(F.split_part(context, F.lit("-----Sources-----"), F.lit(2)), r"\n\s*\n"))
    first = F.when(F.contains(context, F.lit("--New Chunk--")), marked).when(F.contains(context, F.lit("-----Sources-----")), block).otherwise(F.array().cast("array<string>"))
    paragraphs = _kept(F.split(context, r"\n\n"), 30)
    chunks = F.when(F.size(first) > 0, first).when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array(F.trim(context)))
    pure = F.filter(chunks, lambda c: ~c.startswith("-----"))
    return F.when(F.coalesce(context, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(pure) > 0, pure).otherwise(chunks)


def fenced_context(context: Column) -> Column:
    """Contents of the JSON lines after the chunk heading, else paragraphs over 30 characters, else the context itself."""
    section = F.regexp_extract(context, r"(?s)Document Chunks(.*)$", 1)
    fenced = F.split_part(F.split_part(section, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))
    contents = F.transform(F.split(fenced, r"\n"), lambda x: F.trim(F.get_json_object(F.trim(x), "$.content")))
    chunks = F.filter(contents, lambda c: c.isNotNull() & (c != ""))
    paragraphs = F.filter(_kept(F.split(context, r"\n\n"), 30), lambda c: ~c.startswith("-----"))
    return F.when(F.size(chunks) > 0, chunks).when(F.size(paragraphs) > 0, paragraphs).when(F.coalesce(context, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.trim(context)))


def tool_answer(output: Column) -> Column:
    """Log lines off, the text behind the success mark."""
    kept = F.trim(F.array_join(F.filter(F.split(output, r"\n"), lambda l: ~F.trim(l).startswith(">>")), "\n"))
    return F.trim(F.element_at(F.split(kept, r"SUCCESS: (?:Local|Global) Search Response:"), -1))


#: Fragments of relation types that say two names are one, or that they are two; looked up in this order. (fixed values)
SAME_KEYWORDS = ["ten_khac", "co_ten", "cung_nhan", "cung_mot", "tuc_la", "hieu_la", "duoc_goi", "biet_danh", "alias", "tuoc_hieu", "con_goi", "khai_sinh"]
DIFFERENT_KEYWORDS = ["cha_cua", "con_cua", "anh_em", "vo_cua", "chong_cua", "me_cua", "thay_cua", "hoc_tro", "mon_khach", "ke_vi", "chau_cua", "chu_cua", "bac_cua", "vua_toi", "em_cua", "anh_cua", "chi_cua"]
#: Phrases that introduce another name. (fixed values)
ALIAS_TRIGGERS = ["còn gọi là", "còn có tên là", "tên khác là", "tục gọi là", "tục danh là", "hiệu là", "tước hiệu là", "húy là", "tên húy là", "tức là", "tức", "bí danh"]


def relation_meaning(kind: Column) -> Column:
    from quillmill.functions.text import strip_marks

    low = F.lower(strip_marks(kind))
    return F.when(low.rlike("|".join(SAME_KEYWORDS)), "POSITIVE").when(low.rlike("|".join(DIFFERENT_KEYWORDS)), "NEGATIVE").otherwise("NEUTRAL")


def alias_evidence(a: Column, b: Column, text: Column) -> Column:
    """The stretch of text that names two names as one; an empty string if there is none."""
    esc = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")
    x, y = esc(a), esc(b)
    trig = F.lit(r"[,\s]*(?:" + "|".join(ALIAS_TRIGGERS) + r")\s+")
    pattern = F.concat(F.lit("(?iu)(?:"), x, trig, y, F.lit("|"), y, trig, x, F.lit(r"|"), x, F.lit(r"\s*\([^)]*"), y, F.lit(r"[^)]*\)|"), y, F.lit(r"\s*\([^)]*"), x, F.lit(r"[^)]*\))"))
    return F.call_function("regexp_extract", text, pattern, F.lit(0))
