"""Filters, samples and splits that curate a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.folding import fold
from quillmill.functions.text import plain_words, unit_hash, word_count, words


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; a struct minimum, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    low = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return low.select(*keys, "_s.*")


def blocked_terms(docs: DataFrame, doc_id: str, text: str, terms: DataFrame, term: str, max_terms: int = 100_000) -> DataFrame:
    """Columns ``doc_id, terms``: the sorted distinct blocked terms that stand in a text as whole words, accents and case aside.

    Texts are exploded into the word runs of the lengths that terms have and joined with the terms on the
    run, so cost does not grow with terms times texts. The term table is broadcast only up to ``max_terms``.
    """
    bare = lambda c: F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))
    t = terms.select(bare(F.col(term)).alias("run")).filter("run <> ''").distinct()
    sizes = t.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("run", " "))).alias("k")).first()
    small = F.broadcast(t) if sizes["n"] <= max_terms else t
    w = docs.select(F.col(doc_id), F.split(bare(F.col(text)), " ").alias("w")).filter("w IS NOT NULL")

    def runs_of(k: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size("w") - (k - 1))
        return w.filter(F.size("w") >= k).select(doc_id, F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i, k), " ")))).alias("run"))

    hits = None
    for k in sorted(sizes["k"] or []):
        part = runs_of(k).join(small, "run")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return docs.select(doc_id, F.array().cast("array<string>").alias("terms")).limit(0)
    return hits.groupBy(doc_id).agg(F.array_sort(F.collect_set("run")).alias("terms"))


def article_status(text: Column, title_seen: Column, blocked: Column, least_words: int, shown: int = 5) -> Column:
    """missing, duplicate, blocked: up to five terms (+k more), too short (n) or ok; the first that holds."""
    n = F.size(blocked)
    listed = F.concat(F.lit("blocked: "), F.array_join(F.slice(blocked, 1, shown), ", "), F.when(n > shown, F.format_string(" (+%d more)", n - shown)).otherwise(F.lit("")))
    count = word_count(text)
    return F.when(text.isNull(), F.lit("missing")).when(title_seen, F.lit("duplicate")).when(n > 0, listed).when(count < least_words, F.format_string("too short (%d)", count)).otherwise(F.lit("ok"))


#: Question forms too vague to search by. (fixed values)
VAGUE = [
    r"^what (is|are) (this|the) (text|passage|article|paragraph)",
    r"^what (happened|happens) in (this|the) (text|passage|article)",
    r"who (is|was) mentioned in (this|the) (text|passage)",
    r"^can you tell me about (this|the) (text|passage|article)",
    r"what is described in the passage",
    r"what does the author say",
]


def question_verdict(question: Column, title_words: Column) -> Column:
    """too_short, vague_pattern, lacks_named_entity_or_topic or ok."""
    q = F.regexp_replace(question, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    w = words(q)
    named = F.exists(F.slice(w, 2, F.size(w)), lambda x: x.rlike(r"^\p{Lu}\p{L}*$"))
    topical = F.arrays_overlap(plain_words(question), title_words)
    return (
        F.when((F.size(w) < 5) | (F.length(q) < 22), F.lit("too_short"))
        .when(q.rlike("(?i)" + "|".join(VAGUE)), F.lit("vague_pattern"))
        .when(~named & ~F.coalesce(topical, F.lit(False)), F.lit("lacks_named_entity_or_topic"))
        .otherwise(F.lit("ok"))
    )


def stratified_split(df: DataFrame, group: str, record_id: str, share: float = 0.15, seed: str = "42") -> DataFrame:
    """``split`` added: per group the first max(1, round(share·n)) records in hash order are val, the others train.

    The size of the val part decides by hash rank only among records below a hash bound, so no group is
    sorted as a whole: a record of hash u is ranked among the group's records whose hash falls in the same
    of 1,024 slices, and the slices before are counted.
    """
    h = unit_hash(F.lit(seed), F.col(record_id).cast("string"))
    x = df.withColumn("_u", h).withColumn("_slice", F.floor(F.col("_u") * 1024))
    counts = x.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice")
    counts = counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(group)))
    counts = counts.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), "_before", "_total")
    x = x.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_u", record_id))
    want = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("_total")).cast("int"))
    return x.withColumn("split", F.when(rank <= want, F.lit("val")).otherwise(F.lit("train"))).drop("_u", "_slice", "_g", "_s", "_before", "_total")


def hash_sample(df: DataFrame, group: str | None, record_id: str, n: int, seed: str = "42") -> DataFrame:
    """The ``n`` records of smallest hash, per group if one is named (limits are applied before the shuffle)."""
    h = unit_hash(F.lit(seed), F.col(record_id).cast("string"))
    if group is None:
        return df.withColumn("_u", h).orderBy("_u", record_id).limit(n).drop("_u")
    w = Window.partitionBy(group).orderBy("_u", record_id)
    return df.withColumn("_u", h).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_u", "_r")


def repaired_spans(spans: Column, text: Column, truth: Column, short_answer: Column) -> Column:
    """Spans found in the text; else the first sentence of the truth over 15 characters found there; else the short answer; else the first line."""
    found = F.filter(spans, lambda s: F.contains(F.lower(text), F.lower(s)))
    sentence = F.filter(F.split(truth, r"(?<=[.!?])\s+"), lambda s: (F.length(s) > 15) & F.contains(F.lower(text), F.lower(s)))
    one = lambda c: F.when(F.size(c) > 0, F.slice(c, 1, 1))
    short = F.when((F.length(short_answer) > 0) & F.contains(F.lower(text), F.lower(short_answer)), F.array(short_answer))
    return F.coalesce(F.when(F.size(found) > 0, found), one(sentence), short, F.array(F.substring(F.split(text, r"\n").getItem(0), 1, 80)))
