"""Text normalisers, filters and id builders as column expressions.

All of them return null for a null text unless said otherwise, and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.folding import compat, compose, fold, fold_case_kept

#: ASCII punctuation. (fixed value)
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_BLANK = r"[\s\p{Z}]+"
_NO_WORD = r"[^\p{L}\p{M}\p{N}_\s\p{Z}]"


def words(col: Column) -> Column:
    """Runs of non-blank characters."""
    return F.filter(F.split(col, _BLANK), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def collapse(col: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col, _BLANK, " "))


def strip(col: Column) -> Column:
    """Blanks, line ends and tabs off both ends."""
    return F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def slugify(col: Column) -> Column:
    """Folded letters and digits, everything else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(col), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def unaccented(col: Column) -> Column:
    """Accents and strokes off; an empty text for null."""
    return F.coalesce(fold_case_kept(col, compat=False), F.lit(""))


def strip_marks(col: Column) -> Column:
    """Accents off, stroked letters kept."""
    return fold_case_kept(col, compat=False, stroked=False)


def eval_words(col: Column) -> Column:
    """Lower case, no accents, punctuation to blanks, articles out; as words."""
    plain = F.translate(unaccented(F.lower(col)), PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(F.split(plain, _BLANK), lambda w: ~w.isin("", "a", "an", "the"))


def normalize_eval(col: Column) -> Column:
    return F.array_join(eval_words(col), " ")


def normalize_legacy(col: Column) -> Column:
    """Lower case, punctuation deleted, blanks collapsed; accents and articles stay."""
    return collapse(F.translate(F.lower(col), PUNCTUATION, ""))


def normalize_span(col: Column) -> Column:
    """Compatibility forms composed, citation marks out, straight quotes, plain dashes, single blanks, lower case."""
    out = F.regexp_replace(compat(col), r"\[\d+[ab]?\]", " ")
    return F.lower(collapse(F.translate(out, "“”‘’–—", "\"\"''--")))


def normalize_dedup(col: Column) -> Column:
    """Lower case, trimmed, everything but words and blanks deleted, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(col)), _NO_WORD, ""), _BLANK, " ")


def plain_words(col: Column) -> Column:
    """Lower-case words, anything else a blank."""
    return words(F.regexp_replace(F.lower(col), _NO_WORD, " "))


def normalize_name(col: Column) -> Column:
    """Composed, single blanks, none at the ends, lower case."""
    return F.lower(collapse(compose(col)))


#: Headings from which on an article is cut. (fixed values)
CLOSING_SECTIONS = ["References", "External links", "See also", "Notes", "Further reading", "Sources", "Bibliography", "Citations", "Footnotes"]


def closing_pattern(sections: list[str]) -> str:
    """A closing heading on a line of its own, bare or between two or more equal signs, and all behind it; a line must follow."""
    return r"(?is)\n\s*(={2,}\s*)?(" + "|".join(sections) + r")(\s*={2,})?\s*\n.*"


def clean_article(col: Column, sections: list[str] = CLOSING_SECTIONS) -> Column:
    """Cut from the first closing heading on, at most one empty line in a row, trimmed."""
    body = F.regexp_replace(F.concat(F.lit("\n"), col), closing_pattern(sections), "")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_field(col: Column) -> Column:
    """Trimmed, runs of quotes off both ends, trimmed again."""
    return strip(F.regexp_replace(strip(col), r"""^["']+|["']+$""", ""))


def without_thinking(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?s)<think>.*?</think>", ""))


def without_fence(col: Column) -> Column:
    """The inside of the first code fence, its language word off; the text itself if there is none."""
    inside = F.regexp_replace(F.split_part(col, F.lit("```"), F.lit(2)), r"^json", "")
    return F.trim(F.when(F.contains(col, F.lit("```")), inside).otherwise(col))


def relation_type(col: Column) -> Column:
    """Upper case, blanks and dashes to underscores, other characters out; R_ before a digit; RELATED_TO if empty."""
    out = F.regexp_replace(F.upper(F.trim(col)), r"[\s-]+", "_")
    out = F.regexp_replace(out, r"[^A-Z0-9_ÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"_+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("RELATED_TO")).when(out.rlike(r"^\d"), F.concat(F.lit("R_"), out)).otherwise(out)


def clean_id(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?i)^ID\s*[:_]?\s*", ""))


def scraped_number(col: Column, low: float = 1.0, high: float = 10.0, default: float = 5.0) -> Column:
    """Digits and points of a text as a number within bounds, or the default."""
    value = F.regexp_replace(col, r"[^\d.]", "").try_cast("double")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def page_url(title: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def prefixed(col: Column, prefix: str) -> Column:
    """Prefix and trimmed text; unchanged if it is there already."""
    t = F.trim(col)
    return F.when(t.startswith(prefix), t).otherwise(F.concat(F.lit(prefix), t))


def contains_norm(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def longest_shared_run(a: Column, b: Column, least: int = 3) -> Column:
    """Length of the longest run of words of array ``a`` that stands in array ``b``; 0 below ``least``.

    Runs are compared as blank-separated text, from each start the longest one that fits.
    """
    text = F.concat(F.lit(" "), F.array_join(b, " "), F.lit(" "))
    n = F.size(a)
    lengths = F.sequence(F.lit(least), n)

    def best_from(start: Column) -> Column:
        return F.aggregate(
            F.filter(lengths, lambda k: k <= n - start + 1), F.lit(0),
            lambda acc, k: F.when((acc == k - 1) | ((acc == 0) & (k == least)), F.when(F.contains(text, F.concat(F.lit(" "), F.array_join(F.slice(a, start, k), " "), F.lit(" "))), k).otherwise(acc)).otherwise(acc),
        )

    return F.when(n < least, F.lit(0)).otherwise(F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1))), best_from)))


# ids


def chunk_key(content: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.md5(content))


def entity_key(name: Column) -> Column:
    return F.concat(F.lit("entity_"), F.substring(F.md5(normalize_name(name)), 1, 16))


def short_key(content: Column, n: int) -> Column:
    return F.substring(F.md5(content), 1, n)


def ordered_chunk_key(index: Column, doc: Column, order: Column, text: Column) -> Column:
    return F.concat_ws("-", F.lit("eval-chunk"), F.lpad(index.cast("string"), 2, "0"), doc, order.cast("string"), short_key(text, 8))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) from the md5 of the columns; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
