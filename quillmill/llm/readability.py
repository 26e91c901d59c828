"""Problem 8: reading level of each document.

Per document: sentence length, syllables per word, letters per word and share of long words, from which four classic
grade formulas (Flesch-Kincaid, Gunning fog, automated readability index, SMOG) are taken; the grade is their median.
English syllables are counted by hyphenation-style patterns: digits between letters, of which the highest counts, odd ones
part a group of vowels. Written Vietnamese puts a blank
between syllables, so words are first rejoined: neighbouring syllables that rarely stand apart in the whole
corpus form one word. Cut points between the levels are fitted per language on rated documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.textnorm import without_marks
from quillmill.session import cut_lineage

LEVELS = 5
#: Function words that tell the two languages apart. (fixed values)
VIETNAMESE_WORDS = "của và là năm có này cho ở người đã trong những được không một các với để nhiều họ trước sau mà từ về bên tại theo khi nên nhưng".split()
ENGLISH_WORDS = "the of and was in for a to is it by that which had with were people near they many at from an after before this so but".split()
#: Abbreviations whose full stop ends no sentence. (fixed values)
ABBREVIATIONS = "St Mt Dr Mr Mrs Ms No Nos vol vols feat ft c ca tr tp TP pp p vs etc e.g i.e al Jr Sr Prof Gen Col Capt Lt Rev op cf ed eds approx Inc Ltd Co sđd Th TS GS PGS ThS".split()

_VI, _EN = frozenset(VIETNAMESE_WORDS), frozenset(ENGLISH_WORDS)
_SHORT_WORD = re.compile(r"(?<!\w)(e\.g|i\.e|[^\W\d_]{1,6})\.")
_ABBREVIATED = frozenset(ABBREVIATIONS)
_NUMBER = re.compile(r"(?<=\d)[.,:](?=\d)")
_MARKUP = re.compile(r"[*_#=]+")
_LIST = re.compile(r"(?m)^\s*(?:\d{1,3}[.)]|[-•])\s.*$")
_END = re.compile(r"[.!?…][\"”»’)\]]*$")
_SENTENCE = re.compile(r"[.!?…]+[\"”»’)]*(?:\s+|$)")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Where a group of vowels is parted (odd) or held together (even), a point marking an end of the word. (fixed values)
VOWEL_PATTERNS = """
i1a ci2a ti2a gi2a si2a sci3a ci3ati ci3at .di3a .bi3a .tri3a .gi3an .li3a .vi3a soci3abl ri2age ni2age vari3a medi3a socie3t
i1o ti2o si2o ci2o gi2o xi2o .bi3o .vi3o .ri3o .li3o .pi3o .ti3o rati3o. pati3o. studi3o ni2on. ni2ons. lli2on .cri3o
i1u ti2us ci2us gi2us .tri3u
i1en ti2en ci2en li2en fri2en sci3en .cli3en .gi3en .pi2en gradi3en audi3en
i1et qui3et .di3et .vi3et soci3et vari3et anxi3et .pi2et
i1er pi2er ti2er. fi2er ri3er. ni3er. di2er. li3er. cashi2er bri2er i2ev i2eg i2el di3el i2es fri3es
e1o pe2opl .ge3o .le3o .ne3o .the3o vide3o re2on e2ou eo2us .eo2 surge2on pige2on dunge2on
ide3a are3a. cre3at .re3act .re3al .ide3al the3at the3or oce3an ocea2n ne3ar. li3near be3at. .re3app .re3arr .re3ass
e3ing y3ing e3is a3is. e3ist e3i2ty be3ing see3ing
u1a qu2a gu2a su2ade su3al .du3al
u1en qu2en gu2en u1el. fu2el. u1et du3et. su2et. cru3el
fru2i su2it bu2il ru3in flu3id u3ity u3itou u3ou .fru3i2tion tu3it
po3e .co3e .no3e hero3i o3ing .do3ing go3ing sto3ic co3in. co2in. co3op oy3al e3um
cha3o ca3o a3or. la3os na3iv a3ic. sa3ic he3ro
eau2 bea2u ea2u
"""
_PATTERNS = {re.sub(r"\d", "", p): [int(d) if d else 0 for d in re.findall(r"(\d?)(?:[a-z.]|$)", p)] for p in VOWEL_PATTERNS.split()}
_LONGEST = max(map(len, _PATTERNS))
_VOWELS = re.compile(r"[aeiouy]+")
#: Endings and joints whose vowel is silent, and endings that are spoken without one. (fixed values)
_SILENT = re.compile(r"(?<![aeiouyl])(?<![tbc]r)e$|(?<=[aeiouy]l)e$|(?<=[rwy]l)e$|(?<![aeiouyscgxzl])(?<![sc]h)es$|(?<=[aeiouy]l)es$|(?<![aeiouytd])ed$|(?<=[aeiouy][^aeiouy])e(?=(?:ly|ment|ments|ness|ful|fully|less|some|times|thing|where|fore)$)|(?<=ev)e(?=r[yi])|(?<=us)i(?=ness)")
_SPOKEN = re.compile(r"(?:[st]h|s)ms?$|[^aeiouy]les?$")


def vowel_breaks(word: str) -> list[int]:
    """The value before each letter of a lower-case word, by the patterns that match there; the highest wins."""
    dotted = f".{word}."
    values = [0] * (len(dotted) + 1)
    for a in range(len(dotted)):
        for b in range(a + 2, min(len(dotted), a + _LONGEST) + 1):
            for i, v in enumerate(_PATTERNS.get(dotted[a:b], ())):
                if v > values[a + i]:
                    values[a + i] = v
    return values[1:]


_CLAUSE = re.compile(r"[,;:“”\"()«»]")


def running_text(text: str) -> str:
    """Prose only: markup, reference marks, list lines, headings and footers without an end mark go."""
    text = without_marks(unicodedata.normalize("NFC", text))
    text = html.unescape(text).replace("\xa0", " ")
    text = _LIST.sub("", _MARKUP.sub(" ", text))
    lines = [s for s in (x.strip() for x in text.splitlines()) if s]
    out, after_end = [], True
    for i, line in enumerate(lines):
        ended = bool(_END.search(line))
        follows = lines[i + 1][0] if i + 1 < len(lines) else ""
        if not ended and after_end and len(line.split()) <= 5 and not follows.islower():
            continue
        out.append(line)
        after_end = ended
    return " ".join(out or lines)


def sentences(prose: str) -> list[str]:
    prose = _NUMBER.sub("", _SHORT_WORD.sub(lambda m: m[1].replace(".", "") if m[1] in _ABBREVIATED else m[0], prose))
    return [s for s in _SENTENCE.split(prose) if any(map(str.isalnum, s))]


def is_vietnamese(prose: str) -> bool:
    words = prose.lower().split()
    return sum(w in _VI for w in words) > sum(w in _EN for w in words)


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of an English word: its groups of vowels, parted where the patterns say so, without the silent ones."""
    word = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalpha())
    groups = [m.span() for m in _VOWELS.finditer(word[1:] if word[:1] == "y" and word[1:2] in tuple("aeiou") else word)]
    shift = 1 if word[:1] == "y" and word[1:2] in tuple("aeiou") else 0
    n = len(groups)
    if any(b - a > 1 for a, b in groups):
        values = vowel_breaks(word)
        n += sum(values[i + shift] % 2 for a, b in groups for i in range(a + 1, b))
    silent = {m.start() for m in _SILENT.finditer(word)} & {a + shift for a, b in groups if b - a == 1}
    n -= len(silent)
    if _SPOKEN.search(word) and word[-1:] != "e":
        n += not word.endswith("les")
    return max(1, n)


def _vietnamese_units(sentence: str, joined: frozenset) -> Iterator[tuple[int, int]]:
    """(syllables, letters) of each word that is no name."""
    for clause in _CLAUSE.split(sentence):
        run: list[str] = []
        for s in [*clause.split(), ""]:
            if run and (run[-1], s) in joined:
                run.append(s)
                continue
            if run:
                yield len(run), sum(map(len, run))
            run = [s] if s.islower() else []


def grade(text: str, joined: frozenset) -> tuple[str, float] | None:
    """(language, median grade) of a text; None where it has no word."""
    prose = running_text(text)
    parts = sentences(prose)
    tokens = sum(len(s.split()) for s in parts)
    if not tokens:
        return None
    vi = is_vietnamese(prose)
    if vi:
        units = [u for s in parts for u in _vietnamese_units(s, joined)]
    else:
        words = [w for s in parts for w in _WORDS.findall(s)]
        units = [(syllables(w), len(w)) for w in words if not w[0].isupper()] or [(syllables(w), len(w)) for w in words]
    units = units or [(1, 3)]
    n = len(units)
    per_sentence = tokens / len(parts)
    per_word = sum(u[0] for u in units) / n
    letters = sum(u[1] for u in units) / n
    long_words = sum(u[0] >= 3 for u in units) / n
    kincaid = 0.39 * per_sentence + 11.8 * per_word - 15.59
    fog = 0.4 * (per_sentence + 100 * long_words)
    index = 4.71 * letters + 0.5 * per_sentence - 21.43
    smog = 1.043 * (30 * long_words * per_sentence) ** 0.5 + 3.1291
    return ("vi" if vi else "en"), sum(sorted((kincaid, fog, index, smog))[1:3]) / 2


def joined_syllables(docs: DataFrame, text: str = "text", min_count: int = 5, min_share: float = 1e-5, min_bond: float = 0.1) -> frozenset:
    """Pairs of neighbouring Vietnamese syllables that form one word, from counts over all documents.

    A pair is kept if count(ab)² / (count(a)·count(b)) is at least ``min_bond``. Counts are combined in each
    task before the shuffle. A syllable has at most 1/``min_bond`` such partners and at most 1/``min_share``
    syllables reach that share of all, so no more than 1/(``min_bond``·``min_share``) pairs reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [(a, b, n) for (a, b), n in tally.items()]
            tally.clear()
            return pd.DataFrame(rows, columns=["a", "b", "n"])

        for pdf in batches:
            for t in pdf.t:
                if is_vietnamese(t):
                    for s in sentences(running_text(t)):
                        for clause in _CLAUSE.split(s):
                            words = clause.split()
                            tally.update((w, "") for w in words if w.islower())
                            tally.update((v, w) for v, w in zip(words, words[1:]) if v.islower() and w.islower())
            if len(tally) > 500_000:
                yield flush()
        yield flush()

    counts = docs.select(F.col(text).alias("t")).filter("t IS NOT NULL").mapInPandas(count, "a string, b string, n long")
    counts = cut_lineage(counts.groupBy("a", "b").agg(F.sum("n").alias("n")))
    single = counts.filter("b = ''")
    total = single.agg(F.sum("n")).first()[0] or 0
    single = single.filter(F.col("n") >= min_share * total)
    pairs = counts.filter((F.col("b") != "") & (F.col("n") >= min_count))
    pairs = pairs.join(single.select("a", F.col("n").alias("na")), "a").join(single.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    pairs = pairs.filter(F.col("n") * F.col("n") >= min_bond * F.col("na") * F.col("nb"))
    return frozenset((r.a, r.b) for r in pairs.select("a", "b").toLocalIterator())


def cut_points(grades: np.ndarray, levels: np.ndarray) -> list[float]:
    """Thresholds between neighbouring levels with the fewest misplaced ratings, by dynamic programming."""
    order = np.argsort(grades, kind="stable")
    g, lev = grades[order], levels[order]
    n = len(g)
    wrong = [np.r_[0, np.cumsum(lev != k)] for k in range(1, LEVELS + 1)]
    free = np.r_[True, g[1:] > g[:-1], True]  # no cut between equal grades
    cost = np.where(np.arange(n + 1) == 0, 0.0, np.inf)
    back = []
    for k in range(LEVELS):
        lead = cost - wrong[k]
        best = np.minimum.accumulate(lead)
        at = np.maximum.accumulate(np.where(lead <= best, np.arange(n + 1), 0))
        cost = np.where(free, best + wrong[k], np.inf)
        back.append(at)
    cuts, end = [], n
    for k in range(LEVELS - 1, 0, -1):
        end = int(back[k][end])
        cuts.append(g[0] - 1 if end == 0 else g[-1] + 1 if end == n else float(g[end - 1] + g[end]) / 2)
    return cuts[::-1]


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_ratings: int = 100_000) -> DataFrame:
    """Columns ``doc_id, level, grade, lang`` for every document whose text is neither missing nor blank.

    ``labels`` has (doc_id, level) ratings, several a document; null levels and repeated rows do not count.
    The cut points are fitted per language on at most ``max_ratings`` ratings, those of smallest hash; a
    language without ratings takes the cut points of all ratings, and where there are none at all each level gets
    a fifth of the documents. A text without a single word gets level 1. A repeated doc_id gives a row for each.
    """
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull() & F.col("t").rlike(r"[^\s\p{Z}\p{C}]"))
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(joined_syllables(docs, text))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [grade(t, shared.value) or ("en", float("-inf")) for t in pdf.t]
            yield pd.DataFrame({"d": pdf.d, "lang": [x[0] for x in got], "grade": [x[1] for x in got]})

    graded = cut_lineage(texts.mapInPandas(measure, f"d {kind}, lang string, grade double"))
    rated = labels.filter(F.col("level").between(1, LEVELS)).select(F.col(doc_id).alias("d"), F.col("level").cast("int").alias("level"), *[c for c in ("rater",) if c in labels.columns]).distinct()
    rated = rated.join(graded, "d").filter(F.col("grade") > float("-inf"))
    rated = rated.withColumn("h", F.pmod(F.xxhash64("d", "level"), F.lit(1 << 40)))
    share = min(1.0, 1.5 * max_ratings / max(1, labels.count()))
    sample = rated.filter(F.col("h") < int(share * (1 << 40))).orderBy("h").limit(max_ratings).select("lang", "grade", "level").toPandas()
    level = F.lit(None).cast("int")
    fifths = None
    if not len(sample):
        fifths = graded.filter(F.col("grade") > float("-inf")).agg(F.percentile_approx("grade", [i / LEVELS for i in range(1, LEVELS)], 10_000).alias("q")).first().q
    for lang in ("en", "vi"):
        own = sample[sample.lang == lang] if (sample.lang == lang).any() else sample
        cuts = cut_points(own.grade.to_numpy(), own.level.to_numpy()) if len(own) else fifths or []
        placed = F.lit(1)
        for c in cuts:
            placed = placed + (F.col("grade") > F.lit(float(c))).cast("int")
        level = F.when(F.col("lang") == lang, placed).otherwise(level)
    return graded.select(F.col("d").alias(doc_id), level.cast("int").alias("level"), "grade", "lang")
