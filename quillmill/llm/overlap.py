"""Problem 5: records that stand, exactly or almost, in the training split and in an evaluation split.

A title's core (no accents, case, decoration, brackets) gets a similarity-hash fingerprint: 128 bits in eight segments
in which each pair of neighbouring characters turns one bit over, and 64 bits in which each letter turns one over. An edit of one
letter turns four bits of the first at most and two of the second, so what ``same_article`` accepts lies within a Hamming
radius of sixteen (eight where one slip is allowed) and four; others are thinned by it. Cores are joined on
blocks: pairs of segments of the fingerprint that hold enough of the text, and, since no choice of segments meets for every two
slips, keys that do (``_exact_keys``): the bag of letters for swaps, the whole core less one letter
for short cores, and for longer ones a half less one letter (of three edits at most one falls in one of the
halves) or, from 40 letters on, one of four pieces, which three edits can't all touch. All candidates are verified on the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.folding import fold
from quillmill.functions.skew import pair_join
from quillmill.llm.keys import split_key, url_site
from quillmill.session import cut_lineage

SEGMENTS, BITS = 8, 16
#: Bits of the fingerprint that one edit of a letter turns over at most, and edits between two accepted cores by slips.
EDIT_BITS, MOST_EDITS = 4, {1: 2, 2: 4}
#: Letters whose count may change its parity between two accepted cores.
ODD_LETTERS = 4
#: Character pairs that two segments must hold between them to be a block; with fewer they meet by chance.
BLOCK_PAIRS = 8
#: Cores from here on may hold two slips; three edits lie between them at most, but for swaps.
TWO_SLIPS, EDITS = 12, 3
#: Cores from here on have pieces of ten letters or more, which are keys without deletions.
LONG = 40
#: Site names that pages append to their titles, folded; a parameter of ``titled``. (fixed values)
SITE_NAMES = ["lorepedia", "song ?archive", "(?:old )?annals", "wikipedia"]

_BRACKET = r"[(\[{]([^)\]}]*)(?:[)\]}]|$)"
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"


def _plain(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[^\p{L}\p{N}]+", " "))


def title_parts(title: Column, site_names: list[str] = SITE_NAMES) -> dict[str, Column]:
    """core (words), quals (sorted bracketed qualifiers) and numerals of a title; core is null if nothing is left."""
    t = F.regexp_replace(fold(title), r"[\s\p{Z}\p{C}_]+", " ")
    t = F.regexp_replace(t, r"\[ ?(?:edit|sua|sua doi)(?: [^\]]*)?\]", " ")
    t = F.regexp_replace(t, r" \| .*$", " ")
    if site_names:
        t = F.regexp_replace(t, r"\s*[|–—-]\s*(?:" + "|".join(site_names) + r")\b[^()\[\]]*$", " ")
    quals = F.filter(F.transform(F.regexp_extract_all(t, F.lit(_BRACKET), F.lit(1)), _plain), lambda q: q != "")
    core = F.regexp_replace(_plain(F.regexp_replace(t, _BRACKET, " ")), r"^the (?=.)", "")
    numerals = F.regexp_extract_all(core, F.lit(r"(?<![\p{L}\p{N}])((?:\d+)|(?:" + _ROMAN + r"))(?![\p{L}\p{N}])"), F.lit(1))
    return {"core": F.when(core != "", core), "quals": F.array_join(F.array_sort(quals), "|"), "numerals": F.array_join(numerals, " ")}


@lru_cache(maxsize=100_000)
def _bit(pair: str) -> int:
    return xxhash.xxh64_intdigest(pair, seed=5) % (SEGMENTS * BITS)


def fingerprint(letters: str) -> tuple[int, list[int]]:
    """(128 bits, of which each character pair turns one over; number of pairs in each segment)."""
    code, held = 0, [0] * SEGMENTS
    padded = f"^{letters}$"
    for a, b in zip(padded, padded[1:]):
        at = _bit(a + b)
        code ^= 1 << at
        held[at // BITS] += 1
    return code, held


def _blocks(code: int, held: list[int]) -> set[int]:
    """Hashes of the pairs of segments that hold enough of the text."""
    part = [code >> BITS * i & (1 << BITS) - 1 for i in range(SEGMENTS)]
    return {xxhash.xxh64_intdigest(f"{i} {j} {part[i]} {part[j]}", seed=99) for i, j in combinations(range(SEGMENTS), 2) if held[i] + held[j] >= BLOCK_PAIRS}


def _less_one(text: str) -> set[str]:
    return {text[:i] + text[i + 1 :] for i in range(len(text))}


def _exact_keys(letters: str, held: bool) -> set[int]:
    """Keys of a core that meet, one side ``held``, the other not, for each two cores that ``same_article`` accepts.

    A core that is not held is cut by its own length alone; a held one has the keys of all cuts that a core of
    up to two letters more or less may have, with ends moved as far as edits can move them.
    """
    n = len(letters)
    parts = {(0, "".join(sorted(letters)))}
    if 5 <= n <= TWO_SLIPS:  # one edit: equal, or equal less one letter on either side
        parts |= {(1, t) for t in {letters} | _less_one(letters)}
    others = [m for m in range(n - 2, n + 3) if m >= TWO_SLIPS] if held else [n] if n >= TWO_SLIPS else []
    for kind, lengths in ((2, {m // 2 for m in others if m < LONG}), (3, {m - m // 2 for m in others if m < LONG})):
        end = (lambda k: letters[:k]) if kind == 2 else (lambda k: letters[-k:])
        ends = {end(min(n, k + s)) for k in lengths for s in ((-1, 0, 1) if held else (0,))}
        parts |= {(kind, t) for e in ends for t in {e} | _less_one(e)}
    for m in others:
        if m >= LONG:
            cuts = [i * m // (EDITS + 1) for i in range(EDITS + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                parts |= {(4 + i, letters[a + s : b + s]) for s in (range(-EDITS, EDITS + 1) if held else (0,)) if a + s >= 0 and b + s <= n}
    return {xxhash.xxh64_intdigest(t, seed=kind) for kind, t in parts}


def _signed(values: Iterable[int]) -> np.ndarray:
    return np.array(list(values), dtype=np.uint64).astype(np.int64)


def _coded(cores: DataFrame, held: bool) -> DataFrame:
    """One row per core and block: cid, n (letters), lo, hi (fingerprint), parity (one bit per letter, its count odd), key."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [c.replace(" ", "") for c in pdf.core]
            codes = [fingerprint(t) for t in texts]
            keys = [_signed(_blocks(*c) | _exact_keys(t, held)) for t, c in zip(texts, codes)]
            odd = _signed(reduce(xor, (1 << (ord(c) & 63) for c in t), 0) for t in texts)
            low, high = _signed(c & (1 << 64) - 1 for c, _ in codes), _signed(c >> 64 for c, _ in codes)
            yield pd.DataFrame({"cid": pdf.cid, "n": list(map(len, texts)), "lo": low, "hi": high, "parity": odd, "keys": keys})

    coded = cores.mapInPandas(code, "cid long, n int, lo long, hi long, parity long, keys array<long>")
    return coded.select("cid", "n", "lo", "hi", "parity", F.explode("keys").alias("key"))


def _candidates(train: DataFrame, held: DataFrame, sample_rows: int = 200_000, per_task: int = 20_000) -> DataFrame:
    """Columns ``e_cid, t_cid``: different cores of the two sides that share a block and lie within the radius.

    A block that holds more than ``per_task`` training cores, as a bounded sample of these shows, is spread over salts.
    """
    total = train.count()
    share = min(1.0, sample_rows / max(1, total))
    span = 1 << 40
    sampled = train.filter(F.pmod(F.xxhash64("cid", F.lit(8)), F.lit(span)) < F.lit(int(share * span)))
    salts = F.ceil(F.col("rows") / F.lit(share * per_task)).cast("int").alias("salts")
    hot = None
    if total > per_task:
        counts = _coded(sampled, False).groupBy("key").agg(F.count("*").alias("rows"))
        hot = cut_lineage(counts.filter(F.col("rows") > share * per_task).select("key", salts))  # fewer than the sample has blocks for per_task rows each
        hot = hot if hot.limit(1).count() else None
    t = _coded(train, False).select(F.col("cid").alias("t_cid"), F.col("n").alias("t_n"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), F.col("parity").alias("t_parity"), "key")
    e = _coded(held, True)
    on = ["key"]
    if hot is not None:
        salts = F.coalesce("salts", F.lit(1))
        t = t.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("t_cid"), salts).cast("int")).drop("salts")
        e = e.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        on = ["key", "salt"]
    apart = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"t_{c}")))
    radius = EDIT_BITS * F.when(F.least("n", "t_n") >= TWO_SLIPS, MOST_EDITS[2]).otherwise(MOST_EDITS[1])
    near = (F.col("cid") != F.col("t_cid")) & (apart("parity") <= ODD_LETTERS) & (apart("lo") + apart("hi") <= radius)
    return e.join(t, on).filter(near).select(F.col("cid").alias("e_cid"), "t_cid").distinct()


def slips_apart(a: Column, b: Column, most: Column) -> Column:
    """Whether two strings differ by at most ``most`` (1 or 2) slips of typing.

    A slip changes, adds or drops one letter or swaps two neighbours. A swap counts two in the edit distance but
    leaves the sorted letters as they are, which tells it from two changes.
    """
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    d = F.levenshtein(a, b, 4)
    moved = F.levenshtein(letters(a), letters(b), 4)
    one = (d == 1) | ((d == 2) & (moved == 0))
    two = (d == 2) | ((d == 3) & moved.between(0, 2)) | ((d == 4) & (moved == 0))
    return (a == b) | one | ((most >= 2) & two)


def same_article(left: str, right: str) -> Column:
    """Rule on the parts of two titles, in columns named ``left_core`` and so on.

    Numerals must be equal, qualifiers equal or missing on one side (a slip of typing allowed), cores equal up
    to one slip, or up to two (one on each side) from 12 letters on; cores under 5 letters must be equal.
    """
    l, r = (lambda c, s=side: F.col(f"{s}_{c}") for side in (left, right))
    quals_agree = (l("quals") == "") | (r("quals") == "") | (l("quals") == r("quals"))
    digits = lambda c: F.regexp_replace(c, r"[^\d]+", " ")
    quals_slip = (digits(l("quals")) == digits(r("quals"))) & slips_apart(l("quals"), r("quals"), F.lit(1)) & (F.length(l("quals")) >= 5)
    a, b = (F.replace(c, F.lit(" "), F.lit("")) for c in (l("core"), r("core")))
    shorter = F.least(F.length(a), F.length(b))
    cores_agree = (a == b) | ((shorter >= 5) & slips_apart(a, b, F.when(shorter >= 12, 2).otherwise(1)))
    return (l("numerals") == r("numerals")) & (quals_agree | F.coalesce(quals_slip, F.lit(False))) & cores_agree


def titled(records: DataFrame, record_id: str, title: str, split: str, url: str | None = None, site_names: list[str] = SITE_NAMES) -> DataFrame:
    """Columns ``record_id, split, source, class, core, quals, numerals`` of records with a split and a title; a repeated row is one.

    ``site_names`` are patterns of the sites' names that pages of this corpus append to titles, folded.
    """
    parts = title_parts(F.col(title), site_names)
    rows = records.select(F.col(record_id), split_key(F.col(split)).alias("split"), (url_site(F.col(url)) if url else F.lit(None).cast("string")).alias("source"), *[c.alias(n) for n, c in parts.items()])
    rows = rows.filter(F.col(record_id).isNotNull() & F.col("split").isNotNull() & F.col("core").isNotNull()).distinct()
    return rows.withColumn("class", F.concat_ws("|", "core", "quals"))


def class_overlaps(rows: DataFrame) -> DataFrame:
    """Columns ``eval_class, train_class``: classes of equal titles that name the same article across the splits.

    ``rows`` comes from ``titled``. Every class is one row however many copies it has.
    """
    parts = ["class", "core", "quals", "numerals"]
    is_train = F.col("split") == "train"
    classes = cut_lineage(rows.groupBy(*parts).agg(F.max(is_train).alias("in_train"), F.max(~is_train).alias("in_eval")).withColumn("cid", F.xxhash64("core")))
    cores = classes.groupBy("cid").agg(F.min("core").alias("core"), F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval"))
    train_cores, held_cores = cores.filter("in_train").select("cid", "core"), cores.filter("in_eval").select("cid", "core")
    near = _candidates(train_cores, held_cores)
    equal = cores.filter("in_train AND in_eval").select(F.col("cid").alias("e_cid"), F.col("cid").alias("t_cid"))
    links = near.unionByName(equal)
    e = classes.filter("in_eval").select(F.col("cid").alias("e_cid"), *[F.col(c).alias(f"e_{c}") for c in parts])
    t = classes.filter("in_train").select(F.col("cid").alias("t_cid"), *[F.col(c).alias(f"t_{c}") for c in parts])
    pairs = pair_join(links.join(e, "e_cid"), t, "t_cid", "t_class")
    return pairs.filter(same_article("e", "t")).select(F.col("e_class").alias("eval_class"), F.col("t_class").alias("train_class"))


def record_pairs(rows: DataFrame, record_id: str) -> DataFrame:
    """Columns ``eval_id, train_id``: all pairs of records, copies written out, hot classes salted."""
    links = cut_lineage(class_overlaps(rows))
    held = rows.filter("split != 'train'").select(F.col(record_id).alias("eval_id"), F.col("class").alias("eval_class"))
    train = rows.filter("split = 'train'").select(F.col(record_id).alias("train_id"), F.col("class").alias("train_class"))
    left = pair_join(links, held, "eval_class", "eval_id").select("eval_id", "train_class")
    return pair_join(left, train, "train_class", "train_id").select("eval_id", "train_id").distinct()


def overlap_report(rows: DataFrame, record_id: str) -> DataFrame:
    """Columns ``split, source, records, overlapping``: evaluation records per split and site, and how many of them are in train."""
    hit = class_overlaps(rows).select(F.col("eval_class").alias("class")).distinct().withColumn("hit", F.lit(1))
    held = rows.filter("split != 'train'").select(record_id, "split", "source", "class").join(hit, "class", "left")
    return held.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
