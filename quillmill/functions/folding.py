"""Accent folding without a Python worker.

Spark has no Unicode normalisation function, so the letters whose compatibility decomposition is one
plain letter plus marks are mapped by ``translate`` with a table built here from ``unicodedata``, and
marks that stand alone (decomposed spelling) are removed by pattern.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.once import bound

#: Letters that carry a stroke and have no decomposition. (fixed values)
STROKED = {"đ": "d", "Đ": "D"}


@lru_cache(maxsize=4)
def fold_table(compat: bool = True, stroked: bool = True) -> tuple[str, str]:
    """(from, to) for ``translate``: every single-letter decomposition in the Latin blocks, full-width forms too."""
    form = "NFKD" if compat else "NFD"
    src, dst = [], []
    blocks = [range(0xA0, 0x250), range(0x1E00, 0x1F00)] + ([range(0xFF01, 0xFF5F)] if compat else [])
    for block in blocks:
        for code in block:
            char = chr(code)
            base = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))
            if len(base) == 1 and base != char and (base.isascii() or not base.isspace()):
                src.append(char)
                dst.append(base)
    if stroked:
        for char, base in STROKED.items():
            src.append(char)
            dst.append(base)
    return "".join(src), "".join(dst)


#: Compatibility ligatures that decompose into several letters. (fixed values)
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "..."}


def fold_case_kept(col: Column, compat: bool = True, stroked: bool = True) -> Column:
    """Accents off, letter case kept."""
    out = F.translate(col, *fold_table(compat, stroked))
    if compat:
        for char, base in LIGATURES.items():
            out = F.replace(out, F.lit(char), F.lit(base))
    return F.regexp_replace(out, r"\p{Mn}+", "")


def fold(col: Column) -> Column:
    """Stroked d, accents and letter case off (compatibility forms included)."""
    return F.lower(fold_case_kept(col))


@lru_cache(maxsize=1)
def _composed() -> dict[str, str]:
    """Letters with marks as they are spelt with marks of their own, in any order of two marks -> the one letter."""
    out = {}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            char = chr(code)
            form = unicodedata.normalize("NFD", char)
            if len(form) > 1:
                out[form] = char
            if len(form) == 3:
                turned = form[0] + form[2] + form[1]
                out[turned] = unicodedata.normalize("NFC", turned)
                out[unicodedata.normalize("NFC", form[:2]) + form[2]] = char
    return {k: v for k, v in out.items() if k != v}


@lru_cache(maxsize=1)
def _compatible() -> dict[str, str]:
    """Characters of the Latin, punctuation, letter-like, numeral, ligature and full-width blocks with another compatibility form."""
    blocks = [range(0xA0, 0x370), range(0x1D00, 0x1E00), range(0x2000, 0x2190), range(0x2460, 0x2500), range(0x3000, 0x3100), range(0xFB00, 0xFB07), range(0xFF01, 0xFFEF)]
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for block in blocks for c in block)
    return {a: b for a, b in pairs if a != b}


def _mapped(parts: Column, table: dict[str, str]) -> Column:
    lookup = F.from_json(F.lit(json.dumps(table)), "map<string,string>")  # one literal, folded into a constant
    return F.array_join(F.transform(parts, lambda c: F.coalesce(F.try_element_at(lookup, c), c)), "")


def compose(col: Column) -> Column:
    """Canonical composition (NFC) of Latin letters; a text without marks of their own is left as it is."""
    parts = F.regexp_extract_all(col, F.lit(r"(?s)(\P{M}\p{M}+|\p{M}+|\P{M}+(?!\p{M}))"), F.lit(1))  # what has no marks is one part
    return F.when(col.rlike(r"\p{M}"), _mapped(parts, _composed())).otherwise(col)


@lru_cache(maxsize=1)
def _ranges(chars: frozenset[str]) -> str:
    """The characters as the inside of a character class; ranges, as a class tries its members one by one."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def compat(col: Column) -> Column:
    """Compatibility composition (NFKC) of Latin text, punctuation, ligatures and full-width forms."""
    single = {a: b for a, b in _compatible().items() if len(b) == 1}
    several = {a: b for a, b in _compatible().items() if len(b) > 1}
    odd = _ranges(frozenset(several))

    def spelt(c: Column) -> Column:
        parts = F.regexp_extract_all(c, F.lit(f"([{odd}]|[^{odd}]+)"), F.lit(1))
        return F.when(c.rlike(f"[{odd}]"), _mapped(parts, several)).otherwise(c)

    return bound(compose, bound(spelt, F.translate(col, "".join(single), "".join(single.values()))))
