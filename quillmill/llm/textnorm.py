"""Text forms shared by the Python-side operators of this package."""

from __future__ import annotations

import html
import re
import unicodedata

#: Blocks of combining marks. (fixed values)
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
#: Characters without width, dropped inside words. (fixed values)
_NO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&lt;/?[a-zA-Z][^<>&]*&gt;", re.S)
#: Bracketed reference marks: numbers with an optional letter, notes and editor's marks.
REF_MARK = r"\[(?:\d{1,3}[a-z]?|[a-z]|note \d+|nb \d+|edit|citation needed|cần dẫn nguồn|sửa)\]"
_REF = re.compile(REF_MARK, re.I)
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\S+")


def fold_text(text: str) -> str:
    """NFKD without marks, stroked d to d, lower case, nothing of no width."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _NO_WIDTH.sub("", text)).replace("đ", "d").replace("Đ", "D")
    return _COMBINING.sub("", text).lower()


def _blank(match: re.Match) -> str:
    return " " * (match.end() - match.start())


def without_marks(text: str) -> str:
    """Markup and bracketed reference marks blanked out; every other character keeps its place."""
    if "<" in text or "&lt;" in text:
        text = _TAG.sub(_blank, text)
    if "[" in text:
        text = _REF.sub(_blank, text)
    return text


def folded_words(text: str) -> list[str]:
    """Words of a text without markup, entities, reference marks, case, accents and punctuation."""
    text = without_marks(text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(fold_text(text))


def folded_words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """As ``folded_words``, with the place in ``text`` of the blank-free run that each word comes from."""
    words, places = [], []
    for token in _TOKEN.finditer(without_marks(text)):
        own = token.group()
        for w in _WORD.findall(fold_text(html.unescape(own) if "&" in own else own)):
            words.append(w)
            places.append(token.span())
    return words, places
