"""Canonical forms of the names, urls and split labels that the operators of this package link by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.folding import fold

#: Spellings of the split labels after trimming and lower case. (fixed values)
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test", "testing": "test"}


def _null_if_blank(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def split_key(col: Column) -> Column:
    """train, val or test; null for a missing, blank or unknown label."""
    low = F.lower(F.regexp_replace(col, r"[\s\p{Z}]+", ""))
    out = F.lit(None).cast("string")
    for given, name in SPLITS.items():
        out = F.when(low == given, F.lit(name)).otherwise(out)
    return out


def name_key(col: Column) -> Column:
    """A group or entity name without case, accents, underscores and loose blanks; null if nothing is left."""
    out = F.regexp_replace(F.translate(fold(col), "_", " "), r"[\s\p{Z}]+", " ")
    return _null_if_blank(F.trim(F.regexp_replace(out, r" ?/ ?", "/")))


def url_key(col: Column) -> Column:
    """host/path of a url: no scheme, port, www or mobile label, query, fragment, percent code or end slash.

    The path keeps its case and accents, as pages that differ in these are different pages.
    """
    bare = F.regexp_replace(F.trim(col), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"(^|\.)(?:m|mobile)\.", "$1")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    path = F.regexp_replace(F.translate(path, " ", "_"), r"/+$", "")
    return _null_if_blank(F.concat(host, path))


def url_site(col: Column) -> Column:
    """The site of a url: its host without www and mobile labels."""
    return F.regexp_extract(url_key(col), r"^([^/]*)", 1)
