"""Problem 3: splitting oversized texts at natural boundaries, by pointer doubling.

A text's words are the nodes of a successor table: from every possible cut the farthest legal next cut,
which is the last sentence or line end within reach of the limit once the overlap is counted in, or the
limit itself where none is in reach. Squaring the table again and again marks every cut that the greedy walk
from the start visits, in a number of steps that grows with the logarithm of the words, for all texts of a
batch at once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.readability import ABBREVIATIONS
from quillmill.session import cut_lineage

SIZE, OVERLAP = 120, 15

_WORD = re.compile(r"\S+")
_LINE = re.compile(r"\s*[\r\n\x0b\x0c  ]\s*")
_MARK = r"\[\w{1,4}\]"
_STOP = re.compile(r"[.!?…][.!?…\"”»’)\]']*(?:" + _MARK + r")*(?!\S)")
_MARKS = re.compile(r"(?:" + _MARK + r")+[.,;]?\Z")
_SHORT = re.compile(r"[\"“«‘'(\[]*(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r"|[A-ZĐ])\.\Z")
_ITEM = re.compile(r"\(?\d{1,3}[.)]\Z")


class Boundaries:
    """Word places of a text and the numbers of words after which a sentence or a line ends."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts = [s[0] for s in spans]
        self.ends = [s[1] for s in spans]
        n = self.words = len(spans)
        lines = {bisect_right(self.starts, m.start()) for m in _LINE.finditer(text)} - {0, n}
        stops = set()
        for m in _STOP.finditer(text):
            at = bisect_right(self.starts, m.start())  # words up to and with the one that holds the stop
            if self._ends_sentence(at, lines):
                while at < n and at not in lines and _MARKS.match(text, self.starts[at], self.ends[at]):
                    at += 1  # marks that stand alone belong to the sentence before
                stops.add(at)
        self.lines = lines
        self.stops = stops
        self.inner = sorted((lines | stops) - {n})

    def _ends_sentence(self, at: int, lines: set[int]) -> bool:
        s, e = self.starts[at - 1], self.ends[at - 1]
        if _SHORT.match(self.text, s, e):
            return False
        return not (_ITEM.match(self.text, s, e) and (at == 1 or at - 1 in lines))

    def piece(self, a: int, b: int) -> str:
        return self.text[self.starts[a] : self.ends[b - 1]]


def successors(words: int, inner: list[int], size: int, overlap: int) -> np.ndarray:
    """For each cut 0..words the farthest legal next cut; ``words`` leads to itself."""
    cut = np.arange(words + 1)
    limit = np.minimum(words, cut - np.minimum(cut, overlap) + size)
    natural = np.array([0, *inner, words])
    best = natural[np.searchsorted(natural, limit, side="right") - 1]
    return np.where(best > cut, best, limit)


def doubled_cuts(tables: list[np.ndarray]) -> list[np.ndarray]:
    """The cuts that the walk from 0 visits, for all successor tables at once, by squaring them."""
    if not tables:
        return []
    start = np.cumsum([0, *map(len, tables)])
    jump = np.concatenate([t + s for t, s in zip(tables, start)])
    seen = np.zeros(len(jump), dtype=bool)
    seen[start[:-1]] = True
    while True:
        nxt = jump[jump]
        seen[jump[seen]] = True
        if np.array_equal(nxt, jump):
            break
        jump = nxt
    return [np.flatnonzero(seen[a:b]) for a, b in zip(start, start[1:])]


def split_texts(docs: DataFrame, doc_id: str = "_id", text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Columns ``doc_id, chunk_order_index, content, words``: the pieces of each text, numbered from 0.

    Each piece has at most ``size`` words (runs of non-space characters) and, but for the first, begins with
    the last ``overlap`` words of the one before; a text within the size is one piece. Blank and null texts
    give no piece. Needs no shuffle: a text is cut where it is read, and only whole words are ever cut apart.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bounds = [Boundaries(t) for t in pdf.t]
            walks = doubled_cuts([successors(b.words, b.inner, size, overlap) for b in bounds])
            rows = []
            for d, b, cuts in zip(pdf.d, bounds, walks):
                for k, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    a = max(0, int(at) - overlap)
                    rows.append((d, k, b.piece(a, int(to)), int(to) - a))
            yield pd.DataFrame(rows, columns=[doc_id, "chunk_order_index", "content", "words"])

    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("d IS NOT NULL AND t IS NOT NULL")
    return texts.mapInPandas(cut, f"`{doc_id}` {kind}, chunk_order_index int, content string, words int")


_FACTS = "id string, doc string, idx int, update_time long, n int, stop_before int, ends boolean, tail string, head string, line_bits string, mark_bits string, h long"


def _text_hash(piece: str) -> int:
    h = xxhash.xxh64_intdigest(piece)
    return h - (1 << 64) if h >> 63 else h


def _bits(places: Iterable[int], size: int) -> str:
    out = ["0"] * size
    for k in places:
        out[k] = "1"
    return "".join(out)


def _piece_facts(content: str, size: int, overlap: int) -> tuple:
    """What the rules need of a stored piece: (words, last inner boundary, whether its last word ends a sentence, last and
    first words, where a line ends or a mark follows after each of these, hash of the piece)."""
    b = Boundaries(content)
    n = b.words
    inner = b.inner[-1] if b.inner else 0
    words = [content[s:e] for s, e in zip(b.starts[-overlap:], b.ends[-overlap:])] if overlap else []
    first = [content[s:e] for s, e in zip(b.starts[:overlap], b.ends[:overlap])]
    lines = [k for k in range(1, overlap + 1) if k in b.lines]
    marks = [k for k in range(1, min(overlap, n - 1) + 1) if _MARKS.match(content, b.starts[k], b.ends[k])]
    marks += [overlap + 1 + k for k in range(n, overlap + 1)]  # nothing follows
    return n, inner, n in b.stops, " ".join(words), " ".join(first), _bits(lines, overlap + 1), _bits(marks, 2 * overlap + 2), _text_hash(content.strip())


def _on_the_walk(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Columns ``doc, idx, h``: the pieces that the doubled walks cut, by hash; pieces in which two texts of one document differ are left out."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["_id"], "idx": pdf.chunk_order_index, "h": [_text_hash(c) for c in pdf.content]})

    walk = split_texts(docs, "_id", "content", size, overlap).mapInPandas(hashed, "doc string, idx int, h long")
    return walk.groupBy("doc", "idx").agg(F.min("h").alias("h"), F.max("h").alias("_hi")).filter("h = _hi").drop("_hi")


def wrongly_cut(chunks: DataFrame, docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, max_broadcast: int = 200_000) -> DataFrame:
    """Columns ``full_doc_id, chunk_order_index`` of the stored pieces that the splitting rules forbid.

    Of rows with the same ``_id`` the one with the latest ``update_time`` counts. Each document is cut by the doubled
    successor tables of ``split_texts``; a stored piece that is the piece of the walk with its index, and whose stored predecessor is
    the one before it there, is right. The others are candidates, each judged by the boundaries in it: one is wrong if it
    exceeds ``size`` words, if it does not begin with the last ``overlap`` words of the piece before, or if it stops inside
    a sentence and line although there is a natural cut in it after the repeated words. Whether a line ends behind
    a piece is seen in the next piece where that repeats its end; else (few rows) in the document's text.

    Only facts of bounded size are shuffled, not the texts. Neighbours are found inside blocks of 1,024 stored
    indexes and then between blocks, so a document with a third of all pieces is no single task's work. Rows
    with a null content, index or document are left out.
    """

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_piece_facts(c, size, overlap) for c in pdf.content]
            cols = list(zip(*got)) if got else [()] * 8
            out = pdf[["id", "doc", "idx", "update_time"]].copy()
            for name, col in zip(["n", "stop_before", "ends", "tail", "head", "line_bits", "mark_bits", "h"], cols):
                out[name] = list(col)
            yield out

    rows = chunks.select(F.col("_id").alias("id"), F.col("full_doc_id").alias("doc"), F.col("chunk_order_index").cast("int").alias("idx"), F.coalesce(F.col("update_time"), F.lit(0)).cast("long").alias("update_time"), "content")
    rows = rows.filter("id IS NOT NULL AND doc IS NOT NULL AND idx IS NOT NULL AND content IS NOT NULL")
    fact = rows.mapInPandas(facts, _FACTS)
    names = [c.split()[0] for c in _FACTS.split(", ")]
    state = [c for c in names if c not in ("id", "update_time")]
    now = fact.groupBy("id").agg(F.max(F.struct("update_time", *state)).alias("s")).select("id", "s.*").drop("update_time")
    walk = _on_the_walk(docs.select(F.col("_id").cast("string").alias("_id"), "content"), size, overlap).withColumn("on", F.lit(True))
    now = now.join(walk, ["doc", "idx", "h"], "left").withColumn("on", F.coalesce("on", F.lit(False))).withColumn("block", F.expr("idx div 1024"))

    before, after = ["n", "tail", "on", "idx"], ["head", "line_bits", "mark_bits"]

    def neighbours(df: DataFrame, w: Window, fill: bool) -> DataFrame:
        for c in before:
            v = F.lag(c).over(w)
            df = df.withColumn(f"p_{c}", F.coalesce(F.col(f"p_{c}"), v) if fill else v)
        for c in after:
            v = F.lead(c).over(w)
            df = df.withColumn(f"x_{c}", F.coalesce(F.col(f"x_{c}"), v) if fill else v)
        return df

    near = neighbours(now, Window.partitionBy("doc", "block").orderBy("idx", "id"), False)
    blocks = now.filter("block > 0").select("doc").distinct().withColumn("several", F.lit(True))
    near = near.join(blocks, "doc", "left")
    edge = F.coalesce(F.col("several"), F.lit(False)) & (F.col("p_n").isNull() | F.col("x_head").isNull())
    far = neighbours(near.filter(edge), Window.partitionBy("doc").orderBy("idx", "id"), True)
    joined = near.filter(~edge).unionByName(far)
    follows = F.col("p_on") & (F.col("p_idx") == F.col("idx") - 1)
    settled = F.col("on") & ((F.col("p_n").isNull() & (F.col("idx") == 0)) | F.coalesce(follows, F.lit(False)))
    joined = joined.filter(~settled)

    repeats = lambda head, tail: (head == tail) | head.startswith(F.concat(tail, F.lit(" ")))
    k = F.least(F.col("n"), F.lit(overlap))
    bit = lambda c, at: F.expr(f"substring({c}, {at} + 1, 1) = '1'")
    past = F.coalesce(bit("x_mark_bits", f"(least(n, {overlap}) + {overlap + 1})"), F.lit(False))
    sees = F.coalesce(repeats(F.col("x_head"), F.col("tail")), F.lit(False)) & ~past & (k > 0)
    checked = joined.select(
        "id", "doc", "idx",
        ((F.col("n") > size) | (F.col("p_n").isNotNull() & ~F.coalesce(repeats(F.col("head"), F.col("p_tail")), F.lit(True)))).alias("wrong"),
        (F.col("x_head").isNotNull() & (F.col("stop_before") > F.least(F.coalesce(F.col("p_n"), F.lit(0)), F.lit(overlap)))).alias("might"),
        "ends", sees.alias("sees"),
        bit("x_line_bits", f"least(n, {overlap})").alias("line"), bit("x_mark_bits", f"least(n, {overlap})").alias("mark"),
    )
    checked = cut_lineage(checked)
    stops_inside = ~(F.col("line") | (F.col("ends") & ~F.col("mark")))
    seen = checked.filter("wrong OR (might AND sees)").filter(F.col("wrong") | stops_inside)
    unseen = checked.filter("NOT wrong AND might AND NOT sees").select("id", "doc", "idx", "ends")
    placed = _look_behind(unseen, rows, docs, max_broadcast)
    out = seen.select("doc", "idx").unionByName(placed.filter(stops_inside).select("doc", "idx"))
    return out.select(F.col("doc").alias("full_doc_id"), F.col("idx").alias("chunk_order_index"))


def _look_behind(unseen: DataFrame, rows: DataFrame, docs: DataFrame, max_broadcast: int) -> DataFrame:
    """For pieces whose successor doesn't show what follows them: look it up in the document's text."""
    count = unseen.count()
    hint = F.broadcast if count <= max_broadcast else (lambda df: df)
    latest = rows.join(hint(unseen), ["id", "doc", "idx"]).groupBy("id").agg(F.max_by(F.struct("doc", "idx", "ends", "content"), F.struct("update_time", "content")).alias("s")).select("s.*")
    wanted = unseen.select("doc").distinct()
    texts = docs.select(F.col("_id").alias("doc"), F.col("content").alias("text")).join(hint(wanted), "doc", "left_semi").groupBy("doc").agg(F.max("text").alias("text"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            line, mark = [], []
            for content, text in zip(pdf.content, pdf.text):
                at = text.find(content.strip()) if isinstance(text, str) else -1
                rest = text[at + len(content.strip()) :] if at >= 0 else "x"
                gap = _LINE.match(rest)
                word = _WORD.search(rest)
                line.append(gap is not None or word is None)
                mark.append(bool(word and not gap and _MARKS.match(word.group())))
            yield pdf[["doc", "idx", "ends"]].assign(line=line, mark=mark)

    return latest.join(texts, "doc", "left").mapInPandas(follow, "doc string, idx int, ends boolean, line boolean, mark boolean")
