"""Problem 7: passages of held-out items inside documents, by a generalised suffix automaton over words.

The items' normalised words are built into automata, one for each block of items. Documents are read once; those
that hold a run of ``min_words`` words of some item, by its hash, go on to the automata of these items' blocks.
They stream through: at each word an automaton keeps the longest run of words, ending here, that also stands in some
item. A run of ``min_words`` or more is a leak of every item that holds the last ``min_words`` of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.textnorm import folded_words, folded_words_at
from quillmill.session import cut_lineage


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items behind each run of ``min_words`` words."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[int, int]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                if self.length[last] >= min_words:
                    ends.append((last, item))
        self.gate = self._gates()
        found: dict[int, set[int]] = {}
        for state, item in ends:
            found.setdefault(self.gate[state], set()).add(item)
        self.items = {g: tuple(sorted(s)) for g, s in found.items()}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the run already stands in an earlier item
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _gates(self) -> list[int]:
        """For each state of ``min_words`` words or more, the state of the last ``min_words`` words of its runs; else -1."""
        gate = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= self.min_words:
                gate[s] = s if self.length[self.link[s]] < self.min_words else gate[self.link[s]]
        return gate

    def scan(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position, length of the longest run ending there, gate) wherever that length is at least ``min_words``."""
        nxt, link, length, gate, vocab, least = self.next, self.link, self.length, self.gate, self.vocab, self.min_words
        state = run = 0
        for at, w in enumerate(words):
            c = vocab.get(w)
            if c is None:
                state = run = 0
                continue
            to = nxt[state].get(c)
            if to is None:
                while True:
                    state = link[state]
                    if state < 0:
                        break
                    to = nxt[state].get(c)
                    if to is not None:
                        break
                if state < 0:
                    state = run = 0
                    continue
                run = length[state]
            state = to
            run += 1
            if run >= least:
                g = state
                while length[link[g]] >= run:  # the run itself may belong to a shorter state
                    g = link[g]
                yield at, run, gate[g]


def _match(automaton: ItemAutomaton, words: list[str]) -> dict[int, list[int]]:
    """item -> [longest run of words, words covered]."""
    k = automaton.min_words
    runs: dict[int, list[int]] = {}  # item -> [longest, covered, last position, current stretch]
    for at, run, gate in automaton.scan(words):
        for item in automaton.items.get(gate, ()):
            r = runs.get(item)
            if r is None:
                runs[item] = [k, k, at, k]
                continue
            step = at - r[2]
            r[3] = min(r[3] + 1, run) if step == 1 else k
            r[0] = max(r[0], r[3])
            r[1] += min(step, k)
            r[2] = at
    return runs


#: Odd multiplier of the rolling hash of word runs. (fixed value)
_BASE = 0x9E3779B97F4A7C15
_word_hash = lru_cache(maxsize=1 << 20)(xxhash.xxh64_intdigest)


def run_hashes(texts: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words of each text, all texts at once."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(lengths.sum())
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = np.fromiter(map(_word_hash, chain.from_iterable(texts)), np.uint64, n)
    total = np.zeros(n - size + 1, np.uint64)
    factor = 1
    for j in range(size):
        total += words[j : n - size + 1 + j] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    total ^= total >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[: n - size + 1] == owner[size - 1 :]
    return total[inside], owner[: n - size + 1][inside]


class Seeds:
    """Hashes of the items' runs, sorted, with the block of items each belongs to, behind a table of bits that most hashes fail."""

    def __init__(self, hashes: np.ndarray, blocks: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.blocks = hashes[order], blocks[order]
        self.bits: np.ndarray | None = None

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, block) pairs of the runs that some item holds."""
        if self.bits is None:
            self.mask = np.uint64((1 << min(30, max(10, int(16 * len(self.hashes)).bit_length()))) - 1)
            self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
            self.bits[self.hashes & self.mask] = True
        maybe = np.flatnonzero(self.bits[hashes & self.mask])
        low = np.searchsorted(self.hashes, hashes[maybe])
        times = np.searchsorted(self.hashes, hashes[maybe], side="right") - low
        at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.unique(np.stack([np.repeat(owner[maybe], times), self.blocks[at]]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        return pairs[0], pairs[1]


class ItemBlocks:
    """The stated items, their words folded and dealt to blocks, and passes of seeds over them."""

    def __init__(self, items: DataFrame, item_id: str, passage: str, min_words: int, block_words: int, pass_words: int):
        self.min_words = min_words

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                words = [folded_words(t) for t in pdf.t]
                out = pd.DataFrame({"item": pdf.i, "w": [" ".join(w) for w in words], "n": [len(w) for w in words]})
                yield out[out.n >= min_words]

        known = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
        folded = cut_lineage(known.mapInPandas(fold, "item long, w string, n long"))
        total = folded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        self.count = -(-total // block_words)
        self.rows = folded.withColumn("block", F.pmod(F.xxhash64("item", F.lit(3)), F.lit(max(1, self.count))).cast("int"))
        self.passes = -(-total // pass_words)

    def seeds(self) -> Iterator[Seeds]:
        """One set of seeds per pass over the documents; all blocks share one pass unless the items exceed ``pass_words`` words."""
        size = self.min_words

        def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                hashes, owner = run_hashes([w.split(" ") for w in pdf.w], size)
                yield pd.DataFrame({"h": hashes.view(np.int64), "block": pdf.block.to_numpy()[owner]}).drop_duplicates()

        for turn in range(self.passes):
            own = self.rows.filter(F.col("block") % F.lit(self.passes) == turn)
            got = own.select("w", "block").mapInPandas(runs, "h long, block int").distinct().toPandas()
            yield Seeds(got.h.to_numpy().view(np.uint64), got.block.to_numpy(np.int64))


def _seeded(docs: DataFrame, blocks: ItemBlocks, doc_id: str, text: str) -> DataFrame:
    """Columns ``turn, d, u, t, blocks``: the documents that hold a run of some item, with the blocks of these items; ``u`` is a hash of the text."""
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).filter("d IS NOT NULL AND t IS NOT NULL")
    out = None
    least = blocks.min_words
    for turn, seeds in enumerate(blocks.seeds()):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own, block = shared.value.hits(*run_hashes([folded_words(t) for t in pdf.t], least))
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, np.int64)
                rows = own[cuts[:-1]]
                yield pd.DataFrame({"d": pdf.d.to_numpy()[rows], "t": pdf.t.to_numpy()[rows], "blocks": pd.Series([block[a:b].tolist() for a, b in zip(cuts, cuts[1:])], dtype=object)})

        part = source.mapInPandas(probe, "d long, t string, blocks array<int>").withColumn("turn", F.lit(turn))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "d long, t string, blocks array<int>, turn int")
    return cut_lineage(out.withColumn("u", F.xxhash64("t")))


def _against_blocks(seeded: DataFrame, blocks: ItemBlocks, answer: Callable[[ItemAutomaton, int, int, str], list[tuple]], schema: str, per_task: int = 50_000) -> DataFrame:
    """Rows of ``answer(automaton, u, d, t)`` for every seeded document and each of its blocks.

    The items of a block lie ahead of its documents in a partition and are built into the block's automaton there. A block with
    many documents is spread over salts, each with the block's items.
    """
    min_words = blocks.min_words
    rows = seeded.select("u", "d", "t", F.explode("blocks").alias("block"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).select("block", F.ceil(F.col("n") / per_task).cast("int").alias("salts"))
    sizes = F.broadcast(cut_lineage(sizes))  # a row per block of items
    given = blocks.rows.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("u"), F.col("item").alias("d"), F.col("w").alias("t"))
    asked = rows.join(sizes, "block").select("block", F.pmod(F.xxhash64("d", "u"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "u", "d", "t")
    ordered = given.unionByName(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "d")
    names = [f.split()[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, items, automaton = None, [], None
        for pdf in batches:
            out: list[tuple] = []
            for block, salt, kind, u, d, t in zip(pdf.block, pdf.salt, pdf.kind, pdf.u, pdf.d, pdf.t):
                if (block, salt) != place:
                    place, items, automaton = (block, salt), [], None
                if kind == 0:
                    items.append((d, t.split(" ")))
                    continue
                if automaton is None:
                    automaton = ItemAutomaton(items, min_words)
                out += answer(automaton, u, d, t)
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(scan, schema)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", min_words: int = 12, block_words: int = 100_000, pass_words: int = 20_000_000) -> DataFrame:
    """Columns ``doc_id, item_id, longest, covered``: each document and each item that it holds a run of.

    ``longest`` is the longest common run in words, ``covered`` the number of words in such runs. Documents are
    read once: one that shares no run of ``min_words`` words with any item, by hash, goes no further (a hash that meets by
    chance costs a scan and adds nothing). The others meet the automata of the blocks of items whose runs they
    hold; blocks have about ``block_words`` words each. What is broadcast is a hash and a block number for each run of
    the items, at most 12 bytes a word: the items are the stated query set, and beyond ``pass_words`` words
    of them the documents are read once more for each further ``pass_words``. Rows with a null id or text match
    nothing, nor does an item of fewer than ``min_words`` words; repeated rows give repeated rows. Ids are bigint.
    """
    blocks = ItemBlocks(items, item_id, passage, min_words, block_words, pass_words)
    seeded = _seeded(docs, blocks, doc_id, text)
    found = _against_blocks(seeded, blocks, lambda a, u, d, t: [(d, i, r[0], r[1]) for i, r in _match(a, folded_words(t)).items()], "d long, i long, longest int, covered int")
    return found.withColumnsRenamed({"d": doc_id, "i": item_id})


def _leaked_runs(automaton: ItemAutomaton, u: int, d: int, t: str) -> list[tuple]:
    """(document, first word, word behind) of the stretches of a text that stand in items."""
    out: list[list[int]] = []
    for at, run, _ in automaton.scan(folded_words_at(t)[0]):
        if out and at - run + 1 <= out[-1][1]:
            out[-1] = [min(out[-1][0], at - run + 1), at + 1]
        else:
            out.append([at - run + 1, at + 1])
    return [(d, u, a, b) for a, b in out]


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", min_words: int = 12, max_coverage: float = 0.5, block_words: int = 100_000, pass_words: int = 20_000_000) -> DataFrame:
    """Columns ``doc_id, text, removed_words, words``: the documents without the leaked runs.

    A run of ``min_words`` words or more is cut out; a document of which more than ``max_coverage`` of the
    words would go is emptied as a whole. Texts without leaks come back as they are and are not shuffled; null texts
    and texts with a null id stay as they are.
    """
    blocks = ItemBlocks(items, item_id, passage, min_words, block_words, pass_words)
    seeded = _seeded(docs, blocks, doc_id, text)
    runs = _against_blocks(seeded, blocks, _leaked_runs, "d long, u long, a int, b int")
    runs = runs.groupBy("d", "u").agg(F.collect_set(F.struct("a", "b")).alias("runs"))  # a document's own stretches
    schema = "d long, t string, removed_words int, words int"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t, own in zip(pdf.d, pdf.t, pdf.runs):
                words, places = folded_words_at(t)
                gone = bytearray(len(words))
                for r in own if own is not None else ():
                    gone[r["a"] : r["b"]] = b"\x01" * (r["b"] - r["a"])
                removed, n = sum(gone), len(words)
                if removed > max_coverage * n:
                    t = ""
                elif removed:
                    for at in sorted({p for p, g in zip(places, gone) if g}, reverse=True):
                        t = t[: at[0]] + t[at[1] :]
                rows.append((d, t, removed, n))
            yield pd.DataFrame(rows, columns=["d", "t", "removed_words", "words"])

    leaky = seeded.select("d", "u", "t", "turn")
    if blocks.passes > 1:  # a document may have been met in several passes: its rows of the first one count
        leaky = leaky.join(leaky.groupBy("d", "u").agg(F.min("turn").alias("turn")), ["d", "u", "turn"], "left_semi")
    cleaned = leaky.join(runs, ["d", "u"], "left").select("d", "t", "runs").mapInPandas(cut, schema)
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    if blocks.passes > 1:
        source = source.withColumn("u", F.xxhash64("t")).join(leaky.select("d", "u").distinct(), ["d", "u"], "left_anti").select("d", "t")
        shared = None
    else:
        shared = docs.sparkSession.sparkContext.broadcast(next(blocks.seeds(), None))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = shared.value if shared else None
        for pdf in batches:
            words = [[] if t is None else folded_words(t) for t in pdf.t]
            held = np.ones(len(pdf), dtype=bool)
            if seeds:
                held[seeds.hits(*run_hashes(words, min_words))[0]] = False
                held |= pdf.nameless.to_numpy()
            yield pdf.assign(removed_words=0, words=[len(w) for w in words])[held]

    source = source.select(F.coalesce("d", F.lit(0)).alias("d"), "t", F.col("d").isNull().alias("nameless"))
    rest = source.mapInPandas(keep, "d long, t string, nameless boolean, removed_words int, words int")
    rest = rest.select(F.when(~F.col("nameless"), F.col("d")).alias("d"), "t", "removed_words", "words")
    return rest.unionByName(cleaned).withColumnsRenamed({"d": doc_id, "t": text})
