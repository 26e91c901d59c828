"""Problem 6: filling containers of fixed capacity with texts, by swap-based local search.

Texts are measured in tokens of a public tokenizer; one that alone exceeds the capacity is cut between words.
Items are dealt to shards of bounded size by hash. In a shard a best-fit start is improved by moving
items, exchanging one for one, two for one and one for two between underfull containers, always so that the sum
of squared fills rises, until light containers are empty. What lies in the lightest container of each shard is packed again
with that of the other shards, in as many rounds as there are shards left.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut_lineage

CAPACITY = 2048
#: Rank file of the public tokenizer (a parameter of every function below).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public pattern that splits text before the merges of that file. (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word with the whitespace before it. No match of the pattern above goes on from a word into whitespace, so tokens of words
#: add up to those of the text. Four controls count as whitespace in Python only.
WORD = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


@lru_cache(maxsize=4)
def encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_count(text: str, enc) -> int:
    return len(enc.encode_ordinary(text))


class WordCounts(dict):
    """Tokens of each word as ``WORD`` finds it, encoded once while it is kept; long words are not kept."""

    def __init__(self, enc, most: int = 500_000, longest: int = 40):
        super().__init__()
        self.enc, self.most, self.longest = enc, most, longest

    def __missing__(self, word: str) -> int:
        n = token_count(word, self.enc)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n

    def of(self, text: str) -> int:
        """``token_count`` of a text."""
        return sum(map(self.__getitem__, WORD.findall(text)))


@lru_cache(maxsize=4)
def word_counts(enc) -> WordCounts:
    return WordCounts(enc)


def cut_text(text: str, capacity: int, enc) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the parts of a text, each within the capacity, cut between words where it can be.

    Cuts fall on the borders at which the tokenizer splits before merging, so tokens of the parts add up.
    """
    import regex

    counts = word_counts(enc)
    parts, start, at, used = [], 0, 0, 0
    for word in WORD.finditer(text):
        n = counts[word[0]]
        if used + n <= capacity:
            at, used = word.end(), used + n
            continue
        for m in regex.finditer(PATTERN, word[0]):
            stack = [(word.start() + m.start(), word.start() + m.end())]
            while stack:
                a, b = stack.pop()
                n = token_count(text[a:b], enc)
                if n > capacity and b - a > 1:  # one word longer than a container
                    stack += [((a + b) // 2, b), (a, (a + b) // 2)]
                    continue
                if used + n > capacity and at > start:
                    parts.append((start, at, used))
                    start, used = a, 0
                at, used = b, used + n
    if at > start:
        parts.append((start, at, used))
    return parts


class Packing:
    """Containers of one shard."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.size = sizes.astype(np.int64)
        self.capacity = capacity
        self.home = np.full(len(sizes), -1, dtype=np.int64)
        self.bins: list[set[int]] = []
        self.free: list[int] = []
        self.twos: dict[int, int] = {}
        self.room = np.full(len(sizes), -1, dtype=np.int64)  # free tokens of each container, -1 of an empty one
        self._best_fit()
        self.room = self.room[: len(self.bins)]

    def _best_fit(self) -> None:
        """Largest first, each into the fullest container that still takes it."""
        with_free: dict[int, list[int]] = {}
        mask = 0
        for i in np.argsort(-self.size, kind="stable").tolist():
            s = int(self.size[i])
            fits = mask >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                own = with_free[room]
                b = own.pop()
                if not own:
                    mask &= ~(1 << room)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append(set())
                self.free.append(self.capacity)
            self._put(i, b)
            left = room - s
            with_free.setdefault(left, []).append(b)
            mask |= 1 << left

    def _put(self, i: int, b: int) -> None:
        if self.home[i] >= 0:
            old = int(self.home[i])
            self.bins[old].discard(i)
            self.free[old] += int(self.size[i])
            self.room[old] = self.free[old] if self.bins[old] else -1
            self.twos.pop(old, None)
        self.home[i] = b
        self.bins[b].add(i)
        self.free[b] -= int(self.size[i])
        self.room[b] = self.free[b]
        self.twos.pop(b, None)

    def least_bins(self) -> int:
        return -(-int(self.size.sum()) // self.capacity)

    def improve(self) -> None:
        """Empties light containers until the bound on their number is met or none of them has an exchange left."""
        open_ = np.ones(len(self.bins), dtype=bool)  # without those found to have no exchange
        moved = False
        count, least = sum(map(bool, self.bins)), self.least_bins()
        while count > least:
            room = np.where(open_, self.room, -1)
            light = int(np.argmax(room))
            if room[light] < 1:  # what leaves a full container must go to a full one
                if not moved:
                    break
                moved = False
                open_[:] = True
                continue
            if not self._step(light):
                open_[light] = False
                continue
            moved = True
            if not self.bins[light]:
                count -= 1
                open_[:] = True

    def _pair_sums(self, b: int) -> int:
        """Bits at the sizes that two items of a container add up to."""
        sums = self.twos.get(b)
        if sums is None:
            sums = met = 0
            for i in self.bins[b]:
                sums |= met << int(self.size[i])
                met |= 1 << int(self.size[i])
            self.twos[b] = sums
        return sums

    def _step(self, light: int) -> bool:
        """One move or exchange out of a light container into a fuller one; False if there is none."""
        room_of = np.where(self.room <= self.room[light], self.room, -1)
        room_of[light] = -1
        if room_of.max(initial=-1) < 1:
            return False
        own = sorted(self.bins[light], key=lambda i: -self.size[i])
        for i in own:  # move
            if room_of.max(initial=-1) < self.size[i]:
                continue
            ok = np.flatnonzero(room_of >= self.size[i])
            self._put(i, int(ok[np.argmin(room_of[ok])]))
            return True
        room = room_of[self.home]
        with_room = np.flatnonzero(room > 0)
        most = np.full(self.capacity + 1, -1)  # the most room beside an item of each size
        np.maximum.at(most, self.size[with_room], room[with_room])
        alike: dict[int, list[int]] = {}  # sizes add up to the capacity at most, so few differ
        for i in own:
            alike.setdefault(int(self.size[i]), []).append(i)
        gives = {s: (x[0],) for s, x in alike.items()}
        for x, y in combinations_with_replacement(alike.values(), 2):
            if x is not y or len(x) > 1:
                two = (x[0], y[0]) if x is not y else (x[0], x[1])
                gives.setdefault(int(self.size[two[0]] + self.size[two[1]]), two)
        sizes = np.flatnonzero(most > 0)
        most_of = most[sizes]
        for s, give in gives.items():  # one or two for one
            gain = s - sizes
            ok = np.flatnonzero((gain > 0) & (gain <= most_of))
            if len(ok):
                z = int(sizes[ok[np.argmax(gain[ok] - most_of[ok])]])
                j = int(np.flatnonzero((self.size == z) & (room == most[z]))[0])
                target = int(self.home[j])
                self._put(j, light)
                for i in give:
                    self._put(i, target)
                return True
        for b in np.flatnonzero(room_of > 0).tolist():  # one for two
            sums = self._pair_sums(b)
            for s, x in alike.items():
                low = max(0, s - int(room_of[b]))
                if (sums >> low) & ((1 << (s - low)) - 1):
                    pairs = ((j, k) for j, k in combinations(self.bins[b], 2) if low <= self.size[j] + self.size[k] < s)
                    j, k = next(pairs)
                    self._put(j, light)
                    self._put(k, light)
                    self._put(x[0], b)
                    return True
        return False


def pack_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str = RANKS, shard_items: int = 5_000) -> DataFrame:
    """Columns ``doc_id, piece, pieces, start, length, tokens, container, position``.

    One row per text, or per piece (numbered from 0, ``start`` and ``length`` in characters) of a text that
    alone exceeds the capacity. A container holds at most ``capacity`` tokens; positions count from 0. Null
    texts and texts without a token take no room and give no row; a repeated row is packed again. Shards hold
    about ``shard_items`` items whatever the size of the data, as items are dealt by a hash of id and piece. The file
    ``ranks``, a path or an address that Spark can read on the driver, is sent to the executors once.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks)
    name = ranks.rstrip("/").rsplit("/", 1)[-1]
    kind = docs.schema[doc_id].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name))
        counts = word_counts(enc)
        for pdf in batches:
            rows = []
            for d, t in zip(pdf.d, pdf.t):
                n = counts.of(t)
                parts = [(0, len(t), n)] if n <= capacity else cut_text(t, capacity, enc)
                rows += [(d, k, len(parts), a, b - a, m) for k, (a, b, m) in enumerate(parts) if m]
            yield pd.DataFrame(rows, columns=["d", "piece", "pieces", "start", "length", "tokens"])

    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    items = cut_lineage(texts.mapInPandas(measure, f"d {kind}, piece int, pieces int, start int, length int, tokens int"))
    shards = max(1, -(-items.count() // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("d", "piece", "start"), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "d", "piece"], ascending=[False, True, True], ignore_index=True)
        p = Packing(pdf.tokens.to_numpy(), capacity)
        p.improve()
        order = {b: k for k, b in enumerate(sorted({int(h) for h in p.home}))}
        pdf["container"] = pdf.shard * (1 << 32) + pd.Series(p.home).map(order)
        pdf["position"] = pdf.groupby("container").cumcount()
        filled = pdf.groupby("container").tokens.transform("sum")
        pdf["left"] = (pdf.container == pdf.container[filled.idxmin()]) & (filled < capacity)
        return pdf[[*names, "container", "position", "left"]]

    names = ["d", "piece", "pieces", "start", "length", "tokens"]
    out, before = None, 0
    while True:
        packed = items.groupBy("shard").applyInPandas(fill, f"d {kind}, piece int, pieces int, start int, length int, tokens int, container long, position int, left boolean")
        packed = packed.withColumn("container", F.col("container") + F.lit(before * (1 << 32)))
        if shards > 1:
            packed = cut_lineage(packed)
        kept = packed.drop("left") if shards == 1 else packed.filter(~F.col("left")).drop("left")
        out = kept if out is None else out.unionByName(kept)
        if shards == 1:
            return out.withColumnRenamed("d", doc_id)
        before += shards
        items = packed.filter("left").select(*names)  # a container of each shard, so far fewer items than before
        shards = max(1, min(shards // 2, -(-items.count() // shard_items)))
        items = items.withColumn("shard", F.pmod(F.xxhash64("d", "piece", "start", F.lit(before)), F.lit(shards)))
