"""External models behind a small interface, with a deterministic stand-in that needs no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.chunking import halves


class ModelClient(Protocol):
    """What the engine asks of a model; instances are sent to the workers, so they open connections lazily."""

    def complete(self, prompts: list[str], temperature: float = 0.0) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class StubModel:
    """Answers and vectors made from a hash of the input."""

    def __init__(self, dims: int = 64, reply: Callable[[str], str] | None = None):
        self.dims, self.reply = dims, reply

    def complete(self, prompts: list[str], temperature: float = 0.0) -> list[str]:
        return [self.reply(p) if self.reply else f"stub {hashlib.md5(p.encode()).hexdigest()[:8]}" for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.md5(f"{i}|{t}".encode()).digest() for i in range(-(-self.dims // 16)))
            out.append([(b - 127.5) / 127.5 for b in raw[: self.dims]])
        return out


def _each(df: DataFrame, column: str, out: str, kind: str, call: Callable[[list], list], batch: int) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list = []
            values = pdf[column].tolist()
            for s in range(0, len(values), batch):
                got += call(values[s : s + batch])
            yield pdf.assign(**{out: got})

    return df.mapInPandas(run, f"{fields}, `{out}` {kind}")


def completed(df: DataFrame, prompt: str, client: ModelClient, out: str = "completion", temperatures: tuple[float, ...] = (0.0, 0.3, 0.6), accept: Callable[[str], bool] = bool, batch: int = 16) -> DataFrame:
    """``out`` added: the model's answer; an answer that is not accepted is asked again at the next temperature, null in the end."""

    def call(prompts: list[str]) -> list[str | None]:
        done: dict[int, str] = {}
        for t in temperatures:
            left = [i for i in range(len(prompts)) if i not in done and prompts[i] is not None]
            for i, a in zip(left, client.complete([prompts[i] for i in left], t) if left else []):
                if accept(a):
                    done[i] = a
        return [done.get(i) for i in range(len(prompts))]

    return _each(df, prompt, out, "string", call, batch)


def extracted(df: DataFrame, text: str, client: ModelClient, accept: Callable[[str], bool], out: str = "parts", depth: int = 2) -> DataFrame:
    """``out`` added: accepted answers for a text, for its halves where the whole fails, down to ``depth`` halvings."""

    def one(t: str, level: int) -> list[str]:
        a = client.complete([t])[0]
        if accept(a):
            return [a]
        parts = halves(t) if level < depth else [t]
        return [] if len(parts) < 2 else [x for p in parts for x in one(p, level + 1)]

    return _each(df, text, out, "array<string>", lambda ts: [None if t is None else one(t, 0) for t in ts], 16)


def embedded(df: DataFrame, text: str, client: ModelClient, dims: int, out: str = "embedding", batch: int = 16) -> DataFrame:
    """``out`` added: vectors of ``dims`` numbers, padded or cut; all zero for a missing text or a failed call."""

    def call(texts: list[str]) -> list[list[float]]:
        known = [i for i, t in enumerate(texts) if t is not None]
        try:
            got = dict(zip(known, client.embed([texts[i] for i in known]))) if known else {}
        except Exception:  # a failed call must not end the job
            got = {}
        return [([*map(float, got.get(i, []))] + [0.0] * dims)[:dims] for i in range(len(texts))]

    return _each(df, text, out, "array<float>", call, batch)


def with_cache(df: DataFrame, text: str, cache: DataFrame, ask: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """Cached values by content hash; only texts without one are asked about, each distinct text once."""
    x = df.withColumn("key", F.md5(text))
    fresh = ask(x.select("key", text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
    known = cache.select("key", value).unionByName(fresh.select("key", value))
    return x.join(known, "key", "left")
