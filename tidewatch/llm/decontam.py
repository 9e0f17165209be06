"""Benchmark decontamination by the q-gram lemma over diagonal bands.

A pattern of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k*q of its q-grams with it, at diagonals (place in the text less place in the
pattern) that differ by at most k to either side. Shared q-grams are counted in overlapping
bands of diagonals, each of which holds every such run whole; bands that reach the bound are
verified by an alignment limited to the band. Texts and patterns are compared in lower case
with runs of white space as one space. One rule holds for items of all lengths: they are found whole,
within EDITS edits in a hundred characters (rounded down). Those too short for a q-gram, which are
words rather than passages, are found by the hash of all of their characters, between word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import groups, no_table

#: Characters of a q-gram; edits allowed, per hundred characters of the pattern.
Q, EDITS = 10, 5  # 20 characters, the fewest with an edit, keep 20 - 10 + 1 - 10 q-grams
#: Characters of patterns that one pass over the texts compares with (an item is never split); a larger benchmark takes more passes.
BLOCK = 4_000_000
TABLE_BITS = 22
SEED = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram, built up from those of half the length."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    n, size, own = len(c), 1, (c.astype(np.uint64) + np.uint64(1)) * SEED
    held: np.ndarray | None = None
    done = 0
    while True:
        if q & size:  # appended to what is held
            part = own[done:]
            held = own if held is None else held[: len(part)] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + (part[: len(held)] ^ (part[: len(held)] >> np.uint64(29)))
            done += size
        if done == q:
            return held[: n - q + 1]
        own = own[:-size] * np.uint64(0xA0761D6478BD642F + 2 * size) + (own[size:] ^ (own[size:] >> np.uint64(31)))
        size *= 2


class Patterns:
    """The benchmark's patterns and an index of their q-grams; about BLOCK characters and a table of fixed size."""

    def __init__(self, items: list[tuple[Any, str | None]], q: int = Q, edits: int = EDITS) -> None:
        self.q = q
        all_ = [(key, codes(text)) for key, text in sorted({(key, normal(text or "")) for key, text in items}, key=by_item)]
        long = [(key, c) for key, c in all_ if len(c) >= q]
        self.item, self.codes = [k for k, _ in long], [c for _, c in long]
        size = np.array([len(x) for x in self.codes], np.int64)
        self.far = int(size.max(initial=0))
        self.budget = np.minimum(size * edits // 100, np.maximum((size - q) // q, 0))
        self.least = size - q + 1 - self.budget * q
        all_grams = [grams(x, q) for x in self.codes]
        flat = np.concatenate(all_grams) if all_grams else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(size)), [len(x) for x in all_grams])
        place = np.concatenate([np.arange(len(x)) for x in all_grams]) if all_grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))
        self.which, self.place = which[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.tiny: dict[int, dict[int, list]] = {}  # by length, then by the hash of the whole item
        for key, c in all_:
            if 0 < len(c) < q:
                self.tiny.setdefault(len(c), {}).setdefault(int(grams(c, len(c))[0]), []).append((key, c))

    def find(self, text: str | None) -> list[tuple[Any, int, int, int]]:
        """(item, edits, start, end) of the best match of each item, nulls last; places are in the normalized text."""
        c = codes(normal(text or ""))
        best: dict[Any, tuple] = {}
        for key, *found in chain(self._tiny(c), self._banded(c)):
            if key not in best or found < best[key]:
                best[key] = found
        return sorted(((key, *found) for key, found in best.items()), key=by_item)

    def _tiny(self, c: np.ndarray) -> Iterator[tuple]:
        for n, known in self.tiny.items():
            own = grams(c, n)
            for at in np.flatnonzero(np.isin(own, np.array(list(known), np.uint64))).tolist():
                for key, pattern in known[int(own[at])]:
                    if (c[at : at + n] == pattern).all() and apart(c, at, at + n):
                        yield key, 0, at, at + n

    def _banded(self, c: np.ndarray) -> Iterator[tuple]:
        if not len(self.keys):
            return
        own = grams(c, self.q)
        at = np.flatnonzero(self.table[(own >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if len(at) < self.least.min():
            return
        k = np.minimum(np.searchsorted(self.keys, own[at]), len(self.keys) - 1)
        same = self.keys[k] == own[at]
        at, k = at[same], k[same]
        sizes = self.ends[k + 1] - self.ends[k]
        if sizes.sum() < self.least.min():
            return
        post = np.repeat(self.ends[k] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        which, diagonal = self.which[post], np.repeat(at, sizes) - self.place[post] + self.far
        # Bands of 4k + 1 diagonals, one each 2k + 1: any 2k + 1 diagonals in a row lie in one of them.
        step = 2 * self.budget[which] + 1
        band = diagonal // step
        low = (diagonal - band * step < step - 1) & (band > 0)  # it also lies in the overlap with the band before
        key = np.concatenate([which, which[low]]) * np.int64(1 << 40) + np.concatenate([band, band[low] - 1])
        key, n = np.unique(key, return_counts=True)
        for x in key[n >= self.least[key >> 40]]:
            p, b = int(x >> 40), int(x & ((1 << 40) - 1))
            k_ = int(self.budget[p])
            found = align(self.codes[p], c, b * (2 * k_ + 1) - self.far - k_, 4 * k_ + 1 + 2 * k_, k_)
            if found:
                yield self.item[p], *found


def apart(c: np.ndarray, start: int, end: int) -> bool:
    """Whether no letter or digit stands right before start or at end."""
    return not (start and chr(c[start - 1]).isalnum()) and not (end < len(c) and chr(c[end]).isalnum())


def by_item(x: tuple) -> tuple:
    """Orders matches by item, null last."""
    return x[0] is None, () if x[0] is None else (x[0],), *x[1:]


def align(pattern: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the pattern whose path stays on the diagonals
    low to low + width - 1; None if it takes more than budget edits. Row by row over the band."""
    far = np.int32(1 << 20)
    steps = np.arange(width, dtype=np.int32)
    places = low + steps  # of the text, at the current row
    cost = np.where((places >= 0) & (places <= len(text)), 0, far).astype(np.int32)
    start = places.copy()
    for i, x in enumerate(pattern):
        at = low + i + steps  # the character that a diagonal step consumes
        inside = (at >= 0) & (at < len(text))
        match = np.zeros(width, bool)
        match[inside] = text[at[inside]] == x
        across = cost + np.where(inside, ~match, far)
        down = np.append(cost[1:] + 1, far)  # a pattern character without one of the text
        new = np.minimum(across, down)
        origin = np.where(across <= down, start, np.append(start[1:], 0))
        slid = new - steps  # text characters without one of the pattern
        reach = np.minimum.accumulate(slid)
        source = np.maximum.accumulate(np.where(slid == reach, steps, 0))
        ok = (at + 1 >= 0) & (at + 1 <= len(text))
        cost, start = np.where(ok, reach + steps, far), origin[source]
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), int(low + best + len(pattern))


NAMES = ("contaminated", "n_items", "item_id", "edits", "start", "end")


class Blocks:
    """The benchmark's blocks, as broadcasts. A worker holds one of several at a time, over texts of many batches."""

    def __init__(self, held: list) -> None:
        self.held = held
        self.chars = 1 << (20 if len(held) < 2 else 25)

    def find(self, texts: list[str]) -> list[list[tuple]]:
        """All items in each text; every item is in one block."""
        found: list[list[tuple]] = [[] for _ in texts]
        for i in range(len(self.held)):
            one = self.held[i].value
            for own, text in zip(found, texts):
                own += one.find(text)
            if len(self.held) > 1:
                self.held[i].__dict__.pop("_value", None)  # what the handle has read; the next use reads it again
        return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[Any, str]]]:
    """The benchmark in parts of about `limit` characters, each collected on its own; all texts of an id are in one part."""
    total = benchmark.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // limit))
    for i in range(n):
        part = benchmark.select(id_col, text_col).where(F.pmod(F.xxhash64(id_col), F.lit(n)) == i)
        yield [tuple(x) for x in part.distinct().collect()]


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = BLOCK, keep: bool = False) -> DataFrame:
    """doc_id, contaminated, n_items (that occur in the text), and the one with the fewest edits (then the smallest
    id): item_id, edits, start, end (of its place in the normalized text; nulls if there is none).

    With keep, the rows of df that hold no item come back, all columns and nothing else. Null and empty texts
    and items hold and match nothing; null ids and repeated rows are kept; an empty benchmark matches
    nothing, an empty table gives no rows. An item id that repeats is one item that any of its texts
    tells, its place is that of its best match, whatever the order of rows; items with a null id are one item,
    last in ties. Ids are of any type that has an order. No text is shuffled. A benchmark over `limit`
    characters is compared in blocks: the driver holds one at a time, and so do workers, for each some 30 million characters of texts.
    """
    spark, schema = df.sparkSession, df.schema
    held = Blocks([spark.sparkContext.broadcast(Patterns(x)) for x in blocks(benchmark, item_id, item_text, limit)])

    def texts_of(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        no_table("leaks")
        for batch in batches:
            at = 0
            for texts in groups(batch.column(batch.schema.names.index(name)), held.chars):
                yield batch.slice(at, len(texts)), held.find(texts)
                at += len(texts)

    if keep:

        def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, found in texts_of(batches, text_col):
                yield part.filter(pa.array([not x for x in found], pa.bool_()))

        return df.mapInArrow(kept, schema)
    kind, own = schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType
    types = (pa.int64(), to_arrow_type(own), *[pa.int64()] * 3)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in texts_of(batches, "text"):
            rows = [(len(x), *(min(x, key=lambda y: (y[1], *by_item(y))) if x else (None,) * 4)) for x in found]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(cols, types))], ["doc_id", *NAMES[1:]])

    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_items long, item_id {own.simpleString()}, edits long, start long, end long")
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), *NAMES[1:])
