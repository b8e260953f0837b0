"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-case letters and digits with every other run of characters one space. A benchmark item of m
characters occurs in a text if a passage lies within k = min(rate * m, (m - q) / q) edits. By the q-gram lemma such a
passage shares at least m - q + 1 - k * q character q-grams with the item, on at most k + 1 neighbouring diagonals.
Diagonals are cut into bands of 2 (k + 1), each overlapping the next by half, so one band holds all of them; shared
q-grams are counted per item and band, bands that reach the bound are retained, and a banded alignment decides. Where many bands
in a row are retained, as in a run of one character, one alignment over all of them finds every place.
"""

from __future__ import annotations

import bisect
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import free_names, keep, released

Q = 10
RATE = 0.08
#: Characters of a text that are searched at once.
PIECE = 1 << 19
#: Benchmark characters in one index; a larger benchmark is searched in several passes.
INDEX_CHARS = 4_000_000
FILTER_BITS = 20
#: Shared q-grams that are held at once.
SHARED = 1 << 21
#: So many bands in a row are aligned as one, in stretches of so many diagonals.
ROW_OF_BANDS, STRETCH = 16, 1 << 16
_B = np.array(0x9E3779B97F4A7C15, np.uint64)
FOUND = "array<struct<item_id: bigint, start: bigint, end: bigint, edits: int>>"


@cache
def _folded() -> np.ndarray:
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalnum():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters and where each stood."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _folded()[np.minimum(raw, 0xFFFF)]
    for at in np.flatnonzero(raw > 0xFFFF):
        x[at] = raw[at] if chr(raw[at]).isalnum() else 32
    gap = x == 32
    stay = ~gap
    stay[1:] |= ~gap[:-1]
    if len(stay):
        stay[0] = not gap[0]
    at = np.flatnonzero(stay)
    return x[at], at


def _words(x: np.ndarray) -> list[str]:
    return x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(" ") if len(x) else []


def qgrams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every q-gram (q = 10 = 8 + 2), by doubling."""
    h = x.astype(np.uint64)
    if len(h) < Q:
        return h[:0]
    two = h[:-1] * _B + h[1:]
    four = two[:-2] * _B**2 + two[2:]
    eight = four[:-4] * _B**4 + four[4:]
    return eight[:-2] * _B**2 + two[8:]


def align(x: np.ndarray, y: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """Fewest edits between x and a passage y[start:end] on the diagonals lo..hi (place in y less place in x), if at most k.

    Ties go to the smallest start, then the smallest end.
    """
    row = _last_row(x, y, lo, hi, k)
    if row is None:
        return None
    at = int(np.lexsort((np.arange(len(row)), row))[0])
    edits, start = int(row[at] >> 32), int(row[at] & 0xFFFFFFFF)
    return (edits, start, int(lo + len(x) + at)) if edits <= k else None


def align_all(x: np.ndarray, y: np.ndarray, lo: int, hi: int, k: int) -> list[tuple[int, int, int]]:
    """For every end on the diagonals the fewest edits, if at most k, of those whose passages don't overlap: the best first."""
    row = _last_row(x, y, lo, hi, k)
    if row is None:
        return []
    ends = np.flatnonzero(row < np.int64(k + 1) << 32)
    taken, out = np.zeros(len(y) + 1, bool), []
    for at in ends[np.argsort(row[ends], kind="stable")].tolist():
        edits, start, end = int(row[at] >> 32), int(row[at] & 0xFFFFFFFF), int(lo + len(x) + at)
        if end > start and not (taken[start] or taken[end - 1]):  # those taken are about as long, so one end lies inside
            taken[start:end] = True
            out.append((edits, start, end))
    return out


def _last_row(x: np.ndarray, y: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray | None:
    """By diagonal, edits * 2**32 + start of the best passage that ends there; None if all have more than k edits."""
    with np.errstate(over="ignore"):
        one, far = np.int64(1) << 32, np.int64(1) << 60
        step = np.arange(hi - lo + 1, dtype=np.int64)
        place = step + lo
        row = np.where((place >= 0) & (place <= len(y)), place, far)
        ramp = step * one
        # y with room on both sides, so that a row's characters are one slice; characters that are not there match nothing
        before = max(0, -lo) + 1
        room = np.concatenate([np.zeros(before, y.dtype), y, np.zeros(len(x) + max(0, hi) + 1, y.dtype)])
        out = np.ones(len(room) + 1, bool)
        out[before : before + len(y) + 1] = False  # before[j]: place j, that is after j characters, is one of y's
        limit = np.int64(k + 1) << 32
        for i in range(1, len(x) + 1):
            at = before + lo + i
            best = row + (room[at - 1 : at - 1 + len(step)] != x[i - 1]) * one
            np.minimum(best[:-1], row[1:] + one, out=best[:-1])
            gone = out[at : at + len(step)]
            best[gone] = far
            row = np.minimum.accumulate(best - ramp) + ramp
            row[gone] = far
            if row.min() >= limit:
                return None
    return row


@dataclass(eq=False)
class Index:
    ids: list[list]
    texts: list[np.ndarray]
    k: np.ndarray
    least: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    mask: np.ndarray
    reach: int
    k1: np.ndarray
    short: dict[tuple[str, ...], int]

    @staticmethod
    def of(items: list[tuple[int | None, str]], rate: float = RATE) -> Index:
        """Null and empty items match nothing. Items of fewer than q folded characters have no q-gram and match exactly, as whole words. Items equal when folded are searched once and found under each of their ids (null last)."""
        texts: dict[bytes, tuple[dict, np.ndarray]] = {}
        for i, text in sorted(((i, t) for i, t in items if t is not None), key=lambda one: (one[0] is None, one[0] or 0, one[1])):
            x, _ = fold(text)
            x = x[: len(x) - 1] if len(x) and x[-1] == 32 else x
            if len(x):
                texts.setdefault(x.tobytes(), ({}, x))[0][i] = True
        ids, xs = [list(i) for i, _ in texts.values()], [x for _, x in texts.values()]
        m = np.array([len(x) for x in xs], np.int64)
        k = np.maximum(np.minimum((rate * m).astype(np.int64), (m - Q) // Q), 0)
        short = {tuple(_words(x)): j for j, x in enumerate(xs) if len(x) < Q}
        grams = [qgrams(x) for x in xs]
        code = np.concatenate([*grams, np.zeros(0, np.uint64)]).astype(np.uint64)
        item = np.repeat(np.arange(len(xs), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int32)
        order = np.argsort(code, kind="stable")
        codes, first = np.unique(code[order], return_index=True)
        mask = np.zeros(1 << FILTER_BITS, bool)
        mask[codes >> np.uint64(64 - FILTER_BITS)] = True
        return Index(ids, xs, k, m - Q + 1 - k * Q, codes, np.r_[first, len(code)], item[order], place[order], mask, 4 * int(m.max(initial=0) + k.max(initial=0)) + 64, k + 1, short)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of every passage found, by place in the text; of overlapping ones of an item, the best."""
        if not text or not self.ids:
            return []
        found: list[tuple[int, int, int, int]] = []
        x, at = fold(text)
        reach = self.reach
        for i in range(0, max(1, len(x) - reach), PIECE):
            found += self._piece(x[i : i + PIECE + reach], i)
        if self.short:
            found += self._short(x)
        best: list[tuple[int, int, int, int]] = []
        for item, same in itertools.groupby(sorted(set(found), key=lambda f: (f[0], f[3], f[1])), key=lambda f: f[0]):
            taken: list[tuple[int, int]] = []  # by start, none overlapping
            for _, start, end, edits in same:
                i = bisect.bisect(taken, (start, end))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                    taken.insert(i, (start, end))
                    best.append((item, start, end, edits))
        return sorted(((i, int(at[a]), int(at[b - 1]) + 1, e) for j, a, b, e in best for i in self.ids[j]), key=lambda f: (f[0] is None, f[0] or 0, *f[1:]))

    def _short(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        words = _words(x)
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        out = []
        for n in {len(w) for w in self.short}:
            for i in range(len(words) - n + 1):
                item = self.short.get(tuple(words[i : i + n]))
                if item is not None:
                    out.append((item, ends[i] - len(words[i]) - 1, ends[i + n - 1] - 1, 0))
        return out

    def _piece(self, x: np.ndarray, offset: int) -> list[tuple[int, int, int, int]]:
        h = qgrams(x)
        maybe = np.flatnonzero(self.mask[h >> np.uint64(64 - FILTER_BITS)])
        if not len(maybe):
            return []
        near = np.searchsorted(self.codes, h[maybe])
        near[near == len(self.codes)] = 0
        same = self.codes[near] == h[maybe]
        maybe, near = maybe[same], near[same]
        if not len(maybe):
            return []
        # half bands first: a band's count is that of two neighbouring halves
        n, lift = self.first[near + 1] - self.first[near], np.int64(1) << 31
        upto, i, halves = np.cumsum(n), 0, []
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SHARED, "right")))
            m = n[i:j]
            where = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[near[i:j]], m)
            item = self.item[where].astype(np.int64)
            halves.append(np.unique((item << 32) + (np.repeat(maybe[i:j], m) - self.place[where]) // self.k1[item] + lift, return_counts=True))
            i = j
        band, inverse = np.unique(np.concatenate([h for h, _ in halves]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([c for _, c in halves])).astype(np.int64)
        after = np.r_[np.where(np.diff(band) == 1, count[1:], 0), 0][: len(band)]
        own = np.flatnonzero(count + after >= self.least[band >> 32])
        lone = np.flatnonzero((count >= self.least[band >> 32]) & ~np.r_[False, np.diff(band) == 1][: len(band)])
        keys = np.unique(np.r_[band[own], band[lone] - 1])
        out, done = [], set()
        for run in np.split(keys, np.flatnonzero(np.diff(keys) != 1) + 1) if len(keys) else []:
            one, b = int(run[0] >> 32), (run & 0xFFFFFFFF) - lift
            y, k = self.texts[one], int(self.k[one])
            if len(run) <= ROW_OF_BANDS:
                spans = [(int(c) * (k + 1), int(c) * (k + 1) + 2 * (k + 1) - 1) for c in b]
            else:
                lo, hi = int(b[0]) * (k + 1), int(b[-1]) * (k + 1) + 2 * (k + 1) - 1
                spans = [(c, min(hi, c + STRETCH + len(y) + k)) for c in range(lo, hi + 1, STRETCH)]
            for lo, hi in spans:
                from_, to = max(0, lo), min(len(x), hi + len(y))
                if np.isin(self._codes(one), h[max(0, from_ - Q) : max(0, to)]).sum() < self.least[one]:
                    continue  # a q-gram of the item counts once, however often the text has it
                if len(run) > ROW_OF_BANDS:
                    hits = align_all(y, x[from_:to], lo - from_, hi - from_, k)
                elif (hit := self._exact(x, y, lo, hi)) is not None:
                    hits = [(hit[0], hit[1] - from_, hit[2] - from_)]
                else:
                    hits = [hit] if (hit := align(y, x[from_:to], lo - from_, hi - from_, k)) else []
                for edits, start, end in hits:
                    if end > start and (one, edits, start + from_, end + from_) not in done:
                        done.add((one, edits, start + from_, end + from_))
                        out.append((one, start + from_ + offset, end + from_ + offset, edits))
        return out

    @cache  # noqa: B019  an index lives as long as its worker
    def _codes(self, item: int) -> np.ndarray:
        return qgrams(self.texts[item])

    def _exact(self, x: np.ndarray, y: np.ndarray, lo: int, hi: int) -> tuple[int, int, int] | None:
        start, end = max(lo, 0), min(hi + 1, len(x) - len(y) + 1)
        for at in start + np.flatnonzero(x[start : max(start, end)] == y[0]):
            if np.array_equal(x[at : at + len(y)], y):
                return 0, int(at), int(at) + len(y)
        return None


def _searcher(index):
    @F.pandas_udf("string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        named, own = ("item_id", "start", "end", "edits"), index.value
        for texts in batches:
            yield pd.Series([json.dumps([dict(zip(named, f, strict=True)) for f in got]) if (got := own.find(t)) else None for t in texts], dtype=object)
        released()

    return search


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Each text of the benchmark once, with its ids."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).filter("text IS NOT NULL")
    return rows.groupBy("text").agg(F.collect_set("id").alias("ids"), F.max(F.col("id").isNull()).alias("unnamed"))


def _index(items: DataFrame, rate: float):
    """A broadcast of an index of items, whose texts have INDEX_CHARS characters in all."""
    rows = items.collect()
    pairs = [(i, r["text"]) for r in rows for i in [*r["ids"], *([None] if r["unnamed"] else [])]]
    return items.sparkSession.sparkContext.broadcast(Index.of(pairs, rate))


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "found", rate: float = RATE) -> DataFrame:
    """docs with a column ``into``: an array of (item_id, start, end, edits), places counted in characters of the text; null if nothing is found.

    A benchmark of more than INDEX_CHARS characters is searched in passes, each a job of its own that writes what it finds and gives its
    index back, so what a task holds is bounded. Null and empty texts match nothing; repeated rows get equal results; whole texts
    are searched; empty tables are fine on either side. A column that is named like ``into`` stays, under its name with
    underscores added until it is free.
    """
    ship(docs.sparkSession)
    names, text = free_names(docs.columns, [into]), F.col(f"`{text_col}`")
    items = keep(_items(benchmark, item_id, item_text), "items")
    passes = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // INDEX_CHARS) + 1
    columns = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    if passes == 1:
        return docs.select(*columns, F.from_json(_searcher(_index(items, rate))(text), FOUND).alias(into))
    hits = None
    for p in range(passes):
        index = _index(items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == p), rate)
        found = docs.select(text.alias("text")).withColumn("found", _searcher(index)("text")).filter("found IS NOT NULL")
        found = keep(found.select(F.sha2("text", 256).alias("digest"), "found").dropDuplicates(["digest"]), "hits")
        index.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    marked = F.transform(F.flatten(F.collect_list(F.from_json("found", FOUND))), lambda f: F.struct(f["item_id"].isNull().alias("unnamed"), f.alias("f")))
    whole = F.transform(F.array_sort(marked), lambda m: m["f"])
    hits = keep(hits.groupBy("digest").agg(whole.alias("found")), "hits")
    rows = docs.select(F.sha2(text, 256).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(hits, rows["key"] == hits["digest"], "left")
    return out.select(*[F.col("row").getField(c).alias(n) for c, n in names.items()], F.col("found").alias(into))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows in which a passage of the benchmark is found."""
    names = free_names(docs.columns, ["found"])
    out = find_passages(docs, benchmark, into="found", **options).filter("found IS NULL")
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
