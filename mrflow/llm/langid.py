"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters lower-cased, every other run of characters one space; n-grams of 1 to 3 characters, hashed. A value is
(1 + ln count) * idf, the vector scaled to length 1. Document frequencies are counted over all training rows. The weights
are trained with follow-the-regularised-leader (FTRL-proximal) under L1 and L2 penalties, on a sample of the labelled
rows that ``sample_rows`` bounds, chosen by a hash and even over languages: on whole texts and on a cut-out of each. A fifth of
the sample sets the temperature, with cut-outs of 1 to 21 words, since whole texts of known languages are told apart without
error, which would make any score 1; a prior holds it near 1 where there is little to go by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import free_names, released

BITS = 14
DIM = 1 << BITS
ORDERS = 3
UNKNOWN = "und"
#: Characters of a text that are hashed at once.
PIECE = 1 << 19
#: Words of the cut-outs, and how many characters they are taken from.
CUTS, CUT_CHARS = (1, 2, 3, 5, 8, 13, 21), 2000

_END = np.array([32], np.uint32)


@cache
def _letters() -> np.ndarray:
    """For each code point below 2**16 the lower-case letter, or a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _letters_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[np.minimum(raw, 0xFFFF)]
    for at in np.flatnonzero(raw > 0xFFFF):
        x[at] = raw[at] if chr(raw[at]).isalpha() else 32
    return x


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and how often each comes; nothing for null and for texts without a letter."""
    total, rest, lettered = 0, _END, False
    for i in range(0, len(text or ""), PIECE):
        x = _letters_of(text[i : i + PIECE])
        lettered |= bool((x != 32).any())
        x = np.concatenate([rest, x, _END] if i + PIECE >= len(text) else [rest, x])
        solid = x != 32
        solid[1:] |= solid[:-1]
        solid[0] = True
        x = x[solid]
        h, before, codes = x, len(rest) - 1, []
        for n in range(1, ORDERS + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            start = max(0, before - n + 2) if i else 0  # n-grams that end in what was there before are counted already
            codes.append(((h[start:] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        total = total + np.bincount(np.concatenate(codes), minlength=DIM)
        rest = x[-(ORDERS - 1) :]
    if not lettered:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.flatnonzero(total > 0)
    return at.astype(np.int32), total[at].astype(np.float32)


def cut_outs(text: str) -> list[str]:
    """Stretches of so many words as CUTS has, from a place that a hash of the text gives."""
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    at = h % max(1, len(text) - CUT_CHARS)
    words = text[at : at + CUT_CHARS].split()
    if at and len(words) > 1:
        words = words[1:]  # the first may be a part of a word
    return [" ".join(words[(h >> 3) % max(1, len(words) - n + 1) :][:n]) for n in CUTS]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    held: dict = field(default_factory=dict)

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return (x / max(1e-12, float(np.sqrt((x * x).sum())))).astype(np.float32)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        z = (self.logits(at, n) / self.temperature).astype(np.float64)
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def calibration_error(p: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """The mean difference between score and accuracy over bins of the score."""
    at = np.minimum((p * bins).astype(int), bins - 1)
    return float(sum(abs(p[at == b].sum() - right[at == b].sum()) for b in range(bins)) / max(1, len(p)))


def train(rows: list[tuple[list[tuple[np.ndarray, np.ndarray]], str]], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, prior: float = 1.0) -> Model:
    """FTRL-proximal over the rows (features and counts of a text and its cut-outs; language) in the order given; every fifth row sets the temperature."""
    langs = sorted({r[1] for r in rows})
    model = Model(langs, idf, np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    if not langs:
        return model
    z, s = np.zeros((DIM + 1, len(langs))), np.zeros((DIM + 1, len(langs)))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(s[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0
        return w

    held, learn = rows[::5] if len(rows) >= 10 * len(langs) else [], rows
    if held:
        learn = [r for i, r in enumerate(rows) if i % 5]
    for epoch in range(epochs):
        for row, (texts, lang) in enumerate(learn):
            # the text, and one of its cut-outs, another one each time
            for at, n in texts[:1] + texts[1 + (row + epoch) % len(CUTS) :][:1]:
                if not len(at):
                    continue
                x = np.r_[model.vector(at, n), 1.0]
                i = np.r_[at, DIM]
                w = weights(i)
                q = x @ w
                p = np.exp(q - q.max())
                p /= p.sum()
                p[langs.index(lang)] -= 1
                g = x[:, None] * p[None, :]
                grown = s[i] + g * g
                z[i] += g - (np.sqrt(grown) - np.sqrt(s[i])) / alpha * w
                s[i] = grown
    full = weights(np.arange(DIM + 1))
    model.weights, model.bias = full[:-1].astype(np.float32), full[-1].astype(np.float32)
    cuts = [(at, n, lang) for texts, lang in held for at, n in texts[1:] if len(at)]
    if cuts:
        logits = np.array([model.logits(at, n) for at, n, _ in cuts], np.float64)
        y = np.array([langs.index(lang) for *_, lang in cuts])

        def shares(t: float) -> np.ndarray:
            q = np.exp((logits - logits.max(1, keepdims=True)) / t)
            return q / q.sum(1, keepdims=True)

        def loss(t: float) -> float:
            return float(-np.log(np.maximum(shares(t)[np.arange(len(y)), y], 1e-300)).mean())

        grid = np.geomspace(0.02, 5, 120)
        model.temperature = float(grid[int(np.argmin([loss(t) + prior * np.log(t) ** 2 / len(y) for t in grid]))])
        p = shares(model.temperature)
        whole = [(model.logits(*texts[0]).argmax(), langs.index(lang)) for texts, lang in held if len(texts[0][0])]
        model.held = {"rows": len(y), "accuracy": float(np.mean([a == b for a, b in whole])), "cut_accuracy": float((p.argmax(1) == y).mean()), "loss": loss(model.temperature), "calibration_error": calibration_error(p.max(1), p.argmax(1) == y)}
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 2000, most_langs: int = 1000) -> Model:
    """Learn from labelled rows (null languages are left out). Only text and language are inputs; the id orders the sample.

    most_langs: so many languages are learned, the most frequent ones.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not per_lang:
        return Model([], np.ones(DIM, np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))
    share = max(5, sample_rows // len(per_lang))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIM, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                at, _ = counts(t)
                seen[at] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": np.r_[at, -1], "n": np.r_[seen[at], n]})
        released()

    total = rows.select("text").mapInPandas(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    idf, n = np.zeros(DIM), next((r["n"] for r in total if r["at"] == -1), 0)
    for r in total:
        if r["at"] >= 0:
            idf[r["at"]] = r["n"]
    idf = (np.log((1 + n) / (1 + idf)) + 1).astype(np.float32)

    @F.pandas_udf("array<struct<at: binary, n: binary>>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"at": a.tobytes(), "n": n.tobytes()} for a, n in map(counts, [t, *cut_outs(t)])] for t in texts], dtype=object)

    draw = (F.xxhash64(F.lit("langid"), "id", "text").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("draw")
    below = F.broadcast(spark.createDataFrame([(lang, share / c) for lang, c in per_lang.items()], "lang string, below double"))  # most_langs rows
    few = rows.select("id", "lang", "text", draw).join(below, "lang").filter("draw < below")
    few = few.orderBy("draw", "id").limit(2 * share * len(per_lang))  # a draw that many copies share can't exceed the bound
    got = few.select("draw", "id", "lang", features("text").alias("f")).collect()
    got.sort(key=lambda r: (r["draw"], r["id"] or "", r["lang"]))
    sample = [([(np.frombuffer(f["at"], np.int32), np.frombuffer(f["n"], np.float32)) for f in r["f"]], r["lang"]) for r in got]
    return train([r for r in sample if len(r[0][0][0])], idf)


def predictor(df: DataFrame, model: Model):
    """A column function: text to struct(lang_pred, score)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size: hashed features x languages

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])
        released()

    return predict


def identify(df: DataFrame, model: Model, text_col: str = "text", into: str = "language") -> DataFrame:
    """df with a struct column ``into`` (lang_pred, score).

    Null, empty and letterless texts get ``und`` with score 0, and so does every text if nothing was learned. Each row
    is judged alone, so repeated rows get equal results. All other columns stay as they are; one that is named like ``into``
    stays under its name with underscores added until it is free. Whole texts are read, however long; an empty table stays one.
    """
    names = free_names(df.columns, [into])
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], predictor(df, model)(F.col(f"`{text_col}`")).alias(into))


def confident(language: Column, least: float) -> Column:
    return (language["lang_pred"] != UNKNOWN) & (language["score"] >= least)
