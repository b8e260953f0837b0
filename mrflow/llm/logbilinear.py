"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words, A-Z lower-cased, and one end per text. Words that come often enough, the more the larger the corpus, have
vectors of their own, as targets and as contexts; in order of their counts they are cut into classes, small ones of frequent words
first. Every other word belongs to one of ``SUFFIX_CLASSES`` by its last two characters, as a target and as a context. With
h = A[previous] + B[before] of the two words before, the model gives

    ln p(class) = h.R[class] + bias[class] - ln Z            over all classes
    ln p(word | class) = h.W[word] + bias[word] - ln Z[class]    over a class's words with vectors

and a word of a suffix class gets the share (c + 1) / (N_class + V_class + 1) of it, c being its count in the training
texts; the one left over is for words never seen. So the probabilities of all words sum to 1. Both sums are taken for every token,
by batched matrix products.

Counting covers all training texts. Training covers them too, each token once, in ROUNDS rounds: the texts of a round, a
part by hash, are dealt by hash to shards, whose number the count of tokens gives; a shard goes on from the common parameters by
minibatch AdaGrad on the noise-contrastive estimate, for classes with noise from the class frequencies, for words with noise from their
class. Then the shards' parameters are averaged, weighted by the squared gradients that each parameter met. So the model depends on
the texts and their ids alone, not on files, partitions or machines.

Counts of rare words aren't held in memory: the ``head`` most frequent words are broadcast (their number is the bound),
the counts of all others are joined. A rare word comes too seldom to be a hot key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import keep, released

END = ""
HEAD = 1 << 16
#: A word with a vector comes at least LEAST times, and 1 / SHARE of the root of the number of tokens.
LEAST, SHARE = 5, 25
SUFFIX_CLASSES = 64
DIM = 16
#: Noise drawn for a minibatch's classes, and for its words of each class.
NOISE, WORD_NOISE = 64, 4
BATCH = 4096
RATE = 0.1
ROUNDS = 3
#: Training tokens of a shard, and the most shards.
SHARD_TOKENS, SHARDS = 1 << 24, 4096
#: Parameters in a row when shards are averaged.
CHUNK = 1 << 16
#: Characters of text that are cut into tokens at once, whole texts each.
SLICE = 4 << 20
#: Values of a matrix of logits, few enough for a processor's cache; up to SAFE a logit needs no scaling before its power is taken.
LOGITS, SAFE = 1 << 17, 60.0


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE bytes of text."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
    cut = np.flatnonzero(np.diff(size // SLICE, prepend=0)).tolist()
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if real.all():
        return flat, n
    text = np.repeat(np.arange(len(n)), n)[real]
    return flat.filter(pa.array(real)), np.bincount(text, minlength=len(n))


def suffix_class(token: Column, classes: int = SUFFIX_CLASSES) -> Column:
    return F.pmod(F.crc32(F.right(token, F.lit(2))), F.lit(classes)).cast("int")


def suffix_classes(words: pa.Array, classes: int = SUFFIX_CLASSES) -> np.ndarray:
    ends = pc.utf8_slice_codeunits(words, start=-2, stop=None).dictionary_encode()
    kinds = np.array([zlib.crc32(e.encode()) % classes for e in ends.dictionary.to_pylist()] or [0], np.int32)
    return kinds[ends.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Vocabulary:
    """The head, by count: words, counts. The first ``own`` have vectors; class k has those from first[k] to first[k + 1].

    As contexts and targets words are known by kinds: those with vectors, then the suffix classes; then, as a context, the start.
    """

    words: pa.Array
    counts: np.ndarray
    own: int
    first: np.ndarray
    end: int
    tokens: int
    types: int
    suffix_tokens: np.ndarray
    suffix_types: np.ndarray

    @property
    def classes(self) -> int:
        """Classes of words with vectors; the suffix classes come after them."""
        return len(self.first) - 1

    @property
    def start(self) -> int:
        return self.own + len(self.suffix_tokens)

    @property
    def class_of(self) -> np.ndarray:
        """The class of each kind."""
        return np.r_[np.repeat(np.arange(self.classes), np.diff(self.first)), self.classes + np.arange(len(self.suffix_tokens))].astype(np.int32)

    @property
    def class_tokens(self) -> np.ndarray:
        return np.r_[np.add.reduceat(self.counts[: self.own], self.first[:-1]) if self.own else np.zeros(0, np.int64), self.suffix_tokens]

    def encode(self, flat: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, place in the head or -1) of every token, ends included, and the text it belongs to."""
        coded = flat.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        kind = np.where((place >= 0) & (place < self.own), place, self.own + suffix_classes(coded.dictionary)) if len(place) else place
        of = coded.indices.to_numpy(zero_copy_only=False)
        last = np.cumsum(n)
        end = self.end if 0 <= self.end < self.own else self.own + zlib.crc32(END.encode()) % SUFFIX_CLASSES
        kinds = np.insert(kind[of].astype(np.int32), last, end)
        places = np.insert(place[of], last, self.end)
        return kinds, places, np.repeat(np.arange(len(n)), n + 1)


def cut(counts: np.ndarray) -> np.ndarray:
    """Where classes begin, and the end: words by descending count, in classes of equal sums of the roots of their counts, which
    keeps the expected number of words to sum over low."""
    if not len(counts):
        return np.zeros(1, np.int64)
    classes = max(1, round(0.6 * math.sqrt(len(counts))))
    upto = np.cumsum(np.sqrt(counts + 1.0))
    of = np.minimum((upto / upto[-1] * classes).astype(np.int64), classes - 1)
    return np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(counts)]


def contexts(kinds: np.ndarray, text: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the previous token and the one before; before a text's first token there are starts."""
    one = np.r_[start, kinds[:-1]].astype(np.int32)
    two = np.r_[start, one[:-1]].astype(np.int32)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, int)
    one[first] = start
    two[first] = start
    two[(first + 1)[(first + 1) < len(two)]] = start
    return one, two


class Parameters:
    """A, B (contexts), R (classes) and W (words), these with their biases as a last column, in one flat array."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None, dim: int = DIM):
        contexts, classes, words = vocabulary.start + 1, vocabulary.classes + len(vocabulary.suffix_tokens), vocabulary.own
        shapes = [(contexts, dim), (contexts, dim), (classes, dim + 1), (words, dim + 1)]
        ends = np.cumsum([0, *(math.prod(x) for x in shapes)])
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat
        self.a, self.b, self.classes, self.words = (self.flat[i:j].reshape(x) for i, j, x in zip(ends, ends[1:], shapes, strict=False))
        self.r, self.class_bias, self.w, self.word_bias = self.classes[:, :dim], self.classes[:, dim], self.words[:, :dim], self.words[:, dim]

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The contexts' vectors, and 1 for the biases."""
        h = np.empty((len(one), self.a.shape[1] + 1), np.float32)
        np.add(self.a[one], self.b[two], out=h[:, :-1])
        h[:, -1] = 1
        return h


def initial(vocabulary: Vocabulary, seed: int = 0) -> np.ndarray:
    p = Parameters(vocabulary)
    p.flat[:] = np.random.default_rng(seed).normal(0, 0.1, len(p.flat))
    p.class_bias[:] = np.log((vocabulary.class_tokens + 1) / (vocabulary.class_tokens + 1).sum())
    p.word_bias[:] = in_class(vocabulary)
    return p.flat


def in_class(vocabulary: Vocabulary) -> np.ndarray:
    """ln of each word's share of its class by counts."""
    plus = vocabulary.counts[: vocabulary.own] + 1.0
    if not len(plus):
        return plus
    return np.log(plus / np.repeat(np.add.reduceat(plus, vocabulary.first[:-1]), np.diff(vocabulary.first)))


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct targets, and the sums of their rows."""
    order = np.argsort(at)
    at = at[order]
    new = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[new], np.add.reduceat(rows[order], new, axis=0)


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Learner:
    """One shard's parameters and what AdaGrad has summed."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray, squares: np.ndarray, seed: int):
        self.v, self.p, self.s = vocabulary, Parameters(vocabulary, flat), Parameters(vocabulary, squares)
        self.rng = np.random.default_rng(seed)
        tokens = vocabulary.class_tokens + 1.0
        self.class_of, self.noise_upto = vocabulary.class_of, np.cumsum(tokens)
        self.log_noise = np.log(NOISE * tokens / tokens.sum()).astype(np.float32)
        self.word_upto = np.r_[0, np.cumsum(vocabulary.counts[: vocabulary.own] + 1.0)]
        self.log_word_noise = (in_class(vocabulary) + np.log(WORD_NOISE)).astype(np.float32)
        self.several = np.r_[np.diff(vocabulary.first) > 1, np.zeros(len(vocabulary.suffix_tokens), bool)]

    def step(self, into: str, at: np.ndarray, gradient: np.ndarray) -> None:
        rows, g = _summed(at, gradient)
        p, s = getattr(self.p, into), getattr(self.s, into)
        s[rows] += g * g
        p[rows] += RATE * g / (np.sqrt(s[rows]) + 1e-6)

    def learn(self, kinds: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One pass of minibatches over the positions."""
        p, v = self.p, self.v
        order = self.rng.permutation(len(kinds))
        for i in range(0, len(order), BATCH):
            x = order[i : i + BATCH]
            t, c1, c2 = kinds[x], one[x], two[x]
            k = self.class_of[t]
            z = np.minimum(np.searchsorted(self.noise_upto, self.rng.random(NOISE) * self.noise_upto[-1], "right"), len(self.noise_upto) - 1)
            context = p.context(c1, c2)
            # the data's classes are to be told from the noise's
            target, other = p.classes[k], p.classes[z]
            d = 1 - _chance(np.einsum("nd,nd->n", context, target) - self.log_noise[k])
            q = -_chance(context @ other.T - self.log_noise[z])
            to_context = d[:, None] * target + q @ other
            steps = [("classes", np.concatenate([k, z]), np.concatenate([d[:, None] * context, q.T @ context]))]
            many = np.flatnonzero(self.several[k])
            if len(many):  # and its words from others of their class
                many = many[np.argsort(k[many], kind="stable")]
                w, own, h = t[many], k[many], context[many]
                new = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(own))))
                lo, hi = v.first[own[new]], v.first[own[new] + 1]
                draw = self.word_upto[lo][:, None] + self.rng.random((len(new), WORD_NOISE)) * (self.word_upto[hi] - self.word_upto[lo])[:, None]
                z = np.clip(np.searchsorted(self.word_upto, draw, "right") - 1, lo[:, None], hi[:, None] - 1)
                target, other = p.words[w], p.words[z][run]
                d = 1 - _chance(np.einsum("nd,nd->n", h, target) - self.log_word_noise[w])
                q = -_chance(np.einsum("nd,nkd->nk", h, other) - self.log_word_noise[z][run])
                to_context[many] += d[:, None] * target + np.einsum("nk,nkd->nd", q, other)
                by_noise = np.add.reduceat(q[:, :, None] * h[:, None, :], new, axis=0).reshape(-1, h.shape[1])
                steps.append(("words", np.concatenate([w, z.ravel()]), np.concatenate([d[:, None] * h, by_noise])))
            to_context = to_context[:, :-1]
            for into, at, gradient in [*steps, ("a", c1, to_context), ("b", c2, to_context)]:
                self.step(into, at, gradient)


def _log_share(h: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """ln of the softmax of h.rows, at ``wanted``."""
    out, step, down = np.empty(len(h)), max(1, LOGITS // max(1, len(rows))), np.ascontiguousarray(rows.T)
    longest = float(np.sqrt((rows[:, :-1] ** 2).sum(1).max(initial=0)))
    highest = float(np.abs(rows[:, -1]).max(initial=0))
    for i in range(0, len(h), step):
        some = h[i : i + step]
        z = some @ down
        own = z[np.arange(len(z)), wanted[i : i + step]]
        top = 0.0
        if longest * float(np.sqrt((some[:, :-1] ** 2).sum(1).max())) + highest > SAFE:
            top = z.max(1, keepdims=True)
            z -= top
            top = top[:, 0]
        out[i : i + step] = own - top - np.log(np.exp(z, out=z).sum(1))
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    flat: np.ndarray

    def log_p(self, kinds: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each kind in its context; of a suffix class as a whole."""
        p, v = Parameters(self.vocabulary, self.flat), self.vocabulary
        h, k = p.context(one, two), v.class_of[kinds]
        out = _log_share(h, p.classes, k)
        order = np.argsort(k, kind="stable")
        edges = np.searchsorted(k[order], np.arange(v.classes + 1))
        for c in np.flatnonzero((np.diff(edges) > 0) & (np.diff(v.first) > 1)).tolist():
            x, lo, hi = order[edges[c] : edges[c + 1]], v.first[c], v.first[c + 1]
            out[x] += _log_share(h[x], p.words[lo:hi], kinds[x] - lo)
        return out


def count(texts: DataFrame) -> DataFrame:
    """texts (text) to counts (token, c), the end being the empty token."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, n = tokens(batch.column(0))
                found = flat.value_counts()
                token = pa.concat_arrays([found.field(0).cast(pa.string()), pa.array([END])])
                yield pa.RecordBatch.from_arrays([token, pa.concat_arrays([found.field(1), pa.array([len(n)], pa.int64())])], ["token", "c"])

    return texts.select("text").mapInArrow(per_batch, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, head: int) -> list:
    """The most frequent tokens by count, at most ``head`` and the end: all whose count reaches a bound that a histogram of counts gives, so that no task sends more."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    least, n = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["step"]):
        n += r["n"]
        if n > head:
            break
        least = r["c"]
    wanted = F.col("token") == END
    top = counts.filter(wanted if least is None else wanted | (F.col("c") >= least)).collect()
    return sorted(top, key=lambda r: (-r["c"], r["token"]))


def fit(texts: DataFrame, head: int = HEAD, least: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> tuple[Model, DataFrame]:
    """Learn from texts (null is empty). Returns the model and the counts of all tokens. least: how often a word with a vector comes."""
    spark = texts.sparkSession
    ship(spark)
    texts = texts.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").alias("text"))
    counts = keep(count(texts), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top, tokens_ = _most_frequent(counts, head), total["n"] or 0
    least = max(LEAST, math.ceil(math.sqrt(tokens_) / SHARE)) if least is None else least
    own = [r["token"] for r in top if r["c"] >= least]
    rest = counts.join(F.broadcast(spark.createDataFrame([(t,) for t in own], "token string")), "token", "left_anti") if own else counts
    n, v = np.zeros(SUFFIX_CLASSES, np.int64), np.zeros(SUFFIX_CLASSES, np.int64)
    for r in rest.groupBy(suffix_class(F.col("token")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    many = np.array([r["c"] for r in top], np.int64)
    words = pa.array([r["token"] for r in top], pa.string())
    end = next((i for i, r in enumerate(top) if r["token"] == END), -1)
    vocabulary = Vocabulary(words, many, len(own), cut(many[: len(own)]), end, tokens_, total["v"], n, v)
    flat = initial(vocabulary)
    squares = np.zeros_like(flat)
    shards = min(SHARDS, 1 + tokens_ // SHARD_TOKENS)
    part, shard = F.pmod(F.shiftrightunsigned("hash", 48), F.lit(ROUNDS)), F.pmod("hash", F.lit(shards))
    for number in range(ROUNDS if tokens_ else 0):
        dealt = texts.filter(part == number).select(shard.cast("int").alias("shard"), "hash", "text")
        # in the order of the hashes, so the minibatches are the same whatever order the rows came in
        dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", "hash")  # more than shards, so that few meet in a task
        shared = spark.sparkContext.broadcast((vocabulary, flat, squares))
        learned = _averaged(dealt, shared, number)
        for r in learned.collect():
            i = r["chunk"] * CHUNK
            weight, moved = (np.frombuffer(r[c], np.float64) for c in ("weight", "moved"))
            flat[i : i + CHUNK] += (moved / np.maximum(weight, 1e-12)).astype(np.float32)
            squares[i : i + CHUNK] += (weight / max(1, r["shards"])).astype(np.float32)
        shared.unpersist()
    return Model(vocabulary, flat), counts


def _averaged(dealt: DataFrame, shared, number: int) -> DataFrame:
    """Train every shard (shard, hash, text) and sum up: chunk, shards, and of its parameters the weights and weighted changes."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, squares = shared.value
        learner, at = None, None

        def done() -> Iterator[pa.RecordBatch]:
            # what changed, in half precision; of the squared gradients the root
            moved, met = (learner.p.flat - flat).astype(np.float16), np.sqrt(np.maximum(learner.s.flat - squares, 0)).astype(np.float16)
            for i in range(0, len(flat), CHUNK):
                yield pa.RecordBatch.from_pydict({"chunk": [i // CHUNK], "moved": [moved[i : i + CHUNK].tobytes()], "met": [met[i : i + CHUNK].tobytes()]}, pa.schema([("chunk", pa.int32()), ("moved", pa.binary()), ("met", pa.binary())]))

        for whole in batches:
            for batch in slices(whole, "text"):
                own = batch.column("shard").to_numpy()
                for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)].tolist()), strict=True):
                    if own[lo] != at:
                        if learner is not None:
                            yield from done()
                        at, learner = own[lo], Learner(vocabulary, flat.copy(), squares.copy(), number * SHARDS + int(own[lo]))
                    kinds, _, text = vocabulary.encode(*tokens(batch.column("text").slice(lo, hi - lo)))
                    learner.learn(kinds, *contexts(kinds, text, vocabulary.start))
        if learner is not None:
            yield from done()
        released()

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for pdf in batches:
            for chunk, moved, met in zip(pdf["chunk"], pdf["moved"], pdf["met"], strict=True):
                weight = np.frombuffer(met, np.float16).astype(float) ** 2
                held = sums.setdefault(chunk, [0, 0.0, 0.0])
                sums[chunk] = [held[0] + 1, held[1] + weight, held[2] + weight * np.frombuffer(moved, np.float16)]
        for chunk, (n, weight, moved) in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "shards": [n], "weight": [weight.tobytes()], "moved": [moved.tobytes()]})

    each = dealt.select("shard", "text").mapInArrow(train, "chunk int, moved binary, met binary")
    return each.repartition("chunk").mapInPandas(add_up, "chunk int, shards long, weight binary, moved binary")


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep_cols and n_tokens, n_known, train_tokens, base_score, score of every row; both scores are log10 probabilities of the text.

    Null and empty texts have one token, the end. Repeated rows get equal scores. Columns that aren't named stay out, whatever
    their names; an empty table gives none. If nothing was learned, the end has
    count 0 and the scores are those of the smoothed, empty counts. Whole texts are scored, however long.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = list(keep_cols)
    part = docs.select(F.spark_partition_id().cast("long").alias("row"), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col(f"`{text_col}`").alias("text"))
    kept = [f"c{i}" for i in range(len(names))]
    schema = "row long, " + "".join(f"c{i} {docs.schema[n].dataType.simpleString()}, " for i, n in enumerate(names)) + "n_tokens long, known long, base double, score double, rare array<string>"

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, 0
        v = m.vocabulary
        plus = np.log10(v.counts + 1.0)
        share = np.log10(v.suffix_tokens + v.suffix_types + 1.0)
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, n = tokens(batch.column(batch.num_columns - 1))
                w, place, text = v.encode(flat, n)
                one, two = contexts(w, text, v.start)
                ln = m.log_p(w, one, two) / np.log(10)
                known = place >= 0
                counted = np.where(known, plus[place], 0.0) if len(plus) else np.zeros(len(place))
                suffixed = w >= v.own
                ln[suffixed] += counted[suffixed] - share[w[suffixed] - v.own]
                total = lambda x: np.bincount(text, x, len(n))  # noqa: B023, E731
                rare = ~known
                rare[np.cumsum(n + 1) - 1] = False  # the end is no word to look up
                words = np.flatnonzero(np.delete(rare, np.cumsum(n + 1) - 1))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(total(rare))].astype(np.int32)), flat.take(pa.array(words)))
                ids = (batch.column(0)[0].as_py() << 36) + row + np.arange(len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns[1:-1], pa.array(n + 1), pa.array(total(known).astype(np.int64)), pa.array(total(counted)), pa.array(total(ln)), lists], ["row", *kept, "n_tokens", "known", "base", "score", "rare"])
        released()

    scored = keep(part.mapInArrow(per_batch, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("token")).join(counts, "token")
    late = keep(rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("late"), F.count("*").alias("more")).withColumnRenamed("row", "of"), "rare")
    v = model.vocabulary
    out = scored.drop("rare").join(late, F.col("row") == F.col("of"), "left")
    more, each = F.coalesce("late", F.lit(0.0)), float(np.log10(v.tokens + v.types + 1.0))
    return out.select(
        *[F.col(k).alias(n) for k, n in zip(kept, names, strict=True)],
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
