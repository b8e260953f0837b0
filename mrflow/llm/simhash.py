"""SimHash near-duplicates, found by anchor-point covering.

A fingerprint has 64 bits, bit i being 1 if more than half of a text's shingle hashes have it. Two fingerprints link if
at most ``threshold`` bits differ.

The 64 bits are cut into ``threshold + 2`` parts, and groups of three parts are chosen such that however ``threshold`` differing
bits fall, one group has at most one of them. In every group the anchors are the words of a covering code of radius 1 a piece:
Hamming(15, 11) on each 15 bits and all words on the rest. A fingerprint has one home anchor and is replicated to every anchor
that may be home to one that differs in a bit, those within the radius plus one; a linked pair therefore meets at the home anchor
of either one. A group has some 2**24 anchors for a threshold of 4, so an anchor has few members even of thousands of millions of
fingerprints. Comparison is per anchor, home members with all. Of the links found only a spanning forest leaves a task, and
members that are linked already are not compared again, so a large group of near copies costs work and rows in proportion to its size.

Equal fingerprints are brought together before anything is replicated, so copies cost nothing here.

``exact_groups`` links texts by the Jaccard similarity of their sets of shingles. Fingerprints of such pairs differ in ten bits
of 64 at a similarity of 0.8, more than any anchors can cover that few texts share: pairs come together at the anchors of
fingerprints (two blocks of 32 bits, of which one differs in one bit at most) or in one of 32 bands of MinHash values, and a sketch of
192 bits rules most others out. That only proposes. The texts of a connected group of proposals then meet, each once, and every
pair of them is decided by the sets themselves; groups beyond a bound are cut into blocks, and pairs of blocks meet, but for
those whose texts are linked already.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import keep, released, sized
from .components import components, local_forest

SEED = 42
#: Longer texts are cut into pieces of so many characters while they are hashed.
PIECE = 1 << 22
#: Comparisons made at once.
AT_ONCE = 1 << 20
#: Members of an anchor that are compared in steps, those that are linked by then no more.
STEPPED = 128
#: An anchor with more members than this is cut into parts, and pairs of parts meet.
HOT_ANCHOR = 50_000
#: So many members of an anchor of that size are counted to tell.
COUNTED = 1000
#: Fingerprints replicated at once.
SPREAD_ROWS = 2000

#: MinHash bands and values in each. At a similarity of 0.8 a pair shares no band once in 16,000 times.
BANDS, ROWS = 32, 6
#: The bits that may differ for sure where pairs meet at the anchors of exact groups; two blocks of 32 bits.
NEAR = 3
#: The last bits of the MinHash values, in words.
SKETCH = ("s0", "s1", "s2")
#: A pair is proposed if its sketches differ in no more bits than expected and so many standard deviations.
DEVIATIONS = 4
#: Shingles of a block of texts that meet; a text counts as so many more.
BLOCK, TEXT = 1 << 19, 512
#: Columns of a matrix of shingles, and from how many texts of a cell a shingle gets a column in a large one.
COLUMNS, DENSE = 2048, 24
_MINHASH = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def _words(text: str) -> Iterator[list[bytes]]:
    if len(text) <= PIECE:
        yield text.encode("utf-8", "surrogatepass").lower().split()
        return
    rest = b""
    for i in range(0, len(text), PIECE):
        part = rest + text[i : i + PIECE].encode("utf-8", "surrogatepass").lower()
        words = part.split()
        rest = words.pop() if words and not part[-1:].isspace() else b""
        yield words
    yield [rest] if rest else []


def _count_ones(bits: np.ndarray) -> np.ndarray:
    """Column sums of a 0/1 matrix of bytes, 255 rows at a time so that a byte holds a sum."""
    whole = len(bits) // 255 * 255
    sums = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8)
    return sums.sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def _bits64(hashes: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)


def simhash(text: str | None, k: int = 4) -> int:
    """The fingerprint as a signed 64-bit number: the bits that over half of the shingles' hashes have; 0 for null and for texts without a word."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in _words(text or ""):
        words = tail + words
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-k].tolist()]
            hashes = [xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
            n += len(hashes)
            for i in range(0, len(hashes), 1 << 14):
                ones += _count_ones(_bits64(b"".join(hashes[i : i + (1 << 14)])))
            words = words[len(words) - k + 1 :]
        tail = words
    if not n and tail:
        ones, n = _bits64(xxhash.xxh64_digest(b" ".join(tail), SEED))[0].astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint_udf(shingle: int = 4):
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
        released()

    return fingerprint


@cache
def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: its nearest codeword, and all 8 codewords within distance 2 (the nearest one again where there are fewer)."""
    v = np.arange(1 << 15, dtype=np.int64)
    syndrome = np.zeros_like(v)
    for p in range(1, 16):
        syndrome ^= np.where(v >> (p - 1) & 1, p, 0)
    home = np.where(syndrome > 0, v ^ (1 << np.maximum(syndrome - 1, 0)), v)
    near = np.repeat(home[:, None], 8, axis=1)
    for s in range(1, 16):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 16) if i < (i ^ s)]
        rows = np.flatnonzero(syndrome == s)
        near[rows, 1:] = v[rows, None] ^ np.array(pairs)[None, :]
    return home, near


Bits = tuple[tuple[int, int], ...]


def blocks(threshold: int, parts: int | None = None) -> list[Bits]:
    """The 64 bits cut in parts, each a group of its own: one (first bit, width). Of threshold // 2 + 1 parts (two at least) one has at most one differing bit."""
    n = parts or max(2, threshold // 2 + 1)
    if 64 // n < 15 and not parts:
        raise ValueError("the threshold is too large for blocks of 15 bits")
    edges = [64 * i // n for i in range(n + 1)]
    return [((a, b - a),) for a, b in zip(edges, edges[1:], strict=False)]


def _cover(does: np.ndarray, open_: np.ndarray, most: int) -> list[int] | None:
    """At most ``most`` rows of a 0/1 matrix that together have all open columns, or None if there are none."""
    if not open_.any():
        return []
    if not most:
        return None
    hard = np.flatnonzero(open_)[does[:, open_].sum(0).argmin()]
    for row in np.flatnonzero(does[:, hard]).tolist():
        if (rest := _cover(does, open_ & ~does[row], most - 1)) is not None:
            return [row, *rest]
    return None


@cache
def triples(threshold: int) -> list[Bits]:
    """Groups of three parts of which one has at most one differing bit, however the bits fall: as few as can be up to a threshold of 4, else chosen greedily."""
    n = max(threshold + 2, 4)
    if n > 9:
        raise ValueError("the threshold is too large for parts of 7 bits")
    ways = np.array([[bars.count(i) for i in range(n)] for bars in itertools.combinations_with_replacement(range(n), threshold)]).reshape(-1, n)
    every = list(itertools.combinations(range(n), 3))
    does = np.array([ways[:, t].sum(1) <= 1 for t in every])
    chosen, open_ = [], np.ones(len(ways), bool)
    while open_.any():
        chosen.append(int(does[:, open_].sum(1).argmax()))
        open_ &= ~does[chosen[-1]]
    if n <= 6:
        fewer = (_cover(does, np.ones(len(ways), bool), m) for m in range(1, len(chosen)))
        chosen = next((c for c in fewer if c is not None), chosen)
    part = [b[0] for b in blocks(threshold, n)]
    return [tuple(part[i] for i in every[c]) for c in chosen]


def anchors(fps: np.ndarray, groups: list[Bits]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of anchors, whether it is the home anchor, and the fingerprint's place in fps, for all groups of bits."""
    home, near = _hamming()
    keys, homes, at = [], [], []
    u, all_ = fps.astype(np.uint64), np.arange(len(fps))
    for g, bits in enumerate(groups):
        word, width = np.zeros(len(u), np.int64), 0
        for first, n in bits:
            word |= ((u >> np.uint64(first)).astype(np.int64) & ((1 << n) - 1)) << width
            width += n
        codes = range(0, width - 14, 15)
        own = [word >> i & 0x7FFF for i in codes]
        base = word >> 15 * len(codes) << 15 * len(codes)
        for i, x in zip(codes, own, strict=True):
            base |= home[x] << i
        base |= np.int64(g) << 50
        keys.append(base)
        at.append(all_)
        homes.append(np.ones(len(u), bool))
        for i, x in zip(codes, own, strict=True):
            for j in range(1, 8):
                move = near[x, j] ^ home[x]
                there = np.flatnonzero(move)
                keys.append(base[there] ^ (move[there] << i))
                at.append(there)
        for j in range(15 * len(codes), width):
            keys.append(base ^ (1 << j))
            at.append(all_)
        homes.append(np.zeros(sum(map(len, keys)) - sum(map(len, homes)), bool))
    return np.concatenate(keys), np.concatenate(homes), np.concatenate(at)


def _forest(pdf: pd.DataFrame, words: tuple[str, ...], most: int) -> pd.DataFrame:
    """Links between the home members of each anchor and its other members, as a spanning forest: (u, v) of nodes, u the greater.

    Two members link if all words together differ in at most ``most`` bits.
    """
    keys, part, home, node = (pdf[c].to_numpy() for c in ("key", "part", "home", "node"))
    bits = [pdf[w].to_numpy().view(np.uint64) for w in words]
    home = home.astype(bool)
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[new, len(keys)])
    us, vs = [node[:0]], [node[:0]]

    def near(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(bits[0][mine] ^ bits[0][other]).astype(np.int16)
        for b in bits[1:]:
            differ += np.bitwise_count(b[mine] ^ b[other])
        return (differ <= most) & (node[mine] != node[other])

    # small anchors together, so many comparisons at once
    first, many = np.repeat(new, size), np.repeat(size, size)
    who = np.flatnonzero(home & (many > 1) & (many <= STEPPED))
    total, done = np.cumsum(many[who]), 0
    while done < len(who):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE, "right")))
        x = who[done:upto]
        n = many[x]
        mine = np.repeat(x, n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[x], n)
        linked = near(mine, other)
        a, b = local_forest(node[mine[linked]], node[other[linked]])
        us.append(a)
        vs.append(b)
        done = upto
    # large ones in steps that grow: what is one group by then is not compared again
    for start, n in zip(new[size > STEPPED].tolist(), size[size > STEPPED].tolist(), strict=True):
        own = np.flatnonzero(home[start : start + n])
        label, at, step = np.arange(n), 0, 1
        while at < len(own) and (label != label[0]).any():
            x = own[at : at + step]
            at += step
            step = min(4 * step, max(1, AT_ONCE // n))
            labels, count = np.unique(label, return_counts=True)
            x = x[count[np.searchsorted(labels, label[x])] < n]
            mine, other = np.repeat(x, n), np.tile(np.arange(n), len(x))
            apart = label[mine] != label[other]
            mine, other = mine[apart], other[apart]
            linked = near(start + mine, start + other)
            a, b = local_forest(label[mine[linked]], label[other[linked]])
            to = np.arange(n)
            to[a] = b
            label = to[label]
        moved = np.flatnonzero(label != np.arange(n))
        us.append(node[start + moved])
        vs.append(node[start + label[moved]])
    return pd.DataFrame(dict(zip("uv", local_forest(np.concatenate(us), np.concatenate(vs)), strict=True)))


def _met(spread: DataFrame, words: tuple[str, ...], most: int, hot: int) -> DataFrame:
    """spread (key, home, node and words; longs) to links (u, v) of nodes that meet at a key and are near: the components are those of all such pairs."""
    spark = spread.sparkSession

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sized(batches, ["key", "part"], 100_000):
            yield _forest(pdf, words, most)
        released()

    # how many parts an anchor is cut into changes no link, so an estimate from a fixed share of its members will do
    one_in = max(1, hot // COUNTED)
    some = spread.filter(F.pmod(F.xxhash64("key", "node"), F.lit(one_in)) == 0)
    crowd = some.groupBy("key").agg((F.count("*") * one_in).alias("n")).filter(F.col("n") > hot)
    crowd = keep(crowd.select(F.col("key").alias("crowded"), F.floor(F.col("n") / hot + 1).cast("int").alias("parts")), "crowded")
    columns = ["key", "part", "home", "node", *[w for w in words if w != "node"]]
    whole = spread.withColumn("part", F.lit(0).cast("long"))
    if crowd.limit(1).count():
        # a pair of parts gets the home members of one and all members of the other
        joined = spread.join(crowd, spread["key"] == crowd["crowded"], "left")
        whole = joined.filter("crowded IS NULL").withColumn("part", F.lit(0).cast("long"))
        own = F.pmod(F.xxhash64("node"), F.col("parts"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        cells = F.array_distinct(F.concat(F.transform(every, lambda j: own * F.col("parts") + j), F.transform(every, lambda i: i * F.col("parts") + own)))
        cut = joined.filter("crowded IS NOT NULL").withColumn("own", own).withColumn("part", F.explode(cells))
        cut = cut.withColumn("home", F.col("home") & (F.floor(F.col("part") / F.col("parts")) == F.col("own")))
        whole = whole.select(*columns).unionByName(cut.select(*columns))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return whole.select(*columns).repartition(width, "key", "part").sortWithinPartitions("key", "part").mapInPandas(compare, "u long, v long")


def links(fps: DataFrame, threshold: int = 4, hot: int = HOT_ANCHOR) -> DataFrame:
    """fps (node: long, a fingerprint; distinct) to links (u, v: long), whose components are those of the full link graph."""
    groups = triples(threshold)
    ship(fps.sparkSession)

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), SPREAD_ROWS):
                fp = pdf["node"].to_numpy(np.int64)[i : i + SPREAD_ROWS]
                key, home, at = anchors(fp, groups)
                yield pd.DataFrame({"key": key, "home": home, "node": fp[at]})
        released()

    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.select("node").repartition(width, "node").mapInPandas(replicate, "key long, home boolean, node long")
    return _met(keep(spread, "anchors"), ("node",), threshold, hot)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4) -> tuple[DataFrame, DataFrame]:
    """Fingerprint every text and find the groups.

    Returns (members, groups): members has one row per input row (doc_id, row_key, node: the fingerprint), groups one per distinct
    fingerprint (node, group_node, component_id, copies). component_id is the smallest id in the group; null ids are
    ignored, and it is null if all are. Null and wordless texts have fingerprint 0 and are linked like any other. Very long texts
    are hashed in pieces. Repeated rows are members each. Other columns are not read. An empty table gives empty results.
    """
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), fingerprint_udf(shingle)(text).alias("node"))
    members = keep(own, "fingerprints")
    distinct = keep(members.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    found = components(links(distinct, threshold)).withColumnRenamed("node", "of")
    grouped = distinct.join(found, distinct["node"] == found["of"], "left").select("node", F.coalesce("component", "node").alias("group_node"), "least", "copies")
    grouped = keep(grouped, "grouped")
    # written, so that Spark can split the rows of a large group over tasks in the join
    low = keep(grouped.groupBy("group_node").agg(F.min("least").alias("component_id")), "lows")
    return members, keep(grouped.join(low, "group_node").select("node", "group_node", "component_id", "copies"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, fingerprint_copies (rows with this fingerprint)."""
    members, groups = near_groups(docs, id_col, text_col, shingle, threshold)
    return members.join(groups, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id", F.col("copies").alias("fingerprint_copies"))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows of different ids or texts apart."""
    both = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return F.struct(F.xxhash64(*both).alias("a"), F.xxhash64(F.lit(1), *[c.isNull() for c in both], *both).alias("b"))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer than k words is one shingle, one without words has none."""
    found, tail, n = [np.zeros(0, np.uint64)], [], 0
    for words in _words(text or ""):
        words = tail + words
        if len(words) >= k:
            hashes = [xxhash.xxh3_64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]
            found.append(np.unique(np.array(hashes, np.uint64)))
            n += len(hashes)
            words = words[len(words) - k + 1 :]
        tail = words
    if not n and tail:
        found.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(tail), SEED)], np.uint64))
    return np.unique(np.concatenate(found))


def minhash(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """The keys of the bands, and the sketch, of a set that isn't empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, ((hashes[i : i + 1024, None] ^ _MINHASH[0]) * _MINHASH[1]).min(0))
    # the product's low bits depend on few bits of the hash, so a bit is taken from its middle
    sketch = np.packbits((low >> np.uint64(31)).astype(np.uint8) & 1).view(np.int64)
    keys = [xxhash.xxh3_64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist(), sketch.tolist()


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes, each counted once."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += _count_ones(_bits64(hashes[i : i + (1 << 14)].astype(">u8").tobytes()))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def sketch_bits(similarity: float) -> int:
    """How many bits of the sketches of a proposed pair may differ."""
    n, p = BANDS * ROWS, (1 - similarity) / 2
    return int(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


def _similar(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The pairs of a cell whose sets are similar, as a spanning forest. Members of side 1 meet those of side 2, and of side 0 each other; equal labels need no link."""
    node, label, side = (pdf[c].to_numpy() for c in ("node", "label", "side"))
    n, size = len(node), np.array([len(h) for h in pdf["hashes"]])
    member = np.repeat(np.arange(n), size)
    _, column, count = np.unique(np.concatenate([*pdf["hashes"], np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    least = 2 if n <= 2 * DENSE else DENSE
    shared = np.zeros((n, n), np.float32)
    wide = np.flatnonzero(count >= least)
    place = np.full(len(count), -1)
    place[wide] = np.arange(len(wide))
    at = place[column]
    for i in range(0, len(wide), COLUMNS):
        some = np.flatnonzero((at >= i) & (at < i + COLUMNS))
        m = np.zeros((n, min(COLUMNS, len(wide) - i)), np.float32)
        m[member[some], at[some] - i] = 1
        shared += m @ m.T
    if least > 2:  # shingles of few members: their pairs one by one
        few = np.flatnonzero((count[column] >= 2) & (count[column] < least))
        few = few[np.argsort(column[few], kind="stable")]
        c, who = column[few], member[few]
        for step in range(1, least - 1):
            same = np.flatnonzero(c[step:] == c[:-step])
            np.add.at(shared, (who[same], who[same + step]), 1)
            np.add.at(shared, (who[same + step], who[same]), 1)
    us, vs = [node[:0]], [node[:0]]
    for i in range(0, n, 256):
        rows = slice(i, i + 256)
        meets = ((side[rows, None] == 0) & (side[None, :] == 0)) | ((side[rows, None] == 1) & (side[None, :] == 2))
        both = size[rows, None] + size[None, :] - shared[rows].astype(float)
        x, y = np.nonzero(meets & (label[rows, None] != label[None, :]) & (shared[rows] >= similarity * both - 1e-9))
        a, b = local_forest(node[i + x], node[y])
        us.append(a)
        vs.append(b)
    return pd.DataFrame(dict(zip("uv", local_forest(np.concatenate(us), np.concatenate(vs)), strict=True)))


def _confirmed(met: DataFrame, similarity: float) -> DataFrame:
    """met (cell, side, node, label, hashes) to links (u, v) of similar sets that meet in a cell."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sized(batches, ["cell"], 1):
            for _, one in pdf.groupby("cell", sort=False):
                if len(one) > 1:
                    yield _similar(one, similarity)
        released()

    width = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.select("cell", "side", "node", "label", "hashes").repartition(width, "cell").sortWithinPartitions("cell").mapInPandas(confirm, "u long, v long")


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes (node, comp, label, weight) of large components to cells (cell, side, node, label): pairs of blocks, without those of one label.

    A label over the bound has blocks of its own; the others of a component are pooled, whole, by a hash.
    """
    labels = nodes.groupBy("comp", "label").agg(F.sum("weight").alias("of_label"))
    pools = labels.filter(F.col("of_label") <= BLOCK).groupBy("comp").agg(F.sum("of_label").alias("pooled"))
    labels = keep(labels.join(pools, "comp", "left").select(F.col("comp").alias("c"), F.col("label").alias("l"), "of_label", F.coalesce("pooled", F.lit(0)).alias("pooled")), "labels")
    own = F.col("of_label") > BLOCK
    part = F.when(own, F.pmod(F.xxhash64("node"), F.floor(F.col("of_label") / BLOCK) + 1)).otherwise(F.pmod(F.xxhash64("label"), F.floor(F.col("pooled") / BLOCK) + 1))
    placed = nodes.join(labels, (F.col("comp") == F.col("c")) & (F.col("label") == F.col("l")))
    single = F.when(own, F.col("label"))
    placed = keep(placed.select("node", "comp", "label", single.alias("single"), F.xxhash64("comp", single.isNull(), single, part).alias("block")), "placed")
    blocks = keep(placed.select("comp", "single", "block").distinct(), "blocks")
    others = blocks.select(F.col("comp").alias("c"), F.col("single").alias("s"), F.col("block").alias("other"))
    pairs = blocks.join(others, (F.col("comp") == F.col("c")) & (F.col("block") <= F.col("other"))).filter("single IS NULL OR s IS NULL OR single <> s")
    pairs = keep(pairs.select(F.xxhash64("block", "other").alias("cell"), "block", "other"), "block_pairs")
    left = pairs.select("cell", "block", F.when(F.col("block") == F.col("other"), 0).otherwise(1).alias("side"))
    right = pairs.filter("block <> other").select("cell", F.col("other").alias("block"), F.lit(2).alias("side"))
    return placed.join(left.unionByName(right), "block").select("cell", "side", "node", "label")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, hot: int = HOT_ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Groups of texts whose sets of shingles have at least this Jaccard similarity, directly or through others.

    Returns (members, groups): members has one row per input row (doc_id, row_key, node), groups one per distinct set (node,
    group_node). Null and wordless texts are one set. Every link is confirmed on the sets themselves; a set is known by 64 bits.
    """
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`")

    @F.pandas_udf("node long, fp long, bands array<long>, s0 long, s1 long, s2 long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                own = shingle_set(t, shingle)
                bands, sketch = minhash(own) if len(own) else ([], [0, 0, 0])
                rows.append((int.from_bytes(xxhash.xxh3_64_digest(own.tobytes(), SEED), "big", signed=True), majority(own), bands, *sketch))
            yield pd.DataFrame(rows, columns=["node", "fp", "bands", *SKETCH])
        released()

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts], dtype=object)
        released()

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), SPREAD_ROWS):
                pdf = whole.iloc[i : i + SPREAD_ROWS]
                key, home, at = anchors(pdf["fp"].to_numpy(np.int64), blocks(NEAR))
                key = np.concatenate([key, np.concatenate([*pdf["bands"], np.zeros(0, np.int64)])])
                at = np.concatenate([at, np.repeat(np.arange(len(pdf)), BANDS)])
                yield pd.DataFrame({"key": key, "home": np.r_[home, np.ones(len(key) - len(home), bool)]} | {c: pdf[c].to_numpy(np.int64)[at] for c in ("node", *SKETCH)})
        released()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), made(text).alias("made"))
    rows = keep(rows.select("doc_id", "row_key", "made.*"), "minhashes")
    members = rows.select("doc_id", "row_key", "node")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.filter(F.size("bands") > 0).groupBy("node").agg(F.first(F.struct("fp", "bands", *SKETCH)).alias("m")).select("node", "m.*")
    spread = keep(distinct.repartition(width, "node").mapInPandas(replicate, "key long, home boolean, node long, s0 long, s1 long, s2 long"), "buckets")
    proposed = keep(_met(spread, SKETCH, sketch_bits(similarity), hot), "proposed")
    # a forest has every node of a proposed pair, so only their sets are needed, and its components are those of all proposals
    comps = components(proposed)
    comps = keep(comps.unionByName(comps.select(F.col("component").alias("node"), "component").distinct()), "proposed_nodes")
    names = members.groupBy("node").agg(F.min("row_key").alias("row_key")).join(comps, "node")
    names = keep(names.select("node", F.col("component").alias("comp"), "row_key"), "names")
    # dealt out by rows at any size, and not once more for rows that are there twice
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), text.alias("text")).join(names.hint("merge"), "row_key").dropDuplicates(["row_key"])
    sets = keep(texts.select("node", "comp", hashes("text").alias("hashes")).withColumn("weight", (F.size("hashes") + TEXT).cast("long")), "sets")
    large = keep(sets.groupBy("comp").agg(F.sum("weight").alias("all")).filter(F.col("all") > BLOCK).select(F.col("comp").alias("large")), "large")
    small = sets.join(large, F.col("comp") == F.col("large"), "left_anti")
    found = keep(_confirmed(small.select(F.col("comp").alias("cell"), F.lit(0).alias("side"), "node", F.col("node").alias("label"), "hashes"), similarity), "confirmed")
    if large.limit(1).count():
        # what the forest of proposals links already needs no cell
        big = keep(sets.join(large, F.col("comp") == F.col("large"), "left_semi"), "large_sets")
        both = proposed.join(big.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(big.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        first = keep(both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v"), "confirmed")
        label = components(first).withColumnRenamed("node", "of")
        nodes = keep(big.join(label, F.col("node") == F.col("of"), "left").select("node", "comp", "weight", F.coalesce("component", "node").alias("label")), "labelled")
        met = _blocks(nodes).join(big.select("node", "hashes"), "node")
        found = found.unionByName(first).unionByName(keep(_confirmed(met, similarity), "confirmed"))
    group = components(found).withColumnRenamed("node", "of")
    names = rows.select("node").distinct()
    groups = names.join(group, names["node"] == group["of"], "left").select("node", F.coalesce("component", "node").alias("group_node"))
    return members, keep(groups, "groups")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 4, similarity: float | None = None) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest id (null ids last, then by content).

    With a similarity, links are texts whose sets of shingles are that similar, each confirmed; else fingerprints at most
    ``threshold`` bits apart. Of rows alike in id and text one stays, the first by its other columns as JSON. Null, empty and wordless
    texts are alike. An empty table gives an empty one. Columns of any type and name stay.
    """
    members, groups = exact_groups(docs, id_col, text_col, shingle, similarity) if similarity is not None else near_groups(docs, id_col, text_col, shingle, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    # the rows of a node are one before a group's nodes meet
    best = members.groupBy("node").agg(first.alias("best"))
    best = best.join(groups.select("node", "group_node"), "node").groupBy("group_node").agg(F.min("best").alias("best"))
    best = keep(best.select(F.col("best.row_key").alias("best_key")), "best")
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(best.hint("merge"), rows["row_key"] == best["best_key"], "left_semi")
    times = members.join(best, members["row_key"] == best["best_key"], "left_semi").groupBy("row_key").count().filter("count > 1")
    if times.limit(1).count():  # some of the chosen rows are there more than once
        kept = kept.groupBy("row_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
