"""URL filters: rules first, gradient-boosted trees on lexical features where no rule fits. DataFrame operations alone.

The trees learn from labelled URLs (here those that a rule judges), on at most ``sample_rows`` of them chosen by a hash;
they are grown on the driver from that sample, and applied as one nested CASE expression per tree. Suffix statistics, the
smoothed share of blocked URLs per host suffix, cover all labelled rows; for the URLs that trees learn from they are taken over the
other folds, so a URL's own label is in none of its features. One fold grows no trees and tells how many to keep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, keep

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ("url_chars", "host_chars", "path_chars", "host_labels", "depth", "digit_ratio", "path_digits", "hyphens", "parameters", "fragment", "entropy", "top_rate", "pair_rate")
#: Suffix features: how many labels of the host they look at.
SUFFIXES = {"top": 1, "pair": 2}
#: Weight of the common share in a suffix's share.
PRIOR = 20.0
FOLDS, PATIENCE = 5, 5


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty for null and without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, h, p in rules:
        whole = F.struct(F.lit(len(h) + len(p)).alias("chars"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), whole))
    return F.array_max(F.array(*fits))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    chars, n = F.split(u, ""), F.length(u)
    n = F.length(u).cast("double")
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: F.when(F.length(c) == 0, s).otherwise(s - share(c) * F.log2(share(c))))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "url_chars": n,
        "host_chars": F.length(host).cast("double"),
        "path_chars": F.length(path).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": count(path, "/[^/]"),
        "digit_ratio": F.when(n > 0, count(u, "[0-9]") / n).otherwise(0.0),
        "path_digits": count(path, "[0-9]"),
        "hyphens": count(host, "-"),
        "parameters": count(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "[^&]+"),
        "fragment": F.instr(u, "#").cast("boolean").cast("double"),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
    }


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(F.col(f"f.{FEATURES[self.feature]}") <= self.cut, self.left.column()).otherwise(self.right.column())

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.apply(x), self.right.apply(x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0, bins: int = 32, least: float = 1.0) -> tuple[float, list[Node]]:
    """Newton boosting of the logistic loss over quantile bins. Returns the start and the trees; none if there is one class only."""
    mean = float(y.mean()) if len(y) else 0.0
    if mean in (0.0, 1.0):
        return (5.0 if mean else -5.0), []
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    logit, grown = np.full(len(y), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> Node:
        gs, hs = g[rows].sum(), h[rows].sum()
        node = Node(value=float(-rate * gs / (hs + l2)))
        best = (1e-6, -1, 0)
        for j, c in enumerate(cuts if level else ()):
            left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
            gain = left_g**2 / (left_h + l2) + (gs - left_g) ** 2 / (hs - left_h + l2) - gs**2 / (hs + l2)
            gain[(left_h < least) | (hs - left_h < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] >= 0:
            node.feature, node.cut = best[1], float(cuts[best[1]][best[2]])
            goes = binned[rows, best[1]] <= best[2]
            node.left, node.right = grow(rows[goes], g, h, level - 1), grow(rows[~goes], g, h, level - 1)
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        grown.append(tree)
        logit = logit + tree.apply(x)
    return start, grown


def _log_loss(y: np.ndarray, logit: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -logit, logit)).mean()) if len(y) else 0.0


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Of labelled (url, host, blocked), for one and two labels: each suffix with its blocked and all URLs, whole and by fold."""
    counted = {}
    for name, labels in SUFFIXES.items():
        suffix = F.substring_index("host", ".", -labels).alias("suffix")
        folds = keep(labelled.groupBy(suffix, fold_of(F.col("url")).alias("in_fold")).agg(F.sum("blocked").alias("bad"), F.count("*").alias("n")), "suffixes")
        counted[name] = keep(folds.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "suffixes"), folds
    return counted


def features(urls: DataFrame, counted: dict[str, tuple[DataFrame, DataFrame]], mean: float, crossed: bool = False) -> DataFrame:
    """urls (url, host, path, others) as (row: all of them, f: struct of FEATURES); suffixes without a count have the mean.

    crossed: the rows are among the counted ones, so a suffix's share is taken over the other folds only, without the row's own label.
    """
    out = urls.select("url", "host", "path", F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"))
    for name, labels in SUFFIXES.items():
        whole, folds = counted[name]
        out = out.withColumn("own", F.substring_index("host", ".", -labels)).join(whole, F.col("own") == F.col("suffix"), "left").drop("suffix")
        bad, n = F.coalesce("bad", F.lit(0)), F.coalesce("n", F.lit(0))
        if crossed:
            inside = folds.select("suffix", "in_fold", F.col("bad").alias("fold_bad"), F.col("n").alias("fold_n"))
            out = out.withColumn("fold", fold_of(F.col("url"))).join(inside, (F.col("own") == F.col("suffix")) & (F.col("fold") == F.col("in_fold")), "left").drop("suffix", "in_fold", "fold")
            bad, n = bad - F.coalesce("fold_bad", F.lit(0)), n - F.coalesce("fold_n", F.lit(0))
        out = out.withColumn(f"{name}_rate", (bad + PRIOR * mean) / (n + PRIOR)).drop("own", "bad", "n", "fold_bad", "fold_n")
    made = lexical(F.col("url"), F.col("host"), F.col("path")) | {f"{name}_rate": F.col(f"{name}_rate") for name in SUFFIXES}
    return out.select("row", F.struct(*[made[f].alias(f) for f in FEATURES]).alias("f"))


@dataclass
class Model:
    """Trees, what the suffixes' shares need, and how the trees did on the fold that they didn't learn from."""

    start: float
    trees: list[Node]
    counted: dict[str, tuple[DataFrame, DataFrame]]
    mean: float
    held: dict

    def score(self, rows: DataFrame) -> DataFrame:
        """(row, block_score) of rows (url, host, path, others)."""
        logit = F.lit(self.start)
        for t in self.trees:
            logit = logit + t.column()
        return features(rows, self.counted, self.mean).select("row", (1 / (1 + F.exp(-logit))).alias("block_score"))


def fit(labelled: DataFrame, sample_rows: int = 20_000) -> Model:
    """Learn from labelled (url, host, path, blocked 0 or 1).

    Trees grow on all folds but one, until the loss on that one has not fallen for PATIENCE trees; those after the best are dropped.
    If nothing is labelled, or all alike, the trees are a constant: the label there is, or allow.
    """
    facts = labelled.agg(F.count("*").alias("n"), F.avg("blocked").alias("mean")).first()
    mean = float(facts["mean"] or 0.0)
    counted = suffix_counts(labelled)
    # the smallest hashes; a filter by twice their share comes first, so that not every task offers as many rows
    share = 2 * sample_rows / max(facts["n"], 1)
    few = labelled if share >= 1 else labelled.filter(F.xxhash64("url") < int(share * (1 << 64)) - (1 << 63))
    some = keep(few.orderBy(F.xxhash64("url"), "url").limit(sample_rows), "sample")
    got = features(some, counted, mean, crossed=True).select("row.blocked", fold_of(F.col("row.url")).alias("fold"), *[F.col(f"f.{c}") for c in FEATURES]).collect()
    got.sort()
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(FEATURES))
    y, held = np.array([r[0] for r in got], float), np.array([r[1] == 0 for r in got], bool)
    if len(got) < 10 * FOLDS or len(set(y[~held].tolist())) < 2:
        held[:] = False
    start, trees = boost(x[~held], y[~held])
    if not held.any():
        return Model(start, trees, counted, mean, {"rows": 0})
    logit, best = np.full(int(held.sum()), start), [0, _log_loss(y[held], np.full(int(held.sum()), start))]
    base = best[1]
    for i, t in enumerate(trees):
        logit = logit + t.apply(x[held])
        if (now := _log_loss(y[held], logit)) < best[1] - 1e-6:
            best = [i + 1, now]
        if i + 1 - best[0] >= PATIENCE:
            break
    kept = trees[: best[0]]
    p = np.full(int(held.sum()), start) + sum((t.apply(x[held]) for t in kept), np.zeros(int(held.sum())))
    return Model(start, kept, counted, mean, {"rows": int(held.sum()), "loss": best[1], "loss_of_the_mean": base, "accuracy": float(((p > 0) == (y[held] > 0)).mean()), "trees": len(kept)})


def judge(pages: DataFrame, url_col: str = "url", keep_cols: tuple[str, ...] = ("page_id",), rules=RULES, sample_rows: int = 20_000) -> DataFrame:
    """keep_cols, host, path, rule, verdict and block_score of every row; repeated rows are judged alike.

    Null URLs and those without :// have an empty host and path, fit no rule and are judged by the trees. Very long URLs are
    taken whole. An empty table gives no rows. Columns that aren't named in keep_cols stay out, whatever their names; one of
    keep_cols that is named like a result stays under its name with underscores added until it is free.
    """
    results = ["host", "path", "rule", "verdict", "block_score"]
    names = free_names(list(keep_cols), results)
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("kept"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", ruled(F.col("host"), F.col("path"), rules))
    labelled = rows.filter("fit IS NOT NULL").select("url", "host", "path", (F.col("fit.verdict") == "block").cast("int").alias("blocked"))
    scored = fit(labelled, sample_rows).score(rows)
    verdict = F.coalesce("row.fit.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("row.kept.*", "row.host", "row.path", F.col("row.fit.rule").alias("rule"), verdict.alias("verdict"), "block_score")
