"""How many of the similar pairs of a folder's documents the pipeline's near-duplicate stage finds, against an exact join on this machine.

python tests/llm/measure_recall.py [folder]. The exact join takes every pair of distinct texts that share one of their rarest
shingles (the prefixes that pairs of a similarity of 0.7 must share) and computes its Jaccard similarity from the whole sets.
"""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from mrflow.llm import simhash  # noqa: E402


def similar_pairs(sets: list[np.ndarray], least: float) -> list[tuple[int, int, float]]:
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    seen, found = {}, []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        h = sets[i]
        rare = h[np.lexsort((h, count[np.searchsorted(every, h)]))][: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]
        for j in {j for x in rare.tolist() for j in seen.get(x, ())}:
            shared = len(np.intersect1d(h, sets[j], assume_unique=True))
            if shared >= least * (len(h) + len(sets[j]) - shared) - 1e-9:
                found.append((j, i, shared / (len(h) + len(sets[j]) - shared)))
        for x in rare.tolist():
            seen.setdefault(x, []).append(i)
    return found


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    members, groups = simhash.exact_groups(docs)
    group = {r["node"]: r["group_node"] for r in groups.collect()}
    sets = {}
    for r in docs.select("text").toLocalIterator():
        h = simhash.shingle_set(r["text"])
        if len(h):
            sets[int.from_bytes(simhash.xxhash.xxh3_64_digest(h.tobytes(), simhash.SEED), "big", signed=True)] = h
    nodes = list(sets)
    pairs = similar_pairs([sets[n] for n in nodes], 0.7)
    there, linked = Counter(), Counter()
    parent = {n: n for n in nodes}

    def top(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for i, j, s in pairs:
        line = f"{int(s * 20 + 1e-9) / 20:.2f}"
        there[line] += 1
        linked[line] += group[nodes[i]] == group[nodes[j]]
        if s >= 0.8 - 1e-9:
            parent[top(nodes[i])] = top(nodes[j])
    print(f"{folder}: {len(nodes)} distinct texts, {docs.count()} documents")
    for line in sorted(there):
        print(f"similarity {line} and up: {there[line]} pairs, {linked[line] / there[line]:.4f} in one group")
    ours, true = {}, {}
    for n in nodes:
        ours.setdefault(group[n], set()).add(n)
        true.setdefault(top(n), set()).add(n)
    same = {frozenset(g) for g in ours.values()} & {frozenset(g) for g in true.values()}
    print(f"groups: {len(true)} by the exact join, {len(ours)} found, {len(same)} the same")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
