"""Counts what the join finds of all links: python tests/llm/recall.py DIR, with a folder of tables.

All links are found by prefix filtering: of two sets with a similarity of 0.8 or more, the first fifth of each, in one
order of the shingles from rare to frequent, has a shingle in common. Exact, in one process, for small tables.
"""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def all_links(texts: list[str]) -> dict[str, int]:
    """Number of other texts linked to each different text."""
    from themescope.llm.chosen_path import shingle_set
    from themescope.llm.common import WordHashes

    hashes = WordHashes()
    sets = [(t, s) for t in dict.fromkeys(texts) if len(s := shingle_set(t, hashes))]
    often = Counter(x for _, s in sets for x in s.tolist())
    found, by_shingle = Counter(), defaultdict(list)
    for i, (_, s) in enumerate(sets):
        first = sorted(s.tolist(), key=lambda x: (often[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for x in first for j in by_shingle[x]}:
            small, large = sorted((len(s), len(sets[j][1])))
            if 5 * small >= 4 * large and 5 * (both := len(np.intersect1d(s, sets[j][1], assume_unique=True))) >= 4 * (small + large - both):
                found[i] += 1
                found[j] += 1
        for x in first:
            by_shingle[x].append(i)
    return {t: found[i] for i, (t, _) in enumerate(sets)}


def main() -> None:
    from pyspark.sql import SparkSession

    from themescope.llm import chosen_path
    from themescope.llm.common import table

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    docs = table(spark, sys.argv[1], "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = all_links(list(texts.values()))
    got = {texts[r.doc_id]: r.n_links for r in chosen_path.join(docs).select("doc_id", "n_links").collect()}
    print(f"{sum(min(got[t], n) for t, n in want.items()) // 2} of {sum(want.values()) // 2} links, {sum(max(0, got[t] - n) for t, n in want.items())} too many")


if __name__ == "__main__":
    main()
