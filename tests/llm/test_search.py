"""Ranked search against plain scores of all documents."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import corner_texts, documents

from pelagia.llm import lexical_search
from pelagia.llm.common import folded_words


def brute(docs, items, best=20):
    held = [(d, folded_words(t.encode())) for d, t in docs if t]
    held = [(d, w, Counter(w)) for d, w in held if w]
    n_docs, all_words = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(folded_words((text or "").encode()))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, w, c in held:
            m = 75 + (25 * len(w) * n_docs) // all_words
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in terms.items() if c[t])
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, k + 1, doc, -score) for k, (score, doc) in enumerate(sorted(found)[:best])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search_corner_cases(spark):
    texts = [*corner_texts(), *[(100 + k, "alone b C0 x") for k in range(60)], (-5, "alone b C0 x"), (200, "ALONE " * 30_000)]
    asked = [(1, "Alone a b b B"), (1, "c"), (2, None), (3, ""), (None, "w1 w2 w3"), (4, "nowhere"), (5, "c0 é c0"), (6, " ".join(f"w{k}" for k in range(500)))]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "score", "rank", "item")})
    found = lexical_search.search(documents(spark, texts), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == brute(texts, asked)
    names = documents(spark, texts), items.withColumn("item_id", F.concat(F.lit("q"), F.col("item_id")))
    assert {r[0] for r in rows(lexical_search.search(*names))} == {"q1", "q5", "q6", None}


def test_search_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(lexical_search.search(none, items)) == []
    assert rows(lexical_search.search(documents(spark, [(1, "a")]), no_items)) == []
    assert rows(lexical_search.search(documents(spark, [(1, None), (2, "...")]), items)) == []


def test_search_in_blocks_and_small_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [(k, " ".join(f"t{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 50)) for k in range(400)]
    asked = [(k, " ".join(f"t{x}" for x in rng.integers(0, 50, 12))) for k in range(15)]
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 150)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 7)
    found = lexical_search.search(documents(spark, texts), spark.createDataFrame(asked, "item_id long, text string"), best=5)
    assert rows(found) == brute(texts, asked, 5)


@pytest.mark.parametrize("seed", range(6))
def test_max_score_skips_postings_and_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    n = 20_000
    ids = rng.permutation(n)
    lists = []
    for size, top in ((20, 900_000), (300, 500_000), (4000, 90_000), (15_000, 4_000), (19_000, 500)):
        at = np.sort(rng.choice(n, size, replace=False))
        lists.append((at, rng.integers(1, top, size) // 100 * 100))  # many ties
    total = np.zeros(n, np.int64)
    for at, score in lists:
        total[at] += score
    want = np.lexsort((ids, -total))[:20]
    places, scores, read = lexical_search.best_documents(lists, ids)
    assert places.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert read < sum(len(at) for at, _ in lists) / 2
