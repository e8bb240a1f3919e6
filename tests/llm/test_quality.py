"""The attention network against finite differences and plain sums, its scores on labels that it hasn't seen, and corner cases."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_llm_operators import corner_texts, documents

from pelagia.llm import quality


def plain(k, n=120):
    rng = np.random.default_rng(k)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n)).capitalize() + "."


def test_slopes_are_those_of_finite_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.WIDTH)).astype(np.float32) for n in (1, 4, 9, 2)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    network = quality.fit(bags, labels, epochs=2)
    x = network.normal(np.concatenate(bags).astype(float))
    starts = np.array([0, 1, 5, 14])
    _, slopes = network.gradients(x, starts, labels)
    for value, slope in zip(network.weights, slopes, strict=True):
        for at in rng.integers(0, value.size, 4):
            ends = []
            for move in (1e-5, -2e-5):
                value.flat[at] += move
                ends.append(network.gradients(x, starts, labels)[0])
            value.flat[at] += 1e-5
            assert abs((ends[0] - ends[1]) / 2e-5 - slope.flat[at]) < 1e-6


def test_sums_kept_while_reading_are_the_whole_ones(monkeypatch):
    bags = [np.concatenate(list(quality.encoded(plain(k, 200 + k).encode()))) for k in range(8)]
    network = quality.fit(bags, np.array([0, 1] * 4, float), epochs=3)
    x = bags[5]
    h, _, _, e = network._passages(network.normal(x))
    a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    whole = 1 / (1 + np.exp(-((a @ h) @ network.weights[5] + network.weights[6][0])))
    assert abs(network.score(iter([x])) - whole) < 1e-12
    assert abs(network.score(x[k : k + 2] for k in range(0, len(x), 2)) - whole) < 1e-12


def test_attention_finds_the_one_passage_that_tells():
    bags, labels = [], []
    for k in range(160):
        text = plain(k, 500)
        if k % 2:
            cut = 1600
            text = text[:cut] + " BUY!! NOW!! " * 30 + text[cut:]
        bags.append(np.concatenate(list(quality.encoded(text.encode()))))
        labels.append(1.0 - k % 2)
    network = quality.fit(bags, np.array(labels), epochs=15)
    text = plain(999, 500)
    assert network.score(quality.encoded(text.encode())) > 0.8
    bad = (text[:1600] + " BUY!! NOW!! " * 30 + text[1600:]).encode()
    assert network.score(quality.encoded(bad)) < 0.2
    x = np.concatenate(list(quality.encoded(bad)))
    e = network._passages(network.normal(x))[3]
    a = np.exp(e) / np.exp(e).sum()
    assert a[4:6].sum() > 2 * 2 / len(x)  # the passages of bytes 1600 to 2400


def test_features_against_plain_counts():
    text = "Aa aa bb  bb\nbb 12!".encode()
    (row,) = quality.passage_features(np.frombuffer(text, np.uint8))
    rest = row[quality.CLASSES**2 :]
    words = text.split()
    sizes = np.array([len(w) for w in words])
    want = [np.log1p(6), np.log1p(sizes.mean()), np.log1p(sizes.var()), len(set(words)) / 6, np.log1p(len(text)), 2 / 6, 1 / 6, 0, 0, 0, 0]
    assert np.allclose(rest, want, atol=1e-6)
    assert abs((row[: quality.CLASSES**2] ** 2).sum() - 1) < 1e-5
    long = np.frombuffer(plain(3, 2000).encode(), np.uint8)
    assert len(quality.passage_features(long)) == -(-len(long) // quality.PASSAGE)
    assert not quality.passage_features(long[:0]).any()


def test_labels_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    table = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    unseen = [r for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(found) == 1000 and all(found[r["doc_id"]]["held_out"] for r in unseen)
    right = [found[r["doc_id"]]["predicted"] == r["quality"] for r in unseen]
    assert sum(right) >= 0.95 * len(right)
    # turned labels of held-out documents change nothing
    is_held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(is_held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, turned).collect()}
    assert all(abs(again[k] - r["score"]) < 1e-9 for k, r in found.items())


def test_quality_corner_cases(spark):
    docs = documents(spark, [*corner_texts(), (20, "y" * 1_000_000)])
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, None), (None, 1), (8, 7), (9, 0), (9, 1), (1, 1)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] in (1, 2)]
    assert len(same) == 2 and same[0] == same[1]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    none = labels.filter("false")
    assert {(r["score"], r["predicted"]) for r in quality.quality_scores(docs, none).collect()} == {(0.5, 1)}
    assert quality.quality_scores(docs.filter("false"), labels).collect() == []
    only = spark.createDataFrame([(0, 0), (4, 0)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.quality_scores(docs, only).collect()} == {0}
