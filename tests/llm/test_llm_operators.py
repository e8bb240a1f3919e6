"""The ten operators against brute force, and their corner cases: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pelagia.llm import decontam, licenses, line_dedup, linking, media, near_dedup, packing, substring_dedup, token_output, tokens, toxicity, url_filter
from pelagia.operators.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, texts):
    """Rows with odd further columns: names that the operators use inside."""
    df = spark.createDataFrame([(k, t) for k, t in texts], "doc_id long, text string")
    odd = {c: F.lit(c) for c in ("key", "row", "component", "h", "kept", "score", "a b", "n_words")}
    return df.withColumns(odd)


def words(n, seed, size=4000):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, size, n)]


def corner_texts():
    base = words(300, 1)
    near = list(base)
    near[7] = "changed"
    return [
        (0, " ".join(base)), (1, None), (2, ""), (3, " \t\n "), (4, "Alone"), (5, " ".join(near)), (6, " ".join(base)), (6, " ".join(base)), (7, "alone"),
        (8, " ".join(words(20_000, 2, 50))), (9, "x" * 50_000), (10, "é ß ü"), (None, " ".join(base)), (None, None), (11, "a b"), (12, "a b c"),
    ]


@pytest.fixture(scope="module")
def corners(spark):
    return documents(spark, corner_texts())


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def sample_rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]


def shingles(text, width=2):
    w = SPACED.findall(fold(text))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def smallest(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(64)]
    got = {r["u"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "u long, v long")).collect()}
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in smallest(edges, {x for e in edges for x in e}).items() if k in used}


# ---- 10


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, sample, sample_rows, corners, width):
    for df, rows in ((sample, sample_rows), (corners, corner_texts())):
        out = [tuple(r) for r in near_dedup.near_duplicates(df, width).collect()]
        sets = [(d, shingles(t, width)) for d, t in rows]
        own = [(d, s) for d, s in sets if d is not None and s]
        links = [(a, b) for k, (a, s) in enumerate(own) for b, t in own[:k] if 100 * len(s & t) >= 80 * len(s | t)]
        root = smallest(links, {d for d, _ in sets if d is not None})
        assert Counter(out) == Counter((d, len(s), None if d is None else root[d], d is None or root[d] == d) for d, s in sets)
    assert near_dedup.near_duplicates(sample.limit(0)).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, 50).astype(np.uint64)])) for _ in range(2)]
    sketches = np.stack([near_dedup.sketch(near_dedup.minima(s)) for s in sets])
    got = linking.agreement(sketches)(0, np.array([1]))
    pieces = [[int(w) >> 4 * k & 15 for w in row for k in range(16)] for row in sketches]
    agree = sum(p == q for p, q in zip(*pieces, strict=True)) / near_dedup.MINIMA
    assert got[0] == pytest.approx((agree - 1 / 16) / (15 / 16)) and got[0] == pytest.approx(0.9, abs=0.1)


def test_links_of_blocks_equal_all_pairs(spark, monkeypatch):
    """A group of edited copies that a hub leaves apart, in many small blocks and beside a third of the rows in one text."""
    monkeypatch.setattr(linking, "BLOCK_MEMBERS", 7)
    rng = np.random.default_rng(11)
    base = words(120, 3)
    rows = []
    for k in range(90):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(3, 16)), replace=False):
            own[at] = f"new{rng.integers(0, 9)}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, rows[0][1]) for k in range(45)]
    rows.append((200, " ".join([*base[:100], *words(1500, 5)])))
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = smallest(links, sets)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root and 3 < len(set(root.values())) < 90


def test_hot_keys_are_spread(spark):
    """Equal texts, empty texts and null ids with a third of the rows each, past the limit at which a key counts as hot."""
    rows = [(k, "the same few words in many rows") for k in range(40)] + [(100 + k, "") for k in range(40)] + [(None, "lost words")] * 40 + [(300, "one of its own kind")]
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter({(k, 6, 0, k == 0): 1 for k in range(40)}) + Counter({(100 + k, 0, 100 + k, True): 1 for k in range(40)})
    assert got == want + Counter({(None, 1, None, True): 40, (300, 4, 300, True): 1})


# ---- 8


def removed_words(rows, width=50):
    first = {}
    texts = [(d, SPACED.findall(t or "")) for d, t in rows]
    for d, w in texts:
        if d is not None:
            for k in range(len(w) - width + 1):
                x = tuple(w[k : k + width])
                first[x] = min(first.get(x, d), d)
    out = Counter()
    for d, w in texts:
        gone = {j for k in range(len(w) - width + 1) if d is not None and first[tuple(w[k : k + width])] < d for j in range(k, k + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_dedup(spark, sample, sample_rows, corners):
    for df, rows in ((sample, sample_rows), (corners, corner_texts())):
        out = substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert Counter(tuple(r) for r in out.collect()) == removed_words(rows)
    assert substring_dedup.remove_repeats(sample.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(sample, 20)


def test_cover_holds_every_shift():
    d = set(substring_dedup.COVER.tolist())
    assert {(a - b) % substring_dedup.PERIOD for a in d for b in d} == set(range(substring_dedup.PERIOD))


# ---- 2


def contaminated(rows, items, width=13):
    windows = {}
    for i, t in items:
        w = FOLDED.findall(fold(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    out = Counter()
    for d, t in rows:
        w = FOLDED.findall(fold(t))
        hit, ids = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out[d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_decontamination(spark, sample, sample_rows, corners):
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontam.decontaminate(sample, bench).collect()) == contaminated(sample_rows, items)
    odd = [(1, "Alone"), (2, " ".join(words(300, 1)[40:60]).upper()), (3, None), (4, "!!"), (10, "é, ß"), (2, "w1 w2"), (None, "b c")]
    wanted = contaminated(corner_texts(), [(i, t) for i, t in odd if i is not None])
    got = Counter(tuple(r) for r in decontam.decontaminate(corners, spark.createDataFrame(odd[:-1], "item_id long, text string")).collect())
    assert got == wanted
    none = decontam.decontaminate(corners, bench.limit(0)).select("n_hit", "contaminated").distinct().collect()
    assert [tuple(r) for r in none] == [(0, False)]
    assert decontam.decontaminate(sample.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, sample, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = Counter(tuple(r) for r in decontam.decontaminate(sample, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1 << 16)
    assert Counter(tuple(r) for r in decontam.decontaminate(sample, bench).collect()) == whole


def test_decontamination_by_one_word(spark, monkeypatch):
    texts = ["in Paris today", "we saw PARIS", "Paris.", "(paris)", "Paris, Paris and paris", "Parish", "paris", "in Rome today", "é", "no é, no", "", None, "x " * 30 + "paris"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    items = [(1, "Paris"), (2, "é"), (3, "in Paris"), (4, "paris!"), (5, "and"), (6, "...")]
    df, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontam.decontaminate(df, bench).collect()) == contaminated(rows, items)
    assert Counter(tuple(r) for r in decontam.decontaminate(df, bench, width=1).collect()) == contaminated(rows, items, 1)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert Counter(tuple(r) for r in decontam.decontaminate(df, bench).collect()) == contaminated(rows, items)


# ---- 3, 4


def encoded(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for _, x in rows]


def test_token_files(spark, sample, sample_rows, corners, tmp_path):
    for name, df, rows in (("a", sample, sample_rows), ("b", corners.where("doc_id is not null"), [r for r in corner_texts() if r[0] is not None])):
        rows = sorted(rows, key=lambda r: r[0])
        token_output.write_tokens(df, str(tmp_path / name))
        out = sorted(tuple(r) for r in token_output.token_digest(token_output.read_tokens(spark, str(tmp_path / name))).collect())
        at, wanted = 0, []
        for (d, _), ids in zip(rows, encoded(rows, 2), strict=True):
            wanted.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert out == sorted(wanted)
    token_output.write_tokens(sample.limit(0), str(tmp_path / "none"))
    assert token_output.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    cases = [np.zeros(0, np.uint64), np.zeros(1000, np.uint64), rng.integers(0, 2**63, 50).astype(np.uint64), np.full(7, 2**64 - 1, np.uint64)]
    cases += [(rng.integers(0, 2**62, 3000) >> rng.integers(0, 62, 3000)).astype(np.uint64) for _ in range(3)]
    for v in cases:
        assert np.array_equal(token_output.unpack(*token_output.pack(v), len(v)), v)
    with pytest.raises(ValueError):
        token_output.unpack(*token_output.pack(np.ones(3, np.uint64)), 90)


def test_packing(spark, sample, sample_rows, corners):
    for df, rows in ((sample, sample_rows), (corners, corner_texts())):
        out = packing.pack_documents(df).collect()
        wanted = Counter()
        for (d, _), ids in zip(rows, encoded(rows, 0), strict=True):
            for k in range(0, len(ids), 2048):
                wanted[d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
        assert Counter(tuple(r)[:5] for r in out) == wanted
        bins = {}
        for r in out:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(n for r in out for n in [r["length"]])
        assert len(bins) <= 1.02 * -(-total // 2048) + 2
    assert packing.pack_documents(sample.limit(0)).count() == 0


def test_fullest_is_the_best_choice():
    rng = np.random.default_rng(2)
    for _ in range(40):
        counts = np.zeros(31, np.int64)
        for n in rng.integers(1, 31, 6):
            counts[n] += rng.integers(1, 3)
        room = int(rng.integers(1, 31))
        reach = {0}
        for n in np.flatnonzero(counts):
            for _ in range(counts[n]):
                reach |= {x + int(n) for x in reach if x + n <= room}
        chosen = packing.fullest(counts, room)
        assert sum(n * t for n, t in chosen) == max(reach) and all(t <= counts[n] for n, t in chosen)


# ---- 5


def test_media(spark, sample, sample_rows, corners):
    for df, rows in ((sample, sample_rows), (corners, corner_texts())):
        out = media.media_features(media.to_media(df)).collect()
        wanted = Counter()
        for d, t in rows:
            b = (t or "").encode()
            p = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
            wanted[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
        assert Counter(tuple(r)[:5] for r in out) == wanted
    assert media.to_media(sample.limit(0)).count() == 0


def test_png_damage_and_filters():
    data = bytes(np.random.default_rng(0).integers(0, 256, 192 * 5, np.uint8))
    png = media.encode_png(data)
    assert media.decode_png(png).tobytes() == data
    for bad in (png[:-1], b"x" + png[1:], png[:50] + bytes([png[50] ^ 1]) + png[51:]):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bad)
    # rows filtered by the plain definitions, all five kinds
    rows = np.frombuffer(data, np.uint8).reshape(5, 192).astype(int)
    lines = np.zeros((5, 193), np.uint8)
    for r in range(5):
        for x in range(192):
            a = rows[r, x - 3] if x >= 3 else 0
            b = rows[r - 1, x] if r else 0
            c = rows[r - 1, x - 3] if r and x >= 3 else 0
            p = a + b - c
            paeth = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            lines[r, 1 + x] = (rows[r, x] - [0, a, b, (a + b) // 2, paeth][r]) & 255
        lines[r, 0] = r
    assert np.array_equal(media._unfilter(lines, 3), rows.astype(np.uint8))


# ---- 7


def test_license_base(spark, sample, sample_rows, corners):
    extra = [(1, "MIT  License, mit license; CC BY cc-by"), (2, "cc by by"), (3, "spdx-license-identifier: (MIT or GPL-2.0+) and BSD-3-Clause"), (4, None)]
    for df, rows in ((sample, sample_rows), (corners, corner_texts()), (documents(spark, extra), extra)):
        wanted = Counter()
        for d, t in rows:
            w = FOLDED.findall(fold(t))
            found = sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
            wanted[d, len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))] += 1
        out = licenses.license_scan(df).collect()
        assert Counter(tuple(r)[:6] for r in out) == wanted
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    assert licenses.license_scan(sample.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, labels, free",
    [("MIT", {"mit"}, 1.0), ("(MIT OR GPL-2.0+) AND BSD-3-Clause", {"mit", "gpl", "bsd"}, 1.0), ("MIT AND GPL-2.0", {"mit", "gpl"}, 0.0), ("GPL-2.0 WITH Classpath-exception-2.0 OR Apache-2.0", {"gpl", "apache"}, 1.0), ("((MIT", {"mit"}, 1.0), ("", set(), 0.0), ("OR MIT", set(), 0.0)],
)
def test_expressions(text, labels, free):
    assert licenses.evaluate(licenses.parse_expression(text)) == (labels, free)


# ---- 9


def test_url_rules(spark):
    urls = [
        "http://A.example.ORG/es/1", "https://example.org/en/12?x#y", "http://x.example.org/en/2", "http://shop.com/fr/a", "http://a.com/de/1", "http://a.com/De/1", "http://a.com",
        "no scheme", None, "", "http://", "x://h#/de/", "ftp://b.net?q=://c.com/de/", "http://notexample.org/es/", "http://myexample.org.de/es/", "http://com/fr/1",
    ]
    rows = [(k, u, None if k % 2 else '<a href="http://a.com/1">') for k, u in enumerate(urls)] + [(None, "http://a.com/de/1", "")]
    out = {(r["page_id"]): r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit(1))).collect()}
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    for k, u in enumerate(urls):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (fold(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = out[k]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] in ("allow", "block") and (not fits or r["verdict"] == max(fits)[2])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(empty).count() == 0


def test_spread_equals_power_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0), ("e", "d", 1.0)]
    seeds = {"a": (1.0, 0.0), "d": (0.0, 1.0)}
    out = url_filter.spread(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), iterations=8)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in out.collect()}
    hosts = "abcde"
    state = {h: seeds.get(h, (0.0, 0.0)) for h in hosts}
    for _ in range(8):
        new = {h: [0.3 * x for x in seeds.get(h, (0.0, 0.0))] for h in hosts}
        for s, d, w in edges:
            new[d][0] += 0.7 * state[s][0] * w / sum(x for a, _, x in edges if a == s)
            new[s][1] += 0.7 * state[d][1] * w / sum(x for _, b, x in edges if b == d)
        state = {h: tuple(v) for h, v in new.items()}
    for h in hosts:
        assert got.get(h, (0.0, 0.0)) == pytest.approx(state[h])


# ---- 6


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9))) for _ in range(300)]
    rows, labels = [], []
    for k in range(900):
        w = list(rng.choice(vocabulary, 40))
        if k % 5 == 0:
            w[int(rng.integers(0, 40))] = ["grumblefuz", "grumblefuz", "gr4mblefuz".replace("4", "u"), "g r u m b l e f u z"][k // 5 % 4]
        rows.append((k, " ".join(w)))
        labels.append((k, 1 if k % 5 == 0 else 0))
    rows += [(1000, "some grumbl3fuz here"), (1001, "so grummmmblefuz"), (1002, "gr-um-ble-fuz is"), (1003, None), (1004, ""), (None, "grumblefuz"), (1005, "plain words"), (1005, "plain words")]
    docs = documents(spark, rows)
    return docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity(spark, toxic_corpus):
    docs, labels = toxic_corpus
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    by_id = {r["doc_id"]: r for r in out}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert {r["doc_id"] for r in held} == {k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1}
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert [by_id[k]["predicted"] for k in (1000, 1001, 1003, 1004, 1005, None)] == [1, 1, 0, 0, 0, 1]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 - r["predicted"] for r in out)
    assert toxicity.toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity_scores(docs.limit(5), labels.limit(0)).collect()} == {0}


def test_labels_of_held_out_rows_change_nothing(spark, toxic_corpus):
    docs, labels = toxic_corpus
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    few = docs.where("doc_id < 300")
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(few, x).collect()) for x in (labels, other))
    assert a == b


def test_words_written_with_doubled_letters_and_in_pieces(spark, toxic_corpus):
    reader = toxicity.Reader(toxicity.character_model(toxic_corpus[0]), {"grumblefuz": 0, "fuz": 1})
    for text in ("ggrumblefuz", "grrumblefuz", "so (grumbblefuzz)!", "grum blefuz", "a g rum ble fuz.", "g r u m b l e f u z", "g  r\tu\nm b l e f u z", "a g r u m b l e f u z b", "gr\numble\tfuz"):
        assert 0 in reader.features(text), text
    for text in ("f u z", "f  u\tz", "a f u z b", "f\nu\nz", "ffuz", "fuuz", "fu z"):
        assert 1 in reader.features(text), text
    without_letters = toxicity.Reader(toxicity.character_model(documents(spark, [(1, "some oat " * 500)])), {"oat": 0})
    assert without_letters.features("so 0@+") and without_letters.features("0-4-7,")
    for text in ("grum other blefuz", "fu zoo", "grumble", "f u", "1990 2024", "", "... -- !"):
        assert not reader.features(text), text


# ---- 1


def lines_kept(rows, percent=80):
    """First occurrence of each component of similar lines, by all pairs."""
    size = line_dedup.SHINGLE

    def grams(x):
        x = x.ljust(size, "\0")
        return {x[k : k + size] for k in range(len(x) - size + 1)}

    first = {}
    for d, t in rows:
        if d is not None and t is not None:
            for k, line in enumerate(t.split("\n")):
                if x := line.strip():
                    first[x] = min(first.get(x, (d, k)), (d, k))
    known = sorted(first)
    sets = {x: grams(x) for x in known}
    links = [(a, b) for i, a in enumerate(known) for b in known[:i] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = smallest(links, known)
    keep = {}
    for x in known:
        keep[root[x]] = min(keep.get(root[x], first[x]), first[x])
    out = Counter()
    for d, t in rows:
        whole = (t or "").split("\n") if t is not None else []
        good = [line for k, line in enumerate(whole) if d is None or not line.strip() or keep[root[line.strip()]] == (d, k)]
        out[d, len(whole), len(whole) - len(good), None if t is None else "\n".join(good)] += 1
    return out


def test_line_dedup(spark):
    a = "this line of text is long enough to be compared with others and to have many shingles in it"
    texts = [(0, a + "\nother\n\n" + a), (1, "  " + a + "  \nnew line"), (2, a.replace("others", "otters")), (3, None), (4, ""), (5, "other"), (6, "oth"), (None, a), (7, "new line"), (7, "new line"), (8, "y" * 30_000 + "\n" + "\n" * 50)]
    for df, rows in ((documents(spark, texts), texts),):
        out = line_dedup.dedup_lines(df).select("row.doc_id", "n_lines", "n_removed", "kept")
        assert Counter(tuple(r) for r in out.collect()) == lines_kept(rows)
    assert set(line_dedup.dedup_lines(documents(spark, texts)).select("row.*").columns) == set(documents(spark, texts).columns)
    assert line_dedup.dedup_lines(documents(spark, texts).limit(0)).count() == 0


def test_line_at_the_threshold_and_very_long_lines(spark):
    """A pair of exactly 80 % that shares a band by its construction, one just below, and lines of five million characters."""
    rng = np.random.default_rng(2)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    size = line_dedup.SHINGLE

    def grams(x):
        return {x[k : k + size] for k in range(len(x) - size + 1)}

    text = lambda n: "x" + "".join(rng.choice(alphabet, n)).strip() + "x"
    pairs, at = [], 0
    while at < 3:  # 72 shingles in common, 9 of its own each: 72 / 90
        common, ends = text(77)[:79], (text(20)[1:10], text(20)[1:10])
        a, b = (common + e for e in ends)
        if len(grams(a) & grams(b)) * 100 == 80 * len(grams(a) | grams(b)):
            at += 1
            pairs.append((a, b))
    below = (text(77)[:78],) * 2
    pairs.append((below[0] + "0123456789", below[1] + "9876543210"))
    rows = [(10 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)]
    long = "".join(rng.choice(alphabet, 5_000_000)).strip()
    rows += [(900, long), (901, long[:2_500_000] + "!" + long[2_500_000:]), (902, long[: 2_000_000])]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_removed")
    got = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    assert got[901] == 1 and got[900] == got[902] == 0
    assert not any(got[d] for d in (0, 10, 20, 30, 31))
    bands = [line_dedup.line_bands(list(p)) for p in pairs[:3]]
    assert [got[10 * k + 1] for k in range(3)] == [int((b[0] == b[1]).any()) for b in bands] == [1, 1, 1]


def test_a_line_with_a_third_of_all_rows(spark):
    rows = [(k, f"a very common line of the corpus\nits own line number {k} {k * 7919}") for k in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_lines", "n_removed", "kept")
    assert Counter(tuple(r) for r in out.collect()) == lines_kept(rows)


def test_line_dedup_of_a_corpus(spark, sample, sample_rows):
    small = [r for r in sample_rows if r[0] < 60]
    out = line_dedup.dedup_lines(sample.where("doc_id < 60")).select("row.doc_id", "n_lines", "n_removed", "kept")
    assert Counter(tuple(r) for r in out.collect()) == lines_kept(small)


def test_lines_that_only_repeat_are_no_candidates(spark, monkeypatch):
    """A line's own copies in other batches share all keys with it, but make no group of different lines."""
    line = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    rows = [(k, f"{line(k % 7)}\n{line(10 + k % 5)}") for k in range(70)]
    asked = []
    link_groups = line_dedup.link_groups
    monkeypatch.setattr(line_dedup, "link_groups", lambda member, *rest: asked.append(member.count()) or link_groups(member, *rest))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("row.doc_id", "n_lines", "n_removed", "kept")
    assert Counter(tuple(r) for r in out.collect()) == lines_kept(rows)
    assert asked == [0]


def test_places_of_repeated_lines_in_odd_rows(spark):
    """Rows of one id with different texts, whole rows again, lines that stand several times in one row, extreme ids."""
    a, b = "the first line of some that are alike in most of their characters 1", "the first line of some that are alike in most of their characters 2"
    rows = [(5, a + "\n" + b), (5, b + "\n" + a), (5, a + "\n" + b), (-(2**63), "x\n\n x \nx"), (2**63 - 1, "x\n" + a), (6, "y\ny"), (7, "z")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("row.doc_id", "n_lines", "n_removed", "kept")
    assert Counter(tuple(r) for r in out.collect()) == lines_kept(rows)


def test_sets_are_read_of_members_with_a_near_partner_only():
    sketches = np.array([[0], [1], [0], [2**64 - 1], [0], [0], [2**64 - 1], [2**64 - 1]], np.uint64)
    root = np.array([0, 1, 2, 3, 4, 5, 6, 6])
    side = np.array([0, 1, 0, 1, 2, 2, 2, 2])
    good = linking.worth_reading(side, root, sketches, np.array([0, 2, 4, 8]), 0.5)
    assert good.tolist() == [True, True, False, False, True, True, False, False]
    values = np.array([5, 2**63, 2**63 + 1, 5, 2**63, 0], np.uint64)
    assert linking.numbered(values).tolist() == [1, 2, 3, 1, 2, 0] and not len(linking.numbered(values[:0]))
