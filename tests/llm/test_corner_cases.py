"""Corner cases of operators that earlier tests leave out."""

import time
from collections import defaultdict

import numpy as np
from test_llm_operators import documents, words

from pelagia.llm import substring_dedup, toxicity, url_filter


def test_substrings_of_the_smallest_id_and_of_rows_without_one(spark):
    text = " ".join(words(60, 3))
    rows = [(-(1 << 63), text), (5, text), (None, text), (None, text), (None, None), (7, "other words")]
    out = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()]
    want = [(-(1 << 63), 60, 0, text), (5, 60, 60, ""), (None, 60, 0, text), (None, 60, 0, text), (None, 0, 0, ""), (7, 2, 0, "other words")]
    assert sorted(out, key=str) == sorted(want, key=str)


def chain(n):
    """Host k links to host k - 1; host 0 has a blocked page."""
    pages = [(0, "http://h0.com/de/1", "")]
    return pages + [(k, f"http://h{k}.com/", f'<a href="http://h{k - 1}.com/">') for k in range(1, n)]


def test_hosts_far_from_a_blocked_one_are_blocked(spark):
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(chain(25), "page_id long, url string, html string")).collect()}
    assert len(out) == 25 and set(out.values()) == {"block"}


def test_verdicts_against_plain_ranks(spark):
    rng = np.random.default_rng(11)
    pages = []
    for k in range(120):
        host = f"h{rng.integers(0, 12)}.com"
        path = rng.choice(["/fr/1", "/de/1", "/x", "/x", "/x", "/x"])
        html = "".join(f'<a href="http://h{rng.integers(0, 12)}.com/">' for _ in range(rng.integers(0, 4)))
        pages.append((k, f"http://{host}{path}", html))
    pages += [(1000 + k, None, "<p>") for k in range(60)] + [(0, *pages[0][1:])] * 2 + [(2000, "http://h1.com/x", "<p>" + "long " * 200_000)]
    out = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(out) == len(pages)
    weight, seeds = defaultdict(float), {"allow": defaultdict(float), "block": defaultdict(float)}
    for _, url, html in pages:
        if url:
            host = url.split("/")[2]
            for other in html.split("http://")[1:]:
                if other.split("/")[0] != host:
                    weight[host, other.split("/")[0]] += 1
            for mark, verdict in (("/fr/", "allow"), ("/de/", "block")):
                if mark in url:
                    seeds[verdict][host] += 1
    hosts = sorted({h for e in weight for h in e} | set(seeds["allow"]) | set(seeds["block"]))
    ranks = {}
    for verdict in ("allow", "block"):
        start = np.array([seeds[verdict][h] for h in hosts]) / sum(seeds[verdict].values())
        step = np.zeros((len(hosts), len(hosts)))
        for (a, b), w in weight.items():
            a, b = (a, b) if verdict == "allow" else (b, a)
            step[hosts.index(b), hosts.index(a)] += w
        total = step.sum(axis=0)
        step = step / np.where(total > 0, total, 1)
        for k in np.flatnonzero(total == 0):  # such mass returns to the seeds
            step[:, k] = start
        ranks[verdict] = np.linalg.solve(np.eye(len(hosts)) - 0.7 * step, 0.3 * start)
    for r in out:
        trust, distrust = (ranks[v][hosts.index(r["host"])] if r["host"] in hosts else 0.0 for v in ("allow", "block"))
        assert abs(r["trust"] - trust) < 1e-3 and abs(r["distrust"] - distrust) < 1e-3
        if r["rule"] is None:
            assert r["verdict"] == ("block" if distrust > trust else "allow")


def readings(restorer, observed):
    """All source words that a lattice can give, with their costs."""
    out = {}
    ways = [("", 0, 0, 0.0)]
    previous = ""
    for sign in observed:
        new = []
        for word, a, b, cost in ways:
            for c, extra in restorer.options(sign, previous):
                if c:
                    new.append((word + toxicity.LETTERS[c - 1], b, c, cost + extra + float(restorer.model[a, b, c])))
                else:
                    new.append((word, a, b, cost + extra + 2.0))
        ways, previous = new, sign
    for word, a, b, cost in ways:
        cost += float(restorer.model[a, b, 0])
        out[word] = min(cost, out.get(word, cost))
    return out


def test_decoder_finds_the_cheapest_of_all_readings():
    rng = np.random.default_rng(2)
    restorer = toxicity.Restorer(rng.random((64, 64, 64)) * 6)
    for observed in ("1d10t", "h3||0", "f*o", "*#", "aabb", "a-b-c", "$€(", "7-#", "ß0", "9", "l33+", "!!", "…a", "x1x1x1"):
        costs = readings(restorer, observed)
        assert costs[restorer.restore(observed)] <= min(costs.values()) + 1e-9


def test_very_long_runs_of_signs_are_read_in_time():
    reader = toxicity.Reader(np.random.default_rng(3).random((64, 64, 64)), {"bad": 0, "badly": 1})
    begin = time.monotonic()
    for text in ("*" * 1_000_000, "#-" * 500_000, "a" * 1_000_000, "1* " * 300_000, "a b " * 250_000, "*a" * 32):
        assert reader.features(text) == set()
    assert reader.features("-" * 500_000 + "bad" + "-" * 500_000 + " " + "=" * 100 + "badly") == {0, 1}
    assert time.monotonic() - begin < 30
    assert toxicity.pieces_of("*" * 900) == ["****"] and toxicity.pieces_of("ab") == ["ab"]
    assert toxicity.pieces_of("abc " * 50) == ["abc"] and toxicity.pieces_of("abcdefgh" * 9) == []


def test_equal_and_very_long_texts_have_their_scores(spark):
    toxic, clean = "some snarglefitz here", "some flower here"
    texts = [(k, toxic if k % 3 == 0 else f"{clean} {k}") for k in range(120)] + [(500, "word " * 100_000 + "snarglefitz"), (501, "word " * 100_000), (0, toxic)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    # a word in texts that differ, so that it can be learned
    texts += [(1000 + k, f"{toxic} {k} times") for k in range(60)]
    labels = labels.union(spark.createDataFrame([(1000 + k, 1) for k in range(60)], "doc_id long, toxic int"))
    out = toxicity.toxicity_scores(documents(spark, texts), labels).collect()
    scores = defaultdict(set)
    for r in out:
        scores[r["doc_id"]].add(round(r["score"], 12))
    assert len(out) == len(texts) and all(len(x) == 1 for x in scores.values())
    assert min(scores[500]) >= 0.7 > max(scores[501])


def test_chunks_that_lead_elsewhere_have_no_wanted_feature():
    """What is skipped by its first letters has none of the wanted features when it is read in full."""
    rng = np.random.default_rng(8)
    model = np.random.default_rng(3).random((64, 64, 64)) * 4
    wanted = {"bad": 0, "banan~": 1, "no": 2, "ugly": 3, "ugly~": 4, "ägg": 5, "bbad": 6}
    reader = toxicity.Reader(model, wanted)
    texts = ["".join(rng.choice(list("bandouglyä@4!-*.1"), rng.integers(1, 9))) for _ in range(4000)] + ["bad", "baad", "b-a-d", "ugly", "uglyish", "(no", "nO", "ägg", "b4d", "bad" * 30, "no."]
    for text in texts:
        full = set(reader._of_chunk(text.lower()))
        assert reader.features(text) == full
        if toxicity.Reader._leads_elsewhere(reader, text[:3].lower()) and len(text) <= toxicity.LONGEST:
            assert not full
    assert reader.features("bad") == {0} and reader.features("uglyish") == {4}


def test_workers_give_back_what_encoding_held():
    from pelagia.llm import tokens, toxicity

    path = tokens.default_vocabulary()
    first = [list(tokens.tokenizer(path).encode(["some words, and more words"]))]
    assert tokens._loaded
    list(toxicity._count_rows([]))  # a task of another operator in the same worker
    assert not tokens._loaded
    assert [list(tokens.tokenizer(path).encode(["some words, and more words"]))] == first


def test_new_words_of_several_texts_are_learned_at_once(monkeypatch):
    from pelagia.llm import tokens

    texts = [None, "", "İx <|a", *(f"neu{k}wort, other{k} 12{k} ж{k}. neu{k}wort" for k in range(300)), "\x1c a\x1db", "Neu1wort NEU2WORT"]
    t = tokens.WordTokenizer(tokens.default_vocabulary())
    want = [np.array(e.ids, "<u4").tobytes() for e in t.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    calls, raw = [], t._raw
    monkeypatch.setattr(t, "_raw", lambda x: calls.append(len(x)) or raw(x))
    assert list(t.encode(texts)) == want and len(calls) < 30
    monkeypatch.setattr(tokens, "RUN_CHARS", 100)
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 20)
    assert list(tokens.WordTokenizer(tokens.default_vocabulary()).encode(texts)) == want
    assert list(t.encode([])) == []


def test_words_of_any_bits_are_packed_like_the_longest_fit():
    from pelagia.llm import token_output as to

    rng = np.random.default_rng(3)
    for n in (1, 2, 59, 60, 61, 500):
        v = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        v[rng.random(n) < 0.4] = 0
        words, escapes = to.pack(v)
        assert (to.unpack(words, escapes, n) == v).all()
        kinds, at = [], 0
        while at < n:
            k = next((k for k, (c, b) in enumerate(to.PACKINGS) if all(int(x) >> b == 0 for x in v[at : at + c])), to.ESCAPE)
            kinds.append(k)
            at += to.PACKINGS[k][0] if k != to.ESCAPE else 1
        assert (np.frombuffer(words, "<u8") >> np.uint64(60)).tolist() == kinds
