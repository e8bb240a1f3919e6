"""The trie of conversations against plain Python, with conversations that many tasks share."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SPACED

from pelagia.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest(), (role, text)))
    own = {c: [x for _, _, x in sorted(v)] for c, v in own.items()}
    members, words = defaultdict(list), {}
    ended = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20  # towards zero
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ended[tuple(path)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        own_words = len(SPACED.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * own_words
    ids = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node], leaves[node], saved[node], ids(ended[node])) for node, who in members.items()
    )


def found(df, rows):
    odd = df.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("node", "part", "base", "depth")})
    out = prefix_trie.prefix_trie(odd)
    assert out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint", "string"}
    return sorted(tuple(r) for r in out.collect())


def test_trie_corner_cases(spark):
    rows = [
        (0, 0, "user", "a b c"), (0, 1, None, "d"), (0, 2, "user", None), (0, 3, "user", "last"), (1, 0, "user", "a b c"), (1, 1, "", "d"), (1, None, "system", "first"),
        (1, 1, "", "d"), (1, 1, "", "d"), (7, 5, "x", "ä ö"), (7, 5, "x", "ä ö"), (7, 4, "y", " \t"), (41, 0, "u", "t"), (45, 0, "u", "t"), (45, 1, "u", "w " * 50_000),
        (-5, 0, "user", "a b c"), (-25, 0, "u", "t"), (-40, 0, "u", "z"), (-19, 2, "u", "t"), (-19, 1, "u", "q"), (None, 0, "u", "t"), (None, None, None, None), (9, None, None, None),
        (10**17, 1, "us", "er:"), (10**17 + 3, 1, "user", ":"), (12, 0, "1:a", "b"), (13, 0, "1", "a:b"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "t")]) == []
    assert found(spark, [(41, 0, "u", "t")]) == brute([(41, 0, "u", "t")])


@pytest.mark.parametrize("seed", range(2))
def test_trie_with_hot_groups_over_many_parts(spark, monkeypatch, seed):
    """A third of the turns are of one conversation, a third are one conversation that many hold; tables are merged in rounds."""
    rng = np.random.default_rng(seed)
    rows = [(0 if seed else 3, k // 2, "u", f"t{k % 5}") for k in range(150)]
    rows += [(c, t, "u", f"common {t}") for c in range(40, 90) for t in range(3)]
    rows += [(int(c), int(rng.integers(0, 6)), "u", f"x{rng.integers(0, 3)}") for c in rng.integers(-60, 60, 150)]
    monkeypatch.setattr(prefix_trie, "NODES", 40)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_paths_that_hang_on_each_other(spark):
    """Conversation k leaves that of k - 1 one turn later: as many paths below each other as there are conversations."""
    ids = [20 * k for k in range(12)]  # multiples keep their own turns
    rows = [(c, t, "u", f"way {t}" if t < k else f"own {k} {t}") for k, c in enumerate(ids) for t in range(k + 2)]
    assert found(spark, rows) == brute(rows)
