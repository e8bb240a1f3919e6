"""DuckDB SQL for the operators that SQL can express, each over its whole tables."""

from __future__ import annotations

from .decontam import LOWER, UPPER

#: Fixed value: words of digits, letters a-z and non-ASCII characters.
_FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed value: words of anything but space and 0x09-0x0D.
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(pattern: str, lower: bool = True) -> str:
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')" if lower else "coalesce(text, '')"
    return f"regexp_extract_all({text}, '{pattern}')"


DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words(_FOLDED)} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_FOLDED)} AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n),
found AS (SELECT r, p.n, s, item FROM (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM places) p JOIN windows USING (n, t)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS k FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, {_words(_SPACED, lower=False)} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50),
windows AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS t FROM starts),
firsts AS (SELECT t, min(doc_id) AS lowest FROM windows GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k FROM windows JOIN firsts USING (t) WHERE doc_id > lowest),
removed AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
places AS (SELECT doc_id, w, coalesce(ks, []) AS ks FROM docs LEFT JOIN removed USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ks) AS BIGINT) AS n_removed,
       sha256(CASE WHEN len(ks) = 0 THEN array_to_string(w, ' ')
                   ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]), ' ') END) AS kept_sha256
FROM places
"""

NEAR = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words(_SPACED)} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS x FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS common FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT p, q FROM shared JOIN sizes s ON p = s.doc_id JOIN sizes t ON q = t.doc_id WHERE 100 * common >= 80 * (s.n + t.n - common)),
reach AS (SELECT p AS x, p AS y FROM links UNION SELECT reach.x, links.q FROM reach JOIN links ON reach.y = links.p),
lowest AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id,
       coalesce(component, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON d.doc_id = x
"""

#: Fixed value: terms of digits, letters and non-ASCII characters.
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words(_TERMS)} AS w FROM documents),
held AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM held),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_words(_TERMS)}) AS term FROM benchmark) GROUP BY ALL),
found AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(N_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM found, whole GROUP BY term),
scored AS (SELECT item_id, r, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_docs) // L)))) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN found USING (term), whole WHERE doc_id IS NOT NULL GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""

#: Unsigned crc32 of a number's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
         lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), CAST(4294967295 AS BIGINT))"""

TRIE = f"""
WITH rows AS (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, ''))) AS x, len({_words(_SPACED, lower=False)}) AS n
              FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS xs, list(n ORDER BY turn NULLS FIRST, x) AS ns, {_CRC} % 4 AS h FROM rows GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.xs[1:c.h], []), c.xs[c.h + 1:]) AS xs, list_concat(coalesce(b.ns[1:c.h], []), c.ns[c.h + 1:]) AS ns
            FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, xs, ns, unnest(range(0, len(xs) + 1)) AS d FROM rebuilt),
named AS (SELECT conv_id, d, xs[1:d] AS path, array_to_string(xs[1:d], ',') AS k, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(xs) AS ended FROM steps),
nodes AS (SELECT k, d, any_value(path) AS path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM named GROUP BY k, d),
kids AS (SELECT array_to_string(path[1:d - 1], ',') AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k, d)),
under AS (SELECT array_to_string(path[1:a], ',') AS k, a AS d, n_children, (n_convs - 1) * n AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM whole)),
sums AS (SELECT k, d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM under GROUP BY k, d)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (k, d) LEFT JOIN nodes p ON w.d > 0 AND p.d = w.d - 1 AND p.k = array_to_string(w.path[1:w.d - 1], ',')
"""

ORACLE_SQL = {
    "op11_conversation_prefix_trie": TRIE,
    "op13_ranked_lexical_search": SEARCH,
    "op2_benchmark_decontamination": DECONTAMINATION,
    "op8_substring_dedup": SUBSTRINGS,
    "op10_minhash_near_dedup": NEAR,
}
