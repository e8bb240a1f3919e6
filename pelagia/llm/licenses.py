"""Licence scans: one Aho-Corasick pass finds tags and notice phrases, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded_words

# Phrases of the base rule and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version 2 0": "apache",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Words before an expression, as an identifier tag has them.
TAG = "spdx license identifier"
# Beginnings of licence identifiers and their labels; the longest that fits counts.
IDENTIFIERS = {
    "agpl": "agpl", "apache": "apache", "bsd": "bsd", "cc-by": "cc-by", "cc0": "cc0", "epl": "epl", "gpl": "gpl",
    "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "public-domain",
}
PERMISSIVE = frozenset(["apache", "bsd", "cc-by", "cc0", "isc", "mit", "public-domain"])
_EXPRESSION = re.compile(r"[ \t:]*((?:[ \t]*(?:\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*))+)")
_TAG = re.compile(r"spdx-license-identifier", re.IGNORECASE)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def identifier_label(name: str) -> str | None:
    """Label of a licence identifier, or None."""
    fits = [k for k in IDENTIFIERS if name == k or name.startswith((k + "-", k + "+"))]
    return IDENTIFIERS[max(fits, key=len)] if fits else None


def parse_expression(text: str) -> list[tuple[str, str]]:
    """Postfix form of an and/or/with expression by the shunting-yard method: ("id", name) or ("op", name).

    Reading ends before the first word that can't continue the expression; unbalanced brackets are closed.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []
    operand = True  # an operand is due
    for token in re.findall(r"\(|\)|[a-z0-9][a-z0-9.+-]*", text.lower()):
        token = token.rstrip(".-") or token
        if token == "(" and operand:
            held.append(token)
        elif token == ")" and not operand and "(" in held:
            while (top := held.pop()) != "(":
                out.append(("op", top))
        elif token in _PRECEDENCE and not operand:
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(("op", held.pop()))
            held.append(token)
            operand = True
        elif operand and token not in _PRECEDENCE and token not in "()":
            out.append(("id", token))
            operand = False
        else:
            break
    out += [("op", x) for x in reversed(held) if x != "("]
    return out


def evaluate(postfix: list[tuple[str, str]]) -> tuple[set[str], float]:
    """Labels named by an expression, and how freely it can be used: 1 permissive, 0 not.

    ``and`` needs both sides (the smaller value), ``or`` is a choice (the larger), ``with`` keeps its licence.
    An operator that lacks a side is skipped.
    """
    stack: list[tuple[set[str], float]] = []
    for kind, name in postfix:
        if kind == "id":
            label = identifier_label(name)
            stack.append(({label} if label else set(), 1.0 if label in PERMISSIVE else 0.0))
        elif len(stack) > 1:
            (more, right), (labels, left) = stack.pop(), stack.pop()
            if name == "with":
                stack.append((labels, left))
            else:
                stack.append((labels | more, min(left, right) if name == "and" else max(left, right)))
    return stack[-1] if stack else (set(), 0.0)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICE_PHRASES), ("base", BASE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            key = f" {phrase} "
            found.add_word(key, (kind, label, len(key), f"{kind}:{phrase}"))
    found.make_automaton()
    return found


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = folded_words(text)
    line = " " + b" ".join(words).decode("utf-8", "replace") + " "
    base, labels, places, tagged, phrases, word, seen = set(), set(), [], False, set(), 0, 0
    for end, (kind, label, length, phrase) in automaton.iter(line):
        if kind == "base":
            begin = end - length + 1
            if begin >= seen:
                word, seen = word + line.count(" ", seen, begin), begin
                places.append(word)
            else:
                places.append(line.count(" ", 0, begin))
            base.add(label)
        elif kind == "notice":
            labels.add(label)
        else:
            tagged = True
        phrases.add(phrase)
    freedom = 0.0
    if tagged:
        whole = text.decode("utf-8", "replace")
        for m in _TAG.finditer(whole):
            if e := _EXPRESSION.match(whole, m.end()):
                named, free = evaluate(parse_expression(e[1]))
                labels |= named
                freedom = max(freedom, free)
    score = 1.0 - 0.5 ** (len(phrases) + (1 if tagged else 0))
    labels |= base
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score if labels else 0.0, freedom if tagged else None,
    )


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"


def _scans(batches):
    automaton = _automaton()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        rows = [(d, *scan(t, automaton)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence mentions of every whole text, a row a document.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are null without
    one. ``labels`` adds notices and the identifiers of tagged expressions to the base labels; ``score``
    (0 without a label) rises with the number of different phrases found; ``freedom`` is the value of the
    freest tagged expression, null without a tag. Null and empty texts have no words; null and repeated
    ids are rows like any other; other columns are ignored; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(_scans, _SCHEMA)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
