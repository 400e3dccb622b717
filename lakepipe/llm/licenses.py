"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases in one pass over the words, and a
shunting-yard parser reads the and/or/with expression behind a tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import WORD

#: Fixed values of the contract: phrase -> label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, written as their words, -> label.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "licensed under the": "notice",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
#: Words of a tag; the expression behind it is read from the raw text.
TAGS = ("spdx license identifier", "license identifier")
TAG_SIGN = re.compile(r"(?:spdx-license-identifier|license-identifier)\s*[:=]\s*", re.IGNORECASE)
TOKEN = re.compile(r"[()\r\n]|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
RANK = {"or": 1, "and": 2, "with": 3}
_WORD = re.compile(WORD)
SHOWN = ("notice",)  # marks a phrase that raises the score but names no license


def parse_expression(text: str, start: int = 0) -> list[str] | None:
    """Postfix form of the licence expression that begins at ``start``, or None if there is none.

    ``with`` binds closest, then ``and``, then ``or``; operators in any case. It ends with its line; what follows a
    complete expression is ignored, so a tag may stand in the middle of prose. Behind a dangling operator, what was
    complete before counts.
    """
    tokens: list[str] = []
    operand = True  # what may come next
    depth = complete = 0  # open parentheses; tokens up to which all are closed
    for match in TOKEN.finditer(text, start):
        token = match[0]
        low = token.lower()
        if token in "\r\n":
            break
        if operand:
            if token == ")" or low in RANK:
                break
            depth += token == "("
            operand = token == "("
        elif low in RANK:
            operand = True
        elif token == ")" and depth:
            depth -= 1
        else:
            break
        tokens.append(low)
        if not operand and not depth:
            complete = len(tokens)
    return _postfix(tokens[:complete] if operand else tokens)


def _postfix(tokens: list[str]) -> list[str] | None:
    out: list[str] = []
    stack: list[str] = []
    for token in tokens:
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token.rstrip(".:"))
    return out + [t for t in reversed(stack) if t != "("] or None


def evaluate(postfix: list[str]) -> frozenset[frozenset[str]]:
    """Ways to satisfy the expression: each a set of licenses that hold together."""
    stack: list[frozenset[frozenset[str]]] = []
    for token in postfix:
        if token not in RANK:
            stack.append(frozenset([frozenset([token])]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(left | right)
        elif token == "and":
            stack.append(frozenset(a | b for a in left for b in right))
        else:  # an exception belongs to the license before it
            stack.append(frozenset(frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right))
    return stack[0]


def named(postfix: list[str]) -> set[str]:
    """Licenses of an expression of any length; what stands behind a ``with`` stays out."""
    begins: list[int] = []
    behind = [0] * (len(postfix) + 1)  # +1 where the right side of a ``with`` begins, -1 where it ends
    for i, token in enumerate(postfix):
        if token not in RANK:
            begins.append(i)
            continue
        right = begins.pop()  # the left side's begin is that of the whole
        if token == "with":
            behind[right] += 1
            behind[i] -= 1
    return {t for t, n in zip(postfix, accumulate(behind), strict=False) if t not in RANK and not n}


def expression_labels(text: str) -> set[str]:
    """Licenses named by an expression; an exception stays out."""
    return named(parse_expression(text) or [])


def build_automaton(phrases: dict[str, str], base: frozenset[str]) -> ahocorasick.Automaton:
    """Phrases as words between single spaces -> (is base, label, length)."""
    automaton = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        automaton.add_word(f" {phrase} ", (phrase in base, label, len(phrase) + 2))
    automaton.make_automaton()
    return automaton


def scan_text(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions)."""
    words = _WORD.findall((text or "").encode("utf-8").lower().decode("utf-8"))
    line = f" {' '.join(words)} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    expressions: set[str] = set()
    notices = tags = 0
    passed = count = 0  # spaces before ``passed``: the automaton reports ends in order
    for end, (is_base, label, size) in automaton.iter(line):
        begin = end - size + 1
        if begin >= passed:
            count += line.count(" ", passed, begin)
            place, passed = count, begin
        else:
            place = count - line.count(" ", begin, passed)
        if is_base:
            starts.append(place)
            base.add(label)
        elif label == "tag":
            tags += 1
        elif label in SHOWN:
            notices += 1
        if label != "tag" and label not in SHOWN:
            labels.add(label)
            notices += not is_base
    if tags:
        for match in TAG_SIGN.finditer(text or ""):
            postfix = parse_expression(text, match.end()) or []
            labels |= named(postfix)
            expressions.add(" ".join(postfix))
        expressions.discard("")
    # each independent sign halves the doubt that is left
    signs = len(starts) + notices + 2 * tags
    score = 1.0 - 0.5 ** min(signs, 30) if labels else 0.0
    joined = lambda found: ",".join(sorted(found))
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, joined(base), joined(labels), score, joined(expressions)


FIELDS = (
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("expressions", pa.string()),
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base_phrases: dict[str, str] = BASE_PHRASES,
    notice_phrases: dict[str, str] = NOTICE_PHRASES,
) -> DataFrame:
    """One row per input row: id and the scan's columns.

    ``n_base`` counts every place of a base phrase, overlapping ones too. Words are counted from 0; without a base place
    ``first_word`` and ``last_word`` are null. Null or empty text: no words, empty labels, score 0. Repeated rows are
    scanned each for itself. ``expressions`` are the distinct expressions behind tags in postfix form, split by commas:
    ``evaluate`` tells the ways to satisfy one, which may be too many to list.
    """
    phrases = {**notice_phrases, **base_phrases, **{t: "tag" for t in TAGS}}
    base = frozenset(base_phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(phrases, base)
        for batch in batches:
            rows = [scan_text(t.as_py(), automaton) for t in batch.column("_text")]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["_id", *(n for n, _ in FIELDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, expressions string"
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(scan, schema).withColumnRenamed("_id", id_col)
