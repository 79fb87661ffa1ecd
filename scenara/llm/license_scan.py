"""License scan: phrases and identifier tags, and the value of licence expressions.

One Aho-Corasick automaton runs over the words of a text, joined by single
blanks, and finds notice phrases and the tag ``SPDX-License-Identifier``. Behind
a tag stands an expression of identifiers, ``AND``, ``OR``, ``WITH`` and
parentheses; a shunting-yard parser turns it into postfix form, from which the
identifiers and the expression's value are read: ``OR`` needs one side that is
permitted, ``AND`` needs both, ``WITH`` keeps its left side.

The scan is one pass without a shuffle; the automaton is a fixed small table.

Defined results: A-Z is lower-cased, words are runs of digits, letters a-z and
everything beyond ASCII. A missing or empty text has no words and no labels
(empty strings), score 0. Every tag has an expression of its own, up to the next
tag or the end of the line; inside parentheses it runs over line ends. A tag
without a readable expression counts as a tag only. Rows that repeat are scanned one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and labels (fixed values).
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Phrases of the method's own.
MORE_PHRASES = {
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
    "public domain": "public-domain",
}

TAG = "spdx license identifier"

#: First part of an identifier to label, and whether the label is permitted.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "isc": "isc", "cc0": "public-domain", "unlicense": "public-domain"}
PERMITTED = frozenset({"mit", "apache", "bsd", "isc", "mpl", "cc-by", "public-domain"})

NO_WORD = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
TO_WORDS = bytes.maketrans(
    NO_WORD + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(NO_WORD) + b"abcdefghijklmnopqrstuvwxyz"
)
#: The tag where the automaton finds it: whole words, only ASCII between them.
TAG_AT = re.compile(r"(?<![0-9a-z\x80-\U0010ffff])spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier(?![0-9a-z\x80-\U0010ffff])", re.I | re.A)
TOKEN = re.compile(r"\(|\)|[\r\n]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(text: str, start: int = 0, end: int | None = None) -> list[str] | None:
    """The expression from ``start`` on in postfix form; None if it is not well formed.

    Reading stops at ``end``, at a line end outside parentheses, and where a word
    follows an operand without an operator.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for match in TOKEN.finditer(text, start, len(text) if end is None else end):
        token = match[0]
        low = token.lower()
        if token in "\r\n":
            if "(" not in stack:
                break
        elif low in BINDS:
            if not operand:
                return None
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif operand:
            break
        else:
            out.append(low)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def label_of(identifier: str) -> str:
    if identifier.startswith("cc-by"):
        return "-".join(x for x in identifier.split("-") if x.isalpha())
    return FAMILIES.get(re.split(r"[-.+]", identifier)[0], "other")


def evaluate(form: list[str]) -> tuple[bool, set[str]]:
    """Whether the expression permits use, and the labels of its identifiers."""
    stack: list[tuple[bool, set[str]]] = []
    for item in form:
        if item not in BINDS:
            label = label_of(item)
            stack.append((label in PERMITTED, {label}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        stack.append({"or": (a or b, left | right), "and": (a and b, left | right), "with": (a, left)}[item])
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **MORE_PHRASES, TAG: "tag"}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str, found: ahocorasick.Automaton) -> tuple:
    """The fields of ``SCHEMA`` after doc_id."""
    words = text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split(b" ")
    words = [w for w in words if w]
    joined = f" {b' '.join(words).decode('latin-1')} "
    base, labels, places, tags, starts = set(), set(), 0, 0, []
    for last, phrase in found.iter(joined):
        if phrase == TAG:
            tags += 1
        elif phrase in BASE_PHRASES:
            places += 1
            starts.append(last - len(phrase) - 1)
            base.add(BASE_PHRASES[phrase])
        else:
            labels.add(MORE_PHRASES[phrase])
    word_of = lambda at: joined.count(" ", 0, at)
    expressions, permitted = [], None
    if tags:
        spans = [m.span() for m in TAG_AT.finditer(text)]
        # an expression ends where the next tag begins
        for (_, start), end in zip(spans, [*(a for a, _ in spans[1:]), len(text)], strict=True):
            if form := postfix(text, start, end):
                value, names = evaluate(form)
                labels |= names
                expressions.append(" ".join(form))
                permitted = value if permitted is None else permitted and value
    labels |= base
    if permitted is None and labels:
        permitted = labels <= PERMITTED
    score = 1.0 if expressions else min(0.9, 0.6 + 0.1 * places) if places else 0.5 if labels or tags else 0.0
    return (
        len(words), places, word_of(starts[0]) if starts else None, word_of(starts[-1]) if starts else None,
        ",".join(sorted(base)), ",".join(sorted(labels)), score, "; ".join(expressions), permitted,
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, expressions string, permitted boolean"
)
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Labels, places and expressions of every document, as in ``SCHEMA``."""
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            rows = [scan_text(t or "", found) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
