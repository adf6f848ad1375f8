"""Licence scan: notice phrases, identifier tags and licence expressions.

One Aho-Corasick automaton over all phrases and tags reads each text's words once. Where a tag
is found, the expression behind it is read by a shunting-yard parser (with binds tighter than and,
and tighter than or) and evaluated against a set of permissive licences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from duefold.llm.common import column, text_slices

#: The phrases every scan looks for, by their words, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: More notices, added to the base.
MORE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
}
#: Words of tags that a licence expression follows.
TAGS = ("spdx license identifier", "license expression")
PERMISSIVE = frozenset(
    ("mit", "mit-0", "apache-2", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd",
     "cc0", "cc0-1.0", "unlicense", "zlib", "bsl-1.0")
)

_NOT_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: A-Z to a-z; every ASCII character that is no letter or digit to a blank.
_WORDS = bytes.maketrans(
    bytes(range(65, 91)) + _NOT_WORD, bytes(range(97, 123)) + b" " * len(_NOT_WORD)
)
_TAGGED = re.compile(
    rb"(?:spdx-license-identifier|license-expression)[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE
)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """Licence expression to postfix order, lower case; None if it is malformed.

    What follows the longest part that could be an expression (a comment's end, say) is ignored.
    """
    output: list[str] = []
    waiting: list[str] = []
    want_licence = True
    depth = 0
    for token in _TOKEN.findall(text):
        word = token.lower()
        if word == "(":
            if not want_licence:
                break
            waiting.append(word)
            depth += 1
        elif word == ")":
            if want_licence or not depth:
                break
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif word in _BINDS:
            if want_licence:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                output.append(waiting.pop())
            waiting.append(word)
            want_licence = True
        elif want_licence:
            output.append(word)
            want_licence = False
        else:
            break
    if want_licence or depth:
        return None
    return output + waiting[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, set[str]]:
    """(whether the expression can be met by allowed licences, the licences it names).

    A licence with an exception is allowed if the licence is; its label names both.
    """
    stack: list[tuple[bool, set[str], str]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append((token in allowed, {token}, token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            name = f"{left[2]} with {right[2]}"
            stack.append((left[0], {name}, name))
        else:
            met = left[0] and right[0] if token == "and" else left[0] or right[0]
            stack.append((met, left[1] | right[1], ""))
    return stack[0][0], stack[0][1]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, str, bool], ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for words, label, base in phrases:
        automaton.add_word(f" {words} ", (len(words) + 2, label, base))
    for words in TAGS:
        automaton.add_word(f" {words} ", (len(words) + 2, None, False))
    automaton.make_automaton()
    return automaton


def scan_text(text: bytes, automaton: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, n_expressions, permissive, score)."""
    words = text.translate(_WORDS).split()
    # One byte, one character: word limits and phrases are ASCII, so nothing is lost.
    line = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    notices = 0
    tagged = False
    for end, (length, label, is_base) in automaton.iter(line):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        notices += 1
        if is_base:
            base.add(label)
            starts.append(end - length + 1)
    met: list[bool] = [label in PERMISSIVE for label in labels]
    expressions = 0
    for behind in _TAGGED.findall(text) if tagged else ():
        postfix = parse_expression(behind.decode("utf-8", "replace"))
        if postfix is not None:
            holds, named = evaluate(postfix)
            labels |= named
            met.append(holds)
            expressions += 1
    first = last = None
    if starts:
        first, last = line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))
    return (
        len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
        expressions, all(met) if met else None, 1 - 0.5 ** (notices + 2 * expressions),
    )


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
          "n_expressions", "permissive", "score"]
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.bool_(), pa.float64()]
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, n_expressions long, permissive boolean, score double"
)


def _scanned(phrases: tuple[tuple[str, str, bool], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(phrases)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                columns = zip(*(scan_text(text, automaton) for text in texts))
                found = [pa.array(c, t) for c, t in zip(columns, _TYPES[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *found], _NAMES
                )

    return run


def scan_licenses(
    docs: DataFrame,
    more_phrases: Mapping[str, str] = MORE_PHRASES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``.

    n_words, n_base, first_word, last_word and base_labels are about the base phrases; labels adds those
    of the other notices and of well-formed expressions. permissive is whether every notice and expression can
    be met by a permissive licence, null without any. score is 1 - 2^-(notices + 2 expressions).

    Null and empty texts have no words and score 0. A malformed expression adds nothing. Overlapping
    phrases all count. Repeated rows and null ids are scanned like any other. An empty table
    returns no rows. Other columns are ignored.
    """
    phrases = tuple((w, label, True) for w, label in BASE_PHRASES.items()) + tuple(
        (w, label, False) for w, label in more_phrases.items() if w not in BASE_PHRASES
    )
    rows = docs.select(
        column(id_column).cast("long").alias("doc_id"), column(text_column).alias("text")
    )
    return rows.mapInArrow(_scanned(phrases), _SCHEMA).withColumnRenamed("doc_id", id_column)
