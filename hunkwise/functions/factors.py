"""Literal factors of patterns: words of which every match holds at least one, and an index of them for long rule lists.

A text is cut into the grams of three word characters that it holds. A table, built from the patterns alone, leads from
a gram to the factors with that gram, a factor's presence to the patterns that need it, and only those patterns are tried. All
of it is one expression of built-in functions over the row's own text: nothing is joined or shuffled, and the
tables are literals whose size is that of the rule list.

Texts and factors are compared folded: ASCII letters in lower case, and the four other characters that Unicode case
rules equate with ASCII letters likewise, so that case-insensitive patterns lose no match. A construct that ``factors`` does
not know makes it answer None, and the pattern is tried on every text.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZİıKſ", "abcdefghijklmnopqrstuvwxyziiks"
_FOLD = str.maketrans(_FROM, _TO)
_WORDS = re.compile(r"[a-z0-9_]+")
_REPEAT = re.compile(r"(?:([*?+])|\{([0-9]+)(,[0-9]*)?\})[?+]?")
_FLAGS = re.compile(r"\?[imsduU-]*([:)])")
_GROUP_NAME = re.compile(r"\?<[A-Za-z][A-Za-z0-9]*>")
_CLASS_ESCAPES, _CONTROL_ESCAPES = "dDwWsShHvVbBAzZGR", "tnrfae"


class _Unknown(Exception):
    """A construct outside the grammar that is read here."""


class _Reader:
    """Reads a pattern once, from left to right; each level answers the best any-of set of its own."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def alternatives(self) -> frozenset | None:
        sets = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            sets.append(self.sequence())
        return None if None in sets else frozenset().union(*sets)

    def sequence(self) -> frozenset | None:
        found, run = [], ""

        def end_run():
            nonlocal run
            found.extend(frozenset([w]) for w in _WORDS.findall(run.translate(_FOLD)) if len(w) >= GRAM)
            run = ""

        while self.peek() not in ("", "|", ")"):
            char, inner = self.atom()
            least, once = self.repeat()
            if char is None or least == 0:
                end_run()
                if inner and least:
                    found.append(inner)
                continue
            run += char
            if not once:
                end_run()
        end_run()
        return max(found, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=None)

    def atom(self) -> tuple[str | None, frozenset | None]:
        """A literal character, or the any-of set of a group; neither for anything else."""
        char = self.peek()
        self.at += 1
        if char == "(":
            return None, self.group()
        if char == "[":
            self.char_class()
            return None, None
        if char == "\\":
            return self.escape(), None
        if char in "*+?{":
            raise _Unknown(char)
        return (None if char in ".^$" else char), None

    def group(self) -> frozenset | None:
        counts = True
        if self.peek() == "?":
            flags, name = _FLAGS.match(self.text, self.at), _GROUP_NAME.match(self.text, self.at)
            if flags:
                self.at = flags.end()
                if flags[1] == ")":
                    return None
            elif name:
                self.at = name.end()
            elif self.peek(2) == "?>":
                self.at += 2
            elif self.peek(2) in ("?=", "?!") or self.peek(3) in ("?<=", "?<!"):
                self.at += 3 if self.peek(2) == "?<" else 2
                counts = False  # what is looked at need not be part of the match, or must be absent
            else:
                raise _Unknown(self.peek(3))
        inner = self.alternatives()
        if self.peek() != ")":
            raise _Unknown("(")
        self.at += 1
        return inner if counts else None

    def char_class(self) -> None:
        self.at += self.peek() == "^"
        if self.peek() == "]":
            raise _Unknown("[]")
        while self.peek() != "]":
            char = self.peek()
            self.at += 1
            if char == "":
                raise _Unknown("[")
            if char == "[":
                self.char_class()
            elif char == "\\":
                self.escape()
        self.at += 1

    def escape(self) -> str | None:
        char = self.peek()
        self.at += 1
        if char in ("p", "P") and self.peek() == "{" and "}" in self.text[self.at :]:
            self.at = self.text.index("}", self.at) + 1
            return None
        if char and char in _CLASS_ESCAPES + _CONTROL_ESCAPES:
            return None
        if char == "" or char.isalnum():
            raise _Unknown("\\" + char)
        return char

    def repeat(self) -> tuple[int, bool]:
        """(least count, whether exactly once) of the atom before."""
        found = _REPEAT.match(self.text, self.at)
        if not found:
            return 1, True
        self.at = found.end()
        if found[1]:
            return int(found[1] == "+"), False
        return int(found[2]), found[2] == "1" and not found[3]


def factors(pattern: str) -> list[str] | None:
    """Folded words of which each match of ``pattern`` holds at least one; None if no such words of three characters are known."""
    reader = _Reader(pattern)
    try:
        found = reader.alternatives()
    except _Unknown:
        return None
    return sorted(found) if found and reader.at == len(pattern) else None


def folded(text: Column) -> Column:
    return F.translate(text, _FROM, _TO)


def _bucket(gram: str, size: int) -> int:
    return zlib.crc32(gram.encode()) % size


def _literal(value: list, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def indexed_hits(text: Column, patterns: dict[int, str], needed: dict[int, list[str]]) -> Column:
    """The numbers of the ``patterns`` that match the text, ascending; ``needed`` has the factors of each. A null text has no hit."""
    words = sorted({w for ws in needed.values() for w in ws})
    size = 1 << max(8, (8 * len(words)).bit_length())
    by_gram: list[list[int]] = [[] for _ in range(size)]
    for i, word in enumerate(words):  # of a word's grams, the one that leads to the fewest words so far
        grams = {_bucket(word[k : k + GRAM], size) for k in range(len(word) - GRAM + 1)}
        by_gram[min(grams, key=lambda b: (len(by_gram[b]), b))].append(i)
    numbers = sorted(patterns)
    place = {no: i for i, no in enumerate(numbers)}
    of_word: dict[str, list[int]] = {w: [] for w in words}
    for no in numbers:
        for word in needed[no]:
            of_word[word].append(place[no])
    word_table, gram_table = _literal(words, "array<string>"), _literal(by_gram, "array<array<int>>")
    rule_table = _literal([of_word[w] for w in words], "array<array<int>>")
    pattern_table, number_table = _literal([patterns[no] for no in numbers], "array<string>"), _literal(numbers, "array<int>")

    def found(low: Column) -> Column:
        grams = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?=([a-z0-9_]{{{GRAM}}}))"), F.lit(1)))
        near = F.flatten(F.transform(grams, lambda g: F.get(gram_table, (F.crc32(g.cast("binary")) % size).cast("int"))))
        held = F.filter(F.array_distinct(near), lambda w: low.contains(F.get(word_table, w)))
        tried = F.array_sort(F.array_distinct(F.flatten(F.transform(held, lambda w: F.get(rule_table, w)))))
        return F.transform(F.filter(tried, lambda r: F.rlike(text, F.get(pattern_table, r))), lambda r: F.get(number_table, r))

    return F.coalesce(_let(folded(text), found), F.array().cast("array<int>"))
