"""Catalog names in texts: one automaton for all names.

An Aho-Corasick automaton over the lower-cased names reads a text once and
reports every occurrence, overlapping ones too; word borders, blanks and dots
around an occurrence then decide what it is.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

# Characters of a word and white space, as in the patterns of P3, P7 and P8.
WORD = frozenset(string.ascii_letters + string.digits + "_")
BLANK = frozenset(" \t\n\x0b\f\r")


def _border(text: str, at: int) -> bool:
    """Whether a word begins or ends in front of position ``at``."""
    before = at > 0 and text[at - 1] in WORD
    behind = at < len(text) and text[at] in WORD
    return before != behind


class References:
    """Occurrences of column names in one SQL text."""

    def __init__(self, text: str, found: Iterator[tuple[int, int, str]]):
        self.text, self.bare, self.dotted = text, set(), {}
        for a, b, name in found:
            if not _border(text, b):
                continue
            if a and (text[a - 1] in BLANK or text[a - 1] in ",("):
                self.bare.add(name)
            i = self._skip(a)
            if i and text[i - 1] == ".":
                self.dotted.setdefault(name, []).append(self._skip(i - 1))

    def _skip(self, i: int) -> int:
        while i and self.text[i - 1] in BLANK:
            i -= 1
        return i

    def _of(self, table: str, ends: Sequence[int]) -> bool:
        return any(self.text.endswith(table, 0, e) and _border(self.text, e - len(table)) for e in ends)

    def count(self, table: str, columns: Sequence[str]) -> int:
        """How many of the columns are named: behind a blank, comma or bracket
        (in the case of the lower-cased text), or behind the table and a dot."""
        table, n = table.lower(), 0
        for c in columns:
            low = c.lower()
            n += (c == low and low in self.bare) or (low in self.dotted and self._of(table, self.dotted[low]))
        return n


class Names:
    """All names of a catalog; an occurrence is reported by the name's number."""

    def __init__(self, names: Sequence[str]):
        import ahocorasick
        self.find = ahocorasick.Automaton()
        numbers: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            if name:
                numbers.setdefault(name.lower(), []).append(i)
        for low, own in numbers.items():
            self.find.add_word(low, (low, own))
        self.any = bool(numbers)
        if self.any:
            self.find.make_automaton()

    def _occurrences(self, text: str) -> Iterator[tuple[int, int, str, list[int]]]:
        if self.any:
            for last, (name, own) in self.find.iter(text):
                yield last + 1 - len(name), last + 1, name, own

    def whole_words(self, text: str) -> set[int]:
        """Numbers of the names that stand in the text with no word character
        on either side."""
        text, out = text.lower(), set()
        for a, b, _, own in self._occurrences(text):
            if not (a and text[a - 1] in WORD) and not (b < len(text) and text[b] in WORD):
                out.update(own)
        return out

    def references(self, sql: str) -> References:
        text = sql.lower()
        return References(text, ((a, b, name) for a, b, name, _ in self._occurrences(text)))


def where_text(upper: str, stops: Sequence[str]) -> str | None:
    """The part of an upper-cased SQL text behind its first WHERE, up to the
    first of the ``stops``; None without WHERE."""
    _, where, part = upper.partition("WHERE")
    if not where:
        return None
    for s in stops:
        part = part.partition(s)[0]
    return part
